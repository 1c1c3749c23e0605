"""Literal cases for parsers and rules that SQL does not express."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import models as M
from pagewright.functions import text as X
from pagewright.operators import bm25 as B
from pagewright.operators import chunking as K
from pagewright.operators import evaluate as E
from pagewright.operators import frontmatter as FM
from pagewright.operators import lint as L
from pagewright.operators import rank as R
from pagewright.operators import vectors as V
from pagewright.sources import corpus as S
from pagewright.sources import sinks
from pagewright.streaming import incremental


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, ["The user's well-formed É x 10_a, 世界!", None], X.tokens) == [["user's", "well-formed", "10_a", "世界"], None]


def test_struck_and_code(spark):
    assert values(spark, ["a ~~old~~ b", "a ~~x\n\ny~~ b", "~~ no~~"], X.strip_struck) == ["a   b", "a ~~x\n\ny~~ b", "~~ no~~"]
    got = values(spark, ["see `[[a]]` and [[b]]", "  ```\n[[c]]\n  ```\n[[d]]", "``x ` [[e]]`` [[f]]"], X.strip_code)
    assert ["[[a]]" in got[0], "[[b]]" in got[0], "[[c]]" in got[1], "[[d]]" in got[1], "[[e]]" in got[2], "[[f]]" in got[2]] == [False, True, False, True, False, True]


def test_front_map_and_block(spark):
    raw = "---\nname: a\nname: 'b'\n  x: y\nurl: http://h:1/z\n---\nbody"
    assert values(spark, [raw, "no fence"], X.front_map) == [{"name": "b", "url": "http://h:1/z"}, {}]
    assert values(spark, [raw, "---\na: 1\n---"], X.front_block) == ["name: a\nname: 'b'\n  x: y\nurl: http://h:1/z", ""]


def test_query_text_and_norms(spark):
    assert values(spark, ["dell-archivio e l-indice", "x" * 700], X.query_text) == ["dell archivio e l indice", "x" * 600]
    assert values(spark, ["> **Bold**  `code`\n> next"], X.quote_norm) == ["bold code next"]
    assert values(spark, ["x\n## Head one\n# two"], X.first_heading) == ["Head one"]


@pytest.mark.parametrize("prompt, want", [("", True), ("/cmd do this now", True), ("ok", True), ("Va bene!", True), ("two words", True), ("<system-reminder> a b c d e", True), ("please explain the plan", False), (None, True)])
def test_trivial(spark, prompt, want):
    assert values(spark, [prompt], E.trivial) == [want]


def test_chunks_cover_and_overlap():
    r = random.Random(1)
    for _ in range(60):
        paragraphs = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) + r.choice(["", "", "."]) for _ in range(r.randint(1, 120))) for _ in range(r.randint(0, 12))]
        body = "\n\n".join(paragraphs)
        chunks = K.chunk(body, 300, 60)
        assert bool(chunks) == bool(body.strip())
        for p in paragraphs:
            if len(p) <= 600:
                assert any(p.strip() in c for c in chunks)
        for a, b in zip(chunks[:-1], chunks[1:], strict=True):
            assert b.startswith(K.overlap_tail(a, 60))


def test_chunk_edges():
    assert K.chunk("  \n\n ") == [] and K.chunk("one") == ["one"]
    assert K.chunk("x" * 2000) == ["x" * 2000]  # a remainder that is overlap only is no chunk
    assert [len(c) for c in K.cut_long("\n".join(["y" * 99] * 50), 1000)] == [999] * 5
    assert K.cut_long("z" * 9000, 1000) == ["z" * 9000]
    assert K.overlap_tail("a" * 190 + ". " + "word " * 30, 200).startswith("word ")


def test_context_prefix(spark):
    df = spark.createDataFrame([("T", "First one.  Second.", "archived", "[[a]] and [[b|B]]"), ("U", "No end", "active", None)], "t string, b string, s string, r string")
    got = [r.p for r in df.select(K.context_prefix(F.col("t"), F.col("b"), F.col("s"), F.col("r")).alias("p")).collect()]
    assert got == ['This passage is from the wiki page "T". The page opens: First one. Page status: archived. Replaced by: a, b.', 'This passage is from the wiki page "U". The page opens: No end']


def test_ingest_is_idempotent(spark):
    pages = spark.createDataFrame([("wiki/a.md", "x\n\ny" * 900)], "page_path string, body string")
    rows = K.chunk_pages(pages).select(F.lit("c-1").alias("page_address"), "chunk_index", F.sha2("raw_text", 256).alias("body_hash"), F.lit("h").alias("page_body_hash"), F.lit(2).alias("prefix_scheme"), "page_path")
    assert {r.action for r in K.upsert_plan(rows, rows).collect()} == {"skip"}
    assert {r.action for r in K.upsert_plan(rows, rows.withColumn("prefix_scheme", F.lit(None).cast("int"))).collect()} == {"write"}
    assert {r.action for r in K.upsert_plan(rows.filter("chunk_index = 0"), rows).collect()} == {"skip", "prune"}


def test_catalog_fields_and_relations():
    raw = "---\ntitle: 'A b'\nnote: >-\n  one\n  two\nempty:\n# c: d\n---\nx"
    assert FM.catalog_fields(raw) == {"title": "A b", "note": "one two", "empty": ""}
    rel = "---\nname: e\nrelations:\n  hosted_on: \"[[b|B]]\"  # [[no]]\n  part_of:\n    - \"[[c#x]]\"\n    - '[[d]]'\n  depends_on: [\"[[e]]\", \"[[wiki/f]]\"]\nreplaced_by: [[g]]\n---\n"
    assert FM.relations(rel) == {"hosted_on": ["b"], "part_of": ["c", "d"], "depends_on": ["e", "wiki/f"], "replaced_by": ["g"]}
    assert FM.relations("none") == {}
    marks = "---\nrelations:\n  a: '[[x]] # [[y]]' # [[no]]\n  # [[no]]\n  b: [[p#s]] # [[no]]\n    c: [[deep]]\n  d:\nother:\n  e: [[no]]\n---"
    assert FM.relations(marks) == {"a": ["x", "y"], "b": ["p", "deep"]}


@pytest.mark.parametrize(
    "raw, kinds",
    [
        ("body", ["no_frontmatter"]), ("---\na: [x\n---\n", ["yaml_error"]), ("---\na: 1\na: 2\n---\n", ["duplicate_key"]), ("---\n- a\n---\n", ["not_mapping"]), ("---\n---\n", ["no_frontmatter"]),
        ("---\na: b # c\n---\n", ["value_mismatch"]), ("---\ntags: x\n---\n", ["bad_shape"]), ("---\nrelations: [a]\n---\n", ["bad_shape"]), ("---\r\na: true\r\nd: 2024-01-01\r\n---", []), ("---\nx: {p: 1, p: 2}\n---\n", ["duplicate_key"]),
    ],
)
def test_yaml_disagreements(raw, kinds):
    assert [k for k, _, _ in FM.yaml_disagreements(raw)] == kinds


def test_prepend_keys():
    assert FM.prepend_keys("---\na: 1\n---\nx", {"type": "entity"}) == "---\ntype: entity\na: 1\n---\nx"
    assert FM.prepend_keys("x", {"name": "A: b"}) == '---\nname: "A: b"\n---\nx'
    assert FM.prepend_keys("---\na: [1\n---\nx", {"type": "entity"}) == "---\na: [1\n---\nx"


def test_links(spark):
    pages = spark.createDataFrame([("wiki/a.md", "---\nx: [[front]]\n---\n[[b]] [[c\\|C]] `[[code]]` [[d#s]]"), ("wiki/b.md", "[[wiki/a]] [[b]]"), ("wiki/log.md", "x")], "page_path string, raw string")
    links = L.wikilinks(pages)
    assert sorted((r.src, r.target) for r in links.collect()) == [("wiki/a.md", "b"), ("wiki/a.md", "c"), ("wiki/a.md", "d"), ("wiki/b.md", "b"), ("wiki/b.md", "wiki/a")]
    base = L.base_targets(spark.createDataFrame([("wiki/d.base",)], "path string"))
    assert [r.target for r in L.dead_links(links, L.link_targets(pages, base)).collect()] == ["c"]
    assert L.orphans(pages, links).collect() == []


def test_prior_cap_and_slots(spark):
    rows = spark.createDataFrame([(1, "a", "wiki/folds/x", 1.00, 1), (1, "b", "wiki/y", 0.96, 2), (1, "c", "wiki/y", -0.1, 3), (1, "d", "wiki/y", 0.9, 4), (1, "e", "wiki/z", 0.1, 5)], "query_id int, chunk_id string, page_path string, score double, ord int")
    prior = rows.withColumn("score", R.history_prior(F.col("score"), F.col("page_path")))
    assert [r.chunk_id for r in R.cap_and_cut(prior, top=4).orderBy("rank").collect()] == ["b", "a", "d", "e"]
    assert [r.chunk_id for r in R.cap_and_cut(prior, top=9, cap=0).orderBy("rank").collect()] == ["b", "a", "d", "e", "c"]
    twice = spark.createDataFrame([(1, "k", 0.5, 1), (1, "k", 0.5, 2), (1, "k", 0.4, 0)], "query_id int, chunk_id string, score double, ord int")
    assert [r.ord for r in R.dedupe(twice, "chunk_id").collect()] == [1]
    slots = spark.createDataFrame([(1, c, s, ce, False) for c, s, ce in (("a", 3.0, 0.0), ("b", 2.0, 9.0), ("c", 1.0, 5.0))] + [(1, "m", 9.0, 9.0, True)], "query_id int, chunk_id string, score double, ce double, missing boolean")
    only = {r.chunk_id: r.new_score for r in R.reassign_slots(slots, top=3, mode="only").collect()}
    assert only == {"b": 3.0, "c": 2.0, "a": 1.0, "m": 9.0}


def test_bm25_is_a_sum_over_terms(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "alpha alpha gamma", "delta", "", "beta gamma delta alpha"])], "chunk_id int, text string")
    ask = lambda q: {(r.chunk_id): r.score for r in B.search(spark.createDataFrame([(1, q)], "query_id int, q string"), chunks, 9).collect()}
    both, a, b = ask("alpha gamma alpha"), ask("alpha"), ask("gamma")
    assert both.keys() == a.keys() | b.keys() and all(abs(both[k] - 2 * a.get(k, 0) - b.get(k, 0)) < 1e-9 for k in both)
    assert ask("the of unknownword") == {}


def test_blocked_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    items = [(i, [r.gauss(0, 1) for _ in range(5)] if i != 7 else [0.0] * 5) for i in range(60)]
    df = spark.createDataFrame(items, "item_id long, vector array<double>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / ((sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 or 1)
    want = {(a, b) for a, x in items for b, y in items if a < b and cos(x, y) >= 0.3 and 7 not in (a, b)}
    for block in (1000, 13):
        assert {(p.a, p.b) for p in V.similar_pairs(df, 0.3, block).collect()} == want
    assert V.similar_pairs(df.limit(0), 0.3).count() == 0 and V.nearest(df.limit(0).withColumnRenamed("item_id", "query_id"), df, 3).count() == 0


def test_embedder_fills_the_cache_once(spark):
    chunks = spark.createDataFrame([("h1", "a b"), ("h1", "a b"), ("h2", "c"), ("h3", "bad")], "input_hash string, text string")
    cache = spark.createDataFrame([("hash", "v6", "h2", [0.0])], "model string, scheme string, input_hash string, vector array<double>")

    class Fails(M.HashEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return super().embed(texts)

    got = M.embed_missing(chunks, cache, Fails(8), "v6").collect()
    assert [r.input_hash for r in got] == ["h1"] and len(got[0].vector) == 8
    assert M.pick_backend(M.HashEmbedder(4)).size == 4


def test_endpoints():
    at = lambda *ips: lambda host, port: [(0, 0, 0, "", (ip, 0)) for ip in ips]

    def lost(host, port):
        raise OSError

    assert M.endpoint_allowed("http://h:1/", resolve=at("127.0.0.1", "10.1.2.3")) and not M.endpoint_allowed("http://h/", resolve=at("10.0.0.1", "8.8.8.8"))
    assert not M.endpoint_allowed("http://h/", resolve=lost) and M.endpoint_allowed("http://h/", public=True)


def test_readers_and_sinks(spark, tmp_path):
    root = tmp_path / "v"
    for name, data in {"wiki/a.md": b"x\xffy", "wiki/log.md": b"l", ".git/b.md": b"g", "wiki/off.md": b"---\nindex: No\n---\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert [(r.page_path, r.raw) for r in S.read_pages(spark, str(root)).collect()] == [("wiki/a.md", "x�y")]
    assert S.read_pages(spark, str(root), bypass_exclusions=True).count() == 3  # Spark itself never lists dot folders
    (tmp_path / "l.jsonl").write_text('{"title": "a"}\n\nbroken\n{"title": "b"}\n')
    assert S.read_ledger(spark, str(tmp_path / "l.jsonl"), "title string").count() == 2
    (tmp_path / "g.json").write_text('[{"q": "x", "gold": ["a"]}]')
    assert S.read_gold(spark, str(tmp_path / "g.json"), "q string, gold array<string>").first().gold == ["a"]
    sinks.append_log(spark.createDataFrame([("secret", "skip")], "prompt string, action string"), str(tmp_path / "log"))
    assert "prompt" not in spark.read.json(str(tmp_path / "log")).columns
    assert spark.read.parquet(sinks.write_version(spark.range(3), str(tmp_path / "t"), "1")).count() == 3


def test_streaming(spark, tmp_path):
    pages = spark.createDataFrame([("a.md", "one\n\ntwo"), ("b.md", "three")], "page_path string, body string")
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    job = incremental.stream_chunks(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_constants():
    known = [p for pair in C.INVERSE_PAIRS for p in pair] + list(C.INVERSE_FREE)
    assert len(known) == 21 and "the" in C.STOPWORDS and "già" in C.STOPWORDS


def test_dense_fill(spark):
    angle = lambda t: [math.cos(t), math.sin(t)]
    items = [spark.createDataFrame([(i, f"h{i}", angle(sign * i / 10)) for i in range(10)], "item_id long, input_hash string, vector array<double>") for sign in (1, -1)]
    queries = spark.createDataFrame([(q, angle(0.0)) for q in range(4)] + [(4, angle(0.9))], "query_id int, vector array<double>")
    live = spark.createDataFrame([(i, "new" if i == 3 else f"h{i}") for i in range(9)], "chunk_id long, input_hash string")
    hits = [(0, 1), (0, 90)] + [(1, i) for i in range(4)] + [(2, i) for i in range(5)] + [(4, 8), (4, 5), (4, 0)]
    pool = spark.createDataFrame(hits, "query_id int, chunk_id long")
    got = {q: [] for q in range(5)}
    for r in sorted(R.dense_fill(pool, [(queries, i) for i in items], live, 4).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.chunk_id))
    # query 1 is full, 2 more than full, 3 without hits; chunk 3 is stale and 9 gone; the second model has other places for query 4
    assert got == {0: [(1, 0), (2, 2)], 1: [], 2: [], 3: [], 4: [(1, 7)]}
    two = R.dense_fill(pool.filter("chunk_id = 8"), [(queries, i) for i in items], live, 4)
    assert [r.chunk_id for r in two.orderBy("rank").collect()] == [7, 0, 6]


def test_percentiles_over_many_partitions(spark):
    """Exact elements, whatever the ranges: counting and picking read the same saved rows."""
    from pagewright.plans.search import percentile_cuts

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        values = spark.range(0, 50_000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double").alias("v"))
        want = sorted(r.v for r in values.collect())
        assert percentile_cuts(values, "v", [0, 10, 50, 90, 100]) == [want[int(p / 100 * (len(want) - 1))] for p in (0, 10, 50, 90, 100)]
        assert percentile_cuts(values.limit(0), "v", [50]) == [None]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])


@pytest.mark.parametrize("focus", [None, 3])
def test_matching_is_the_greedy_walk(spark, focus):
    import hashlib

    from pagewright.plans.search import disjoint_pairs

    r = random.Random(8)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(200)})
    pairs = [p for p in pairs if focus is None or focus in p]
    used, want = set(), []
    for a, b in sorted(pairs, key=lambda p: hashlib.md5(f"0-{p[0]}-{p[1]}".encode()).hexdigest()):
        if (a in used and a != focus) or (b in used and b != focus):
            continue
        used |= {a, b}
        want.append((a, b))
    got = disjoint_pairs(spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "a long, b long, cosine double"), 9, focus=focus).collect()
    assert sorted((x.a, x.b) for x in got) == sorted(want[:9])


@pytest.mark.parametrize("focus", [None, 7, 1000])
@pytest.mark.parametrize("block", [9, 2_000])
def test_band_of_pairs_is_exact(spark, focus, block):
    """Copies, a zero vector and missing ones (last, as in SQL), pairs left out either way and with strangers, blocks of all sizes."""
    r = random.Random(5)
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    vectors += [(100 + i, vectors[i % 3][1]) for i in range(12)] + [(200, [0.0] * 4), (201, None), (202, None)]
    r.shuffle(vectors)
    ids = sorted(i for i, _ in vectors)
    skip = {tuple(sorted(r.sample(ids, 2))) for _ in range(120)}
    at = dict(vectors)

    def cosine(a, b):  # the last two sort last
        x, y = at[a], at[b]
        if x is None or y is None:
            return 9.0
        n = math.dist(x, [0] * 4) * math.dist(y, [0] * 4)
        return round(sum(p * q for p, q in zip(x, y)) / n, 9) if n else 8.0

    all_pairs = {(a, b): cosine(a, b) for a in ids for b in ids if a < b and (a, b) not in skip and (focus is None or focus in (a, b))}
    cs = sorted(all_pairs.values())
    df = spark.createDataFrame(vectors, "item_id long, vector array<double>").repartition(5)
    left_out = spark.createDataFrame([*skip, (1, 999), (-5, 3), (None, 4)], "a long, b long")
    for lo, hi in ((50, 90), (0, 94), (0, 100), (20, 20)):
        low, high = (cs[int(p / 100 * (len(cs) - 1))] if cs else 9.0 for p in (lo, hi))
        want = sorted((*k, None if c == 8 else c) for k, c in all_pairs.items() if low <= c <= high and high != 9)
        got = V.pair_band(df, left_out, lo, hi, focus, block).collect()
        assert sorted((x.a, x.b, None if math.isnan(x.cosine) else round(x.cosine, 9)) for x in got) == want


@pytest.mark.parametrize("name", ["seed_pair_band", "seed_pair_matching"])
def test_seed_pairs_are_not_saved(spark, name):
    """What goes to disk grows with the pages, not with their pairs."""
    import os

    from pagewright.plans import catalogue

    base = spark.conf.get("spark.checkpoint.dir")
    folder = base.removeprefix("file://")
    old = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    saved = [spark.read.parquet(f"{base}/{x}").count() for x in set(os.listdir(folder)) - old]
    assert saved and sum(saved) <= 500  # vectors; there are about 64,000 pairs


@pytest.mark.parametrize("focus", [None, 3])
def test_matching_in_several_turns(spark, focus, monkeypatch):
    import hashlib

    from pagewright.plans import search

    r = random.Random(9)
    pairs = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(150)} | {(3, x) for x in range(4, 20)})
    used, want = set(), []
    for a, b in sorted(pairs, key=lambda p: hashlib.md5(f"0-{p[0]}-{p[1]}".encode()).hexdigest()):
        if not {a, b} & used:
            want.append((a, b))
            used |= {a, b} - {focus}
    pool = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "a long, b long, cosine double")
    for drawn in (1, 4):
        monkeypatch.setattr(search, "DRAWN", drawn)
        for n in (0, 3, 100):
            assert [(x.a, x.b) for x in search.disjoint_pairs(pool, n, focus=focus).collect()] == want[:n]


def test_fused_scores_cancel_as_in_sql(spark):
    """Two vectors in a pool have opposite z-scores; whether they cancel to 0 or leave a residue decides the compact score. Rows come in any order."""
    import duckdb

    r = random.Random(3)
    pools = [(q, q * 100 + k, k, r.uniform(-0.4, 0.4), r.uniform(-0.4, 0.4)) for q in range(300) for k in range(2)]
    duck = duckdb.connect(config={"threads": 1})
    duck.execute("create table c (q bigint, c bigint, ord bigint, a double, b double)")
    duck.executemany("insert into c values (?, ?, ?, ?, ?)", pools)
    z = lambda v: f"({v} - avg({v}) OVER w) / coalesce(nullif(stddev_pop({v}) OVER w, 0), 1)"
    want = duck.execute(f"SELECT q, c, ({z('a')} + {z('b')}) / 2 FROM c WINDOW w AS (PARTITION BY q)").fetchall()
    rows = [(q, c, o, m, x) for q, c, o, a, b in pools for m, x in (("a", a), ("b", b))]
    r.shuffle(rows)
    cosines = spark.createDataFrame(rows, "query_id long, chunk_id long, ord long, model string, cosine double")
    got = R.fuse(cosines.select("query_id", "chunk_id", "ord").distinct(), cosines).collect()
    assert len(want) == 600 and {(x.query_id, x.chunk_id, x.rerank_score) for x in got} == set(want)
    assert 0 < sum(x.rerank_score == 0 for x in got) < sum(abs(x.rerank_score) < 1e-9 for x in got)


def test_index_is_stored_or_missing(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "apple pear"), (2, "apple apple plum"), (3, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "plum apple"), (2, "nothing")], "query_id long, q string")
    with pytest.raises(B.IndexMissing):
        B.read_index(spark, str(tmp_path / "none"))
    index = B.read_index(spark, B.write_index(chunks, str(tmp_path / "index")))
    rows = lambda df: sorted((x.query_id, x.chunk_id, round(x.score, 9), x.rank) for x in df.collect())
    assert rows(B.search_index(asked, index, 5)) == rows(B.search(asked, chunks, 5)) and len(rows(B.search(asked, chunks, 5))) == 2


def test_matches_by_join_equal_literals(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(9))) for i in range(30)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "w3 w4 w4 w16"), (2, "w0 w9")], "query_id long, q string")
    rows = lambda: sorted((x.query_id, x.chunk_id, round(x.score, 9), x.rank) for x in B.search(asked, chunks, 7).collect())
    want = rows()
    monkeypatch.setattr(B, "LITERAL_TERMS", 2)
    assert rows() == want and want


def test_index_flag_counts_in_the_frontmatter_only(spark):
    assert values(spark, ["---\nindex: off\n---\nx", "---\na: 1\n---\nindex: off\n", "index: off", None], X.indexed) == [False, True, True, True]


def test_prefix_of_struck_and_untitled_pages(spark):
    df = spark.createDataFrame([("", "Opens: Old ~~struck~~ text  line. Two.", " Archived ", None)], "t string, b string, s string, r string")
    assert [r.p for r in df.select(K.context_prefix(F.col("t"), F.col("b"), F.col("s"), F.col("r")).alias("p")).collect()] == ['This passage is from the wiki page "(untitled)". The page opens: Opens: Old   text  line. Page status: archived.']


def test_packed_paragraphs():
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 80, "", "d" * 10])
    assert K.packed_paragraphs(text, 62) == ["a" * 30 + "\n\n" + "b" * 30, "c" * 80, "d" * 10]
    assert K.packed_paragraphs("short", 62) == ["short"] and K.packed_paragraphs("\n" * 98, 62) == ["\n" * 62] and K.packed_paragraphs("\n" * 99, 62) == ["\n"]
