"""Literal cases of scopes, records, the log, sections, model families and settings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import models as M
from pagewright.operators import chunking as K
from pagewright.operators import evaluate as E
from pagewright.operators import scan as N
from pagewright.operators import vectors as V
from pagewright.plans.upkeep import maintenance_round
from pagewright.sources import corpus as S
from pagewright.sources import sinks


def test_scopes(spark):
    p = spark.createDataFrame([(x,) for x in ("wiki/a.md", "wiki/e/b.md", "wiki/e/f/c.md", "wiki/.x/d.md", "wiki/.lint/r.md", "wiki/e/_index.md")], "page_path string")
    got = {r.page_path: r.section for r in N.catalog_scope(p).collect()}
    assert got == {"wiki/a.md": "(root)", "wiki/e/b.md": "e", "wiki/e/f/c.md": "e/f"}
    assert [r.page_path for r in N.catalog_scope(p, ["/e/"]).collect()] == ["wiki/e/b.md"]
    assert N.lint_scope(p).count() == 5 and N.catalog_scope(p.limit(0)).count() == 0
    asked = spark.createDataFrame([("wiki/a.md",), ("no.md",), ("no.md",)], "page_path string")
    assert {(r.page_path, r.found) for r in N.listed(p, asked).collect()} == {("wiki/a.md", True), ("no.md", False)}


def test_records(spark):
    rows = [("b", '{"page_address": "x", "chunk_index": 1, "raw_text": "r", "contextualized_text": ""}'), ("a", '{"page_address": "x", "chunk_index": 0}'), ("c", "{"), ("d", '{"page_address": "x"}'), ("e", None)]
    got = N.chunk_scan(spark.createDataFrame(rows, "path string, content string")).collect()
    assert [(r.chunk_id, r.text) for r in got] == [("x:0", ""), ("x:1", "r")]
    payloads = spark.createDataFrame([(x,) for x in ("[]", '{"chunk_id": "a"}', "[{", None, '[{"chunk_id": "a", "score": 1}]')], "payload string")
    assert [r.status for r in N.candidate_lists(payloads).collect()] == ["ok", "malformed", "malformed", "malformed", "ok"]


def test_stored_vectors(spark):
    cache = spark.createDataFrame([(1, "m", "v7", "t"), (1, "n", "v6", "t"), (1, None, None, None)], "version int, model string, scheme string, tag string")
    assert N.live_vectors(cache, "m").count() == 1 and N.live_vectors(cache.limit(0), "m").count() == 0
    assert tuple(N.prune_counts(cache, "v7", "t").first()) == (1, 2)
    for bad in (2, None):
        with pytest.raises(ValueError):
            N.live_vectors(cache.withColumn("version", F.lit(bad).cast("int")), "m")


def test_log(spark):
    text = ["- 2024-05-02 · save · **T: a** — see [[p|x]] and `a/b.md`, `no`", "- 2024-05-01 · **U**", "# log", "- 2024-05-01 · **U** — again", "-2024-05-01 · **V**", None]
    lines = spark.createDataFrame(list(enumerate(text)), "line int, text string")
    got = E.log_entries(lines).orderBy("line").collect()
    assert [(r.line, r.entry_date, r.category, r.title, r.body, r.links, r.paths) for r in got] == [
        (0, "2024-05-02", "save", "T: a", "see [[p|x]] and `a/b.md`, `no`", ["p"], ["a/b.md"]), (1, "2024-05-01", None, "U", "", [], []), (3, "2024-05-01", None, "U", "again", [], []),
    ]
    entries = E.log_entries(lines)
    assert [r.line for r in E.oldest_unfolded(entries, entries.limit(0), 1).collect()] == [3, 1]
    assert [r.line for r in E.oldest_unfolded(entries, entries.filter("line = 1"), 1).collect()] == [0]


def test_sections_and_costs(spark):
    chunks = spark.createDataFrame([("p", 0, 0, "a"), ("p", 1, 10, "b"), ("p", 2, 20, "## Own\nc"), ("p", 3, 30, "d"), ("q", 0, 0, "x")], "page string, chunk_index int, pos int, raw_text string")
    heads = spark.createDataFrame([("p", 12, "## B"), ("p", 33, "## Late")], "page string, start int, heading string")
    got = E.sections(chunks, heads)
    assert [r.section for r in got.orderBy("page", "chunk_index").collect()] == [None, "## B", "## Own", "## B", None]
    marked = got.withColumns({"returned": F.expr("page = 'p' and chunk_index = 1"), "answer": F.expr("page = 'p' and chunk_index in (0, 3)")})
    assert [tuple(r) for r in E.window_costs(marked).collect()] == [("p", 1, True, 1)]
    assert [tuple(r) for r in E.window_costs(marked.withColumn("answer", F.lit(False))).collect()] == [("p", None, None, 1)]


def test_passages(spark):
    rows = spark.createDataFrame([("p", 0, "a" * 10), ("p", 1, "b" * 6), ("p", 2, "c" * 10), ("p", 4, "z ~~old~~ z")], "page string, chunk_index int, raw_text string")
    n = K.neighbours(rows)
    of = lambda cap: [r.t for r in n.orderBy("chunk_index").select(K.capped_passage(F.col("raw_text"), F.col("passage"), cap).alias("t")).collect()]
    assert of(100) == ["a" * 10 + "\n" + "b" * 6, "a" * 10 + "\n" + "b" * 6 + "\n" + "c" * 10, "b" * 6 + "\n" + "c" * 10, "z   z"]
    assert of(10)[1] == "a\n" + "b" * 6 + "\n" + "c" and of(4)[1] == "bbbb"


def test_sweep_and_runs(spark):
    sweep = spark.createDataFrame([("mean", 0, 0.5, 0.5), ("first", 3, 0.5, 0.5), ("first", 4, 0.5, 0.5), ("second", 0, 0.1, 0.9)], "feature string, step int, precision_ double, recall_ double")
    assert tuple(E.best_of_sweep(sweep).first())[:2] == ("first", 3)
    run = "query_id int, rank int, labels string"
    d = E.run_diff(spark.createDataFrame([(1, 1, "C"), (2, None, None), (3, 1, "C")], run), spark.createDataFrame([(1, 1, "S"), (2, None, None), (4, 1, "C")], run))
    assert {r.query_id: r.state for r in d.collect()} == {1: "changed", 2: "same", 3: "new", 4: "gone"}


def test_ties_of_nearest(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "item_id long, vector array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, vector array<double>")
    for last, want in ((False, [0, 1]), (True, [4, 3])):
        assert [r.item_id for r in V.nearest(q, items, 2, last_first=last).orderBy("place").collect()] == want


def test_models():
    assert M.task_prefixes("text-embedding-nomic-embed-text-v1.5@f16")[1] == "search_document: "
    assert M.task_prefixes("qwen3-embedding:0.6b")[1] == ""
    with pytest.raises(ValueError):
        M.task_prefixes("unknown")
    assert M.separable(["a<s>b", "", "x" * 9], "<s>", 5) == ["a b", " ", "xxxxx"]
    assert M.split_served(["a", "b"], lambda m: m == "b") == (["b"], ["a"])
    assert [M.prefix_tier(["api", "cli"]), M.prefix_tier(["api", "cli"], True), M.prefix_tier(["cli"], True), M.prefix_tier([], True), M.prefix_tier(["api"], True, True)] == ["synthetic", "api", "cli", "synthetic", "synthetic"]

    def broken(page, chunk):
        raise OSError

    makers = {"api": broken, "cli": lambda p, c: None, "synthetic": lambda p, c: "s"}
    assert M.make_prefix("api", makers, "p", "c") == ("s", "synthetic")
    assert M.make_prefix("cli", makers | {"api": lambda p, c: "dear"}, "p", "c") == ("s", "synthetic")
    assert M.OverlapScorer().score([("a b", "B c"), ("", "x")]) == [0.5, 0.0]


def test_usable_embedder():
    e = M.HashEmbedder(4, "m")
    assert [M.usable(e, ["m"], "m"), M.usable(e, ["n"]), M.usable(e, ["m"], "n")] == ["", "model not listed", "answered by n"]
    e.healthcheck = lambda: False
    assert M.usable(e, ["m"]) == "out of reach"
    e.healthcheck, e.embed = (lambda: True), (lambda texts: [None])
    assert M.usable(e, ["m"]) == "no vector for a trial text"


def test_maintenance_round(spark, tmp_path):
    rows = [("a.md", "---\nname: a\ndescription: d\n---\nsee [[b]] and [[gone]]", "entity"), ("b.md", "---\nname: b\ndescription: d\ntype: source\n---\n", None), ("c.md", "---\nname: c\ntype: meta\n---\n", None)]
    pages = spark.createDataFrame(rows, "page_path string, raw string, type string")
    fixed, found = maintenance_round(pages, {"type": "type"}, str(tmp_path / "s"), "2024-05-01")
    assert [(r.path, "type: entity" in r.raw) for r in fixed.collect()] == [("a.md", True)]
    assert {tuple(r) for r in found.collect()} == {("missing_frontmatter", "c.md", "description"), ("dead_link", "a.md", "gone")}
    assert sinks.last_stamps(spark, str(tmp_path / "s")).first().day == "2024-05-01"


def test_settings_and_sinks(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"band_error": 0.95}))
    got = C.load_settings(str(path))
    assert (got.band_error, got.band_review) == (0.95, 0.80) and C.load_settings(str(tmp_path / "none")) == C.DEFAULTS and C.described(got)["band_error"] == 0.95
    path.write_text(json.dumps({"bands": 1}))
    with pytest.raises(TypeError):
        C.load_settings(str(path))
    for day in ("2024-05-01", "2024-05-03", "2024-05-02"):
        sinks.write_stamp(spark, str(tmp_path / "stamps"), "lint", day)
    assert [tuple(r) for r in sinks.last_stamps(spark, str(tmp_path / "stamps")).collect()] == [("lint", "2024-05-03")]
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    sinks.dump_pairs(pairs, str(tmp_path / "dump"), "2024-05-01")
    assert spark.read.json(str(tmp_path / "dump")).first().day == "2024-05-01"
    sinks.save_run(pairs, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run")).count() == 1
    (tmp_path / "g.json").write_text(json.dumps([{"id": "1", "q": "x", "required": ["a", "b"]}]))
    assert S.read_gold(spark, str(tmp_path / "g.json"), "multi").first().required == ["a", "b"]
