"""The ten operators against brute force on small fixtures, with nulls, empty tables, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import quality_model, quality_rules, warc
from pagewright.llm.common import split_words, steps
from pagewright.llm.decontamination import find_contamination
from pagewright.llm.encoding import UnitEncoder, tokenizer_path
from pagewright.llm.fm_index import FMIndex
from pagewright.llm.graph import components
from pagewright.llm.jaccard_join import similar, similar_documents
from pagewright.llm.packing import best_fit, lower_bound, pack, pack_documents
from pagewright.llm.quality_model import score_quality
from pagewright.llm.quality_rules import judge_quality
from pagewright.llm.substring_dedup import drop_repeats
from pagewright.llm.token_counts import count_tokens
from pagewright.llm.token_files import decode_file, encode_file, token_file_digest
from pagewright.llm.url_filter import host_and_path, judge_urls, labelled_table, train, _scores
from pagewright.llm.warc import archive_digest, parse_warc, read_archive, write_archive

SPACED = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, node string, rid string, place int, n_words string, text_key string, length int"


def frame(spark, docs):
    """Documents with extra columns of names that operators use inside."""
    return spark.createDataFrame([(*d, "x", "y", 1, "z", "k", 3) for d in docs], DOCS)


def odd_texts(words, n, seed):
    r = random.Random(seed)
    base = [[r.choice(words) for _ in range(r.randint(1, 70))] for _ in range(8)]
    docs = []
    for i in range(n):
        w = list(r.choice(base)) + ([] if r.random() < 0.6 else list(r.choice(base)))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    return docs + [(None, docs[0][1]), (None, None), (n + 5, None), (n + 6, ""), (n + 7, " \n\t"), (3, docs[3][1]), (5, "other text with the same id"), (n + 8, " ".join(r.choice(words) for _ in range(30000)))]


WORDS = [f"w{i}é" for i in range(60)] + ["The", "the", "ÀB", "x.", "#"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_steps_and_words_on_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["A b", "c  D", "e f g", None, ""] * 7)], ["t"])
    got = []
    for part in steps([batch], "t", 6):
        words, starts = split_words(part.column("t"), lower=True)
        w = words.to_pylist()
        got += [w[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [["a", "b"], ["c", "d"], ["e", "f", "g"], [], []] * 7


def test_encoder_equals_the_library(library):
    r = random.Random(1)
    bits = [" ", "\n", "a", "B", "'s", "'ll", "23", "!", "?!", "\t", "\r\n", "\x85", "　", "\x1c", "​", "é", "<|endoftext|>", "😀", "ß", "\n\n", "  ", "Ġ", "'", "the", ".", "\x00"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, "", "word " * 50000]
    want = [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    enc = UnitEncoder(tokenizer_path("byte_bpe_50k.json"), memo_units=500)
    for lo in range(0, len(texts), 333):
        ids, cuts = enc.encode(pa.array(texts, pa.string()).slice(lo, 333))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == want[lo : lo + 333]


def test_token_counts(spark, library):
    docs = odd_texts(WORDS, 30, 2)
    got = count_tokens(frame(spark, docs)).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in docs]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert count_tokens(frame(spark, [])).count() == 0
    pieces = count_tokens(frame(spark, docs[:5]), tokenizer="piece_bpe_32k.model").collect()
    assert all(r.n_tokens > 0 for r in pieces)


def test_url_rules_and_model(spark):
    urls = ["http://A.Org/x", "https://example.org/es/1?q", "http://sub.example.org/en/17#a", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/", "http://x.net/", "nothing", None, "a://b://c/d", "http://org", "http://corg/x", "http://x.org:80/a?b#c"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], None), (0, urls[0], "h")]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    for i, u, _ in rows:
        rest = u.partition("://")[2] if u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [(len(k), k, v) for k, v in rules if (host == (h := k.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + k.partition("/")[2])]
        rule, verdict = got[(i, host, path)]
        assert (rule, verdict) == max(fit)[1:] if fit else rule is None and verdict in ("allow", "block")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_generalises():
    table = labelled_table()
    held = table[::4]
    w, b = train([x for i, x in enumerate(table) if i % 4])
    p = _scores([x[0] for x in held], [x[1] for x in held], w, b)
    assert np.mean((p > 0.5) == [x[2] == 1 for x in held]) >= 0.75


def test_similar_is_exact():
    r = random.Random(3)
    for _ in range(500):
        a, b = (set(r.sample(range(40), r.randint(0, 30))) for _ in range(2))
        want = bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
        assert similar(np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)) == want


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_join(spark, seed):
    docs = odd_texts(WORDS, 150, seed)
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(frame(spark, docs)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_jaccard_join_of_nothing(spark):
    assert similar_documents(frame(spark, [])).count() == 0


def test_bounds_and_best_fit():
    r = np.random.default_rng(7)
    for _ in range(40):
        lengths = r.integers(1, 65, r.integers(1, 60))
        bins, offsets = best_fit(lengths, 64)
        for b in np.unique(bins):
            mine = np.argsort(offsets[bins == b])
            assert np.array_equal(np.cumsum(lengths[bins == b][mine])[:-1], offsets[bins == b][mine][1:]) and lengths[bins == b].sum() <= 64
        assert -(-lengths.sum() // 64) <= lower_bound(lengths, 64) <= bins.max() + 1
    assert lower_bound(np.full(9, 33), 64) == 9


def test_packing_in_exchanged_partitions(spark):
    r = np.random.default_rng(8)
    lengths = r.integers(1, 700, 900).tolist()
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
    got = pack(df, 1000, part_pieces=200).collect()
    room = collections.defaultdict(list)
    for x in got:
        room[x.sequence_id].append((x.offset, x.length))
    assert len(got) == 900 and len({x.item for x in got}) == 900
    for s in room.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1000
    assert len(room) <= lower_bound(np.array(lengths), 1000) * 1.02 + 1


def test_pack_documents(spark, library):
    docs = odd_texts(WORDS, 25, 9)
    got = pack_documents(frame(spark, docs)).collect()
    want = []
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(map(str, want))
    assert pack_documents(frame(spark, [])).count() == 0


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(40)] + [(50, "u", None), (51, None, ""), (None, "n", "<p>1</p>"), (38, "v", "<p>3</p>"), (38, "http://h/38", "<p>3</p>")]
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, record_type int")
    groups = collections.defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(-1 if i is None else i)
    want = []
    for data, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids.sort()
        want += [(x, len(data), digest, *(("response", None) if k == len(ids) - 1 else ("revisit", ids[-1]))) for k, x in enumerate(ids)]
    got = [(-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_digest(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert archive_digest(pages.limit(0)).count() == 0
    path = (tmp_path / "archive").as_uri()
    write_archive(pages, path)
    records = read_archive(spark, path).collect()
    for r in records:
        (header, payload), = parse_warc(bytes(r.record))
        assert header == bytes(r.header) and (r.record_type == "revisit" and payload == b"" or payload == bytes(r.payload))


def brute_contamination(docs, items, n=13):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = words.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("seed, block", [(10, 1 << 20), (11, 250)])
def test_decontamination(spark, seed, block):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(4)] + ["É", "9"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(1, 30)))) for i in range(10)] + [(None, "x Y, z"), (3, None), (4, ""), (2, "w1 w2 w3 w1")]
    docs = [(i, " ".join(r.choice([*v, "Q"]) for _ in range(r.randint(0, 50))) + " " + (items[i % 10][1].upper() if i % 2 else "")) for i in range(60)] + [(None, None), (3, "x y z"), (3, "x y z")]
    got = find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_contamination(docs, items)))
    assert find_contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_removes_spans(spark, block):
    """Both ways (one pass; several, for a larger benchmark) on whole texts, long ones too: the words that no item's window covers stay."""
    r = random.Random(block)
    items = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(20))) for i in range(12)]
    filler = lambda n: " ".join(f"f{r.randrange(9)}" for _ in range(n))
    docs = [(1, f"{filler(5)} {items[0][1]} {filler(3)}"), (2, filler(9)), (3, f"{filler(60_000)} {items[5][1].upper()}, {filler(4)}"), (4, items[7][1] + " " + items[8][1]), (5, None), (1, "another text, one id")]
    got = {(x.doc_id, x.n_words): x for x in find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), with_text=True, block_bytes=block).collect()}
    assert len(got) == 6
    whole = lambda k: docs[k][1].lower().replace(",", "").split(" ")
    assert got[1, 28].kept_text == " ".join(whole(0)[:5] + whole(0)[25:]) and got[1, 28].contaminated and got[1, 28].n_hit == 20
    assert got[3, 60_024].kept_text == " ".join(whole(2)[:60_000] + whole(2)[60_020:]) and not got[3, 60_024].contaminated
    assert got[4, 40].kept_text == "" and got[4, 40].n_items == 2
    assert got[2, 9].kept_text is None and got[5, 0].kept_text is None and got[1, 4].kept_text is None


def test_quality_rules(spark):
    r = random.Random(12)
    good = [(i, "\n".join(" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(12)) for _ in range(5))) for i in range(200)]
    junk = [(1000 + i, " ".join(r.choice(["###", "$$$"]) + r.choice("abc") * 3 + str(k) for k in range(60))) for i in range(60)]
    more = [(2000, None), (2001, ""), (2002, "same line\nsame line\n\n \nsame line"), (None, good[0][1]), (2003, "a b c d e " * 20)]
    docs = good + junk + more
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:150]] + [(i, 0) for i, _ in junk[:45]] + [(1, None), (None, 0)], "doc_id long, quality int")
    got = collections.defaultdict(list)
    for x in judge_quality(frame(spark, docs), labels).collect():
        got[x.doc_id].append(x)
    for d, t in docs:
        w = SPACED.findall(t or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
        x = got[d][0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (x.base_failed and x.kept)
    assert all(got[i][0].kept for i, _ in good) and not any(got[i][0].kept for i, _ in junk)
    assert judge_quality(frame(spark, []), labels).count() == 0
    assert judge_quality(frame(spark, good[:3]), labels.limit(0)).filter("kept").count() == 3


def test_quality_model_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = score_quality(docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})), labels)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert scored.filter("doc_id is null").count() == 1
    assert {r.score for r in score_quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_risk_gradient_and_prior():
    r = np.random.default_rng(6)
    p, u, w = r.normal(1, 1, (40, 5)), r.normal(0, 1, (60, 5)), r.normal(0, 0.5, 5)
    for which, grad in ((0, 2), (1, 3)):
        got = quality_model.risk(w, p, u, 0.4)[grad]
        for i in range(5):
            d = np.eye(5)[i] * 1e-5
            assert abs((quality_model.risk(w + d, p, u, 0.4)[which] - quality_model.risk(w - d, p, u, 0.4)[which]) / 2e-5 - got[i]) < 1e-6
    for share in (0.2, 0.5, 0.8):
        good = lambda n: np.hstack((r.normal(3, 1, (n, 3)), np.ones((n, 1))))
        bad = lambda n: np.hstack((r.normal(-3, 1, (n, 3)), np.ones((n, 1))))
        mixed = r.permutation(np.vstack((good(int(2000 * share)), bad(2000 - int(2000 * share)))))
        assert abs(quality_model.estimate_prior(good(2000), mixed) - share) < 0.08
    assert quality_model.estimate_prior(p[:0], u) == 0.5


def test_texts_without_white_space(library):
    """Memory that a worker keeps stays flat over long units, and their ids are the library's."""
    r = random.Random(9)
    encoder = UnitEncoder(tokenizer_path("byte_bpe_50k.json"))
    make = lambda kinds, n: "".join(r.choice(kinds) for _ in range(n))
    kinds = ["春夏秋冬山川草木，。", "abcXYZ0123+/=", "a'b's1!'", "ワタシはねこ、12", "é%ñ&1x"]
    texts = [make(k, n) for k in kinds for n in (3, 3000, 60_000)] + ["x" * 40_000, "\u3000" + make(kinds[0], 40_000), "a  " + make(kinds[1], 40_000)]
    got, starts = encoder.encode(pa.array(texts))
    for t, lo, hi in zip(texts, starts[:-1], starts[1:], strict=True):
        assert got[lo:hi].tolist() == library.encode(t, add_special_tokens=False).ids
    for _ in range(20):
        encoder.encode(pa.array([make(kinds[0], 3000) for _ in range(50)]))
    assert all(len(u) <= 64 for memo in (encoder.memo, encoder.odd, encoder.parts) for u in memo)
    assert sum(len(u) + len(x or b"") for memo in (encoder.memo, encoder.odd, encoder.parts) for u, x in memo.items()) < 1 << 20
    five = make(kinds[0], 1_700_000)  # 5 MB
    assert encoder.counts(pa.array([five]))[0] == len(library.encode(five, add_special_tokens=False).ids)


def test_token_file_round_trip():
    r = np.random.default_rng(13)
    for n in (0, 1, 1023, 1024, 5000):
        ids = r.integers(0, 50257, n).astype(np.uint32)
        ids[r.random(n) < 0.02] += 4_000_000_000
        ids[: n // 3] = 7
        doc_ids, null, lengths = np.array([5, 0]), np.array([False, True]), np.array([n, 0])
        got = decode_file(encode_file(ids, doc_ids, null, lengths))
        assert np.array_equal(got[0], ids) and all(np.array_equal(a, b) for a, b in zip(got[1:], (doc_ids, null, lengths), strict=True))
        if n > 2048:
            assert np.array_equal(decode_file(encode_file(ids, doc_ids, null, lengths), slice(1, 2))[0], ids[1024:2048])


def test_token_files(spark, library):
    docs = odd_texts(WORDS, 40, 14)
    got = token_file_digest(frame(spark, docs).repartition(3)).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((d, len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes()))) for d, t in docs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    assert token_file_digest(frame(spark, [])).count() == 0


def test_fm_index():
    r = random.Random(15)
    for symbols, window in ((2, 4), (3, 6), (40, 3)):
        parts = [[r.randint(1, symbols) for _ in range(r.randint(1, 25))] for _ in range(60)]
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        index = FMIndex(np.array(sum(parts, [])), starts)
        want, seen = np.zeros(len(index.text), bool), set()
        for p, b in zip(parts, index.begin, strict=True):
            for i in range(len(p) - window + 1):
                want[b + i] = tuple(p[i : i + window]) in seen
                seen.add(tuple(p[i : i + window]))
        assert np.array_equal(index.earlier(window), want)


@pytest.mark.parametrize("seed, options, few", [(16, {}, None), (17, {"shard_words": 400, "most_segments": 3}, None), (18, {"shard_words": 400, "most_segments": 3}, 0)])
def test_substring_dedup(spark, monkeypatch, seed, options, few):
    if few is not None:
        monkeypatch.setattr("pagewright.llm.substring_dedup.FEW_ANCHORS", few)
    docs = odd_texts(WORDS, 120, seed)
    seen, want = set(), []
    key = lambda x: (x[0] is not None, x[0] or 0)
    same_id = [x for x in docs if x[0] in (5, None)]
    docs = [x for x in docs if x not in same_id] + [x for x in same_id if x[1] is None or x[1] == docs[5][1]]
    for d, t in sorted(set(docs), key=key):
        w, covered = SPACED.findall(t or ""), set()
        for i in range(len(w) - 19):
            if (g := tuple(w[i : i + 20])) in seen:
                covered.update(range(i, i + 20))
            seen.add(g)
        left = " ".join(x for i, x in enumerate(w) if i not in covered)
        want += [(d, len(w), len(covered), hashlib.sha256(left.encode()).hexdigest())] * docs.count((d, t))
    got = drop_repeats(frame(spark, docs).repartition(3), **options).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert drop_repeats(frame(spark, [])).count() == 0


def test_archive_digest_reads_records_back(spark, monkeypatch):
    def write(pages, path, least_bytes=0):
        write_archive(pages, f"{path}/first", least_bytes)
        spark.read.parquet(f"{path}/first/headers").withColumn("refers_to", F.lit(-1).cast("long")).write.parquet(f"{path}/headers")
        spark.read.parquet(f"{path}/first/payloads").write.parquet(f"{path}/payloads")

    pages = spark.createDataFrame([(1, "u", "é\r\n\r\nContent-Length: 9\r\n\r\n"), (5, "v", "x"), (6, "w", "x"), (None, "z", None), (None, "y", "")], "page_id long, url string, html string")
    want = sorted(map(str, archive_digest(pages).collect()))
    monkeypatch.setattr(warc, "write_archive", write)
    assert sorted(map(str, archive_digest(pages).collect())) == want
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = [tuple(r) for r in archive_digest(pages).filter("page_id > 1").orderBy("page_id").collect()]
    assert got == [(5, 1, digest("x"), "revisit", 6), (6, 1, digest("x"), "response", None)]


def test_samples_have_one_row_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"hot words number {i % 40}") for i in range(120)] + [(i, f"other words of {i}") for i in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 ^ 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sizes = []
    real_fit, real_list = quality_model.fit, quality_rules.learn_list
    monkeypatch.setattr(quality_model, "fit", lambda p, u, prior: sizes.append((len(p), len(u))) or real_fit(p, u, prior))
    monkeypatch.setattr(quality_rules, "learn_list", lambda rows: sizes.append(list(rows["doc_id"])) or real_list(rows))
    free = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert score_quality(docs, labels).count() == 149
    assert judge_quality(docs, labels).count() == 149
    assert sizes[0] == (sum(i % 2 == 0 for i in free), len(free))
    assert sorted(sizes[1]) == list(range(30))


def test_odd_rows_of_the_other_operators(spark):
    """Empty tables, repeated rows, clashing names and very long values: op1, op5, op6, op8, op9."""
    long_url = "https://A.example.org/es/" + "x" * 200_000
    pages = [(1, long_url, "h" * 3_000_000, "own"), (1, long_url, "h" * 3_000_000, "own"), (None, "no scheme", None, "own"), (4, "http://b.org?q", "h" * 3_000_000, "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha256 string")
    got = judge_urls(df).collect()
    assert len(got) == 4 and sum(r.path == "/es/" + "x" * 200_000 and r.verdict == "block" and r.rule == "example.org/es/" for r in got) == 2
    assert judge_urls(df.limit(0)).count() == 0 and archive_digest(df.limit(0)).count() == 0
    kept = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in archive_digest(df).collect())
    assert kept == [(0, 0, "response", None), (1, 3_000_000, "revisit", 4), (1, 3_000_000, "revisit", 4), (4, 3_000_000, "response", None)]
    text = " ".join(f"word{i % 977} and" for i in range(60_000))
    docs = frame(spark, [(1, text), (1, text), (2, "good words here."), (None, None), (3, "")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    scored = score_quality(docs, labels).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id == 1}) == 1
    assert score_quality(docs.limit(0), labels).count() == 0 and judge_quality(docs, labels).filter("doc_id = 1 and n_words = 120000").count() == 2
    assert [r.n_tokens for r in token_file_digest(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).filter("doc_id = 3").collect()] == [1]
