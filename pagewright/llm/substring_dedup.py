"""Operator 10, substring dedup: FM-indexes of the passages that may recur, and matching statistics by backward search.

A window of 20 words picks the least hash of its 8-word grams as its anchor, so equal windows have
equal anchors. A document's windows with one anchor form a segment. An anchor seen once ends the matter. Equal
segments are one class: all places but the first are repeats. Segments that share an anchor but differ go to
the shard of their anchor, which holds an FM-index of them; each is streamed through it by backward search, and
a window whose interval holds an earlier place is a repeat. Anchors with very many different segments are
dealt by window instead, so that no shard grows with one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import gram_hashes, map_arrow, mix, save, split_words, steps, word_hashes
from pagewright.llm.fm_index import FMIndex

WINDOW, GRAM = 20, 8
#: Words that one FM-index holds, but for the last anchor's segments.
SHARD_WORDS = 1_000_000
#: Anchors, 8 bytes each, that are broadcast; with more, they meet the segments by shuffle.
FEW_ANCHORS = 1_000_000
#: Different segments of one anchor that stay together; beyond, its windows are dealt apart.
MOST_SEGMENTS = 20_000


def sliding_anchor(grams: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` grams, the position of the first least one."""
    m = len(grams) - span + 1
    if m <= 0:
        return np.empty(0, np.int64)
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:m], least[span - width : span - width + m])
    at = np.full(m, -1, np.int64)
    for k in range(span - 1, -1, -1):
        same = grams[k : k + m] == least
        at[same] = np.flatnonzero(same) + k
    return at


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, for hashes of stretches of any length."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    @classmethod
    def stretch(cls, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = len(hashes) + 1
        up, down = np.full(n, cls.base), np.full(n, cls.inverse)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
        return mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))


def segments(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of a batch: text number, first window's word, windows, anchor hash, segment hash."""
    grams = gram_hashes(hashes, gram)
    span = window - gram + 1
    at = sliding_anchor(grams, span)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    valid = text[: len(at)] == text[window - 1 : window - 1 + len(at)]
    where = np.flatnonzero(valid)
    if not len(where):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.concatenate(([True], (np.diff(where) != 1) | (np.diff(at[where]) != 0) | (np.diff(text[where]) != 0)))
    first = where[new]
    count = np.diff(np.concatenate((np.flatnonzero(new), [len(where)])))
    anchor = grams[at[first]]
    body = _Powers.stretch(hashes, first, first + count + window - 1)
    return text[first], first - starts[text[first]], count, anchor, mix(body + (at[first] - first).astype(np.uint64))


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rid``, a long in document order: the id itself where ids are unique and not null; else dealt by (doc_id, text)."""
    facts = docs.select(F.count("*").alias("n"), F.count("doc_id").alias("m")).first()
    if facts.n == facts.m and docs.select("doc_id").distinct().count() == facts.n and dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        return docs.withColumn("rid", F.col("doc_id").cast("long"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key").asc()]
    names = keyed.select("doc_id", "text_key").distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id())
    names = save(names, "row-names").withColumnsRenamed({"doc_id": "own_id", "text_key": "own_key"})
    return keyed.join(names, keyed["doc_id"].eqNullSafe(names["own_id"]) & (keyed["text_key"] == names["own_key"])).drop("own_id", "own_key", "text_key")


def _occurrences(rows: DataFrame, window: int) -> DataFrame:
    """``anchor, segment, rid, place`` of each segment; ``place`` packs its start and windows.

    Of equal segments in a batch only the first goes to its anchor; the others are repeats already and
    travel under a key of their own, with ``segment`` null. So no anchor gathers more rows than there are batches and texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            words, starts = split_words(b.column("text"))
            text, first, count, anchor, body = segments(word_hashes(words), starts, window)
            if not len(text):
                continue
            rid = b.column("rid").to_numpy(zero_copy_only=False)[text]
            place = (first << 8) | count
            order = np.lexsort((place, rid, body, anchor))
            a, s, r, p = anchor[order], body[order], rid[order], place[order]
            again = np.concatenate(([False], (a[1:] == a[:-1]) & (s[1:] == s[:-1])))
            twin = np.concatenate(([False], (r[1:] == r[:-1]) & (p[1:] == p[:-1]))) & again  # a repeated row of the table
            a = np.where(again, mix(r.astype(np.uint64) + p.astype(np.uint64)), a)
            keep = ~twin
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)[keep]), pa.array(s.view(np.int64)[keep], mask=again[keep]), pa.array(r[keep]), pa.array(p[keep])], ["anchor", "segment", "rid", "place"])

    return map_arrow(rows.select("rid", "text"), run, "anchor long, segment long, rid long, place long")


def _classes(occurrences: DataFrame) -> DataFrame:
    """Saved rows ``repeat, anchor, rid, place``: repeats of an equal segment, and first places of segments that share their anchor with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repeat", "anchor", "rid", "place"]

        def rows(repeat: bool, *cols: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), repeat)), *(pa.array(c) for c in cols)], names)

        last = None  # the row before: anchor, segment, rid, place
        held = None  # the last first place, not given out yet: anchor, rid, place, whether it shares its anchor
        for b in batches:
            alone = b.column("segment").is_null().to_numpy(zero_copy_only=False)
            cols = [b.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("anchor", "segment", "rid", "place")]
            if alone.any():
                yield rows(True, *(cols[i][alone] for i in (0, 2, 3)))
            a, s, r, p = (c[~alone] for c in cols)
            if not len(a):
                continue
            a0, s0, r0, p0 = (np.concatenate((c[:1] if last is None else [last[i]], c[:-1])) for i, c in enumerate((a, s, r, p)))
            again = (a == a0) & (s == s0)
            twin = again & (r == r0) & (p == p0)
            if last is None:
                again[0] = twin[0] = False
            last = (a[-1], s[-1], r[-1], p[-1])
            out = again & ~twin
            if out.any():
                yield rows(True, a[out], r[out], p[out])
            a, r, p = a[~again], r[~again], p[~again]
            if held is not None:
                a, r, p = np.append(held[0], a), np.append(held[1], r), np.append(held[2], p)
            if not len(a):
                continue
            same = np.concatenate(([held is not None and held[3]], a[1:] == a[:-1]))
            shares = same[:-1] | same[1:]
            if shares.any():
                yield rows(False, a[:-1][shares], r[:-1][shares], p[:-1][shares])
            held = (a[-1], r[-1], p[-1], bool(same[-1]))
        if held is not None and held[3]:
            yield rows(False, *(np.array([x], np.int64) for x in held[:3]))

    dealt = occurrences.repartition("anchor").sortWithinPartitions("anchor", "segment", "rid", "place")
    return save(map_arrow(dealt, run, "repeat boolean, anchor long, rid long, place long"), "classes")


def _texts(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``shard, rid, place, words`` of the wanted segments; of anchors with too many, each window alone, and equal ones of a batch once (the others with null words)."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 4 << 20):
            out: list[tuple] = []
            windows: dict[int, list[tuple[int, int, str]]] = {}
            for rid, text, lists in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                words = text.encode().split()
                for x in lists:
                    start, count = x["place"] >> 8, x["place"] & 255
                    if not x["hot"]:
                        out.append((x["anchor"], rid, x["place"], b" ".join(words[start : start + count + window - 1]).decode()))
                        continue
                    for k in range(start, start + count):
                        body = b" ".join(words[k : k + window])
                        key = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
                        windows.setdefault(key, []).append((rid, (k << 8) | 1, body.decode()))
            for key, places in windows.items():
                ordered = sorted(set(places))
                out += [(key, r, p, w if i == 0 else None) for i, (r, p, w) in enumerate(ordered)]
            out = list(dict.fromkeys(out))
            for lo in range(0, len(out), 20_000):
                c = list(zip(*out[lo : lo + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], ["shard", "rid", "place", "words"])

    joined = rows.select("rid", "text").join(lists, "rid")
    return map_arrow(joined.select("rid", "text", "wanted"), run, "shard long, rid long, place long, words string")


def _searched(texts: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Saved ``rid, place`` of the windows of different segments that also start earlier, by an FM-index for each shard."""

    def repeats(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("rid", "ascending"), ("place", "ascending")])
        rid, place = table.column("rid").to_numpy(), table.column("place").to_numpy()
        twin = np.concatenate(([False], (rid[1:] == rid[:-1]) & (place[1:] == place[:-1])))  # of repeated rows of the table
        if twin.any():
            table, rid, place = table.filter(pa.array(~twin)), rid[~twin], place[~twin]
        words, starts = split_words(table.column("words"))
        d = words.dictionary_encode()
        index = FMIndex(np.asarray(d.indices).astype(np.int64) + 1, starts)
        at = np.flatnonzero(index.earlier(window))
        segment = np.searchsorted(index.begin, at, "right") - 1
        start = (place[segment] >> 8) + at - index.begin[segment]
        return pa.RecordBatch.from_arrays([pa.array(rid[segment]), pa.array((start << 8) | 1)], ["rid", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            null = b.column("words").is_null()
            if null.true_count:
                yield pa.RecordBatch.from_arrays([b.column("rid").filter(null), b.column("place").filter(null)], ["rid", "place"])
                b = b.filter(null.to_numpy(zero_copy_only=False) == False)  # noqa: E712
                if not b.num_rows:
                    continue
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist()]
            if last is not None and shard[0] == last:
                edges = edges[1:]
            low = 0
            each = np.cumsum((b.column("place").to_numpy(zero_copy_only=False) & 255) + window - 1)
            for cut in edges:  # only between shards
                if size + (each[cut - 1] if cut else 0) - (each[low - 1] if low else 0) >= shard_words:
                    if cut > low:
                        held.append(b.slice(low, cut - low))
                    yield repeats(held)
                    held, size, low = [], 0, cut
            if low < b.num_rows:
                held.append(b.slice(low))
                size += int(each[-1] - (each[low - 1] if low else 0))
            last = shard[-1]
        if held:
            yield repeats(held)

    dealt = texts.repartition("shard").sortWithinPartitions("shard", "rid", "place")
    return save(map_arrow(dealt, run, "rid long, place long"), "repeats")


def drop_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, shard_words: int = SHARD_WORDS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, one row for each row of ``docs``.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a smaller doc_id, or
    earlier in the same document. ``with_text`` adds ``kept_text`` (null where nothing goes) and ``text_key``. Null texts have no
    words. Null ids come before all others; different texts with one id are ordered by a hash of the text; rows
    that repeat id and text are one document, whose result each row gets. Other columns are not read. An empty table gives no rows;
    texts of any length are read whole. An anchor with over ``most_segments`` different segments is dealt by single windows, with the same results.
    """
    rows = _rows(docs.select("doc_id", "text"))
    classes = _classes(_occurrences(rows, window))
    firsts = classes.filter("not repeat")
    hot = save(firsts.groupBy("anchor").count().filter(F.col("count") > most_segments).select("anchor", F.lit(True).alias("hot")), "hot")
    few = hot.limit(FEW_ANCHORS + 1).count() <= FEW_ANCHORS  # then the rows of an anchor need not meet in one task
    wanted = firsts.join(F.broadcast(hot) if few else hot, "anchor", "left").select("anchor", "rid", "place", F.coalesce("hot", F.lit(False)).alias("hot"))
    found = _searched(_texts(rows, wanted, window), window, shard_words)
    places = classes.filter("repeat").select("rid", "place").unionByName(found).groupBy("rid").agg(F.collect_list("place").alias("places"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            lists = b.column("places")
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            n_words, n_removed, digests, texts = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = (text or "").encode().split()
                mine = flat[bounds[i] : bounds[i + 1]]
                left = words
                if len(mine):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, mine >> 8, 1)
                    np.add.at(edge, (mine >> 8) + (mine & 255) + window - 1, -1)
                    left = [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]
                body = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(body).hexdigest())
                texts.append(body.decode() if len(left) < len(words) else None)
            cols, names = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols += [b.column("text_key"), pa.array(texts, pa.string())]
                names += ["text_key", "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    joined = rows.join(places, "rid", "left").withColumn("text_key", F.xxhash64("text"))
    return map_arrow(joined.select("doc_id", "text", "text_key", "places"), run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text_key long, kept_text string" * with_text)
