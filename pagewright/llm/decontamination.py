"""Operator 7, benchmark decontamination: a generalised suffix automaton of the benchmark's words.

Training tokens stream through the automaton, which tracks the longest match that ends at each word.
A match of ``window`` words or more hits the last ``window`` words; shorter items are one window each.
The automaton covers a bounded block of the benchmark; a larger benchmark is so many automata, used in turn.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import compact, cut_at_space, map_arrow, save, steps

WINDOW = 13
#: Text bytes of one automaton: some tens of MB once built, whatever the benchmark's size.
BLOCK_BYTES = 512 << 10
#: Automata that a worker holds at once, and so the most that are broadcast at once.
HELD = 4
#: Each byte as a word byte, or blank: A-Z lower-cased, digits, a-z and all bytes above ASCII stay.
_BYTES = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _BYTES[_b] = _b
for _b in range(65, 91):
    _BYTES[_b] = _b + 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each lower-cased (A-Z) text and where each text's words start. A null text has none."""
    return cut_at_space(compact(texts, _BYTES))


class Automaton:
    """Generalised suffix automaton of items given as (item_id, words), with the items of each window."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        vocabulary: dict[str, int] = {}
        coded = [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for i, words in items if words]
        self.vocabulary, self.window, self.base = list(vocabulary), window, max(1, len(vocabulary))
        self.step: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        self._out: list[list[int]] = [[]]
        ends: dict[int, set[str]] = {}
        for item, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
                ends.setdefault(last, set()).add(item)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:  # what ends in a state also ends in its link
            if v in ends and self.link[v] > 0 and self.length[self.link[v]] >= window:
                ends.setdefault(self.link[v], set()).update(ends[v])
        #: For a state of ``window`` words or more: the state that holds the last ``window`` words of its match.
        self.at_window = [0] * len(self.length)
        for v in reversed(order):
            if self.length[v] >= window:
                self.at_window[v] = self.at_window[self.link[v]] or v
        self.items = {v: ends[v] for v in ends if self.length[v] >= window and self.at_window[v] == v}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, codes in coded:
            if len(codes) < window:
                v = 0
                for c in codes:
                    v = self.step[v * self.base + c]
                short.setdefault(v, []).append((len(codes), item))
        #: For a state: short items that a match in it ends with.
        self.short: dict[int, list[tuple[int, str]]] = {}
        for v in reversed(order):
            found = short.get(v, []) + self.short.get(self.link[v], [])
            if found:
                self.short[v] = found
        self.least = min([window, *(len(c) for _, c in coded)])
        pairs = {a * self.base + b for _, c in coded for a, b in zip(c[:-1], c[1:], strict=True)}
        self.pairs = np.array(sorted(pairs), np.int64)
        del self._out

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        return len(self.length) - 1

    def _set(self, v: int, c: int, to: int) -> None:
        if v * self.base + c not in self.step:
            self._out[v].append(c)
        self.step[v * self.base + c] = to

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the part of ``q`` that is one word longer than ``p``."""
        r = self._new(self.length[p] + 1, self.link[q])
        for x in self._out[q]:
            self._set(r, x, self.step[q * self.base + x])
        self.link[q] = r
        while p != -1 and self.step.get(p * self.base + c) == q:
            self.step[p * self.base + c] = r
            p = self.link[p]
        return r

    def _extend(self, last: int, c: int) -> int:
        q = self.step.get(last * self.base + c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        v, p = self._new(self.length[last] + 1, 0), last
        while p != -1 and (p * self.base + c) not in self.step:
            self._set(p, c, v)
            p = self.link[p]
        if p != -1:
            q = self.step[p * self.base + c]
            self.link[v] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return v

    def runs(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that can hold a window: all in the vocabulary, each pair of neighbours somewhere in an item, within one text."""
        if self.least < 2:
            good = codes >= 0
            least = 1
        else:
            a, b = codes[:-1], codes[1:]
            good = (a >= 0) & (b >= 0)
            at = np.flatnonzero(good)
            keys = a[at].astype(np.int64) * self.base + b[at]
            spot = np.searchsorted(self.pairs, keys)
            good[at] = (spot < len(self.pairs)) & (self.pairs[np.minimum(spot, len(self.pairs) - 1)] == keys) if len(self.pairs) else False
            edges = starts[1:-1]
            good[edges[(edges > 0) & (edges <= len(good))] - 1] = False
            least = self.least - 1
        flips = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        lows, highs = flips[::2], flips[1::2]
        keep = highs - lows >= least
        extra = 0 if self.least < 2 else 1
        out = list(zip(lows[keep].tolist(), (highs[keep] + extra).tolist(), strict=True))
        if extra or not out:
            return out
        cut: list[tuple[int, int]] = []  # runs of single words may reach over text bounds
        for a, b in out:
            inner = starts[np.searchsorted(starts, a, "right") : np.searchsorted(starts, b, "left")].tolist()
            points = [a, *dict.fromkeys(inner), b]
            cut += list(zip(points[:-1], points[1:], strict=True))
        return cut

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, set[str] | list[str]]]:
        """For each window that ends at a word: its bounds and its items."""
        v, n, base, step = 0, 0, self.base, self.step
        for i, c in enumerate(codes):
            while v and (v * base + c) not in step:
                v = self.link[v]
                n = self.length[v]
            to = step.get(v * base + c) if c >= 0 else None
            if to is None:
                v, n = 0, 0
                continue
            v, n = to, n + 1
            if n >= self.window:
                u = self.at_window[v]
                yield i + 1 - self.window, i + 1, self.items[u]
            for m, item in self.short.get(v, ()):
                if m <= n:
                    yield i + 1 - m, i + 1, [item]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> tuple[int, Iterator[Automaton]]:
    """How many bounded blocks of items there are, dealt by a hash, and their automata; the driver holds one block's text at a time."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").filter("text is not null")
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)

    def built() -> Iterator[Automaton]:
        for k in range(blocks):
            block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().toPandas().sort_values(["item_id", "text"])
            words, starts = words_of(pa.array(block["text"], pa.string()))
            words = words.to_pylist()
            yield Automaton([(i, words[a:b]) for i, a, b in zip(block["item_id"], starts[:-1].tolist(), starts[1:].tolist(), strict=True)], window)

    return blocks, built()


class Hits:
    """What streams of a batch's texts through automata find: hit bounds and items by text."""

    def __init__(self, texts: pa.Array):
        self.words, self.starts = words_of(texts)
        self.spans: dict[int, list[int]] = {}
        self.items: dict[int, set[str]] = {}

    def stream(self, a: Automaton, vocabulary: pa.Array) -> None:
        codes = pc.fill_null(pc.index_in(self.words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False) if a.vocabulary else np.full(len(self.words), -1)
        for lo, hi in a.runs(codes, self.starts):
            text = int(np.searchsorted(self.starts, lo, "right")) - 1
            shift = lo - int(self.starts[text])
            for x, y, ids in a.stream(codes[lo:hi].tolist()):
                spans = self.spans.setdefault(text, [])
                if spans and spans[-2] <= shift + x <= spans[-1]:
                    spans[-1] = max(spans[-1], shift + y)
                else:
                    spans += [shift + x, shift + y]
                self.items.setdefault(text, set()).update(ids)

    def columns(self, with_text: bool) -> list[pa.Array]:
        """``n_words, n_hit, n_items, items_sha256`` and, if asked for, ``kept_text``."""
        edge = np.zeros(len(self.words) + 1, np.int32)
        for text, spans in self.spans.items():
            at = np.array(spans, np.int64).reshape(-1, 2) + self.starts[text]
            np.add.at(edge, at[:, 0], 1)
            np.add.at(edge, at[:, 1], -1)
        covered = np.cumsum(edge[:-1]) > 0
        n_hit = np.diff(np.concatenate(([0], np.cumsum(covered)))[self.starts])
        ids = [sorted(self.items.get(i, ())) for i in range(len(n_hit))]
        out = [pa.array(np.diff(self.starts)), pa.array(n_hit), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string())]
        if with_text:
            bounds = zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), n_hit.tolist(), strict=True)
            out.append(pa.array([" ".join(self.words.slice(s, e - s).filter(pa.array(~covered[s:e])).to_pylist()) if h else None for s, e, h in bounds], pa.string()))
        return out


def _streamed(batches: Iterator[pa.RecordBatch], automata: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, Hits]]:
    held = [(x.value, pa.array(x.value.vocabulary, pa.large_string())) for x in automata]
    for b in steps(batches, "text"):
        hits = Hits(b.column("text"))
        for a, vocabulary in held:
            hits.stream(a, vocabulary)
        yield b, hits


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, with_text: bool = False, with_key: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``n_words, n_hit, n_items, items_sha256, contaminated`` of every document, one row for each row of ``docs``.

    A document is contaminated where ``n_hit`` is above 0 and at least one ``share``-th of its words. ``with_text`` adds
    ``kept_text``, the words that are not hit joined by blanks (null where nothing is hit), ``with_key`` a hash of the text. Null texts have no
    words; items without words match nothing; a null item_id counts as ``null``; equal item_ids count once; other columns are not read; texts of any
    length stream whole.

    Up to :data:`HELD` blocks of items are broadcast at once. A benchmark of that size takes one pass without a shuffle; a
    larger one a pass for each so many blocks, whose hits are saved and meet their documents in a last pass.
    """
    sc = docs.sparkSession.sparkContext
    blocks, built = item_blocks(items, block_bytes, window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", *["kept_text"] * with_text, *["text_key"] * with_key]
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string" + ", kept_text string" * with_text + ", text_key long" * with_key

    def row(b: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *hits.columns(with_text), *[b.column("text_key")] * with_key], names)

    if blocks <= HELD:
        automata = [sc.broadcast(a) for a in built]
        out = map_arrow(source, lambda batches: (row(b, hits) for b, hits in _streamed(batches, automata)), schema)
        return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))

    def passing(automata: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, hits in _streamed(batches, automata):
                at = sorted(hits.spans)
                spans, ids = pa.array([hits.spans[i] for i in at], pa.list_(pa.int32())), pa.array([sorted(hits.items[i]) for i in at], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), b.column("text_key").take(pa.array(at, pa.int64())), spans, ids], ["id", "key", "spans", "items"])

        return map_arrow(source, run, f"id {kind}, key long, spans array<int>, items array<string>").dropDuplicates(["id", "key"])

    met = None
    for _ in range(-(-blocks // HELD)):
        automata = [sc.broadcast(a) for a in itertools.islice(built, HELD)]
        found = save(passing(automata), "hits")
        for a in automata:
            a.destroy()
        met = found if met is None else met.unionByName(found)
    met = met.groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = source.join(met, source["doc_id"].eqNullSafe(met["id"]) & (source["text_key"] == met["key"]), "left").select("doc_id", "text", "text_key", "spans", "items")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            hits = Hits(b.column("text"))
            hits.spans = {i: x for i, x in enumerate(b.column("spans").to_pylist()) if x}
            hits.items = {i: set(x) for i, x in enumerate(b.column("items").to_pylist()) if x}
            yield row(b, hits)

    return map_arrow(joined, last, schema).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
