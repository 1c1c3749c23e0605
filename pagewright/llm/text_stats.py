"""Counts of whole texts, vectorised over Arrow batches; operators 6 and 8 share them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import compact, gram_hashes, map_arrow, mix, split_words, spread, steps, word_hashes

#: Counted characters. Fixed values.
SYMBOLS = b"#*$%&|<>"
CLASSES = {
    "n_symbols": SYMBOLS,
    "n_upper": bytes(range(65, 91)),
    "n_digits": b"0123456789",
    "n_shouts": b"!?",
    "n_stops": b".,;:",
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
NAMES = [*BASE, "n_upper", "n_digits", "n_shouts", "n_stops", "n_lines", "n_distinct"]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def repeat_words(hashes: np.ndarray, starts: np.ndarray, n: int = 5) -> np.ndarray:
    """For each text, its words inside ``n``-word windows found twice or more in this text."""
    total, texts = len(hashes), len(starts) - 1
    grams = gram_hashes(hashes, n)
    if not len(grams):
        return np.zeros(texts, np.int64)
    text = np.repeat(np.arange(texts), np.diff(starts))
    inside = text[: len(grams)] == text[n - 1 :]
    at = np.flatnonzero(inside)
    keys = mix(grams[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, starts)


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts in :data:`NAMES` for each text. A null text counts as empty: every count is 0."""
    words, starts = split_words(texts)
    hashes = word_hashes(words)
    out = {"n_words": np.diff(starts)}
    plain = compact(texts)
    _, offsets, data = plain.buffers()
    bounds = np.frombuffer(offsets, np.int64)[: len(plain) + 1]
    chars = np.frombuffer(data, np.uint8)[: int(bounds[-1])] if bounds[-1] else np.empty(0, np.uint8)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    points = (chars & 0xC0) != 0x80
    out["word_chars"] = _sums(points & ~space[chars], bounds)
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = _sums(table[chars], bounds)
    dup, lines = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
    raw = memoryview(chars)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        full = [x for x in bytes(raw[a:b]).split(b"\n") if x.strip()]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    out["n_dup_lines"], out["n_lines"] = dup, lines
    out["n_repeat_words"] = repeat_words(hashes, starts)
    text = np.repeat(np.arange(len(plain)), np.diff(starts))
    # distinct words: the words less those equal to an earlier one of the same text
    order = np.lexsort((hashes, text))
    again = np.zeros(len(hashes), bool)
    if len(order) > 1:
        again[1:] = (np.diff(hashes[order]) == 0) & (np.diff(text[order]) == 0)
    out["n_distinct"] = out["n_words"] - _sums(again, starts)
    return out


def with_text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and the counts of each whole text, one row for each row; no shuffle, bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = text_counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(found[c], pa.int64()) for c in NAMES)], ["doc_id", "text_key", *NAMES])

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(spread(narrow), run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text_key long, " + ", ".join(f"{c} long" for c in NAMES))
