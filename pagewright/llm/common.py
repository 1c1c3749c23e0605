"""Helpers that the operators share: the shared work folder, bounded Arrow batches, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.sources.work import save, shared_dir, spread  # noqa: F401

#: Bytes of text that one step of a Python function holds at once.
STEP_BYTES = 2 << 20
#: Bytes and rows of one Arrow batch that Spark sends to a Python function.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4_000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches: where the session has Spark's own limits, they are lowered; limits that a user has set stay."""
    conf = df.sparkSession.conf
    for key, usual, ours in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS)):
        if conf.get(key) == usual:
            conf.set(key, str(ours))
    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, rows: int, key: str = "doc_id", salt: int = 0) -> DataFrame:
    """All rows, or where there are more, those with the least hashes of ``key``: about ``rows`` in the mean, whatever the size.

    The cut is on the hash, so each partition decides alone and only the sample moves; rows with one key stay together.
    """
    count = df.count()
    if count <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 31)) < int((1 << 31) * rows / count))


def steps(batches: Iterable[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each (one row at least). At the end, unused memory goes back to the system."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    release()


def release() -> None:
    """Give the memory that this worker no longer uses back to the system: idle workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit integers so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def compact(texts: pa.Array | pa.ChunkedArray, table: np.ndarray | None = None) -> pa.Array:
    """The texts as a large_string array whose buffers begin at 0, null as empty; ``table`` maps every byte.

    Some Arrow kernels read a slice's cast from its parent's start, so slices are rebuilt first.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = plain.buffers()
    if not len(plain) or data is None:
        return pa.array([""] * len(plain), pa.large_string())
    bounds = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    body = body.copy() if table is None else table[body]
    return pa.LargeStringArray.from_buffers(len(plain), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(body))


#: A-Z to a-z, every other byte as it is.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_at_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of compact texts, and where each text's words start."""
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten()
    bounds = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return words.filter(full), kept[bounds].astype(np.int64)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+`` of each text: all words in one array, and where each text's words start.

    A null text has no words. ``lower`` lower-cases A-Z only.
    """
    return cut_at_space(compact(texts, _LOWER if lower else None))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word of the array is hashed once."""
    if not len(words):
        return np.empty(0, np.uint64)
    d = words.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    each = np.fromiter((h(w, seed) for w in d.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(d.dictionary))
    return each[np.asarray(d.indices)]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive words, from the words' hashes; text bounds are the caller's matter."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + m]
    return mix(out)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def environment() -> None:
    """Keep libraries in Python workers to one thread each: Spark runs one worker a core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
