"""Operator 9, token-ID output: patched frame-of-reference blocks.

File format ``PFB1`` (little-endian): magic; u32 ids a block; u64 ids; u32 documents; u32 blocks;
then per document i64 id, u8 whether the id is null, u64 ids; then per block u64 start in the body,
u32 minimum, u8 width, u16 exceptions; then the body. A block's body is ``width`` rows of 32 u32 words
(value ``32 * i + lane`` of the block sits in column ``lane`` at bit ``i * width``), the positions
(u16) of its exceptions and what these have above ``width`` bits (u32). The last block is filled with its minimum.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import map_arrow, save, shared_dir, steps
from pagewright.llm.encoding import encoder, tokenizer_path

BLOCK = 1024
#: The width holds this share of a block's values; the rest are exceptions.
SHARE = 0.95
#: Ids of one file at most, so that a file always fits one row and one task.
FILE_IDS = 2_000_000
_HEAD = struct.Struct("<4sIQII")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values of ``width`` bits to (blocks, width, 32) words."""
    out = np.zeros((len(v), max(width, 1), 32), np.uint32)
    v = v.reshape(len(v), 32, 32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out[:, :width]


def _unpack(w: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(w), 32, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        x = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | (w[:, word + 1] << np.uint32(32 - shift))
        out[:, i] = x & mask
    return out.reshape(len(w), BLOCK)


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """One file image of the documents' ids."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    v = np.zeros(nb * BLOCK, np.uint32)
    v[:n] = ids
    if n < len(v):
        v[n:] = ids[(nb - 1) * BLOCK :].min()
    v = v.reshape(nb, BLOCK)
    low = v.min(axis=1) if nb else np.empty(0, np.uint32)
    v = v - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(SHARE * BLOCK)) - 1)
    fit = np.partition(v, at, axis=1)[:, at] if nb else np.empty(0, np.uint32)
    width = np.ceil(np.log2(fit.astype(np.float64) + 1)).astype(np.uint8)
    cut = np.where(width[:, None] >= 32, 0, v >> np.minimum(width, 31)[:, None].astype(np.uint32))
    odd_block, odd_at = np.nonzero(cut)
    odd_n = np.bincount(odd_block, minlength=nb)
    odd_from = np.concatenate(([0], np.cumsum(odd_n)))
    high, odd_at = cut[odd_block, odd_at].astype("<u4"), odd_at.astype("<u2")
    words: list[bytes] = [b""] * nb
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        mask = np.uint32((1 << int(w)) - 1)
        for some in np.array_split(rows, max(1, len(rows) // 2048)):
            for k, x in zip(some, _pack(v[some] & mask, int(w)).astype("<u4"), strict=True):
                words[k] = x.tobytes()
    body = []
    for k in range(nb):
        a, b = odd_from[k], odd_from[k + 1]
        body += [words[k], odd_at[a:b].tobytes(), high[a:b].tobytes()]
    size = width.astype(np.int64) * 128 + odd_n * 6
    starts = np.concatenate(([0], np.cumsum(size)))[:nb].astype("<u8")
    head = _HEAD.pack(b"PFB1", BLOCK, n, len(lengths), nb)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), lengths.astype("<u8").tobytes(), starts.tobytes(), low.astype("<u4").tobytes(), width.tobytes(), odd_n.astype("<u2").tobytes(), *body])


def decode_file(data: bytes, blocks: slice | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, doc_ids, null, lengths)`` of a file image; ``blocks`` reads only these blocks by the index."""
    magic, block, n, docs, nb = _HEAD.unpack_from(data)
    if magic != b"PFB1" or block != BLOCK:
        raise ValueError("not a PFB1 file")
    at = _HEAD.size
    parts = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", nb), ("<u4", nb), ("u1", nb), ("<u2", nb)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, null, lengths, starts, low, width, odd_n = parts
    wanted = np.arange(nb)[blocks or slice(None)]
    out = np.empty((len(wanted), BLOCK), np.uint32)
    begin = starts[wanted].astype(np.int64) + at
    for w in np.unique(width[wanted]):
        rows = np.flatnonzero(width[wanted] == w)
        for some in np.array_split(rows, max(1, len(rows) // 2048)):
            words = np.stack([np.frombuffer(data, "<u4", int(w) * 32, begin[k]) for k in some]).reshape(len(some), int(w), 32)
            out[some] = _unpack(words, int(w))
    for k in np.flatnonzero(odd_n[wanted]):
        m, w = int(odd_n[wanted[k]]), int(width[wanted[k]])
        where = begin[k] + w * 128
        out[k, np.frombuffer(data, "<u2", m, where)] |= np.frombuffer(data, "<u4", m, where + 2 * m) << np.uint32(w)
    out += low[wanted][:, None].astype(np.uint32)
    first = int(wanted[0]) * BLOCK if len(wanted) else 0
    return out.reshape(-1)[: max(0, min(n, (int(wanted[-1]) + 1) * BLOCK) - first) if len(wanted) else 0], doc_ids, null, lengths


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, part_bytes: int = 16 << 20) -> DataFrame:
    """Write the ids of all whole texts (null: empty), each document closed by ``end_id``, in ascending doc_id order below ``path``.

    Returns the manifest ``(shard, part, n_ids, n_docs)``, saved. Null doc_ids come first; rows with one doc_id are
    ordered by a hash of their text; repeated rows are written once for each row. Ids are integers or text of integers; other
    text is an error (the files hold 64-bit ids). Other columns are not read; texts of any length are one document. One range shuffle by
    doc_id; each task streams its sorted rows into files of a bounded number of ids, under a temporary
    name that is then renamed, so a task may run again. ``path`` is a folder that all machines share.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    total = narrow.select(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-total // part_bytes)), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        shard, enc = task.partitionId(), encoder(tokenizer_path(tokenizer))
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            ids, keys, null, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{shard:06d}-{len(rows):06d}.pfb"
            with fs.open_output_stream(draft := posixpath.join(base, f"_{name}.{task.taskAttemptId()}")) as f:
                f.write(encode_file(ids, keys, null, lengths))
            fs.move(draft, posixpath.join(base, name))
            rows.append((shard, len(rows), len(ids), len(lengths)))
            held.clear()

        n = 0
        for b in steps(batches, "text", 2 * FILE_IDS):
            ids, cuts = enc.encode(b.column("text"))
            lengths = np.diff(cuts) + 1
            closed = np.insert(ids, cuts[1:], end_id)
            keys = b.column("doc_id")
            if held and n + len(closed) > FILE_IDS:
                flush()
                n = 0
            n += len(closed)
            held.append((closed, keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), lengths))
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, ["shard", "part", "n_ids", "n_docs"])

    return save(map_arrow(dealt.select("doc_id", "text"), run, "shard long, part long, n_ids long, n_docs long"), "token-manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Each document of the files: ``doc_id, start`` (ids of all documents before it)``, n_tokens, ids_crc32`` and, asked for, ``ids``.

    Only the manifest's prefix sums need an order over all files: one narrow row for each file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfb").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                shard, part = map(int, posixpath.basename(name)[:-4].split("-"))
                ids, keys, null, lengths = decode_file(data.as_py())
                cuts = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                m = len(lengths)
                cols = [pa.array(np.full(m, shard)), pa.array(np.full(m, part)), pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(cuts[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["shard", "part", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    out = map_arrow(files, run, "shard long, part long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    before = W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("shard", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return out.join(bases, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the files to the shared folder, read them back, and return the digest of each document."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-files")
    manifest = write_token_files(docs, path, tokenizer)
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, manifest)
