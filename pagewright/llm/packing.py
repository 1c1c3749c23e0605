"""Operator 3, best-fit packing with certified bounds and repacking between partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import map_arrow, save, spread, steps
from pagewright.llm.encoding import encoder, tokenizer_path

#: Pieces that one partition packs at most (in the mean): bounds a task's memory and time.
PART_PIECES = 30_000
#: Exchanges at most. Each leaves a small share of the pieces in play, so three reach one partition from any size.
ROUNDS = 4


def pieces_of(docs: DataFrame, size: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """The pieces of each document: only longer ones are cut, and only the first piece may be shorter than ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for b in steps(batches, "text", 16 << 20):
            ids, cuts = enc.encode(b.column("text"))
            raw = memoryview(np.insert(ids, cuts[1:], end_id).astype("<u4").tobytes())
            n = np.diff(cuts) + 1
            base = np.concatenate(([0], np.cumsum(n)))[:-1]
            count = -(-n // size)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - (count - 1) * size)[row]
            start = np.where(piece == 0, 0, first + (piece - 1) * size)
            length = np.where(piece == 0, first, size)
            low = (base[row] + start).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(low, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select("doc_id", "text")
    return map_arrow(spread(narrow), run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset. Ties keep the order given.

    Open bins are kept by room left; a bit set of the rooms in use gives the tightest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, made = 0, 0
    for i in order.tolist():
        x = int(lengths[i])
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - room
        left = room - x
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of dual feasible functions over the lengths.

    Two families, with u = x / size. Rounding by k: (k + 1) u if whole, as u, else floor((k + 1) u) / k.
    Threshold by a: 1 above 1 - a, 0 below a, u between.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // size)
    for k in range(1, 33):
        whole = (k + 1) * x % size == 0
        scaled = np.where(whole, x * k, (k + 1) * x // size * size)  # times k * size
        best = max(best, -(-int((n * scaled).sum()) // (k * size)))
    count, mass = np.cumsum(n[::-1])[::-1], np.cumsum(n * x)
    a = np.arange(1, size // 2 + 1)
    large = np.where(size - a + 1 <= size, count[np.minimum(size - a + 1, size)], 0)
    between = mass[size - a] - mass[a - 1]
    return max(best, int((large + -(-between // size)).max()) if len(a) else 0)


def pack(pieces: DataFrame, size: int = 2048, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Give each piece (any columns with ``length``, 1 to ``size``) a ``sequence_id``, an ``offset`` in it, and the ``gap`` of its partition.

    The gap is how many bins the partition's pieces that stay there take beyond their lower bound; 0 certifies that they cannot be fewer.

    Pieces are dealt to partitions of bounded size by a hash, and best-fit decreasing packs each. A
    dual-feasible lower bound certifies a partition whose bins it equals. Others release their
    emptiest bins, as many as have twice the surplus as room; the released documents of all partitions are dealt
    anew to as few partitions as hold them and packed again, and the new packing stays where it
    needs fewer bins. This goes on until no partition has a gap, one partition held all, or ``rounds`` are over.
    Only narrow rows move; no partition depends on the corpus size. An empty table gives no rows.
    """
    state = save(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    columns = pieces.columns
    full = state.filter(F.col("length") == size).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")})
    moving = state.filter(F.col("length") < size).withColumns({"old": F.lit(None).cast("long"), "at": F.lit(None).cast("long")})
    out_columns = [*columns, "sequence_id", "offset", "gap"]
    done = [full.select(*out_columns)]
    waiting = moving.count()
    schema = moving.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long"), "release": F.lit(False)}).schema

    def run(key: tuple, pdf: pd.DataFrame, turn: int) -> pd.DataFrame:
        pdf = pdf.drop(columns="part").sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, size)
        made, bound = int(bins.max()) + 1, lower_bound(lengths, size)
        ids = (turn << 56) | (1 << 55) | (int(key[0]) << 24) | bins
        if turn and pdf["old"].nunique() <= made:
            ids, offsets, made = pdf["old"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), int(pdf["old"].nunique())
        pdf["sequence_id"], pdf["offset"], pdf["release"] = ids, offsets, False
        if made > bound:
            room = (size - pdf.groupby("sequence_id")["length"].sum()).sort_values(ascending=False, kind="stable")
            enough = int(np.searchsorted(np.cumsum(room.to_numpy()), 2 * size * (made - bound))) + 1
            pdf["release"] = pdf["sequence_id"].isin(room.index[: max(2, min(enough, int((room > 0).sum())))])
        kept = ~pdf["release"].to_numpy()
        pdf["gap"] = max(0, pdf["sequence_id"].nunique() - bound)
        if pdf["release"].any() and kept.any():  # what stays is judged on its own
            pdf.loc[kept, "gap"] = max(0, pdf.loc[kept, "sequence_id"].nunique() - lower_bound(lengths[kept], size))
        return pdf[[f.name for f in schema]]

    def packer(turn: int):
        return lambda key, pdf: run(key, pdf, turn)

    for turn in range(rounds + 1):
        if not waiting:
            break
        parts = -(-waiting // part_pieces)
        dealt = moving.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        packed = save(dealt.groupBy("part").applyInPandas(packer(turn), schema), "packed")
        last = turn == rounds or parts == 1
        done.append((packed if last else packed.filter("not release")).select(*out_columns))
        if last:
            break
        moving = packed.filter("release").select(*columns, "uid", F.col("sequence_id").alias("old"), F.col("offset").alias("at"))
        waiting = moving.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Pack whole documents (null text: empty, one end id) into sequences of ``size`` tokens; one row a piece.

    Null doc_ids stay null and repeated rows are packed once for each row; other columns are not read. ``certified``: the
    sequence stands in a partition whose packing is proven to be the best (:func:`pack`).
    """
    packed = pack(pieces_of(docs, size, tokenizer), size).withColumn("certified", F.col("gap") == 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap", "certified")
