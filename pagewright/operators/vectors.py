"""Vectors: cosine, pooling, exact nearest neighbours and the blocked pair join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.sources.work import save

#: Vectors of one block: a block pair is one task's matrix product, so this bounds memory and output.
BLOCK = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing vector, other lengths or a zero norm."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(F.coalesce(dot(a, b) / size, F.lit(0.0)))


def mean_pool(rows: DataFrame, key: str, vector: str = "vector", unit: bool = True) -> DataFrame:
    """The mean of each key's vectors, scaled to length 1; sums per dimension are combined on the map side."""
    each = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    length = norm(F.col("vector"))
    return pooled.withColumn("vector", F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector"))) if unit else pooled


def cached(candidates: DataFrame, cache: DataFrame, model: str, scheme: str) -> DataFrame:
    """Candidates (input_hash, ...) with the ``vector`` that the cache (model, scheme, input_hash, vector) has for their very text, null on a miss.

    A text's vector is stored once; of repeated rows any one is taken. The misses are what ``models.embed_missing`` has to embed.
    """
    mine = cache.filter((F.col("model") == model) & (F.col("scheme") == scheme)).select("input_hash", "vector").dropDuplicates(["input_hash"])
    return candidates.join(mine, "input_hash", "left")


def nearest(queries: DataFrame, items: DataFrame, k: int, last_first: bool = False) -> DataFrame:
    """The ``k`` items with the largest cosine to each query, exact: ``query_id, item_id, cosine``.

    Queries are dealt to blocks and held a block at a time against Arrow batches of all items, so there is no row for each pair: a
    batch gives at most ``k`` rows a query, and these meet in a top-k aggregation. Ties go to the smaller item_id, or to
    the larger one with ``last_first`` (L03).
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    kind = items.schema["item_id"].dataType.simpleString()
    parts = []
    for block in range(blocks):
        rows = sorted(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "vector").collect(), key=lambda r: r.query_id)
        if not rows:
            continue
        ids, mine = [r.query_id for r in rows], np.array([r.vector for r in rows], np.float64)
        mine /= np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-300)

        def run(batches, ids=ids, mine=mine):
            for pdf in batches:
                if pdf.empty:
                    continue
                x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                cos = np.round(mine @ x.T, 12)
                item = pdf["item_id"].to_numpy()
                turn = np.argsort(np.argsort(item, kind="stable"), kind="stable")
                order = np.lexsort((np.broadcast_to(-turn if last_first else turn, cos.shape), -cos), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "item_id": item[order].ravel(), "cosine": np.take_along_axis(cos, order, 1).ravel()})

        parts.append(items.select("item_id", "vector").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {kind}, cosine double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {kind}, cosine double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col("item_id").desc() if last_first else "item_id")
    return out.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def similar_pairs(items: DataFrame, floor: float, block: int = BLOCK) -> DataFrame:
    """All pairs ``a < b`` with a cosine of at least ``floor``, exact.

    Items are dealt to blocks; each pair of blocks is one matrix product in one task. An item is sent once for each
    block, so the work is the square over the block size and no task holds more than two blocks. Zero vectors pair with nothing.
    """
    count = items.count()
    blocks = max(1, -(-count // block))
    kind = items.schema["item_id"].dataType.simpleString()
    home = items.select("item_id", "vector").withColumn("home", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    sent = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"lo": F.least("home", "other"), "hi": F.greatest("home", "other")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        left = pdf[pdf["home"] == lo].drop_duplicates("item_id")
        right = left if lo == hi else pdf[pdf["home"] == hi].drop_duplicates("item_id")
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series(dtype=pdf["item_id"].dtype), "b": pd.Series(dtype=pdf["item_id"].dtype), "cosine": pd.Series(dtype="float64")})
        x, y = np.stack(left["vector"].to_numpy()).astype(np.float64), np.stack(right["vector"].to_numpy()).astype(np.float64)
        x /= np.where(n := np.linalg.norm(x, axis=1, keepdims=True), n, 1)
        y /= np.where(n := np.linalg.norm(y, axis=1, keepdims=True), n, 1)
        cos = x @ y.T
        i, j = np.nonzero(cos >= floor)
        a, b = left["item_id"].to_numpy()[i], right["item_id"].to_numpy()[j]
        keep = a < b if lo == hi else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": cos[i, j][keep]})

    return sent.groupBy("lo", "hi").applyInPandas(run, f"a {kind}, b {kind}, cosine double")


#: Cosines at nine places as whole numbers from 0 (-1) to 2 * UNIT (1); those that are NaN (a zero vector) and null (a missing one) come last, as in SQL.
UNIT, SHIFT = 1_000_000_000, 16
NAN, NULL, SKIPPED = ((((2 * UNIT) >> SHIFT) + i) << SHIFT for i in (1, 2, 3))
#: Rows of a block that meet another block at a time, and blocks that meet one block in a task.
STRIP, MEET = 500, 16


def packed(items: DataFrame, skip: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``items`` (item_id, vector) as saved rows of about ``block`` unit vectors each, and the number of blocks.

    With each block go the pairs of ``skip`` (a, b) that one of its items is in, so that no pair has to be joined with them later.
    """
    items = items.filter("item_id IS NOT NULL")
    blocks = max(1, -(-items.count() // block))
    home = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int").alias("block")
    rows = items.select(home("item_id"), F.col("item_id").cast("long").alias("item"), "vector", F.lit(0).cast("long").alias("other"), F.lit(True).alias("own"))
    for a, b in (("a", "b"), ("b", "a")):
        rows = rows.unionByName(skip.filter("a IS NOT NULL AND b IS NOT NULL").select(home(a), F.col(a).cast("long").alias("item"), F.lit(None).cast("array<double>").alias("vector"), F.col(b).cast("long").alias("other"), F.lit(False).alias("own")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine, away = pdf[pdf["own"]], pdf[~pdf["own"]]
        mine = mine.drop_duplicates("item").sort_values("item")
        ids, lost = mine["item"].to_numpy(np.int64), mine["vector"].isna().to_numpy()
        size = max((len(v) for v in mine["vector"][~lost]), default=0)
        x = np.zeros((len(ids), size))
        if size:
            x[~lost] = np.stack(mine["vector"][~lost].to_numpy())
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(length, length, 1)
        state = np.where(lost, 2, length[:, 0] == 0).astype(np.int8)
        at = np.searchsorted(ids, away["item"].to_numpy(np.int64))
        here = at < len(ids)
        here[here] = ids[at[here]] == away["item"].to_numpy(np.int64)[here]
        return pd.DataFrame({"block": [key[0]], "ids": [ids.tobytes()], "x": [x.tobytes()], "state": [state.tobytes()], "at": [at[here].astype(np.int64).tobytes()], "other": [away["other"].to_numpy(np.int64)[here].tobytes()]})

    return save(rows.groupBy("block").applyInPandas(pack, "block int, ids binary, x binary, state binary, at binary, other binary"), "blocks"), blocks


def met(blocks: DataFrame, n: int) -> DataFrame:
    """Each pair of blocks once, as a row, and each block with itself; every block meets about half of the others, so tasks are even."""
    left = blocks.repartitionByRange(n, "block").select([F.col(c).alias(f"l_{c}") for c in blocks.columns])
    right = blocks.repartitionByRange(-(-n // MEET), "block").select([F.col(c).alias(f"r_{c}") for c in blocks.columns])
    gap = F.pmod(F.col("r_block") - F.col("l_block"), F.lit(n)) * 2
    return left.hint("shuffle_replicate_nl").join(right, (gap < n) | ((gap == n) & (F.col("l_block") < F.col("r_block"))))


def strips(batches: Iterator[pa.RecordBatch], focus: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item ids of some rows and of all columns, and the codes of their cosines, SKIPPED where there is no pair."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(batch.schema.get_field_index(c))[row].as_buffer(), kind)  # noqa: B023, E731
            own = batch.column(batch.schema.get_field_index("l_block"))[row] == batch.column(batch.schema.get_field_index("r_block"))[row]
            left, right = get("l_ids", np.int64), get("r_ids", np.int64)
            if not len(left) or not len(right):
                continue
            x, y = get("l_x", np.float64).reshape(len(left), -1), get("r_x", np.float64).reshape(len(right), -1)
            odd_left, odd_right = get("l_state", np.int8), get("r_state", np.int8)
            if x.shape[1] != y.shape[1]:  # a block without any vector
                x, y = np.zeros((len(left), 1)), np.zeros((len(right), 1))
            at, other = get("l_at", np.int64), get("l_other", np.int64)
            to = np.minimum(np.searchsorted(right, other), len(right) - 1)
            at, to = at[right[to] == other], to[right[to] == other]
            places = np.arange(len(left))
            if focus is not None and focus not in right:
                places = places[left == focus]
            for k in range(0, len(places), STRIP):
                some = places[k : k + STRIP]
                code = (np.clip(np.rint((x[some] @ y.T) * UNIT), -UNIT, UNIT) + UNIT).astype(np.int32)
                for state, value in ((1, NAN), (2, NULL)):
                    code[odd_left[some] == state] = value
                    code[:, (odd_right == state)] = np.maximum(code[:, (odd_right == state)], value)
                if own:
                    code[some[:, None] >= np.arange(len(right))] = SKIPPED
                if focus is not None:
                    code[(left[some][:, None] != focus) & (right != focus)] = SKIPPED
                inside = (at >= some[0]) & (at <= some[-1])
                if focus is not None:
                    inside &= np.isin(at, some)
                code[np.searchsorted(some, at[inside]), to[inside]] = SKIPPED
                yield left[some], right, code


def cosine_counts(pairs: DataFrame, focus: int | None, bins: list[int] | None = None) -> list[tuple[int, int]]:
    """How many pairs there are of each bin of codes, in order; with ``bins``, of each code of these bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 0 if bins else SHIFT
        found = {b << SHIFT: np.zeros(1 << SHIFT, np.int64) for b in bins} if bins else {0: np.zeros((SKIPPED >> SHIFT) + 1, np.int64)}
        for _, _, code in strips(batches, focus):
            code = code.ravel()
            for start, counts in found.items():
                counts += np.bincount(code[(code >> SHIFT) == (start >> SHIFT)] - start if bins else code >> shift, minlength=len(counts))
        for start, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at + start, pa.int64()), pa.array(counts[at], pa.int64())], ["code", "n"])

    rows = pairs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return sorted((r["code"], r["n"]) for r in rows if r["code"] != SKIPPED >> SHIFT or bins)


def element(counts: list[tuple[int, int]], place: int) -> tuple[int, int]:
    """The code at ``place``, and the place among those of this code."""
    for code, n in counts:
        if place < n:
            return code, place
        place -= n
    raise IndexError(place)


def pair_band(items: DataFrame, skip: DataFrame, lo: int, hi: int, focus: int | None = None, block: int = BLOCK) -> DataFrame:
    """``a, b, cosine`` of the pairs ``a < b`` that are not in ``skip``, and with ``focus``, if given, whose cosine lies between two percentiles of all these pairs.

    Exact, though no pair is stored: the cosines, at nine places, are counted by coarse bins, then within the bins that hold the two
    elements, then the pairs between these are given out. Each is a pass over the pairs of packed blocks; what is
    saved grows with the items. Pairs without a cosine count last, as in SQL, and a band that would end among null ones has no rows.
    """
    blocks, n = packed(items, skip, block)
    pairs = met(blocks, n)
    coarse = cosine_counts(pairs, focus)
    total = sum(c for _, c in coarse)
    kind = "a long, b long, cosine double"
    if not total:
        return items.sparkSession.createDataFrame([], kind)
    bins = [element(coarse, int(p / 100 * (total - 1))) for p in (lo, hi)]
    fine = cosine_counts(pairs, focus, sorted({b for b, _ in bins}))
    low, high = (element([x for x in fine if x[0] >> SHIFT == b], place)[0] for b, place in bins)
    if NULL in (low, high):
        return items.sparkSession.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, code in strips(batches, focus):
            i, j = np.nonzero((code >= low) & (code <= high))
            a, b, c = left[i], right[j], code[i, j]
            cosine = np.where(c == NAN, np.nan, (c.astype(np.int64) - UNIT) / UNIT)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine)], ["a", "b", "cosine"])

    return pairs.mapInArrow(run, kind)
