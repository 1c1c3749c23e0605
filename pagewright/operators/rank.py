"""Fusion, score rules, dedupe, cap and cut: what happens to candidates after the sparse pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.operators.bm25 import small
from pagewright.operators.vectors import nearest


def z_scores(cosines: DataFrame) -> DataFrame:
    """``z`` of each cosine in its query's pool for its model, summed in order of arrival (``ord`` if given, else by chunk).

    Opposite z-scores cancel to 0 or to a residue of some 1e-17, by the order in which mean and deviation are summed, and
    :func:`compact_score` asks for 0. So the order is fixed, not that of partitions, and each step is that of the SQL's engine.
    """
    arrival = [c for c in ("ord", "chunk_id") if c in cosines.columns]
    rows = F.array_sort(F.collect_list(F.struct(*arrival, *[c for c in cosines.columns if c not in (*arrival, "query_id", "model")])))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "sum", "mean", "squares")])

    def add(s: Column, row: Column) -> Column:
        x, n = row["cosine"], s["n"] + F.lit(1.0)
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), (s["sum"] + x).alias("sum"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    pools = cosines.groupBy("query_id", "model").agg(rows.alias("rows")).withColumn("s", F.aggregate("rows", start, add))
    deviation = F.sqrt(F.col("s.squares") / F.col("s.n"))
    pools = pools.select("query_id", "model", "rows", (F.col("s.sum") / F.col("s.n")).alias("avg"), F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias("dev"))
    each = pools.select("query_id", "model", "avg", "dev", F.inline("rows"))
    return each.withColumn("z", (F.col("cosine") - F.col("avg")) / F.col("dev")).drop("avg", "dev")


def fuse(candidates: DataFrame, cosines: DataFrame) -> DataFrame:
    """``rerank_score``, ``rerank_source`` and the raw ``cosine`` map of each (query_id, chunk_id).

    ``cosines``: (query_id, chunk_id, model, cosine), missing vectors absent. With one model the score is the raw cosine; with
    several, the mean of z-scores over the models present (population deviation, 0 taken as 1). A
    candidate without a vector keeps 0 and says so.
    """
    models = F.size(F.collect_set("model").over(W.partitionBy("query_id")))
    scored = z_scores(cosines).withColumn("models", models)
    each = scored.groupBy("query_id", "chunk_id").agg(F.when(F.max("models") == 1, F.avg("cosine")).otherwise(F.avg("z")).alias("fused"), F.map_from_entries(F.collect_list(F.struct("model", F.round("cosine", 4)))).alias("cosine"))
    joined = candidates.join(each, ["query_id", "chunk_id"], "left")
    return joined.withColumn("rerank_source", F.when(F.col("fused").isNull(), "missing-chunk").otherwise("cosine")).withColumn("rerank_score", F.coalesce("fused", F.lit(0.0))).drop("fused")


def history_prior(score: Column, page: Column, weight: float = C.DEFAULTS.fold_weight, prefix: str = "wiki/folds/") -> Column:
    """Pages of history lose a share of their score's size; weight 1 changes nothing."""
    return score if weight == 1 else F.when(page.startswith(prefix), score - F.lit(1.0 - weight) * F.abs(score)).otherwise(score)


def base_score(source: Column, rerank: Column, bm25: Column, weight: float = C.DEFAULTS.fold_weight) -> Column:
    """Without a reranker the prior works on the BM25 score, but only where the prior does anything."""
    return rerank if weight == 1 else F.when(source.startswith("noop"), bm25).otherwise(rerank)


def compact_score(rerank: Column, bm25: Column) -> Column:
    """The first of both that is neither null nor 0, else 0."""
    some = lambda c: F.when(c != 0, c)
    return F.coalesce(some(rerank), some(bm25), F.lit(0.0))


def dedupe(rows: DataFrame, key: str, score: str = "score", arrival: str = "ord") -> DataFrame:
    """The best row of each key in a query; the first to arrive wins ties."""
    w = W.partitionBy("query_id", key).orderBy(F.col(score).desc(), F.col(arrival))
    return rows.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def cap_and_cut(rows: DataFrame, top: int = C.DEFAULTS.top, cap: int = C.DEFAULTS.per_page_cap, page: str = "page_path", score: str = "score", arrival: str = "ord") -> DataFrame:
    """At most ``cap`` rows a page (0: any), then the first ``top``; a capped slot is filled by the next row."""
    if cap > 0:
        w = W.partitionBy("query_id", page).orderBy(F.col(score).desc(), F.col(arrival))
        rows = rows.withColumn("_turn", F.row_number().over(w)).filter(F.col("_turn") <= cap).drop("_turn")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(arrival))).cast("long")).filter(F.col("rank") <= top)


def dense_interleave(nearest: DataFrame, k: int) -> DataFrame:
    """The models' lists in turns (``query_id, model_order, place, chunk_id``), each chunk once, ``k`` a query."""
    first = W.partitionBy("query_id", "chunk_id").orderBy("place", "model_order")
    once = nearest.withColumn("_turn", F.row_number().over(first)).filter("_turn = 1").drop("_turn")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place", "model_order")).cast("long")).filter(F.col("rank") <= k)


def dense_fill(pool: DataFrame, models: list[tuple[DataFrame, DataFrame]], live: DataFrame, k: int = C.DEFAULTS.bm25_top) -> DataFrame:
    """``query_id, chunk_id, rank`` of the chunks that fill each query's pool up to ``k``.

    ``pool``: (query_id, chunk_id), the sparse hits. ``models``: for each its query vectors (query_id, vector) and its indexed chunks (item_id,
    input_hash, vector), one row a chunk. ``live``: (chunk_id, input_hash) of the chunks as they are now; an indexed chunk with another hash
    is stale and stays out before places are counted. A query gets ``k`` less its hits; one without hits, or with ``k`` or more, gets none.
    Of chunks that are equally near the larger id comes first (L03). Of a model's ``k`` nearest at most the hits are in the pool already, so those left are enough.
    """
    have = pool.select("query_id", "chunk_id").distinct()
    need = have.groupBy("query_id").agg((F.lit(k) - F.count("*")).alias("need")).filter("need > 0")
    lists = None
    for order, (queries, items) in enumerate(models):
        fresh = items.join(small(live.select(F.col("chunk_id").alias("item_id"), "input_hash").distinct()), ["item_id", "input_hash"], "left_semi")
        part = nearest(queries.join(need, "query_id", "left_semi"), fresh, k, last_first=True).withColumnRenamed("item_id", "chunk_id").join(have, ["query_id", "chunk_id"], "left_anti")
        again = W.partitionBy("query_id").orderBy("place")
        part = part.select("query_id", "chunk_id", F.row_number().over(again).alias("place"), F.lit(order).alias("model_order"))
        lists = part if lists is None else lists.unionByName(part)
    return dense_interleave(lists, k).join(need, "query_id").filter(F.col("rank") <= F.col("need")).select("query_id", "chunk_id", "rank")


def reassign_slots(rows: DataFrame, top: int = C.DEFAULTS.ce_top, mode: str = "fuse") -> DataFrame:
    """The best ``top`` rows (not those without a chunk) are ordered anew by the pair scorer; they share out their own scores again.

    ``rows``: (query_id, chunk_id, score, ce, missing). ``only`` orders by the scorer's z-score, ``fuse`` by the mean of both.
    """
    order = W.partitionBy("query_id").orderBy("missing", F.col("score").desc(), "chunk_id")
    placed = rows.withColumn("slot", F.row_number().over(order)).withColumn("listed", (F.col("slot") <= top) & ~F.col("missing"))
    listed = placed.filter("listed")
    pool = W.partitionBy("query_id")

    def z(c: str) -> Column:
        d = F.stddev_pop(c).over(pool)
        return (F.col(c) - F.avg(c).over(pool)) / F.when(d == 0, F.lit(1.0)).otherwise(d)

    mixed = z("ce") if mode == "only" else (z("score") + z("ce")) / F.lit(2.0)
    turned = listed.withColumn("mixed", F.round(mixed, 9)).withColumn("turn", F.row_number().over(pool.orderBy(F.col("mixed").desc(), "slot")))
    slots = listed.select("query_id", F.col("slot").alias("turn"), F.col("score").alias("given"))
    dealt = turned.join(slots, ["query_id", "turn"]).select("query_id", "chunk_id", F.col("given").alias("new_score"))
    return placed.join(dealt, ["query_id", "chunk_id"], "left").withColumn("new_score", F.coalesce("new_score", "score")).select("query_id", "chunk_id", "score", "ce", "missing", "new_score")
