"""Sparse index and batched BM25. Every query is keyed by ``query_id``; one query is a batch of one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X
from pagewright.sources.work import save, spread

#: Query-side rows that may be broadcast; larger batches join by shuffle.
BROADCAST_ROWS = 200_000
#: Query terms that may stand in an expression; more are joined.
LITERAL_TERMS = 20_000


def fits(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``most`` rows. Meant for sides that are cheap to count."""
    return F.broadcast(df) if fits(df, most) else df


def docs_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``chunk_id, dl, input_hash``: every chunk, those without tokens too. No shuffle."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(X.tokens(F.coalesce(text_col, F.lit("")))).cast("long").alias("dl"), X.text_hash(F.col(text_col)).alias("input_hash"))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``term, chunk_id, tf``."""
    words = spread(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col))).select("chunk_id", F.explode(X.tokens(F.col(text_col))).alias("term"))
    return words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def vocab(posts: DataFrame) -> DataFrame:
    """``term, df, total_tf``."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row; chunks without tokens count in the mean length."""
    return docs.agg(F.count("*").alias("doc_count"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def query_terms(queries: DataFrame, text_col: str = "q") -> DataFrame:
    """One row for each place of a term in a query, so repeated terms count as often as they stand there."""
    return queries.select("query_id", F.explode(X.tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def score(terms: DataFrame, posts: DataFrame, df: DataFrame, doc_count: int, avg_dl: float, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """``query_id, chunk_id, score`` of every chunk with a term of the query; unknown terms fall away.

    ``posts``: ``term, chunk_id, tf, dl``; ``df``: ``term, df``. Only the query side is broadcast, and only if it is small.
    """
    k1, b = F.lit(settings.k1), F.lit(settings.b)
    idf = F.log1p((F.lit(doc_count) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weights = terms.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))
    if fits(terms):  # at most as many weights as query terms
        weights = F.broadcast(weights)
    length = F.lit(1.0) - b + b * F.col("dl") / F.lit(avg_dl or 1.0)
    part = F.col("weight") * F.col("tf") * (k1 + F.lit(1.0)) / (F.col("tf") + k1 * length)
    return posts.join(weights, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int, by: str = "score", key: str = "chunk_id") -> DataFrame:
    """The first ``k`` of each query by score, ties by id; scores compare at nine places, as sums depend on their order."""
    w = W.partitionBy("query_id").orderBy(F.round(by, 9).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def matches(chunks: DataFrame, terms: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``chunk_id, dl, hits``: of every chunk its length and its tokens that are terms of a query, in one pass over the texts.

    Up to :data:`LITERAL_TERMS` terms are part of the expression; more meet the words by a join.
    """
    ws = X.tokens(F.coalesce(F.col(text_col), F.lit("")))
    words = terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()
    cut = spread(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col))).select("chunk_id", ws.alias("ws"))
    if len(words) <= LITERAL_TERMS:
        known = [w.term for w in words]
        hits = F.filter("ws", lambda w: w.isin(*known)) if known else F.array().cast("array<string>")
        return cut.select("chunk_id", F.size("ws").cast("long").alias("dl"), hits.alias("hits"))
    cut = save(cut, "tokens")
    met = cut.select("chunk_id", F.explode("ws").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    gathered = met.groupBy("chunk_id").agg(F.collect_list("term").alias("hits"))
    return cut.select("chunk_id", F.size("ws").cast("long").alias("dl")).join(gathered, "chunk_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def search(queries: DataFrame, chunks: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text", settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Queries over chunks without a stored index: the texts are read once, into a narrow table that all the rest reads."""
    terms = query_terms(queries)
    met = save(matches(chunks, terms, id_col, text_col), "matches")
    stats = met.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = met.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    posts = met.select("chunk_id", "dl", F.explode("hits").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return ranked(score(terms, posts, df, *stats, settings), k)


def write_index(chunks: DataFrame, root: str, id_col: str = "chunk_id", text_col: str = "text") -> str:
    """The stored index below ``root``: ``postings`` (with each chunk's length, by term), ``docs``, ``vocab``, ``stats``.

    The texts are read once; ``stats`` is written last, so a folder without it is no index.
    """
    ws = X.tokens(F.coalesce(F.col(text_col), F.lit("")))
    cut = save(spread(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col))).select("chunk_id", ws.alias("ws"), X.text_hash(F.col(text_col)).alias("input_hash")), "tokens")
    cut.select("chunk_id", F.size("ws").cast("long").alias("dl"), "input_hash").write.mode("overwrite").parquet(f"{root}/docs")
    words = cut.select("chunk_id", F.size("ws").cast("long").alias("dl"), F.explode("ws").alias("term"))
    posts = words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    posts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/postings")
    read = chunks.sparkSession.read
    vocab(read.parquet(f"{root}/postings")).write.mode("overwrite").parquet(f"{root}/vocab")
    corpus_stats(read.parquet(f"{root}/docs")).write.mode("overwrite").parquet(f"{root}/stats")
    return root


class IndexMissing(LookupError):
    """There is no whole index; a command line ends with :attr:`status`."""

    status = 3


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a stored index."""
    try:
        found = {name: spark.read.parquet(f"{root}/{name}") for name in ("postings", "docs", "vocab", "stats")}
    except AnalysisException as e:
        raise IndexMissing(root) from e
    if found["stats"].limit(1).count() == 0:
        raise IndexMissing(root)
    return found


def search_index(queries: DataFrame, index: dict[str, DataFrame], k: int, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Queries over a stored index: postings are stored in order of term, so those of other terms are skipped by their statistics."""
    terms = query_terms(queries)
    stats = index["stats"].first()
    posts = index["postings"].join(small(terms.select("term").distinct()), "term", "left_semi")
    df = index["vocab"].join(small(terms.select("term").distinct()), "term", "left_semi").select("term", "df")
    return ranked(score(terms, posts, df, stats["doc_count"], stats["avg_dl"], settings), k)
