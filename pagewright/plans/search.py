"""Index, BM25, vectors, fusion and ranking over the plain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X
from pagewright.operators import bm25 as B
from pagewright.operators import rank as R
from pagewright.operators import vectors as V
from pagewright.sources import corpus as S
from pagewright.sources.work import save, shared_dir

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


STOP = "[" + ", ".join("'" + w + "'" for w in C.STOPWORDS) + "]"
_PATTERN = C.TOKEN.replace("'", "''")


def tok_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{_PATTERN}'), lambda x: lower(x)), lambda x: len(x) > 1 AND NOT list_contains({STOP}, x))"


#: Tokens, term counts, lengths and BM25 scores of benchmark queries, as the head of a WITH clause.
BM25_SQL = f"""
toks AS (SELECT doc_id, {tok_sql("text")} AS ws FROM documents),
dl AS (SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS dl FROM toks),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM toks) GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl),
qt AS (SELECT item_id AS query_id, w, count(*) AS times FROM (SELECT item_id, unnest({tok_sql("text")}) AS w FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT query_id, tf.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS score
  FROM qt JOIN tf USING (w) JOIN df USING (w) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY 1, 2),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
"""


def queries_of(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def chunks_of(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def pool(s: SparkSession, d: str, k: int = C.DEFAULTS.bm25_top) -> DataFrame:
    """The first ``k`` chunks of each query, saved: what is built on them reads them several times."""
    return save(B.search(queries_of(s, d), chunks_of(s, d), k), "pool").withColumnRenamed("chunk_id", "doc_id")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(s, d):
    """J01 J02 A04 L01 L02."""
    return pool(s, d, C.DEFAULTS.top).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_stored_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def bm25_stored_topk(s, d):
    """The same from an index that is written, read back and searched."""
    index = B.read_index(s, B.write_index(chunks_of(s, d), shared_dir(s, "index")))
    return B.search_index(queries_of(s, d), index, C.DEFAULTS.top).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("bm25_index_vocab", f"WITH {BM25_SQL} SELECT w AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY 1")
def bm25_index_vocab(s, d):
    """A01 A02."""
    return B.vocab(B.postings(chunks_of(s, d)))


@query("bm25_index_docs", f"WITH {BM25_SQL} SELECT doc_id AS chunk_id, dl, 'sha256:' || sha256(text) AS input_hash FROM dl JOIN documents USING (doc_id)")
def bm25_index_docs(s, d):
    """A03."""
    return B.docs_index(chunks_of(s, d))


@query("bm25_stats", f"WITH {BM25_SQL} SELECT (SELECT n FROM st) AS doc_count, (SELECT round(avg_dl, 6) FROM st) AS avg_dl, (SELECT count(*) FROM df) AS terms, (SELECT count(*) FROM tf) AS postings")
def bm25_stats(s, d):
    """A05."""
    voc = B.vocab(B.postings(chunks_of(s, d))).agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return B.corpus_stats(B.docs_index(chunks_of(s, d))).withColumn("avg_dl", F.round("avg_dl", 6)).crossJoin(voc)


@query("tokenize_terms", f"WITH {BM25_SQL} SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ws)) AS BIGINT) AS n_terms, sha256(array_to_string(ws, ' ')) AS digest FROM toks")
def tokenize_terms(s, d):
    """P17."""
    t = S.table(s, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("ws"))
    return t.select("doc_id", F.size("ws").cast("long").alias("n_tokens"), F.size(F.array_distinct("ws")).cast("long").alias("n_terms"), F.sha2(F.array_join("ws", " "), 256).alias("digest"))


def digest_of(rows: DataFrame, line) -> DataFrame:
    """A stable digest in two levels, so that no row holds the corpus: 256 buckets by the line's own hash, then their digests in order."""
    hashed = rows.select(F.sha2(line, 256).alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    part = hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"))
    return part.agg(F.sum("n").alias("n"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "p"))), ""), 256), 1, 16).alias("digest"))


def _digest_sql(head: str, line: str, source: str) -> str:
    return f"""WITH {head} h AS (SELECT sha256({line}) AS h FROM {source}), p AS (SELECT substr(h, 1, 2) AS bucket, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, substr(sha256(string_agg(bucket || p, '' ORDER BY bucket || p)), 1, 16) AS digest FROM p"""


@query("index_digest", _digest_sql(BM25_SQL + ",", "CAST(doc_id AS VARCHAR) || '|' || 'sha256:' || sha256(text) || '|' || CAST(dl AS VARCHAR)", "(SELECT * FROM dl JOIN documents USING (doc_id))"))
def index_digest(s, d):
    """The index by (id, input hash, length)."""
    return digest_of(B.docs_index(chunks_of(s, d)), F.concat_ws("|", F.col("chunk_id").cast("string"), "input_hash", F.col("dl").cast("string")))


@query("corpus_digest", _digest_sql(S.PAGES_SQL + ",", "page_path || '|' || sha256(raw)", "pages1"))
def corpus_digest(s, d):
    """The pages by (path, bytes)."""
    return digest_of(S.pages(s, d), F.concat_ws("|", "page_path", F.sha2("raw", 256)))


# Vectors: two models are the halves of the embedding; queries are the mean vectors of the labels.
def vectors(s: SparkSession, d: str, lo: int = 1, n: int = 64) -> DataFrame:
    return S.table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice(F.transform("embedding", lambda x: x.cast("double")), lo, n).alias("vector"), "label")


VEC_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, list_slice(CAST(embedding AS DOUBLE[]), 1, 32) AS va, list_slice(CAST(embedding AS DOUBLE[]), 33, 64) AS vb FROM embeddings)
"""
POOL_SQL = (
    VEC_SQL
    + """,
dims AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY 1, 2),
means AS (SELECT label, list(x ORDER BY i) AS m FROM dims GROUP BY 1)
"""
)


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


@query("page_vector_pool", f"WITH {POOL_SQL} SELECT label, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(list_sum(m) / sqrt(list_dot_product(m, m)), 6) AS total FROM means")
def page_vector_pool(s, d):
    """A09."""
    p = V.mean_pool(vectors(s, d), "label")
    return p.select("label", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def label_queries(s: SparkSession, d: str) -> DataFrame:
    return V.mean_pool(vectors(s, d), "label").withColumnRenamed("label", "query_id")


@query("cosine_topk", f"WITH {POOL_SQL}, c AS (SELECT label AS query_id, e.vec_id AS item_id, {_cos('m', 'v')} AS cosine FROM means CROSS JOIN (SELECT vec_id, v FROM e) e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, item_id) AS place FROM c) SELECT query_id, item_id, round(cosine, 6) AS cosine, place FROM r WHERE place <= 10")
def cosine_topk(s, d):
    """J04 G09."""
    return V.nearest(label_queries(s, d), vectors(s, d), 10).select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), "place")


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Each benchmark query's BM25 pool with its place of arrival."""
    return pool(s, d).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("score").alias("bm25_score"), F.col("rank").alias("ord"))


def cosines(s: SparkSession, d: str, cand: DataFrame, models: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Cosines of candidates with the vector of the same id, per model; a query's vector is that of its own id. Missing vectors stay out."""
    half = {"a": (1, 32), "b": (33, 32)}
    out = None
    for m in models:
        v = vectors(s, d, *half[m])
        one = cand.join(v.select(F.col("item_id").alias("chunk_id"), F.col("vector").alias("x")), "chunk_id").join(B.small(v.select(F.col("item_id").alias("query_id"), F.col("vector").alias("y"))), "query_id")
        one = one.select("query_id", "chunk_id", "ord", F.lit(m).alias("model"), V.cosine(F.col("x"), F.col("y")).alias("cosine"))
        out = one if out is None else out.unionByName(one)
    return out


FUSE_SQL = f"""{BM25_SQL}, {VEC_SQL},
cand AS (SELECT query_id, doc_id AS chunk_id, score AS bm25, rank AS ord FROM ranked WHERE rank <= 20),
cs AS (SELECT c.query_id, c.chunk_id, {_cos('x.va', 'y.va')} AS ca, {_cos('x.vb', 'y.vb')} AS cb FROM cand c JOIN e x ON x.vec_id = c.chunk_id JOIN e y ON y.vec_id = c.query_id),
zs AS (SELECT query_id, chunk_id, ca, cb, (ca - avg(ca) OVER w) / coalesce(nullif(stddev_pop(ca) OVER w, 0), 1) AS za, (cb - avg(cb) OVER w) / coalesce(nullif(stddev_pop(cb) OVER w, 0), 1) AS zb FROM cs WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT cand.*, coalesce((za + zb) / 2, 0) AS rerank, CASE WHEN za IS NULL THEN 'missing-chunk' ELSE 'cosine' END AS source, ca, cb FROM cand LEFT JOIN zs USING (query_id, chunk_id))
"""


def fused(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d)
    return R.fuse(c, cosines(s, d, c))


@query("fused_zscore", f"WITH {FUSE_SQL} SELECT query_id, chunk_id, round(rerank, 6) AS rerank_score, source AS rerank_source, round(ca, 4) AS cos_a FROM fused")
def fused_zscore(s, d):
    """A06 A07 A08 W09 T19."""
    return fused(s, d).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_source", F.col("cosine")["a"].alias("cos_a"))


@query("history_prior", f"WITH {FUSE_SQL} SELECT query_id, chunk_id, round(CASE WHEN chunk_id % 9 = 0 THEN rerank - 0.05 * abs(rerank) ELSE rerank END, 6) AS reranked, round(CASE WHEN chunk_id % 9 = 0 THEN bm25 - 0.05 * abs(bm25) ELSE bm25 END, 6) AS noop, round(bm25, 6) AS skipped FROM fused")
def history_prior(s, d):
    """The prior on fused scores, on BM25 where nothing reranked, and the scores of the mode without reranking."""
    f = fused(s, d).withColumn("page", F.when(F.col("chunk_id") % 9 == 0, "wiki/folds/x.md").otherwise("wiki/x.md"))
    w = C.DEFAULTS.fold_weight
    prior = lambda source: R.history_prior(R.base_score(F.lit(source), F.col("rerank_score"), F.col("bm25_score"), w), F.col("page"), w)
    return f.select("query_id", "chunk_id", F.round(prior("cosine"), 6).alias("reranked"), F.round(prior("noop-no-embedder"), 6).alias("noop"), F.round("bm25_score", 6).alias("skipped"))


HYBRID_SQL = f"""{FUSE_SQL},
prior AS (SELECT *, 'wiki/p' || CAST(chunk_id % 40 AS VARCHAR) || '.md' AS page_path, round(CASE WHEN chunk_id % 40 = 9 THEN rerank - 0.05 * abs(rerank) ELSE rerank END, 9) AS score FROM fused),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, ord) AS turn FROM prior),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_path ORDER BY score DESC, ord) AS on_page FROM dd WHERE turn = 1),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS place FROM capped WHERE on_page <= 2)
"""


def hybrid(s: SparkSession, d: str) -> DataFrame:
    """The whole order of operations: pool, fusion, prior, dedupe by chunk, cap by page, cut."""
    f = fused(s, d).withColumn("page_path", F.concat(F.lit("wiki/p"), (F.col("chunk_id") % 40).cast("string"), F.lit(".md")))
    f = f.withColumn("score", F.round(R.history_prior(F.col("rerank_score"), F.col("page_path"), C.DEFAULTS.fold_weight, "wiki/p9."), 9))
    return R.cap_and_cut(R.dedupe(f, "chunk_id"))


@query("hybrid_topk", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, page_path, round(score, 6) AS score, source AS strategy, place AS rank FROM final WHERE place <= 5")
def hybrid_topk(s, d):
    return hybrid(s, d).select("query_id", "chunk_id", "page_path", F.round("score", 6).alias("score"), F.col("rerank_source").alias("strategy"), "rank")


@query("page_dedupe", f"WITH {HYBRID_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_path ORDER BY score DESC, ord) AS t FROM prior) SELECT query_id, page_path, chunk_id, round(score, 6) AS score FROM one WHERE t = 1")
def page_dedupe(s, d):
    """A10: page mode."""
    f = fused(s, d).withColumn("page_path", F.concat(F.lit("wiki/p"), (F.col("chunk_id") % 40).cast("string"), F.lit(".md")))
    f = f.withColumn("score", F.round(R.history_prior(F.col("rerank_score"), F.col("page_path"), C.DEFAULTS.fold_weight, "wiki/p9."), 9))
    return R.dedupe(f, "page_path").select("query_id", "page_path", "chunk_id", F.round("score", 6).alias("score"))


@query("per_page_cap", f"WITH {BM25_SQL}, p AS (SELECT query_id, doc_id, score, rank, doc_id % 5 AS page FROM ranked WHERE rank <= 20), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY rank) AS t FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c WHERE t <= 2) SELECT query_id, doc_id, page, place AS rank FROM f WHERE place <= 5")
def per_page_cap(s, d):
    """A capped slot is filled again."""
    p = pool(s, d).withColumn("page", F.col("doc_id") % 5).withColumn("ord", F.col("rank")).withColumn("score", F.round("score", 9)).drop("rank")
    return R.cap_and_cut(p, page="page").select("query_id", "doc_id", "page", "rank")


@query("result_compact", f"WITH {HYBRID_SQL}, g AS (SELECT * FROM final JOIN documents d ON d.doc_id = final.chunk_id WHERE place <= 5) SELECT query_id, chunk_id, round(coalesce(nullif(rerank, 0), nullif(bm25, 0), 0), 3) AS score, CASE WHEN len(text) > 200 THEN rtrim(substr(text, 1, 200), ' ') || '…' ELSE text END AS snippet, CASE WHEN len(text) > 6000 THEN substr(text, 1, 6000) || '…[truncated]' ELSE text END AS full_text FROM g")
def result_compact(s, d):
    """K08 P18 G05 J03."""
    h = hybrid(s, d).join(chunks_of(s, d), "chunk_id")
    return h.select("query_id", "chunk_id", F.round(R.compact_score(F.col("rerank_score"), F.col("bm25_score")), 3).alias("score"), X.snippet(F.col("text")).alias("snippet"), X.capped(F.col("text")).alias("full_text"))


@query("result_explain", f"WITH {HYBRID_SQL} SELECT query_id, count(*) AS pool, count(DISTINCT page_path) AS pages, count(*) FILTER (WHERE source = 'missing-chunk') AS missing, min(CASE WHEN ord = 1 THEN source END) AS strategy FROM prior GROUP BY 1")
def result_explain(s, d):
    """The counters of one retrieval."""
    f = fused(s, d).withColumn("page_path", F.concat(F.lit("wiki/p"), (F.col("chunk_id") % 40).cast("string"), F.lit(".md")))
    return f.groupBy("query_id").agg(F.count("*").alias("pool"), F.count_distinct("page_path").alias("pages"), F.count_if(F.col("rerank_source") == "missing-chunk").alias("missing"), F.min(F.when(F.col("ord") == 1, F.col("rerank_source"))).alias("strategy"))


DENSE_SQL = f"""{POOL_SQL},
ca AS (SELECT label AS query_id, vec_id AS chunk_id, {_cos('list_slice(m, 1, 32)', 'va')} AS c, 0 AS model_order FROM means CROSS JOIN (SELECT vec_id, va, vb FROM e)),
cb AS (SELECT label AS query_id, vec_id AS chunk_id, {_cos('list_slice(m, 33, 64)', 'vb')} AS c, 1 AS model_order FROM means CROSS JOIN (SELECT vec_id, va, vb FROM e)),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id, model_order ORDER BY round(c, 9) DESC, chunk_id) AS place FROM (SELECT * FROM ca UNION ALL SELECT * FROM cb) WHERE chunk_id % 3 <> 0),
o AS (SELECT query_id, chunk_id, place, model_order, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place, model_order) AS t FROM near WHERE place <= 20),
f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place, model_order) AS rank FROM o WHERE t = 1)
"""


@query("dense_fill", f"WITH {DENSE_SQL} SELECT query_id, chunk_id, rank, CAST(0 AS DOUBLE) AS bm25_score FROM f WHERE rank <= 12")
def dense_fill(s, d):
    """Pools of 8 are filled to 20 by ``rank.dense_fill``.

    The plain tables have neither pools for these queries nor chunk hashes, and the SQL fixes which chunks are out. So every third chunk's
    live hash is another than the indexed one, and each pool is 8 of those.
    """
    q = V.mean_pool(vectors(s, d), "label", unit=False).withColumnRenamed("label", "query_id")
    live = vectors(s, d).select(F.col("item_id").alias("chunk_id"), F.when(F.col("item_id") % 3 == 0, "changed").otherwise("indexed").alias("input_hash"))
    hits = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(21), F.lit(3)).cast("array<bigint>")).alias("chunk_id"))
    models = [(q.select("query_id", F.slice("vector", lo, 32).alias("vector")), vectors(s, d, lo, 32).withColumn("input_hash", F.lit("indexed"))) for lo in (1, 33)]
    return R.dense_fill(hits, models, live).select("query_id", "chunk_id", "rank", F.lit(0.0).alias("bm25_score"))


@query(
    "ce_slot_rerank",
    f"""WITH {FUSE_SQL}, l AS (SELECT query_id, chunk_id, round(rerank, 9) AS score, source = 'missing-chunk' AS missing, CAST((chunk_id * 7919) % 101 AS DOUBLE) AS ce FROM fused),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY missing, score DESC, chunk_id) AS slot FROM l),
k AS (SELECT * FROM p WHERE slot <= 6 AND NOT missing),
z AS (SELECT *, round(((score - avg(score) OVER w) / coalesce(nullif(stddev_pop(score) OVER w, 0), 1) + (ce - avg(ce) OVER w) / coalesce(nullif(stddev_pop(ce) OVER w, 0), 1)) / 2, 9) AS mixed FROM k WINDOW w AS (PARTITION BY query_id)),
t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, slot) AS turn FROM z)
SELECT p.query_id, p.chunk_id, round(p.score, 6) AS score, round(coalesce(g.score, p.score), 6) AS new_score FROM p LEFT JOIN t USING (query_id, chunk_id) LEFT JOIN k g ON g.query_id = t.query_id AND g.slot = t.turn""",
)
def ce_slot_rerank(s, d):
    """With given pair scores."""
    f = fused(s, d).select("query_id", "chunk_id", F.round("rerank_score", 9).alias("score"), ((F.col("chunk_id") * 7919) % 101).cast("double").alias("ce"), (F.col("rerank_source") == "missing-chunk").alias("missing"))
    return R.reassign_slots(f).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("new_score", 6).alias("new_score"))


# Pairs: thresholds are lower than the defaults, as the synthetic vectors are far apart.
FLOOR, ERROR = 0.25, 0.40
PAIR_SQL = VEC_SQL + f", pr AS (SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.v', 'y.v')} AS c FROM e x JOIN e y ON x.vec_id < y.vec_id), near AS (SELECT * FROM pr WHERE c >= {FLOOR})"


def pairs(s: SparkSession, d: str) -> DataFrame:
    return V.similar_pairs(vectors(s, d), FLOOR)


@query("near_duplicate_bands", f"WITH {PAIR_SQL} SELECT a, b, round(c, 6) AS cosine, CASE WHEN c >= {ERROR} THEN 'error' ELSE 'review' END AS band FROM near")
def near_duplicate_bands(s, d):
    """J11 F07 L04."""
    return pairs(s, d).select("a", "b", F.round("cosine", 6).alias("cosine"), F.when(F.col("cosine") >= ERROR, "error").otherwise("review").alias("band"))


@query("semantic_pairs", f"WITH {PAIR_SQL}, g AS (SELECT a, b, c, least(a % 100, b % 100) AS pa, greatest(a % 100, b % 100) AS pb FROM near WHERE a % 100 <> b % 100), o AS (SELECT *, row_number() OVER (PARTITION BY pa, pb ORDER BY round(c, 9) DESC, a DESC, b DESC) AS t FROM g) SELECT pa, pb, a, b, round(c, 6) AS cosine FROM o WHERE t = 1 ORDER BY round(c, 9) DESC, a DESC, b DESC LIMIT 30")
def semantic_pairs(s, d):
    """Chunks of different pages (id modulo 100), the strongest of each pair of pages, the top 30 as the report shows them."""
    page = lambda c: F.col(c) % 100
    p = pairs(s, d).filter(page("a") != page("b")).withColumns({"pa": F.least(page("a"), page("b")), "pb": F.greatest(page("a"), page("b")), "c": F.round("cosine", 9)})
    w = W.partitionBy("pa", "pb").orderBy(F.col("c").desc(), F.col("a").desc(), F.col("b").desc())
    one = p.withColumn("t", F.row_number().over(w)).filter("t = 1")
    return one.orderBy(F.col("c").desc(), F.col("a").desc(), F.col("b").desc()).limit(C.DEFAULTS.scan_pairs).select("pa", "pb", "a", "b", F.round("cosine", 6).alias("cosine"))


LINK_SQL = "links AS (SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings), ledger AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 2 = 0)"


def links_and_ledger(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = S.table(s, d, "embeddings").select("vec_id")
    n = v.count()
    return v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % n).alias("dst")), v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


def either_way(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs ``a <= b`` of what stands either way."""
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def unlinked(p: DataFrame, links: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Pairs without a link either way, and not in the ledger of earlier ideas."""
    out = p.join(either_way(links, "src", "dst").distinct(), ["a", "b"], "left_anti")
    return out if ledger is None else out.join(either_way(ledger, "a", "b").distinct(), ["a", "b"], "left_anti")


@query("missing_links", f"WITH {PAIR_SQL}, {LINK_SQL} SELECT a, b, round(c, 6) AS cosine FROM near WHERE NOT EXISTS (SELECT 1 FROM links WHERE (src = a AND dst = b) OR (src = b AND dst = a))")
def missing_links(s, d):
    """J12."""
    return unlinked(pairs(s, d), links_and_ledger(s, d)[0]).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("ledger_antijoin", f"WITH {PAIR_SQL}, {LINK_SQL} SELECT a, b, round(c, 6) AS cosine FROM near WHERE NOT EXISTS (SELECT 1 FROM links WHERE (src = a AND dst = b) OR (src = b AND dst = a)) AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.a = near.a AND l.b = near.b)")
def ledger_antijoin(s, d):
    """S15 J12."""
    return unlinked(pairs(s, d), *links_and_ledger(s, d)).select("a", "b", F.round("cosine", 6).alias("cosine"))


def percentile_cuts(values: DataFrame, column: str, percents: list[int]) -> list[float | None]:
    """For each percentage the element at ``int(p / 100 * (n - 1))`` of the sorted values (lower nearest rank), exact.

    The values are ranged once and saved with their partition, so counting and picking see the same ranges; no row holds all values.
    """
    ranged = save(values.select(column).repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    n = sum(size for _, size in sizes)
    out: list[float | None] = []
    for p in percents:
        place = int(p / 100 * (n - 1))
        for part, size in sizes:
            if place < size:
                turn = F.row_number().over(W.partitionBy("_part").orderBy(column))
                out.append(ranged.filter(F.col("_part") == part).withColumn("_turn", turn).filter(F.col("_turn") == place + 1).first()[column])
                break
            place -= size
        else:
            out.append(None)
    return out


#: Vectors as pages: classes of them are profiles, folds and archived pages.
SEED_SQL = f"""pages2 AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'wiki/meta/profile/p' WHEN vec_id % 13 = 0 THEN 'wiki/folds/f' ELSE 'wiki/p' END || CAST(vec_id AS VARCHAR) || '.md' AS page_path, CASE WHEN vec_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status FROM embeddings),
seeds AS (SELECT vec_id, page_path FROM pages2 WHERE NOT regexp_matches(page_path, '{C.SCAN_SKIP}') AND NOT regexp_matches(page_path, '{C.SEED_SKIP}') AND status NOT IN ({", ".join(f"'{x}'" for x in C.STALE_STATUSES)}))"""


def allowed_seeds(pages: DataFrame) -> DataFrame:
    """pages that may seed ideas: no archive-like ones, no profiles or overviews, none that is stale."""
    path = F.col("page_path")
    return pages.filter(~path.rlike(C.SCAN_SKIP) & ~path.rlike(C.SEED_SKIP) & ~X.stale(F.col("status")))


@query("seed_pages", f"WITH {SEED_SQL} SELECT * FROM seeds")
def seed_pages(s, d):
    """F03 F04 F01."""
    k = F.col("vec_id")
    top = F.when(k % 11 == 0, "wiki/meta/profile/p").when(k % 13 == 0, "wiki/folds/f").otherwise("wiki/p")
    p = S.table(s, d, "embeddings").select("vec_id", F.concat(top, k.cast("string"), F.lit(".md")).alias("page_path"), F.when(k % 7 == 0, "archived").otherwise("active").alias("status"))
    return allowed_seeds(p).select("vec_id", "page_path")


BAND_SQL = f"""{VEC_SQL}, {SEED_SQL}, {LINK_SQL}, se AS (SELECT e.* FROM e JOIN seeds USING (vec_id)), al AS (SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.v', 'y.v')} AS c FROM se x JOIN se y ON x.vec_id < y.vec_id),
un AS (SELECT a, b, round(c, 9) AS c FROM al WHERE NOT EXISTS (SELECT 1 FROM links WHERE (src = a AND dst = b) OR (src = b AND dst = a)) AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.a = al.a AND l.b = al.b)),
s AS (SELECT list(c ORDER BY c) AS cs FROM un), cut AS (SELECT cs[CAST(floor(0.5 * (len(cs) - 1)) AS BIGINT) + 1] AS lo, cs[CAST(floor(0.9 * (len(cs) - 1)) AS BIGINT) + 1] AS hi FROM s)"""


def seed_pool(s: SparkSession, d: str, lo: int = 50, hi: int = 90, focus: int | None = None) -> DataFrame:
    """of all unlinked pairs of seed pages (with the ``focus`` page, if given), those whose cosine lies between two percentiles of them.

    The percentiles are of all these pairs, so each is looked at, but none is saved (``vectors.pair_band``).
    """
    v = vectors(s, d).join(B.small(seed_pages(s, d).select(F.col("vec_id").alias("item_id"))), "item_id", "left_semi")
    links, ledger = links_and_ledger(s, d)
    return V.pair_band(v, either_way(links, "src", "dst").unionByName(either_way(ledger, "a", "b")).distinct(), lo, hi, focus)


@query("seed_pair_band", f"WITH {BAND_SQL} SELECT a, b FROM un, cut WHERE c >= lo AND c <= hi")
def seed_pair_band(s, d):
    """A20 F03 F04 F08 J12."""
    return seed_pool(s, d).select("a", "b")


@query("seed_pair_focus", f"WITH {BAND_SQL.replace('WHERE NOT EXISTS (SELECT 1 FROM links', 'WHERE (a = 1 OR b = 1) AND NOT EXISTS (SELECT 1 FROM links')} SELECT a, b FROM un, cut WHERE c >= lo AND c <= hi")
def seed_pair_focus(s, d):
    """Pairs with a focus page, and the percentiles of these."""
    return seed_pool(s, d, focus=1).select("a", "b")


#: Pairs of a greedy walk that the driver takes at a time.
DRAWN = 1_000


def disjoint_pairs(pool: DataFrame, n: int, seed: int = 0, focus: int | None = None) -> DataFrame:
    """Greedy matching in a drawn order: each item once but for ``focus``, the first ``n`` pairs.

    The walk goes over the pairs that come first, as many as ``DRAWN`` allows; if these do not give ``n``, over the first of the pairs
    whose items are all still free. Those left out can not be taken any more, so this is the very matching of one greedy walk, and
    no pair of ``pool`` is saved. Each turn reads ``pool`` again; it has one of the ``n`` pairs at least.
    """
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")))
    left = pool.select("a", "b", "cosine")
    used: set = set()
    found: list = []
    while len(found) < n:
        first = left.withColumn("draw", draw).orderBy("draw", "a", "b").limit(DRAWN).collect()
        for r in first:
            if len(found) < n and not {r.a, r.b} & used:
                found.append((r.a, r.b, r.cosine))
                used |= {r.a, r.b} - {focus}
        if len(first) < DRAWN:
            break
        gone = B.small(pool.sparkSession.createDataFrame([(x,) for x in used], pool.select(F.col("a").alias("item")).schema))
        left = pool.select("a", "b", "cosine").join(gone, F.col("a") == gone["item"], "left_anti").join(gone, F.col("b") == gone["item"], "left_anti")
    return pool.sparkSession.createDataFrame(found, left.schema)


@query(
    "seed_pair_matching",
    f"""WITH RECURSIVE {BAND_SQL}, pl AS (SELECT a, b, c, md5('0-' || CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR)) AS k FROM un, cut WHERE c >= lo AND c <= hi),
w(n, k, a, b, c, used) AS (SELECT 0, '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[])
  UNION ALL SELECT n + 1, x.k, x.a, x.b, x.c, list_concat(used, [x.a, x.b]) FROM (SELECT w.n, w.used, arg_min(pl, pl.k) AS x FROM w JOIN pl ON pl.k > w.k AND NOT list_contains(w.used, pl.a) AND NOT list_contains(w.used, pl.b) WHERE w.n < 12 GROUP BY w.n, w.used))
SELECT a, b FROM w WHERE n > 0""",
)
def seed_pair_matching(s, d):
    """The report's 12 pairs."""
    return disjoint_pairs(seed_pool(s, d), C.DEFAULTS.seed_pairs).select("a", "b")


def nearest_sides(queries: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """The nearest item of each side: ``query_id, side, item_id, cosine``."""
    found = [V.nearest(queries, items, 1).select("query_id", F.lit(side).alias("side"), "item_id", "cosine") for side, items in sides.items()]
    return reduce(DataFrame.unionByName, found)


@query("nearest_chunk", f"WITH {POOL_SQL}, c AS (SELECT label AS query_id, vec_id AS item_id, {_cos('m', 'v')} AS c FROM means CROSS JOIN (SELECT vec_id, v FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, item_id) AS t FROM c) SELECT query_id, item_id, round(c, 6) AS cosine FROM r WHERE t = 1")
def nearest_chunk(s, d):
    """J20."""
    return V.nearest(label_queries(s, d), vectors(s, d), 1).select("query_id", "item_id", F.round("cosine", 6).alias("cosine"))


@query("bridge_chunk", f"WITH {POOL_SQL}, c AS (SELECT e.label AS page, m.label AS other, vec_id AS chunk, {_cos('m', 'v')} AS c FROM e JOIN means m ON m.label = (e.label + 1) % 10), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(c, 9) DESC, chunk) AS t FROM c) SELECT page, other, chunk, round(c, 6) AS cosine FROM r WHERE t = 1")
def bridge_chunk(s, d):
    """For each page, its chunk that is nearest to the mean vector of the other page."""
    means = V.mean_pool(vectors(s, d), "label").select(F.col("label").alias("other"), F.col("vector").alias("m"))
    c = vectors(s, d).withColumn("other", ((F.col("label") + 1) % 10).cast("int")).join(B.small(means), "other").withColumn("c", F.round(V.cosine(F.col("vector"), F.col("m")), 9))
    best = c.groupBy(F.col("label").alias("page"), "other").agg(F.max(F.struct("c", (-F.col("item_id")).alias("k"))).alias("best"))
    return best.select("page", "other", (-F.col("best.k")).alias("chunk"), F.round("best.c", 6).alias("cosine"))
