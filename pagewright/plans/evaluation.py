"""Prompt gate, evaluation, quote checks, folds and flows over the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X
from pagewright.operators import bm25 as B
from pagewright.operators import evaluate as E
from pagewright.operators import frontmatter as FM
from pagewright.plans import search as P
from pagewright.sources import corpus as S
from pagewright.sources.work import save, spread

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Prompts are the user turns; their decision runs on the benchmark items, of which a class is trivial.
TRIVIAL_SQL = "(len({p}) = 0 OR starts_with({p}, '/') OR regexp_matches({p}, '<(command-name|local-command-[a-z]+|system-reminder|task-notification)>') OR regexp_matches({p}, '(?i)^\\s*(ok(ay)?|s[iì]|yes|no|va bene|vai|procedi|continua|retry|riprova|fai tu|concludi|perfetto|grazie|thanks|go|fatto|chiudiamo)\\b[\\s.!,]*$') OR len({p}) < 12 OR len(regexp_split_to_array({p}, '\\s+')) < 3)"


@query("recall_trivial", f"WITH p AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, {TRIVIAL_SQL.format(p='t')} AS trivial FROM p")
def recall_trivial(s, d):
    """F05."""
    return S.table(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", E.trivial(F.col("text")).alias("trivial"))


#: Threshold on the synthetic vectors, which are far apart.
THRESHOLD = 0.05


def prompts(s: SparkSession, d: str) -> DataFrame:
    b = S.table(s, d, "benchmark")
    p = F.when(F.col("item_id") % 7 == 0, "Ok, grazie!").otherwise(F.col("text"))
    return b.select(F.col("item_id").alias("query_id"), p.alias("prompt")).withColumn("trivial", E.trivial(F.col("prompt")))


def gate_candidates(s: SparkSession, d: str) -> DataFrame:
    f = P.fused(s, d)
    best = F.max(F.when(F.col("rerank_source") == "cosine", F.lit("cosine:a+b")).otherwise(F.lit("bm25"))).over(W.partitionBy("query_id"))
    return f.withColumns({"a": F.col("cosine")["a"], "b": F.col("cosine")["b"], "page": F.concat(F.lit("p"), (F.col("chunk_id") % 40).cast("string")), "strategy": best}).withColumn("mean", F.coalesce((F.col("a") + F.col("b")) / F.lit(2.0), "a", "b")).withColumnRenamed("ord", "rank")


GATE_SQL = f"""{P.FUSE_SQL},
pr AS (SELECT item_id AS query_id, item_id % 7 = 0 AS trivial FROM benchmark),
gc AS (SELECT query_id, chunk_id, ord AS rank, 'p' || CAST(chunk_id % 40 AS VARCHAR) AS page, round(ca, 4) AS a, round(cb, 4) AS b, (round(ca, 4) + round(cb, 4)) / 2.0 AS mean, source FROM fused),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY rank) AS t FROM gc WHERE a >= {THRESHOLD}),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS u FROM ok WHERE t = 1),
ps AS (SELECT * FROM pk WHERE u <= 2)
"""


@query(
    "recall_decision",
    f"""WITH {GATE_SQL}, po AS (SELECT query_id, count(*) AS hits, max(coalesce(a, 0)) AS top, max(CASE WHEN source = 'cosine' THEN 1 ELSE 0 END) AS emb FROM gc GROUP BY 1), n AS (SELECT query_id, count(*) AS k FROM ps GROUP BY 1)
SELECT pr.query_id, CASE WHEN trivial THEN 'skip' WHEN hits IS NULL THEN 'none' WHEN emb = 0 THEN 'skip' WHEN k > 0 THEN 'inject' ELSE 'none' END AS action, CASE WHEN trivial THEN 'trivial' WHEN hits IS NULL THEN 'no-hits' WHEN emb = 0 THEN 'no-embedder' ELSE '' END AS reason,
CASE WHEN NOT trivial AND emb = 1 THEN round(top, 4) END AS top, CASE WHEN NOT trivial AND emb = 1 THEN coalesce(k, 0) ELSE 0 END AS pointers FROM pr LEFT JOIN po USING (query_id) LEFT JOIN n USING (query_id)""",
)
def recall_decision(s, d):
    """F05 F06 G08 W04."""
    c = gate_candidates(s, d)
    return E.decide(prompts(s, d), c, E.picks(c, "a", THRESHOLD), "a").withColumn("top", F.round("top", 4))


EXCERPT_WORDS = "list_distinct(list_transform(regexp_extract_all({t}, '" + C.WORD4.replace("'", "''") + "'), lambda x: lower(x)))"


@query(
    "recall_pointers",
    f"""WITH {GATE_SQL}, tx AS (SELECT ps.query_id, ps.chunk_id, ps.page, ps.a, d.text, b.text AS prompt FROM ps JOIN pr USING (query_id) JOIN documents d ON d.doc_id = ps.chunk_id JOIN benchmark b ON b.item_id = ps.query_id WHERE NOT trivial),
ln AS (SELECT query_id, chunk_id, prompt, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(ltrim(trim(unnest(string_split(text, chr(10)))), '#>-*| ')) AS l FROM tx),
sc AS (SELECT *, len(list_intersect({EXCERPT_WORDS.replace('{t}', 'prompt')}, {EXCERPT_WORDS.replace('{t}', 'l')})) AS n FROM ln WHERE len(l) >= 25),
be AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n DESC, i) AS t FROM sc)
SELECT tx.query_id, tx.page, round(tx.a, 4) AS feature, CASE WHEN len(m) > 220 THEN rtrim(substr(m, 1, 220), ' ') || '…' ELSE m END AS excerpt FROM tx JOIN (SELECT *, regexp_replace(replace(replace(l, '**', ''), '`', ''), '\\s+', ' ', 'g') AS m FROM be) be ON be.query_id = tx.query_id AND be.chunk_id = tx.chunk_id AND be.t = 1""",
)
def recall_pointers(s, d):
    """Pages and excerpts; the section and the text form of a gate are ``text.first_heading`` and ``sinks.pointers_text``."""
    ps = E.picks(gate_candidates(s, d), "a", THRESHOLD).join(B.small(prompts(s, d).filter("not trivial").select("query_id", "prompt")), "query_id")
    tx = ps.join(P.chunks_of(s, d), "chunk_id")
    e = E.excerpts(tx, ["query_id", "chunk_id"])
    return tx.select("query_id", "chunk_id", "page", F.round("a", 4).alias("feature")).join(e, ["query_id", "chunk_id"]).drop("chunk_id")


GOLD_SQL = f"""{P.HYBRID_SQL},
gold AS (SELECT DISTINCT item_id AS query_id, doc_id AS page FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))),
res AS (SELECT query_id, chunk_id AS page, place AS rank, len(text) AS chars, text FROM final JOIN documents d ON d.doc_id = final.chunk_id WHERE place <= 5),
bres AS (SELECT query_id, doc_id AS page, rank, len(text) AS chars, text FROM ranked JOIN documents d USING (doc_id) WHERE rank <= 5)
"""


def gold(s: SparkSession, d: str) -> DataFrame:
    """Documents that contain the first 60 characters of an item.

    The second to fourth word of these characters are whole words in any text that contains them, so an item meets only the texts
    with its word triple; items of fewer words meet all texts.
    """
    mark = F.substring("text", 1, 60)
    items = S.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), mark.alias("mark"), F.split(mark, " ").alias("ws"))
    items = items.withColumn("anchor", F.when(F.size("ws") >= 5, F.concat_ws(" ", F.slice("ws", 2, 3)))).drop("ws")
    docs = spread(S.table(s, d, "documents").select(F.col("doc_id").alias("page"), "text"))
    ws = F.split("text", " ")
    rest = lambda n: F.slice(ws, n, F.size(ws) + 1)
    zipped = F.arrays_zip(ws.alias("x"), rest(2).alias("y"), rest(3).alias("z"))
    triples = F.transform(zipped, lambda t: F.concat_ws(" ", t["x"], t["y"], t["z"]))
    keys = items.filter("anchor is not null").select("anchor").distinct()
    near = docs.select("page", "text", F.explode(F.array_distinct(triples)).alias("anchor")).join(B.small(keys), "anchor", "left_semi")
    met = near.join(B.small(items), "anchor").filter(F.contains("text", "mark")).select("query_id", "page")
    short = items.filter("anchor is null").select("query_id", "mark")
    if short.take(1):
        met = met.unionByName(docs.join(B.small(short), F.contains("text", "mark")).select("query_id", "page"))
    return save(met.distinct(), "gold")


def results(s: SparkSession, d: str) -> DataFrame:
    """BM25 windows of five with their texts."""
    return P.pool(s, d, 5).withColumnRenamed("doc_id", "page").join(S.table(s, d, "documents").select(F.col("doc_id").alias("page"), "text"), "page").withColumn("chars", F.length("text"))


@query("eval_recall_mrr", f"WITH {GOLD_SQL}, rk AS (SELECT item_id AS query_id, (SELECT min(rank) FROM bres r JOIN gold g ON g.query_id = r.query_id AND g.page = r.page WHERE r.query_id = b.item_id) AS rank FROM benchmark b), z AS (SELECT query_id, sum(chars) AS chars, count(DISTINCT page) AS pages FROM bres GROUP BY 1) SELECT (SELECT count(*) FROM rk) AS items, (SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM rk) AS r1, (SELECT round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) FROM rk) AS r3, (SELECT round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM rk) AS rk, (SELECT round(avg(coalesce(1.0 / rank, 0)), 6) FROM rk) AS mrr, (SELECT round(avg(chars), 6) FROM z) AS avg_chars, (SELECT round(avg(chars / 4.0), 6) FROM z) AS avg_tokens, (SELECT round(avg(pages), 6) FROM z) AS avg_pages")
def eval_recall_mrr(s, d):
    """A13 J16 W06."""
    r = results(s, d)
    m = E.rank_metrics(E.first_rank(P.queries_of(s, d), r, gold(s, d)), r)
    return m.select("items", *(F.round(c, 6).alias(c) for c in m.columns if c != "items"))


LABEL_SQL = f"""{GOLD_SQL},
lb AS (SELECT r.query_id, rank, CASE WHEN contains(lower(replace(replace(r.text, '*', ''), '`', '')), lower(substr(b.text, 20, 40))) THEN 'C' WHEN contains(lower(replace(replace(r.text, '*', ''), '`', '')), lower(substr(b.text, 1, 4))) THEN 'S' ELSE '-' END AS label FROM bres r JOIN benchmark b ON b.item_id = r.query_id),
ls AS (SELECT query_id, string_agg(label, '' ORDER BY rank) AS labels FROM lb GROUP BY 1)
"""


def labels(s: SparkSession, d: str) -> DataFrame:
    marks = S.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.substring("text", 20, 40)).alias("current"), F.array(F.substring("text", 1, 4)).alias("stale"))
    r = results(s, d).join(B.small(marks), "query_id")
    return E.label_strings(r.withColumn("label", E.label(F.col("text"), F.col("current"), F.col("stale"))))


@query("eval_answer_labels", f"WITH {LABEL_SQL} SELECT query_id, labels FROM ls")
def eval_answer_labels(s, d):
    """A14 J18 P22."""
    return labels(s, d)


@query("eval_ku_order", f"WITH {LABEL_SQL} SELECT count(*) AS items, round(avg(CASE WHEN starts_with(labels, 'C') THEN 1.0 ELSE 0.0 END), 6) AS at_1, round(avg(CASE WHEN instr(labels, 'C') > 0 THEN 1.0 ELSE 0.0 END), 6) AS at_k, round(avg(CASE WHEN instr(labels, 'C') > 0 AND (instr(labels, 'S') = 0 OR instr(labels, 'S') > instr(labels, 'C')) THEN 1.0 ELSE 0.0 END), 6) AS in_order FROM ls")
def eval_ku_order(s, d):
    """A14 T22."""
    m = E.label_metrics(labels(s, d))
    return m.select("items", *(F.round(c, 6).alias(c) for c in ("at_1", "at_k", "in_order")))


@query("eval_required_pages", f"WITH {GOLD_SQL}, q AS (SELECT query_id, count(*) AS needed FROM gold GROUP BY 1), f AS (SELECT g.query_id, count(*) AS found FROM gold g JOIN bres r ON r.query_id = g.query_id AND r.page = g.page GROUP BY 1), c AS (SELECT query_id, sum(chars) AS chars FROM bres GROUP BY 1) SELECT query_id, needed, coalesce(found, 0) AS found, coalesce(found, 0) = needed AS all_found, round(coalesce(chars, 0) / 4.0, 4) AS tokens FROM q LEFT JOIN f USING (query_id) LEFT JOIN c USING (query_id)")
def eval_required_pages(s, d):
    """A16 J17."""
    g, r = gold(s, d), results(s, d)
    found = g.join(r.select("query_id", "page"), ["query_id", "page"]).groupBy("query_id").agg(F.count("*").alias("found"))
    size = r.groupBy("query_id").agg(F.sum("chars").alias("chars"))
    out = g.groupBy("query_id").agg(F.count("*").alias("needed")).join(found, "query_id", "left").join(size, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select("query_id", "needed", "found", (F.col("found") == F.col("needed")).alias("all_found"), F.round(F.coalesce("chars", F.lit(0)) / F.lit(4.0), 4).alias("tokens"))


COVER_SQL = f"{S.PAGES_SQL}, ix AS (SELECT doc_id, page_path, CASE WHEN doc_id % 4 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 200 AS INTEGER)), '%Y-%m-%d') END AS created FROM pages1 WHERE doc_id % 17 <> 0), g AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60)))"


def coverage_pages(s: SparkSession, d: str) -> DataFrame:
    created = F.when(F.col("doc_id") % 4 != 0, F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 200).cast("int")), "yyyy-MM-dd"))
    return S.pages(s, d).filter(X.indexed(F.col("raw"))).select("doc_id", "page_path", created.alias("created"))


@query("eval_coverage", f"WITH {COVER_SQL} SELECT (SELECT count(*) FROM ix) AS indexed, (SELECT count(DISTINCT ix.doc_id) FROM ix JOIN g USING (doc_id) WHERE item_id % 2 = 0) AS this_set, (SELECT count(DISTINCT ix.doc_id) FROM ix JOIN g USING (doc_id)) AS any_set")
def eval_coverage(s, d):
    """Two gold sets, the even items and all."""
    g = gold(s, d)
    of = lambda x: x.select(F.col("page").alias("doc_id")).distinct().withColumn("hit", F.lit(1))
    p = coverage_pages(s, d).join(of(g.filter("query_id % 2 = 0")).withColumnRenamed("hit", "here"), "doc_id", "left").join(of(g), "doc_id", "left")
    return p.agg(F.count("*").alias("indexed"), F.count("here").alias("this_set"), F.count("hit").alias("any_set"))


@query("eval_uncovered", f"WITH {COVER_SQL} SELECT page_path, created FROM ix WHERE doc_id NOT IN (SELECT doc_id FROM g) ORDER BY created DESC NULLS LAST, page_path")
def eval_uncovered(s, d):
    """Newest first, undated last."""
    p = coverage_pages(s, d).join(gold(s, d).select(F.col("page").alias("doc_id")).distinct(), "doc_id", "left_anti")
    return p.select("page_path", "created").orderBy(F.col("created").desc_nulls_last(), "page_path")


@query("eval_run_diff", f"WITH {GOLD_SQL}, n AS (SELECT b.item_id AS query_id, (SELECT min(rank) FROM bres r JOIN gold g ON g.query_id = r.query_id AND g.page = r.page WHERE r.query_id = b.item_id) AS new_rank FROM benchmark b WHERE item_id % 10 <> 9), o AS (SELECT b.item_id AS query_id, (SELECT min(rank) FROM res r JOIN gold g ON g.query_id = r.query_id AND g.page = r.page WHERE r.query_id = b.item_id) AS old_rank FROM benchmark b WHERE item_id % 10 <> 8) SELECT coalesce(n.query_id, o.query_id) AS query_id, new_rank, old_rank, CASE WHEN o.query_id IS NULL THEN 'new' WHEN n.query_id IS NULL THEN 'gone' WHEN new_rank IS NOT DISTINCT FROM old_rank THEN 'same' ELSE 'changed' END AS state FROM n FULL OUTER JOIN o ON n.query_id = o.query_id")
def eval_run_diff(s, d):
    """A BM25 run against a fused one, each without a class of items."""
    g, q = gold(s, d), P.queries_of(s, d)
    hybrid = P.hybrid(s, d).select("query_id", F.col("chunk_id").alias("page"), "rank")
    n = E.first_rank(q.filter("query_id % 10 <> 9"), results(s, d), g).withColumnsRenamed({"rank": "new_rank"}).withColumn("n", F.lit(1))
    o = E.first_rank(q.filter("query_id % 10 <> 8"), hybrid, g).withColumnsRenamed({"rank": "old_rank"}).withColumn("o", F.lit(1))
    state = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("new_rank").eqNullSafe(F.col("old_rank")), "same").otherwise("changed")
    return n.join(o, "query_id", "full_outer").select("query_id", "new_rank", "old_rank", state.alias("state"))


@query("eval_neighbour_cost", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), r AS (SELECT doc_id, idx FROM l WHERE contains(line, 'the') AND idx % 4 = 1), o AS (SELECT DISTINCT r.doc_id, l.idx, l.line, abs(l.idx - r.idx) AS dist FROM r JOIN l ON l.doc_id = r.doc_id AND abs(l.idx - r.idx) <= 2 WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.doc_id = l.doc_id AND x.idx = l.idx)), m AS (SELECT doc_id, idx, line, min(dist) AS dist FROM o GROUP BY 1, 2, 3) SELECT doc_id, CAST(sum(CASE WHEN dist <= 1 THEN len(line) ELSE 0 END) AS BIGINT) AS extra_1, CAST(sum(len(line)) AS BIGINT) AS extra_2 FROM m GROUP BY 1")
def eval_neighbour_cost(s, d):
    """Characters that the neighbours of returned chunks would add; lines are chunks."""
    lines = S.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    back = F.contains(F.col("line"), F.lit("the")) & (F.col("idx") % 4 == 1)
    w = W.partitionBy("doc_id").orderBy("idx")
    near = lambda k: F.max(back).over(w.rowsBetween(-k, k))  # noqa: E731  lines of a document are gapless, so rows are distances
    m = lines.withColumns({"back": back, "n1": near(1), "n2": near(2)}).filter("n2 and not back")
    return m.groupBy("doc_id").agg(F.sum(F.when(F.col("n1"), F.length("line")).otherwise(0)).alias("extra_1"), F.sum(F.length("line")).alias("extra_2"))


SWEEP_SQL = f"""{GATE_SQL}, gd AS (SELECT DISTINCT item_id AS query_id, 'p' || CAST(doc_id % 40 AS VARCHAR) AS page FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))),
kd AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN 'trivial' WHEN item_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind FROM benchmark)"""


def kinds(s: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("query_id") % 7 == 0, "trivial").when(F.col("query_id") % 2 == 0, "positive").otherwise("negative")
    return P.queries_of(s, d).select("query_id", k.alias("kind"))


def page_gold(s: SparkSession, d: str) -> DataFrame:
    return gold(s, d).select("query_id", F.concat(F.lit("p"), (F.col("page") % 40).cast("string")).alias("page")).distinct()


@query(
    "recall_threshold_sweep",
    f"""WITH {SWEEP_SQL}, th AS (SELECT k, -0.40 + 0.02 * k AS thr FROM range(0, 21) t(k)),
fe AS (SELECT query_id, chunk_id, rank, page, 'first' AS feature, a AS v FROM gc UNION ALL SELECT query_id, chunk_id, rank, page, 'second', b FROM gc UNION ALL SELECT query_id, chunk_id, rank, page, 'mean', mean FROM gc),
s1 AS (SELECT fe.*, k, row_number() OVER (PARTITION BY feature, k, query_id, page ORDER BY rank) AS t FROM fe JOIN th ON v >= thr JOIN kd USING (query_id) WHERE kind <> 'trivial'),
s2 AS (SELECT *, row_number() OVER (PARTITION BY feature, k, query_id ORDER BY rank) AS u FROM s1 WHERE t = 1),
q AS (SELECT feature, k, s2.query_id, max(CASE WHEN gd.page IS NOT NULL THEN 1 ELSE 0 END) AS good FROM s2 LEFT JOIN gd ON gd.query_id = s2.query_id AND gd.page = s2.page WHERE u <= 2 GROUP BY 1, 2, 3),
g AS (SELECT feature, k, sum(CASE WHEN kind = 'positive' THEN good ELSE 0 END) AS hit, sum(CASE WHEN kind = 'positive' THEN 1 - good ELSE 0 END) AS wrong, sum(CASE WHEN kind <> 'positive' THEN 1 ELSE 0 END) AS neg, count(*) AS inj FROM q JOIN kd USING (query_id) GROUP BY 1, 2),
a AS (SELECT f.feature, th.k FROM th, (SELECT 'first' AS feature UNION SELECT 'second' UNION SELECT 'mean') f), np AS (SELECT count(*) AS n FROM kd WHERE kind = 'positive')
SELECT a.feature, CAST(a.k AS INTEGER) AS step, CAST(coalesce(hit, 0) AS BIGINT) AS hit, CAST(coalesce(wrong, 0) AS BIGINT) AS wrong, CAST(n - coalesce(hit, 0) - coalesce(wrong, 0) AS BIGINT) AS silent, CAST(coalesce(neg, 0) AS BIGINT) AS neg_injected, round(CASE WHEN inj > 0 THEN hit / inj ELSE 0 END, 6) AS precision_, round(coalesce(hit, 0) / n, 6) AS recall_ FROM a LEFT JOIN g ON g.feature = a.feature AND g.k = a.k CROSS JOIN np""",
)
def recall_threshold_sweep(s, d):
    """Three features by 21 thresholds (a lower grid for these vectors)."""
    c, k = gate_candidates(s, d), kinds(s, d)
    grid = s.range(21).select(F.col("id").cast("int").alias("step"), (F.lit(-0.40) + F.lit(0.02) * F.col("id")).alias("thr"))
    features = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(v).alias("v")) for n, v in (("first", "a"), ("second", "b"), ("mean", "mean")))))
    each = c.join(B.small(k.filter("kind <> 'trivial'")), "query_id").select("query_id", "rank", "page", "kind", features.alias("f")).select("query_id", "rank", "page", "kind", "f.*")
    at = each.join(F.broadcast(grid), F.col("v") >= F.col("thr"))
    chosen = E.picks(at, "v", None, keys=("feature", "step", "query_id")).join(page_gold(s, d).withColumn("good", F.lit(1)), ["query_id", "page"], "left")
    one = chosen.groupBy("feature", "step", "query_id", "kind").agg(F.max(F.coalesce("good", F.lit(0))).alias("good"))
    pos = F.col("kind") == "positive"
    got = one.groupBy("feature", "step").agg(F.sum(F.when(pos, F.col("good")).otherwise(0)).alias("hit"), F.sum(F.when(pos, 1 - F.col("good")).otherwise(0)).alias("wrong"), F.count_if(~pos).alias("neg_injected"), F.count("*").alias("n"))
    frame = grid.select("step").crossJoin(s.createDataFrame([("first",), ("second",), ("mean",)], "feature string"))
    total = k.agg(F.count_if(F.col("kind") == "positive").alias("total"))
    j = frame.join(got, ["feature", "step"], "left").fillna(0, ["hit", "wrong", "neg_injected", "n"]).crossJoin(F.broadcast(total))
    return j.select("feature", "step", "hit", "wrong", (F.col("total") - F.col("hit") - F.col("wrong")).alias("silent"), "neg_injected", F.round(F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(F.lit(0.0)), 6).alias("precision_"), F.round(F.col("hit") / F.col("total"), 6).alias("recall_"))


@query("ranking_ceiling", f"WITH {SWEEP_SQL}, s1 AS (SELECT gc.*, row_number() OVER (PARTITION BY query_id, page ORDER BY rank) AS t FROM gc JOIN kd USING (query_id) WHERE kind = 'positive' AND a IS NOT NULL), s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS u FROM s1 WHERE t = 1) SELECT count(DISTINCT s2.query_id) AS ceiling, (SELECT count(*) FROM kd WHERE kind = 'positive') AS positives FROM s2 JOIN gd ON gd.query_id = s2.query_id AND gd.page = s2.page WHERE u <= 2")
def ranking_ceiling(s, d):
    """A18."""
    k = kinds(s, d).filter("kind = 'positive'")
    top = E.picks(gate_candidates(s, d).join(B.small(k), "query_id"), "a", None)
    hit = top.join(page_gold(s, d), ["query_id", "page"], "left_semi").agg(F.count_distinct("query_id").alias("ceiling"))
    return hit.crossJoin(k.agg(F.count("*").alias("positives")))


@query("recall_log_retention", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recall_log_retention(s, d):
    """K14."""
    return E.keep_last(S.table(s, d, "events").select("event_id", "ts"), ["ts", "event_id"])


@query("recall_log_rotated", "WITH l AS (SELECT event_id, ts, strlen(props) + 1 AS n FROM events), z AS (SELECT sum(n) AS size FROM l) SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS t FROM l), z WHERE size <= 262144 OR t <= 500")
def recall_log_rotated(s, d):
    """Rotation only once the log is large."""
    log = S.table(s, d, "events").select("event_id", "ts", "props")
    return E.rotated(log, F.col("props"), ["ts", "event_id"]).select("event_id", "ts")


#: Ideas made from documents (side a) and items (side b); classes of ids lack a field, have an unknown kind or other quotes.
IDEAS_SQL = """j AS (SELECT d.doc_id, d.text AS text_a, b.text AS text_b FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
ideas AS (SELECT doc_id AS idea_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'T' END AS title, CASE WHEN doc_id % 13 <> 0 THEN 'I' END AS idea, 'F' AS first_step, CASE WHEN doc_id % 5 = 0 THEN 'invention' WHEN doc_id % 7 <> 0 THEN 'synergy' END AS kind,
  substr(text_a, 1, 10 + CAST(doc_id % 30 AS INTEGER)) AS quote_a, CASE WHEN doc_id % 3 = 0 THEN 'words that no item has in it' ELSE substr(text_b, 3, 30) END AS quote_b, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'stale' WHEN 2 THEN 'duplicate' END AS relation, text_a, text_b FROM j)"""
_NORM_SQL = "lower(trim(regexp_replace(replace(replace(replace({}, '**', ''), '__', ''), '`', ''), '\\s+', ' ', 'g')))"


def ideas(s: SparkSession, d: str) -> DataFrame:
    b = S.table(s, d, "benchmark")
    k = F.col("idea_id")
    j = S.table(s, d, "documents").select(F.col("doc_id").alias("idea_id"), F.col("text").alias("text_a"), (F.col("doc_id") % b.count()).alias("item_id")).join(B.small(b.select("item_id", F.col("text").alias("text_b"))), "item_id")
    relation = F.when(k % 4 == 0, "none").when(k % 4 == 1, "stale").when(k % 4 == 2, "duplicate")
    return j.select(
        "idea_id", F.when(k % 11 == 0, " ").otherwise("T").alias("title"), F.when(k % 13 != 0, "I").alias("idea"), F.lit("F").alias("first_step"), F.when(k % 5 == 0, "invention").when(k % 7 != 0, "synergy").alias("kind"),
        F.substring(F.col("text_a"), F.lit(1), (10 + k % 30).cast("int")).alias("quote_a"), F.when(k % 3 == 0, "words that no item has in it").otherwise(F.substring("text_b", 3, 30)).alias("quote_b"), relation.alias("relation"), "text_a", "text_b",
    )


@query(
    "idea_check",
    f"""WITH {IDEAS_SQL}, n AS (SELECT *, {_NORM_SQL.format('quote_a')} AS qa, {_NORM_SQL.format('quote_b')} AS qb, {_NORM_SQL.format('text_a')} AS ta, {_NORM_SQL.format('text_b')} AS tb FROM ideas)
SELECT idea_id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing title' WHEN trim(coalesce(idea, '')) = '' THEN 'missing idea' WHEN trim(coalesce(quote_a, '')) = '' THEN 'missing quote_a' WHEN trim(coalesce(quote_b, '')) = '' THEN 'missing quote_b'
  WHEN kind IS NULL OR kind NOT IN ({', '.join(f"'{x}'" for x in C.IDEA_KINDS)}) THEN 'kind ' || coalesce(kind, 'none') WHEN len(qa) < 15 THEN 'quote_a too short' WHEN NOT contains(ta, qa) THEN 'quote_a not in passage A' WHEN len(qb) < 15 THEN 'quote_b too short' WHEN NOT contains(tb, qb) THEN 'quote_b not in passage B' END AS fault FROM n""",
)
def idea_check(s, d):
    """Shape, kind and quotes of proposed ideas."""
    return ideas(s, d).select("idea_id", E.idea_fault().alias("fault"))


@query("verdict_check", f"WITH {IDEAS_SQL} SELECT idea_id, coalesce(relation IN ('contradiction', 'stale', 'duplicate') AND {_NORM_SQL.format('quote_a')} <> '' AND {_NORM_SQL.format('quote_b')} <> '' AND contains({_NORM_SQL.format('text_a')}, {_NORM_SQL.format('quote_a')}) AND contains({_NORM_SQL.format('text_b')}, {_NORM_SQL.format('quote_b')}), false) AS kept FROM ideas")
def verdict_check(s, d):
    """verdicts with a known relation and quotes on both sides."""
    return ideas(s, d).select("idea_id", E.verdict_kept().alias("kept"))


@query("proposal_order", f"WITH {P.VEC_SQL}, i AS (SELECT label AS idea_id, CASE WHEN label % 4 <> 0 THEN max(round(v[1], 6)) END AS nearest FROM e GROUP BY 1) SELECT idea_id, nearest, row_number() OVER (ORDER BY coalesce(nearest, 0), idea_id) AS place FROM i")
def proposal_order(s, d):
    """Ten proposals, some without a nearest cosine."""
    made = P.vectors(s, d).groupBy(F.col("label").alias("idea_id")).agg(F.max(F.round(F.element_at("vector", 1), 6)).alias("top"))
    return E.proposal_order(made.select("idea_id", F.when(F.col("idea_id") % 4 != 0, F.col("top")).alias("nearest"))).withColumn("place", F.col("place").cast("long"))


@query("quote_check", "WITH p AS (SELECT d.doc_id, b.item_id, d.text, substr(b.text, 5, 10 + CAST(b.item_id % 40 AS INTEGER)) AS quote FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), n AS (SELECT *, lower(trim(regexp_replace(replace(replace(replace(text, '**', ''), '__', ''), '`', ''), '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS q FROM p) SELECT doc_id, item_id, CASE WHEN len(quote) < 15 THEN 'short quote' WHEN NOT contains(t, q) THEN 'not verbatim' ELSE 'kept' END AS verdict FROM n")
def quote_check(s, d):
    """A quote of 15 characters or more that its own side contains."""
    n = S.table(s, d, "benchmark").count()
    q = S.table(s, d, "benchmark").select("item_id", F.col("text").alias("b"))
    j = S.table(s, d, "documents").withColumn("item_id", F.col("doc_id") % n).join(B.small(q), "item_id")
    quote = F.substring(F.col("b"), F.lit(5), (10 + F.col("item_id") % 40).cast("int"))
    verdict = F.when(F.length(quote) < C.DEFAULTS.quote_chars, "short quote").when(~F.contains(X.quote_norm(F.col("text")), X.quote_norm(quote)), "not verbatim").otherwise("kept")
    return j.select("doc_id", "item_id", verdict.alias("verdict"))


@query("fold_rollup", "WITH b AS (SELECT strftime(ts, '%Y-%m-%d') AS d, event_id FROM events WHERE event_id % 3 <> 0 ORDER BY 1, 2 LIMIT 32) SELECT 'fold-k5-from-' || min(d) || '-to-' || max(d) || '-n' || CAST(count(*) AS VARCHAR) AS fold_id, count(*) AS entries, count(*) < 32 AS short FROM b")
def fold_rollup(s, d):
    """P28 P29."""
    log = S.table(s, d, "events").select(F.col("event_id").alias("entry_id"), F.date_format("ts", "yyyy-MM-dd").alias("entry_date"))
    return E.fold(log, log.filter("entry_id % 3 = 0").select("entry_id"), 5)


@query("flow_gates", "WITH i AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'fail' WHEN doc_id % 13 = 0 THEN 'error' ELSE 'pass' END AS p, CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS v, CASE WHEN doc_id % 5 = 0 THEN 'fail' ELSE 'pass' END AS n FROM labels) SELECT doc_id, CASE WHEN p = 'fail' THEN 'refuted' WHEN p = 'error' THEN 'errored' WHEN v = 'fail' OR n = 'fail' THEN 'refuted' ELSE 'survived' END AS outcome, CASE WHEN p <> 'pass' THEN 'premises' WHEN v <> 'pass' THEN 'value' WHEN n <> 'pass' THEN 'novelty' ELSE '' END AS gate, CAST(CASE WHEN p <> 'pass' THEN 1 WHEN v <> 'pass' THEN 2 ELSE 3 END AS INTEGER) AS ran FROM i")
def flow_gates(s, d):
    """X07."""
    k = F.col("doc_id")
    i = S.table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "fail").when(k % 13 == 0, "error").otherwise("pass").alias("premises"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("value"), F.when(k % 5 == 0, "fail").otherwise("pass").alias("novelty"))
    return E.gates(i).select("doc_id", "outcome", "gate", F.col("ran").cast("int").alias("ran"))


@query("flow_units", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR (quality = 0 AND doc_id % 5 = 0) THEN 'error' WHEN quality = 0 THEN 'revised' ELSE 'drafted' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'draft' WHEN doc_id % 11 = 0 THEN 'verify' WHEN quality = 0 AND doc_id % 5 = 0 THEN 'revise' ELSE '' END AS error_stage FROM labels")
def flow_units(s, d):
    """X06."""
    k = F.col("doc_id")
    f = S.table(s, d, "labels").select("doc_id", (k % 7 != 0).alias("draft_ok"), (k % 11 != 0).alias("verify_ok"), F.when(F.col("quality") == 0, 2).otherwise(0).alias("findings"), (k % 5 != 0).alias("revise_ok"))
    return E.units(f).select("doc_id", "status", "error_stage")


@query("flow_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 7 AS batch FROM labels WHERE quality = 0")
def flow_batches(s, d):
    """Batches of seven in order of id; ranks come from range partitions, so no task sees all rows."""
    rows = S.table(s, d, "labels").filter("quality = 0").select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    before = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.row_number().over(W.partitionBy("part").orderBy("doc_id"))
    return rows.withColumn("turn", turn).join(F.broadcast(before), "part").select("doc_id", F.floor((F.col("before") + F.col("turn") - 1) / 7).alias("batch"))


#: A frontmatter fault in each of eight classes of documents; ``{}`` is the document's number.
FAULTS = {
    0: "---\nname: doc {0}\ndescription: b\ntype: entity\ntags: [x, y]\n---\n",
    1: "",
    2: "---\nname: [a\n---\n",
    3: "---\nname: a\nname: b\n---\n",
    4: "---\n- a\n- b\n---\n",
    5: "---\nname: doc {0} # note\nversion: 1.50\n---\n",
    6: "---\nname: doc {0}\ntags: x\nrelations: [a]\n---\n",
    7: "---\nname: doc {0}\nrelations:\n  hosted_on: \"[[doc-{0}|D]]\"  # [[no]]\n  part_of:\n    - \"[[all#x]]\"\n    - '[[other]]'\n  depends_on: [\"[[base]]\", \"[[wiki/{0}]]\"]\nreplaced_by: [[next]]\n---\n",
}


def faulty_pages(s: SparkSession, d: str) -> DataFrame:
    """Every document as a page with the fault of its class before its text."""
    k = F.col("doc_id")
    front = F.lit("")
    for cls, text in FAULTS.items():
        parts = text.split("{0}")
        made = F.concat_ws("", *(x for i, part in enumerate(parts) for x in ([k.cast("string")] if i else []) + [F.lit(part)]))
        front = F.when(F.pmod(k, F.lit(8)) == cls, made).otherwise(front)
    return S.table(s, d, "documents").select("doc_id", F.concat(F.lit("wiki/doc-"), k.cast("string"), F.lit(".md")).alias("page_path"), F.concat(front, F.coalesce("text", F.lit(""))).alias("raw"))


def _per_class(columns: str, rows: list[tuple]) -> str:
    """A statement that gives each document the rows of its class; ``{}`` becomes its number."""
    values = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    names = columns.split(", ")[1:]
    made = ", ".join(f"replace({c}, '{{}}', CAST(doc_id AS VARCHAR)) AS {c}" for c in names)
    return f"SELECT 'wiki/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS {columns.split(', ')[0]}, {made} FROM documents JOIN (VALUES {values}) v(cls, {', '.join(names)}) ON doc_id % 8 = cls"


FINDINGS = [
    (1, "no_frontmatter", "", ""),
    (2, "yaml_error", "", "frontmatter line 1: expected ',' or ']', but got '<stream end>'"),
    (3, "duplicate_key", "", "frontmatter line 2: duplicate key 'name'"),
    (4, "not_mapping", "", "list"),
    (5, "value_mismatch", "name", "YAML: 'doc {}'; lines: 'doc {} # note'"),
    (5, "value_mismatch", "version", "YAML: '1.5'; lines: '1.50'"),
    (6, "bad_shape", "tags", "expected a list of strings"),
    (6, "bad_shape", "relations", "expected links or lists of links by predicate"),
]


@query("yaml_line_mismatch", _per_class("path, kind, key, detail", FINDINGS))
def yaml_line_mismatch(s, d):
    """P07 J22 on every document, with the fault of its class."""
    return FM.yaml_findings(faulty_pages(s, d))


EDGES = [(7, "hosted_on", "doc-{}"), (7, "part_of", "all"), (7, "part_of", "other"), (7, "depends_on", "base"), (7, "depends_on", "wiki/{}"), (7, "replaced_by", "next")]


@query("relation_edges", _per_class("src, predicate, dst_raw", EDGES))
def relation_edges(s, d):
    """P04 D3 on every document, with the relations of its class."""
    return FM.relation_edges(faulty_pages(s, d))


CATALOG = [(c, "name", n) for c, n in ((0, "doc {}"), (2, "[a"), (3, "b"), (5, "doc {} # note"), (6, "doc {}"), (7, "doc {}"))]


@query("catalog_names", _per_class("path, field, value", CATALOG))
def catalog_names(s, d):
    """The catalog's view of the name field."""
    view = FM.catalog_view(faulty_pages(s, d)).select("path", F.lit("name").alias("field"), F.col("fields")["name"].alias("value"))
    return view.filter("value is not null")


@query("autofix_pages", "SELECT 'wiki/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS path, sha256('---' || chr(10) || 'type: source' || chr(10) || '---' || chr(10) || coalesce(text, '')) AS raw_sha FROM documents WHERE doc_id % 8 = 1")
def autofix_pages(s, d):
    """The type put into pages that lack frontmatter; pages whose frontmatter would not read back stay as they are."""
    p = faulty_pages(s, d).withColumn("missing", F.when(F.pmod("doc_id", F.lit(8)).isin(1, 2, 3, 4), F.lit("source")))
    return FM.with_keys(p, {"type": "missing"}).select("path", F.sha2("raw", 256).alias("raw_sha"))
