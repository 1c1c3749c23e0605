"""Scopes of scans, stored chunks and vectors, the log, sections and comparisons of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X
from pagewright.operators import chunking as K
from pagewright.operators import evaluate as E
from pagewright.operators import frontmatter as FM
from pagewright.operators import lint as L
from pagewright.operators import scan as N
from pagewright.operators import vectors as VE
from pagewright.plans import evaluation as V
from pagewright.plans import pages as G
from pagewright.plans import search as P
from pagewright.sources import corpus as S
from pagewright.sources import sinks

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Pages in folders by id: at the top, in sections, in dot folders, under the lint folder; one class is navigation.
PLACED_SQL = "pl AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'wiki/' WHEN 1 THEN 'wiki/.obsidian/' WHEN 2 THEN 'wiki/.lint/' WHEN 3 THEN 'wiki/entities/' WHEN 4 THEN 'wiki/entities/old/' ELSE 'wiki/' || source || '/' END || CASE WHEN doc_id % 11 = 0 THEN '_index' ELSE 'doc-' || CAST(doc_id AS VARCHAR) END || '.md' AS page_path FROM documents)"


def placed(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    folder = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in (0, "wiki/", 1, "wiki/.obsidian/", 2, "wiki/.lint/", 3, "wiki/entities/", 4, "wiki/entities/old/"))), (k % 7).cast("int")), F.concat(F.lit("wiki/"), "source", F.lit("/")))
    name = F.when(k % 11 == 0, "_index").otherwise(F.concat(F.lit("doc-"), k.cast("string")))
    return S.table(s, d, "documents").select("doc_id", F.concat(folder, name, F.lit(".md")).alias("page_path"))


@query("catalog_scan", f"WITH {PLACED_SQL} SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '(root)' WHEN 3 THEN 'entities' WHEN 4 THEN 'entities/old' ELSE source END AS section FROM pl JOIN documents USING (doc_id) WHERE doc_id % 11 <> 0 AND doc_id % 7 NOT IN (1, 2)")
def catalog_scan(s, d):
    """Pages for the catalog, with their sections."""
    return N.catalog_scope(placed(s, d)).select("doc_id", "section")


@query("catalog_sections", f"WITH {PLACED_SQL} SELECT doc_id FROM pl WHERE doc_id % 11 <> 0 AND doc_id % 7 IN (0, 3)")
def catalog_sections(s, d):
    """The catalog of two given sections, which their subfolders do not belong to."""
    return N.catalog_scope(placed(s, d), ["entities/", "(root)"]).select("doc_id")


@query("lint_scan", f"WITH {PLACED_SQL} SELECT doc_id FROM pl WHERE doc_id % 7 <> 2")
def lint_scan(s, d):
    """S05."""
    return N.lint_scope(placed(s, d)).select("doc_id")


@query("listed_pages", "SELECT 'wiki/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS page_path, doc_id % 3 <> 0 AS found FROM documents WHERE doc_id % 9 < 4")
def listed_pages(s, d):
    """A list of paths, some of which no page has."""
    p, k = S.pages(s, d), F.col("doc_id")
    wanted = p.filter("doc_id % 9 < 4").select(F.when(k % 3 == 0, F.regexp_replace("page_path", r"md$", "txt")).otherwise(F.col("page_path")).alias("page_path"))
    return N.listed(p.select("page_path"), wanted)


@query("chunk_scan", "SELECT 'a' || CAST(doc_id AS VARCHAR) || ':0' AS chunk_id, 'chunks/a' || CAST(doc_id AS VARCHAR) || '/chunk-000.json' AS path, 'sha256:' || sha256(CASE WHEN doc_id % 7 < 2 THEN '' ELSE 'On a page. ' END || coalesce(text, '')) AS input_hash FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 13 > 1")
def chunk_scan(s, d):
    """Records of all documents; classes have an empty or no context, lack a key or are cut off."""
    k = F.col("doc_id")
    address = F.concat(F.lit("a"), k.cast("string"))
    record = F.to_json(F.struct(
        F.when(k % 13 != 0, address).alias("page_address"), F.when(k % 13 != 1, 0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("raw_text"),
        F.when(k % 7 == 0, "").when(k % 7 != 1, F.concat(F.lit("On a page. "), F.coalesce("text", F.lit("")))).alias("contextualized_text"),
    ))
    content = F.when(k % 19 == 0, F.substring(record, 1, 9)).otherwise(record)
    files = S.table(s, d, "documents").select(F.concat(F.lit("chunks/"), address, F.lit("/chunk-000.json")).alias("path"), content.alias("content"))
    return N.chunk_scan(files).select("chunk_id", "path", "input_hash")


@query("candidate_lists", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'malformed' ELSE 'ok' END AS status, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS candidates FROM documents")
def candidate_lists(s, d):
    """Lists of candidates as JSON; a class is no list, one is cut off."""
    k = F.col("doc_id")
    one = F.to_json(F.struct(k.cast("string").alias("chunk_id"), F.col("source").alias("path"), (k / 2).alias("score")))
    payload = F.when(k % 5 == 0, one).when(k % 5 == 1, F.concat(F.lit("["), one)).when(k % 5 == 2, "[]").when(k % 5 == 3, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit(" ["), one, F.lit(", "), one, F.lit("]")))
    read = N.candidate_lists(S.table(s, d, "documents").select("doc_id", payload.alias("payload")))
    return read.select("doc_id", "status", F.coalesce(F.size("candidates"), F.lit(0)).alias("candidates"))


@query("vector_cache_load", "SELECT vec_id FROM embeddings WHERE label % 3 = 1")
def vector_cache_load(s, d):
    """The stored vectors of the current model."""
    e = S.table(s, d, "embeddings").select("vec_id", F.lit(1).alias("version"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"))
    return N.live_vectors(e, "m1").select("vec_id")


@query("vector_cache_pruned", "SELECT count(*) FILTER (vec_id % 4 <> 0 AND label % 3 = 1) AS kept, count(*) FILTER (NOT (vec_id % 4 <> 0 AND label % 3 = 1)) AS pruned FROM embeddings")
def vector_cache_pruned(s, d):
    """S11."""
    e = S.table(s, d, "embeddings").select(F.when(F.col("vec_id") % 4 != 0, "v7").alias("scheme"), F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("tag"))
    return N.prune_counts(e, "v7", "t1")


WIKI_SQL = r"wl AS (SELECT doc_id, regexp_replace(text, '([a-z]+), ([a-z]+)', '[[\1\\|\2]]', 'g') AS body FROM documents), tg AS (SELECT DISTINCT doc_id, trim(regexp_replace(x, '\\+$', '')) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(body, '\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]', 1)) AS x FROM wl))"


@query("wikilink_dead", f"WITH {WIKI_SQL} SELECT target, count(DISTINCT doc_id) AS referrers, min('doc-' || CAST(doc_id AS VARCHAR)) AS first_referrer FROM tg WHERE target NOT IN (SELECT target FROM tg WHERE doc_id % 10 = 0) GROUP BY 1")
def wikilink_dead(s, d):
    """Links in double brackets, made of the texts' word pairs with an escaped bar; targets are those of a class."""
    p = S.table(s, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("page_path"), F.regexp_replace("text", "([a-z]+), ([a-z]+)", r"[[$1\\\\|$2]]").alias("raw"))
    return L.dead_links(L.wikilinks(p), L.wikilinks(p.filter("doc_id % 10 = 0")).select("target").distinct())


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"


def lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of a document as the chunks of a page."""
    return S.table(s, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "raw_text"))


@query("bridge_passage", f"""WITH {LINES_SQL}, k AS (SELECT * FROM l WHERE (doc_id + idx) % 5 <> 0), n AS (SELECT k.doc_id, k.idx, k.line AS own, coalesce(p.line || chr(10), '') || k.line || coalesce(chr(10) || x.line, '') AS f FROM k LEFT JOIN k p ON p.doc_id = k.doc_id AND p.idx = k.idx - 1 LEFT JOIN k x ON x.doc_id = k.doc_id AND x.idx = k.idx + 1)
SELECT doc_id AS page, CAST(idx AS INTEGER) AS chunk_index, sha256(CASE WHEN len(f) <= 400 THEN f WHEN len(own) >= 400 THEN substr(own, 1, 400) ELSE substr(f, CAST(greatest(0, instr(f, substr(own, 1, 200)) - 1 - (400 - len(own)) // 2) AS BIGINT) + 1, 400) END) AS passage_sha FROM n""")
def bridge_passage(s, d):
    """Each chunk's passage in at most 400 characters, so that all three cases occur."""
    n = K.neighbours(lines(s, d).filter("(page + chunk_index) % 5 <> 0"))
    return n.select("page", "chunk_index", F.sha2(K.capped_passage(F.col("raw_text"), F.col("passage"), 400), 256).alias("passage_sha"))


#: Lines of a log, newest first by line number; classes lack a category, have a link and a path, or are no entry.
LOG_SQL = "lg AS (SELECT event_id AS line, strftime(ts, '%Y-%m-%d') AS entry_date, CASE WHEN event_id % 4 <> 0 THEN event_type END AS category, 'Event ' || CAST(user_id AS VARCHAR) AS title, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'saw [[page ' || CAST(user_id AS VARCHAR) || '|p]] at `a/' || CAST(event_id AS VARCHAR) || '.md`' END AS body FROM events WHERE event_id % 9 <> 0)"


def log_lines(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    body = F.format_string(" — saw [[page %d|p]] at `a/%d.md`", "user_id", "event_id")
    entry = F.concat(F.lit("- "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" · "), F.when(k % 4 != 0, F.concat("event_type", F.lit(" · "))).otherwise(""), F.format_string("**Event %d**", "user_id"), F.when(k % 6 == 0, "").otherwise(body))
    return S.table(s, d, "events").select(k.alias("line"), F.when(k % 9 == 0, F.concat(F.lit("  "), entry)).otherwise(entry).alias("text"))


@query("log_entries", f"WITH {LOG_SQL} SELECT line, entry_date, category, title, body, CASE WHEN body <> '' THEN regexp_extract(body, 'page \\d+') ELSE '' END AS links, regexp_extract(body, '`(.*)`', 1) AS paths FROM lg")
def log_entries(s, d):
    """The entries of a log and what they name."""
    return E.log_entries(log_lines(s, d)).select("line", "entry_date", "category", "title", "body", F.array_join("links", ",").alias("links"), F.array_join("paths", ",").alias("paths"))


@query("log_fold_batch", f"WITH {LOG_SQL} SELECT line, entry_date, title FROM lg WHERE (entry_date, title) NOT IN (SELECT (entry_date, title) FROM lg WHERE line % 3 = 0) ORDER BY line DESC LIMIT 32")
def log_fold_batch(s, d):
    """The next fold's 32 entries, from the end of the log, without those of earlier folds."""
    entries = E.log_entries(log_lines(s, d))
    return E.oldest_unfolded(entries, entries.filter("line % 3 = 0"), 5).select("line", "entry_date", "title")


@query("recall_best_threshold", f"SELECT feature, step, precision_, recall_, neg_injected FROM ({V.SQL['recall_threshold_sweep']}) ORDER BY precision_ * recall_ DESC, CASE feature WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 3 END, step LIMIT 1")
def recall_best_threshold(s, d):
    """The sweep's best row."""
    return E.best_of_sweep(V.recall_threshold_sweep(s, d)).select("feature", "step", "precision_", "recall_", "neg_injected")


SECTION_SQL = f"""{LINES_SQL}, ps AS (SELECT doc_id, idx, CASE WHEN idx % 11 = 10 THEN '## own' || chr(10) ELSE '' END || line AS raw, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - len(line) - 1 AS pos, CASE WHEN idx % 4 = 1 THEN '## ' || substr(line, 1, 12) END AS head FROM l),
hd AS (SELECT doc_id, pos + doc_id % 4 AS start, head FROM ps WHERE head IS NOT NULL),
sc AS (SELECT c.doc_id AS page, c.idx AS i, c.raw, CASE WHEN starts_with(c.raw, '## ') THEN '## own' ELSE (SELECT arg_max(h.head, h.start) FROM hd h WHERE h.doc_id = c.doc_id AND h.start <= c.pos + 2) END AS section, contains(c.raw, 'the') AND c.idx % 5 = 2 AS returned, contains(c.raw, 'on') AND c.idx % 3 = 0 AS answer FROM ps c)"""


def sectioned(s: SparkSession, d: str) -> DataFrame:
    """Lines with a heading at or a little after every fourth; some open with a heading of their own."""
    w = W.partitionBy("page").orderBy("chunk_index")
    ends = F.sum(F.length("raw_text") + 1).over(w)
    c = lines(s, d).withColumn("pos", ends - F.length("raw_text") - 1)
    heads = c.filter("chunk_index % 4 = 1").select("page", (F.col("pos") + F.col("page") % 4).alias("start"), F.concat(F.lit("## "), F.substring("raw_text", 1, 12)).alias("heading"))
    raw = F.when(F.col("chunk_index") % 11 == 10, F.concat(F.lit("## own\n"), "raw_text")).otherwise(F.col("raw_text"))
    i = F.col("chunk_index")
    marks = {"returned": F.contains("raw_text", F.lit("the")) & (i % 5 == 2), "answer": F.contains("raw_text", F.lit("on")) & (i % 3 == 0)}
    return E.sections(c.withColumn("raw_text", raw), heads).withColumns(marks)


@query("chunk_sections", f"WITH {SECTION_SQL} SELECT page, CAST(i AS INTEGER) AS chunk_index, section FROM sc")
def chunk_sections(s, d):
    """The heading in force at each chunk."""
    return sectioned(s, d).select("page", "chunk_index", "section")


@query(
    "eval_window_cost",
    f"""WITH {SECTION_SQL}, own AS (SELECT DISTINCT page, section FROM sc WHERE returned), sh AS (SELECT sc.*, EXISTS (SELECT 1 FROM own WHERE own.page = sc.page AND own.section IS NOT DISTINCT FROM sc.section) AS shared FROM sc)
SELECT page, (SELECT CAST(min(abs(r.i - a.i)) AS INTEGER) FROM sc r JOIN sc a ON r.page = a.page AND r.returned AND a.answer WHERE r.page = sh.page) AS distance, CAST(max(CASE WHEN answer THEN shared END) AS BOOLEAN) AS same_section, CAST(sum(CASE WHEN shared AND NOT returned THEN len(raw) ELSE 0 END) AS BIGINT) AS extra_section FROM sh GROUP BY page HAVING bool_or(returned)""",
)
def eval_window_cost(s, d):
    """How far answers lie from what was returned, and what whole sections would cost."""
    return E.window_costs(sectioned(s, d))


RUN_SQL = f"""{V.LABEL_SQL}, r5 AS (SELECT b.item_id AS query_id, (SELECT min(rank) FROM bres r JOIN gold g ON g.query_id = r.query_id AND g.page = r.page WHERE r.query_id = b.item_id) AS rank FROM benchmark b),
nw AS (SELECT r5.query_id, rank, labels FROM r5 LEFT JOIN ls USING (query_id) WHERE r5.query_id % 10 <> 9), od AS (SELECT r5.query_id, CASE WHEN rank <= 3 THEN rank END AS rank, substr(labels, 1, 3) AS labels FROM r5 LEFT JOIN ls USING (query_id) WHERE r5.query_id % 10 <> 8)"""


@query("eval_label_diff", f"WITH {RUN_SQL} SELECT coalesce(nw.query_id, od.query_id) AS query_id, nw.rank AS new_rank, nw.labels AS new_labels, od.rank AS old_rank, od.labels AS old_labels, CASE WHEN od.query_id IS NULL THEN 'new' WHEN nw.query_id IS NULL THEN 'gone' WHEN nw.rank IS NOT DISTINCT FROM od.rank AND nw.labels IS NOT DISTINCT FROM od.labels THEN 'same' ELSE 'changed' END AS state FROM nw FULL OUTER JOIN od ON nw.query_id = od.query_id")
def eval_label_diff(s, d):
    """A run with windows of five against one with windows of three, by rank and labels."""
    run = E.first_rank(P.queries_of(s, d), V.results(s, d), V.gold(s, d)).join(V.labels(s, d), "query_id", "left")
    old = run.filter("query_id % 10 <> 8").select("query_id", F.when(F.col("rank") <= 3, F.col("rank")).alias("rank"), F.substring("labels", 1, 3).alias("labels"))
    return E.run_diff(run.filter("query_id % 10 <> 9"), old)


@query("judge_summary", "SELECT coalesce(CASE user_id % 4 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'stale' WHEN 2 THEN 'duplicate' END, 'none') AS relation, count(*) AS pairs, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1")
def judge_summary(s, d):
    """Events as judged pairs."""
    relation = F.element_at(F.create_map(*(x for i, r in enumerate(C.PAIR_RELATIONS) for x in (F.lit(i), F.lit(r)))), (F.col("user_id") % 4).cast("int"))
    out = E.judge_summary(S.table(s, d, "events").select(relation.alias("relation"), F.col("value").alias("seconds")))
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("lint_report", f"SELECT (SELECT CAST(sum(findings) AS BIGINT) FROM ({G.SQL['lint_by_type']})) AS findings, z.n AS page_count, z.digest AS vault_sha FROM ({P.SQL['corpus_digest']}) z")
def lint_report(s, d):
    """The lint report's head: findings, pages and the digest of the corpus."""
    total = G.lint_by_type(s, d).agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
    return total.crossJoin(P.corpus_digest(s, d).select(F.col("n").alias("page_count"), F.col("digest").alias("vault_sha")))


@query("idea_nearest_sides", f"WITH {P.POOL_SQL}, c AS (SELECT label AS query_id, CASE WHEN vec_id % 5 = 0 THEN 'ledger' ELSE 'chunk' END AS side, vec_id AS item_id, {P._cos('m', 'v')} AS c FROM means CROSS JOIN (SELECT vec_id, v FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY round(c, 9) DESC, item_id) AS t FROM c) SELECT query_id, side, item_id, round(c, 6) AS cosine FROM r WHERE t = 1")
def idea_nearest_sides(s, d):
    """Each idea's nearest chunk and nearest entry of the ledger, which a class of vectors stands for."""
    return P.nearest_sides(P.label_queries(s, d), {"chunk": P.vectors(s, d).filter("item_id % 5 <> 0"), "ledger": P.vectors(s, d).filter("item_id % 5 = 0")}).withColumn("cosine", F.round("cosine", 6))


@query("cache_lookup", "SELECT doc_id, doc_id % 5 NOT IN (0, 1) AND vec_id IS NOT NULL AND label % 3 <> 0 AS hit, round(CASE WHEN doc_id % 5 NOT IN (0, 1) AND label % 3 <> 0 THEN CAST(embedding[1] AS DOUBLE) END, 6) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def cache_lookup(s, d):
    """Stored vectors by model, scheme and text; a class of texts has changed, one is of another scheme, some have another model."""
    of = lambda c: X.text_hash(c.cast("string"))
    k = F.col("doc_id")
    wanted = S.table(s, d, "documents").select("doc_id", of(F.when(k % 5 == 0, -k - 1).otherwise(k)).alias("input_hash"))
    v = F.col("vec_id")
    cache = S.table(s, d, "embeddings").select(F.when(F.col("label") % 3 == 0, "other").otherwise("m").alias("model"), F.when(v % 5 == 1, "v6").otherwise("v7").alias("scheme"), of(v).alias("input_hash"), F.col("embedding").alias("vector"))
    got = VE.cached(wanted, cache, "m", "v7")
    return got.select("doc_id", F.col("vector").isNotNull().alias("hit"), F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("retrieval_texts", "SELECT item_id, substr(regexp_replace(trim('  dell-' || replace(text, ' the ', ' l-') || ' '), '(?i)\\b(l|un|dell|all|nell|dall|sull|quell|quest|c|d|s|m|t|v|n|po|qual|com|dov|anch)-([\\p{L}\\p{N}_])', '\\1 \\2', 'g'), 1, 600) AS query_text FROM benchmark")
def retrieval_texts(s, d):
    """What the gate asks for a prompt; articles become elisions written with a hyphen."""
    prompt = F.concat(F.lit("  dell-"), F.replace(F.col("text"), F.lit(" the "), F.lit(" l-")), F.lit(" "))
    return S.table(s, d, "benchmark").select("item_id", X.query_text(prompt).alias("query_text"))


@query("first_headings", "SELECT doc_id, trim(regexp_extract(regexp_replace(text, '\\n([A-M])', chr(10) || '##  \\1', 'g'), '(?m)^#+[ \\t]*(.*)$', 1)) AS section FROM documents")
def first_headings(s, d):
    """P20: the section that a pointer names; lines of a class of initials become headings."""
    return S.table(s, d, "documents").select("doc_id", X.first_heading(F.regexp_replace("text", "\n([A-M])", "\n##  $1")).alias("section"))


def maintenance_round(pages: DataFrame, missing: dict[str, str], stamps: str, day: str) -> tuple[DataFrame, DataFrame]:
    """One round over pages (page_path, raw): missing keys are put in, then fields, types and links are linted, then the round is stamped.

    ``missing`` names the columns that hold the values of missing keys. Returns the changed pages and the findings on the pages after the change.
    """
    fixed = FM.with_keys(pages, missing)
    now = pages.select("page_path", "raw").join(fixed.select(F.col("path").alias("page_path"), F.col("raw").alias("new_raw")), "page_path", "left").select("page_path", F.coalesce("new_raw", "raw").alias("raw"))
    lacking = now.withColumn("missing", F.array_join(L.missing_keys(X.front_map(F.col("raw"))), ",")).filter("missing <> ''")
    dead = L.dead_links(L.wikilinks(now), L.link_targets(now))
    found = L.finding(lacking, "missing_frontmatter", "page_path", "missing").unionByName(L.finding(dead, "dead_link", "first_referrer", "target"))
    sinks.write_stamp(pages.sparkSession, stamps, "maintenance", day)
    return fixed, found
