"""Ingest, lint, growth and catalog over the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X
from pagewright.operators import chunking as K
from pagewright.operators import lint as L
from pagewright.sources import corpus as S

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


STALE = "(" + ", ".join(f"'{x}'" for x in C.STALE_STATUSES) + ")"


@query("page_frontmatter_fields", f"WITH {S.PAGES_SQL} SELECT page_path, coalesce(declared, '') AS address, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, status, status IN {STALE} AS stale, doc_id % 17 <> 0 AS indexed, ptype AS type FROM pages1")
def page_frontmatter_fields(s, d):
    """P01 P03 P05 P06 S03 F01."""
    p, block = S.pages(s, d), X.front_block(F.col("raw"))
    return p.select("page_path", X.field(block, "address").alias("address"), X.field(block, "title").alias("title"), X.field(block, "status").alias("status"), X.stale(X.field(block, "status")).alias("stale"), X.indexed(F.col("raw")).alias("indexed"), X.front_map(F.col("raw"))["type"].alias("type"))


@query("address_resolution", f"WITH {S.PAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY declared ORDER BY page_path) AS t FROM pages1) SELECT page_path, CASE WHEN declared IS NOT NULL AND t = 1 THEN declared ELSE 'syn-' || substr(sha1(page_path), 1, 6) END AS address FROM o")
def address_resolution(s, d):
    """P08 P09 W10."""
    return L.address_owner(S.pages(s, d)).select("page_path", "address")


@query("address_allocation", f"WITH {S.PAGES_SQL}, t AS (SELECT max(CAST(substr(declared, 3) AS BIGINT)) AS top FROM pages1) SELECT page_path, 'c-' || lpad(CAST(top + row_number() OVER (ORDER BY page_path) AS VARCHAR), 6, '0') AS address FROM pages1, t WHERE declared IS NULL")
def address_allocation(s, d):
    """K16 A24."""
    return L.next_addresses(S.pages(s, d))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace("body", "\n", "\n\n")
    return K.chunk_pages(S.pages(s, d).withColumn("body", body))


def chunk_sql(body: str) -> str:
    """Tables of a recursive statement up to ``chunks(page_path, k, txt)``: paragraphs, runs of lines of long ones, bins with tails."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    tails = " ".join(f"WHEN strpos(t, {m}) > 0 AND len(t) - strpos(t, {m}) - {n} + 1 >= 20 THEN substr(t, strpos(t, {m}) + {n})" for m, n in (("chr(10) || chr(10)", 2), ("'. '", 2), ("chr(10)", 1), ("' '", 1)))
    return f"""{S.PAGES_SQL},
para AS (SELECT page_path, j, trim(x, {blank}) AS x FROM (SELECT page_path, unnest(ps) AS x, generate_subscripts(ps, 1) AS j FROM (SELECT page_path, regexp_split_to_array({body}, '\\n\\s*\\n') AS ps FROM pages1)) WHERE trim(x, {blank}) <> ''),
lines AS (SELECT page_path, j, list(l ORDER BY i) AS ls, list(e ORDER BY i) AS es FROM (SELECT *, sum(len(l) + 1) OVER (PARTITION BY page_path, j ORDER BY i) AS e FROM (SELECT page_path, j, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM para WHERE len(x) > 4000)) GROUP BY 1, 2),
cut(page_path, j, lo, hi) AS (SELECT page_path, j, 0, least(len(list_filter(es, lambda e: e < 2000)) + 1, len(es)) FROM lines
  UNION ALL SELECT page_path, j, hi, least(greatest(len(list_filter(es, lambda e: e < es[hi] + 2000)), hi) + 1, len(es)) FROM cut JOIN lines USING (page_path, j) WHERE hi < len(es)),
piece AS (SELECT page_path, j, 0 AS lo, x FROM para WHERE len(x) <= 4000 UNION ALL SELECT page_path, j, lo, array_to_string(ls[lo + 1 : hi], chr(10)) FROM cut JOIN lines USING (page_path, j)),
held AS (SELECT page_path, list(x ORDER BY j, lo) AS ps, list(e ORDER BY j, lo) AS es FROM (SELECT *, sum(len(x) + 2) OVER (PARTITION BY page_path ORDER BY j, lo) AS e FROM piece) GROUP BY 1),
chunks(page_path, k, hi, txt, tail) AS (SELECT page_path, -1, 0, '', '' FROM held
  UNION ALL SELECT page_path, k, hi, txt, CASE WHEN len(txt) <= 200 THEN txt {tails} ELSE t END
  FROM (SELECT *, right(txt, 200) AS t FROM (SELECT page_path, k + 1 AS k, nx AS hi, CASE WHEN tail <> '' THEN tail || chr(10) || chr(10) ELSE '' END || array_to_string(ps[hi + 1 : nx], chr(10) || chr(10)) AS txt
    FROM (SELECT *, least(greatest(len(list_filter(es, lambda e: e < coalesce(es[hi], 0) + 2000 - len(tail))), hi) + 1, len(es)) AS nx FROM chunks JOIN held USING (page_path) WHERE hi < len(es)))))"""


DIGEST_SQL = "SELECT page_path, CAST(k AS INTEGER) AS chunk_index, CAST(len(txt) AS INTEGER) AS char_count, sha256(txt) AS body_hash FROM chunks WHERE k >= 0"
LINES_SQL = "replace(body, chr(10), chr(10) || chr(10))"


@query("chunk_corpus", f"WITH RECURSIVE {chunk_sql(LINES_SQL)} {DIGEST_SQL}")
def chunk_corpus(s, d):
    """P10 P11 P12 on the bodies, each line a paragraph."""
    return _chunks(s, d).select("page_path", "chunk_index", F.length("raw_text").alias("char_count"), F.sha2("raw_text", 256).alias("body_hash"))


@query("chunk_hard_split", f"WITH RECURSIVE {chunk_sql('body')} {DIGEST_SQL}")
def chunk_hard_split(s, d):
    """P10 P11 on the bodies as they are: single paragraphs, the long ones cut at lines."""
    return K.chunk_pages(S.pages(s, d)).select("page_path", "chunk_index", F.length("raw_text").alias("char_count"), F.sha2("raw_text", 256).alias("body_hash"))


#: The documents hold no struck span, so the statement leaves their removal out; tests cover it.
PREFIX_SQL = f"""{chunk_sql(LINES_SQL)},
heads AS (SELECT page_path, 'This passage is from the wiki page "Doc ' || CAST(doc_id AS VARCHAR) || '". The page opens: ' || substr(coalesce(nullif(regexp_extract(b, '^((?s:.*?)[.!?])\\s', 1), ''), b), 1, 300)
  || CASE WHEN status IN {STALE} THEN ' Page status: ' || status || '. Replaced by: doc-1, doc-2.' ELSE '' END AS prefix FROM (SELECT *, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM pages1))"""


@query("chunk_context_prefix", f"WITH RECURSIVE {PREFIX_SQL} SELECT page_path, CAST(k AS INTEGER) AS chunk_index, prefix, CAST(len(prefix) + 2 + len(txt) AS INTEGER) AS char_count FROM chunks JOIN heads USING (page_path) WHERE k >= 0")
def chunk_context_prefix(s, d):
    """The indexed text of every chunk."""
    p = S.pages(s, d)
    prefix = K.context_prefix(X.field(X.front_block(F.col("raw")), "title"), F.col("body"), F.col("status"), F.lit("[[doc-1]], [[doc-2|two]]"))
    head = p.select("page_path", prefix.alias("prefix"))
    return _chunks(s, d).join(head, "page_path").select("page_path", "chunk_index", "prefix", F.length(K.indexed_text(F.col("prefix"), F.col("raw_text"))).alias("char_count"))


UPSERT_SQL = f"""{S.PAGES_SQL},
n AS (SELECT 'a' || CAST(doc_id AS VARCHAR) AS page_address, 0 AS chunk_index, sha256(body) AS bh, sha256(raw) AS ph, 2 AS scheme, page_path FROM pages1 WHERE doc_id % 10 <> 9),
o AS (SELECT 'a' || CAST(doc_id AS VARCHAR) AS page_address, 0 AS chunk_index, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(body) END AS bh, sha256(raw) AS ph, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 2 END AS scheme, CASE WHEN doc_id % 7 = 0 THEN 'wiki/moved.md' ELSE page_path END AS page_path FROM pages1 WHERE doc_id % 6 <> 5)"""


@query("chunk_upsert_plan", f"WITH {UPSERT_SQL} SELECT coalesce(n.page_address, o.page_address) AS page_address, CASE WHEN n.page_address IS NULL THEN 'prune' WHEN o.page_address IS NOT NULL AND n.bh = o.bh AND n.ph = o.ph AND n.scheme = coalesce(o.scheme, 1) AND n.page_path = o.page_path THEN 'skip' ELSE 'write' END AS action FROM n FULL OUTER JOIN o ON n.page_address = o.page_address")
def chunk_upsert_plan(s, d):
    """A new snapshot against a stored one that lacks, changes and moves pages."""
    p, k = S.pages(s, d), F.col("doc_id")
    base = p.select("doc_id", F.concat(F.lit("a"), k.cast("string")).alias("page_address"), F.lit(0).alias("chunk_index"), F.sha2("body", 256).alias("body_hash"), F.sha2("raw", 256).alias("page_body_hash"), F.lit(2).alias("prefix_scheme"), "page_path")
    old = base.filter("doc_id % 6 <> 5").withColumns({"body_hash": F.when(k % 4 == 0, "old").otherwise(F.col("body_hash")), "prefix_scheme": F.when(k % 5 != 0, F.col("prefix_scheme")), "page_path": F.when(k % 7 == 0, "wiki/moved.md").otherwise(F.col("page_path"))})
    return K.upsert_plan(base.filter("doc_id % 10 <> 9"), old).select("page_address", "action")


@query("chunk_gc", f"WITH {S.PAGES_SQL} SELECT 'c-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS address FROM pages1 p WHERE NOT EXISTS (SELECT 1 FROM pages1 q WHERE q.declared = 'c-' || lpad(CAST(p.doc_id AS VARCHAR), 6, '0'))")
def chunk_gc(s, d):
    """Stored addresses that no page has any more."""
    p = S.pages(s, d)
    stored = p.select(F.format_string("c-%06d", "doc_id").alias("address"))
    return K.dead_rows(stored, p.select(F.col("declared").alias("address")), "address")


@query("cache_gc", "WITH c AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'odd' ELSE 'tag:model:v6:sha256:' || sha256(CAST(vec_id AS VARCHAR)) END AS key FROM embeddings), l AS (SELECT 'sha256:' || sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id % 3 = 0) SELECT vec_id, key FROM c WHERE key = 'odd' OR substr(key, 14) NOT IN (SELECT h FROM l)")
def cache_gc(s, d):
    """Keys whose last two parts are no live hash; a key of unknown shape is dead."""
    own = F.concat(F.lit("sha256:"), F.sha2(F.col("vec_id").cast("string"), 256))
    c = S.table(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, "odd").otherwise(F.concat(F.lit("tag:model:v6:"), own)).alias("key"))
    live = S.table(s, d, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("sha256:"), F.sha2(F.col("doc_id").cast("string"), 256)).alias("hash"))
    return K.dead_rows(c.withColumn("hash", K.live_key(F.col("key"))), live, "hash").select("vec_id", "key")


@query("vector_orphans", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1)")
def vector_orphans(s, d):
    """K07 S12 J23."""
    live = S.table(s, d, "documents").filter("doc_id % 4 <> 1").select(F.col("doc_id").alias("vec_id"))
    return K.dead_rows(S.table(s, d, "embeddings").select("vec_id"), live, "vec_id")


@query("cache_merge", "WITH a AS (SELECT vec_id, label, 'disk' AS origin FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT vec_id, label + 100 AS label, 'mine' AS origin FROM embeddings WHERE vec_id % 2 = 0) SELECT * FROM b UNION ALL SELECT * FROM a WHERE vec_id NOT IN (SELECT vec_id FROM b)")
def cache_merge(s, d):
    """K06 S11 U01."""
    e = S.table(s, d, "embeddings")
    disk = e.filter("vec_id % 3 <> 0").select("vec_id", "label", F.lit("disk").alias("origin"))
    return K.merge_cache(disk, e.filter("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit("mine").alias("origin")), "vec_id")


@query("neighbour_passages", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), k AS (SELECT * FROM l WHERE (doc_id + idx) % 5 <> 0) SELECT k.doc_id, CAST(k.idx AS INTEGER) AS idx, CAST(coalesce(len(p.line) + 1, 0) + len(k.line) + coalesce(len(n.line) + 1, 0) AS INTEGER) AS size FROM k LEFT JOIN k p ON p.doc_id = k.doc_id AND p.idx = k.idx - 1 LEFT JOIN k n ON n.doc_id = k.doc_id AND n.idx = k.idx + 1")
def neighbour_passages(s, d):
    """A chunk with its neighbours, only where the index is adjacent."""
    lines = S.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).filter("(doc_id + idx) % 5 <> 0")
    return K.neighbours(lines, "doc_id", "idx", "line").select("doc_id", "idx", F.length("passage").alias("size"))


HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
LINKS_SQL = f"lk AS (SELECT CAST(page_id AS VARCHAR) AS src, unnest({HREF}) AS target FROM pages), tg AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[^:]*://[^/]*', ''), '[?#].*$', '') AS target FROM pages UNION SELECT '/' || w FROM (SELECT 'the' AS w UNION SELECT 'of' UNION SELECT 'and'))"


def links(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = S.table(s, d, "pages")
    found = p.select(F.col("page_id").cast("string").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    own = p.select(F.regexp_replace(F.regexp_replace("url", r"^[^:]*://[^/]*", ""), r"[?#].*$", "").alias("target")).unionByName(s.createDataFrame([("/the",), ("/of",), ("/and",)], "target string"))
    return found, own.distinct()


@query("dead_links", f"WITH {LINKS_SQL} SELECT target, count(DISTINCT src) AS referrers, min(src) AS first_referrer FROM lk WHERE target NOT IN (SELECT target FROM tg) GROUP BY 1")
def dead_links(s, d):
    """Links are the pages' href values."""
    return L.dead_links(*links(s, d))


@query("orphan_pages", "WITH p AS (SELECT 'wiki/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS page_path, doc_id FROM documents), l AS (SELECT 'doc-' || CAST((doc_id * 3) % (SELECT count(*) FROM documents) AS VARCHAR) AS target FROM documents WHERE doc_id % 2 = 0 UNION SELECT 'wiki/' || source || '/doc-' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 9 = 1) SELECT page_path FROM p WHERE 'doc-' || CAST(doc_id AS VARCHAR) NOT IN (SELECT target FROM l) AND replace(page_path, '.md', '') NOT IN (SELECT target FROM l)")
def orphan_pages(s, d):
    """Links by slug and by path, links to the page itself among them."""
    p, k = S.pages(s, d), F.col("doc_id")
    n = p.count()
    by_slug = p.filter("doc_id % 2 = 0").select(F.col("page_path").alias("src"), F.concat(F.lit("doc-"), ((k * 3) % n).cast("string")).alias("target"))
    by_path = p.filter("doc_id % 9 = 1").select(F.col("page_path").alias("src"), F.regexp_replace("page_path", r"\.md$", "").alias("target"))
    return L.orphans(p, by_slug.unionByName(by_path))


EDGE_SQL = """
ed AS (SELECT 'entity/s' || CAST(s_suppkey AS VARCHAR) AS src, CASE WHEN s_suppkey % 29 = 0 THEN 'lives_in' ELSE 'hosted_on' END AS predicate, 'entity/n' || CAST(s_nationkey AS VARCHAR) AS dst FROM supplier
  UNION SELECT 'entity/n' || CAST(s_nationkey AS VARCHAR), 'hosts', 'entity/s' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 <> 0
  UNION SELECT 'entity/n' || CAST(n_nationkey AS VARCHAR), 'part_of', 'meta/r' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION SELECT 'entity/n' || CAST(n_nationkey AS VARCHAR), 'references', 'meta/r' || CAST(n_regionkey AS VARCHAR) FROM nation)
"""


def edges(s: SparkSession, d: str) -> DataFrame:
    """Suppliers hosted on nations (a class of back edges missing), nations part of regions."""
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sup, nat = S.table(s, d, "supplier"), S.table(s, d, "nation")
    a = sup.select(at("entity/s", "s_suppkey").alias("src"), F.when(F.col("s_suppkey") % 29 == 0, "lives_in").otherwise("hosted_on").alias("predicate"), at("entity/n", "s_nationkey").alias("dst"))
    b = sup.filter("s_suppkey % 4 <> 0").select(at("entity/n", "s_nationkey").alias("src"), F.lit("hosts").alias("predicate"), at("entity/s", "s_suppkey").alias("dst"))
    c = nat.select(at("entity/n", "n_nationkey").alias("src"), F.explode(F.array(F.lit("part_of"), F.lit("references"))).alias("predicate"), at("meta/r", "n_regionkey").alias("dst"))
    return a.unionByName(b).unionByName(c).distinct()


@query("relation_missing_inverse", f"WITH {EDGE_SQL}, inv AS (SELECT 'hosted_on' AS p, 'hosts' AS i UNION SELECT 'hosts', 'hosted_on' UNION SELECT 'references', 'referenced_by') SELECT DISTINCT e.dst AS src, i AS predicate, e.src AS dst FROM ed e JOIN inv ON inv.p = e.predicate WHERE e.src LIKE 'entity/%' AND e.dst LIKE 'entity/%' AND NOT EXISTS (SELECT 1 FROM ed b WHERE b.src = e.dst AND b.predicate = i AND b.dst = e.src)")
def relation_missing_inverse(s, d):
    """J10."""
    e = edges(s, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("page_path")).distinct()
    return L.missing_inverses(e, nodes.withColumn("ptype", F.substring_index("page_path", "/", 1)))


@query("relation_unknown_predicate", f"WITH {EDGE_SQL} SELECT predicate, count(*) AS edges FROM ed WHERE predicate = 'lives_in' GROUP BY 1")
def relation_unknown_predicate(s, d):
    """P04 vocabulary."""
    return L.unknown_predicates(edges(s, d))


@query("relation_resolve", "WITH pg AS (SELECT page_id, 'wiki/p' || CAST(page_id % 2 AS VARCHAR) || '/n' || CAST(page_id % 60 AS VARCHAR) || '-' || CAST(CASE WHEN page_id % 60 < 20 THEN 0 ELSE page_id END AS VARCHAR) AS stem FROM pages), u AS (SELECT DISTINCT stem FROM pg), sl AS (SELECT regexp_extract(stem, '[^/]+$') AS slug, count(*) AS n, min(stem) AS stem FROM u GROUP BY 1), e AS (SELECT DISTINCT stem AS src, CASE WHEN page_id % 3 = 0 THEN stem WHEN page_id % 3 = 1 THEN regexp_extract(stem, '[^/]+$') ELSE 'n' || CAST((page_id + 61) % 60 AS VARCHAR) || '-' || CAST(page_id + 61 AS VARCHAR) END AS raw FROM pg) SELECT src || '.md' AS src, coalesce(u.stem, CASE WHEN sl.n = 1 THEN sl.stem END) || '.md' AS dst FROM e LEFT JOIN u ON u.stem = e.raw LEFT JOIN sl ON sl.slug = e.raw WHERE coalesce(u.stem, CASE WHEN sl.n = 1 THEN sl.stem END) <> src")
def relation_resolve(s, d):
    """By path, by unique slug, ambiguous and unknown targets, edges to the page itself."""
    k = F.col("page_id")
    stem = F.concat(F.lit("wiki/p"), (k % 2).cast("string"), F.lit("/n"), (k % 60).cast("string"), F.lit("-"), F.when(k % 60 < 20, F.lit(0)).otherwise(k).cast("string"))
    p = S.table(s, d, "pages").select("page_id", stem.alias("stem"))
    raw = F.when(k % 3 == 0, F.col("stem")).when(k % 3 == 1, F.substring_index("stem", "/", -1)).otherwise(F.concat(F.lit("n"), ((k + 61) % 60).cast("string"), F.lit("-"), (k + 61).cast("string")))
    e = p.select(F.concat("stem", F.lit(".md")).alias("src"), F.lit("related_to").alias("predicate"), raw.alias("dst_raw")).distinct()
    return L.resolve(e, p.select(F.concat("stem", F.lit(".md")).alias("page_path")).distinct()).select("src", "dst")


@query("frontmatter_missing", f"WITH {S.PAGES_SQL} SELECT page_path, 'description' AS missing FROM pages1 WHERE doc_id % 5 = 4")
def frontmatter_missing(s, d):
    """F12 P03."""
    p = S.pages(s, d).withColumn("missing", L.missing_keys(X.front_map(F.col("raw")))).filter(F.size("missing") > 0)
    return p.select("page_path", F.array_join("missing", ",").alias("missing"))


@query("invalid_type", f"WITH {S.PAGES_SQL} SELECT page_path, ptype AS type FROM pages1 WHERE ptype = 'note'")
def invalid_type(s, d):
    """F12."""
    p = S.pages(s, d).withColumn("type", X.front_map(F.col("raw"))["type"])
    return p.filter(~F.col("type").isin(*C.PAGE_TYPES)).select("page_path", "type")


@query("duplicate_slug", "WITH p AS (SELECT CASE WHEN doc_id % 50 = 0 THEN '_index' ELSE 'doc-' || CAST(doc_id // 2 * 2 % 300 AS VARCHAR) END AS slug, 'wiki/' || source || '/' || CAST(doc_id AS VARCHAR) AS page_path FROM documents) SELECT slug, count(*) AS pages, min(page_path) AS first_page, max(page_path) AS last_page FROM p WHERE slug <> '_index' GROUP BY 1 HAVING count(*) > 1")
def duplicate_slug(s, d):
    """A12."""
    k = F.col("doc_id")
    slug = F.when(k % 50 == 0, "_index").otherwise(F.concat(F.lit("doc-"), ((k - k % 2) % 300).cast("string")))
    p = S.table(s, d, "documents").select(slug.alias("slug"), F.concat(F.lit("wiki/"), "source", F.lit("/"), k.cast("string")).alias("page_path"))
    return L.duplicates(p.filter("slug <> '_index'"), "slug")


@query("duplicate_address", f"WITH {S.PAGES_SQL} SELECT declared AS address, count(*) AS pages, min(page_path) AS first_page, max(page_path) AS last_page FROM pages1 WHERE declared IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_address(s, d):
    """A12."""
    return L.duplicates(S.pages(s, d).withColumnRenamed("declared", "address"), "address")


AGE_SQL = f"""{S.PAGES_SQL}, up AS (SELECT p.page_path, p.status, p.doc_id, CASE WHEN p.doc_id % 23 = 0 THEN 'soon' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS updated, o.o_orderdate AS day FROM pages1 p JOIN orders o ON o.o_orderkey = p.doc_id)"""


def updated(s: SparkSession, d: str) -> DataFrame:
    o = S.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return S.pages(s, d).join(o, "doc_id").withColumn("updated", F.when(F.col("doc_id") % 23 == 0, "soon").otherwise(F.col("day"))).withColumn("indexed", X.indexed(F.col("raw")))


@query("stale_pages", f"WITH {AGE_SQL} SELECT page_path, CAST(DATE '1998-01-01' - CAST(day AS DATE) AS INTEGER) AS age_days FROM up WHERE doc_id % 23 <> 0 AND doc_id % 17 <> 0 AND status NOT IN ('evergreen', 'archived') AND DATE '1998-01-01' - CAST(day AS DATE) > 90")
def stale_pages(s, d):
    """F11."""
    return L.stale_pages(updated(s, d), "1998-01-01").select("page_path", "age_days")


FINDINGS_SQL = f"""{AGE_SQL}, fi AS (
SELECT 'missing_frontmatter' AS type, page_path AS path, CAST(NULL AS VARCHAR) AS target FROM pages1 WHERE doc_id % 5 = 4
UNION ALL SELECT 'invalid_type', page_path, ptype FROM pages1 WHERE ptype = 'note'
UNION ALL SELECT 'stale', page_path, NULL FROM up WHERE doc_id % 23 <> 0 AND doc_id % 17 <> 0 AND status NOT IN ('evergreen', 'archived') AND DATE '1998-01-01' - CAST(day AS DATE) > 90
UNION ALL SELECT 'duplicate_address', min(page_path), max(page_path) FROM pages1 WHERE declared IS NOT NULL GROUP BY declared HAVING count(*) > 1)"""


def findings(s: SparkSession, d: str) -> DataFrame:
    """The union of the linters."""
    out = L.finding(frontmatter_missing(s, d), "missing_frontmatter", "page_path")
    out = out.unionByName(L.finding(invalid_type(s, d), "invalid_type", "page_path", "type"))
    out = out.unionByName(L.finding(stale_pages(s, d), "stale", "page_path"))
    return out.unionByName(L.finding(duplicate_address(s, d), "duplicate_address", "first_page", "last_page"))


@query("lint_by_type", f"WITH {FINDINGS_SQL} SELECT type, count(*) AS findings FROM fi GROUP BY 1")
def lint_by_type(s, d):
    """A11."""
    return findings(s, d).groupBy("type").agg(F.count("*").alias("findings"))


@query("lint_brief", f"WITH {FINDINGS_SQL} SELECT * FROM fi WHERE type NOT IN ('stale', 'hot_oversize', 'log_oversize')")
def lint_brief(s, d):
    """F17 K12."""
    return L.brief(findings(s, d))


@query("lint_only", f"WITH {FINDINGS_SQL}, w AS (SELECT min(page_path) AS a, max(page_path) AS b FROM pages1) SELECT fi.* FROM fi, w WHERE path IN (a, b) OR target IN (a, b)")
def lint_only(s, d):
    """Findings on two given pages."""
    a, b = S.pages(s, d).agg(F.min("page_path"), F.max("page_path")).first()
    return L.only(findings(s, d), [a, b])


@query("oversize_pages", "WITH t AS (SELECT doc_id, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents) SELECT doc_id, CAST(bytes AS INTEGER) AS n_bytes, CAST(lines AS INTEGER) AS n_lines, CASE WHEN bytes > 7168 THEN 'hot_oversize' ELSE 'log_oversize' END AS type FROM t WHERE bytes > 7168 OR lines > 500")
def oversize_pages(s, d):
    """bytes of a hot page, lines of a log."""
    t = S.table(s, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), F.size(F.split("text", "\n")).alias("n_lines"))
    hot = F.col("n_bytes") > C.DEFAULTS.hot_bytes
    return t.filter(hot | (F.col("n_lines") > C.DEFAULTS.log_lines)).withColumn("type", F.when(hot, "hot_oversize").otherwise("log_oversize"))


@query("catalog", f"WITH {S.PAGES_SQL} SELECT section, 'doc-' || CAST(doc_id AS VARCHAR) AS page, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, count(*) OVER (PARTITION BY section) AS in_section FROM pages1 WHERE status IN ('active', 'evergreen') AND doc_id % 17 <> 0 ORDER BY section, page")
def catalog(s, d):
    """S04 A19 L06 F02."""
    p, block = S.pages(s, d), X.front_block(F.col("raw"))
    live = p.filter(~X.page_name(F.col("page_path")).isin(*C.CATALOG_SKIP) & X.field(block, "status").isin(*C.LIVE_STATUSES) & ~F.lower(X.field(block, "index")).isin("false", "no", "off"))
    counts = live.groupBy("section").agg(F.count("*").alias("in_section"))
    return live.select("section", X.slug(F.col("page_path")).alias("page"), X.field(block, "title").alias("title")).join(counts, "section").orderBy("section", "page")


TILING_SQL = f"""{S.PAGES_SQL},
files AS (SELECT CASE doc_id % 43 WHEN 0 THEN 'wiki/overview.md' WHEN 1 THEN 'wiki/folds/f' || CAST(doc_id AS VARCHAR) || '.md' WHEN 2 THEN 'wiki/meta/m' || CAST(doc_id AS VARCHAR) || '.md' ELSE page_path END AS page_path, doc_id % 37 = 0 AS is_link, doc_id % 53 <> 0 AS inside, doc_id % 41 <> 0 AS readable, strlen(raw) * 8 AS n_bytes, ptype AS type FROM pages1)"""


def tiling_files(s: SparkSession, d: str) -> DataFrame:
    """Pages as a scan's files. What plain tables lack follows the id; sizes are eight times the pages', which are small."""
    k = F.col("doc_id")
    path = F.when(k % 43 == 0, "wiki/overview.md").when(k % 43 == 1, F.format_string("wiki/folds/f%d.md", k)).when(k % 43 == 2, F.format_string("wiki/meta/m%d.md", k)).otherwise(F.col("page_path"))
    return S.pages(s, d).select(path.alias("page_path"), (k % 37 == 0).alias("is_link"), (k % 53 != 0).alias("inside"), (k % 41 != 0).alias("readable"), (F.octet_length("raw") * 8).alias("n_bytes"), F.col("ptype").alias("type"))


@query("tiling_scan_reasons", f"WITH {TILING_SQL} SELECT CASE WHEN is_link THEN 'symlink' WHEN NOT inside THEN 'escapes vault' WHEN NOT readable THEN 'read_error' WHEN n_bytes > 131072 THEN 'too_large' WHEN page_path = 'wiki/overview.md' THEN 'excluded filename' WHEN page_path LIKE 'wiki/folds/%' THEN 'under wiki/folds/' WHEN page_path LIKE 'wiki/meta/%' THEN 'under wiki/meta/' WHEN type IN ('meta', 'fold') THEN 'type=' || type ELSE 'included' END AS reason, count(*) AS pages FROM files GROUP BY 1")
def tiling_scan_reasons(s, d):
    """Each file with its first reason, counted."""
    return tiling_files(s, d).groupBy(L.tiling_reason().alias("reason")).agg(F.count("*").alias("pages"))


@query("consolidation_pages", f"WITH {S.PAGES_SQL}, m AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'wiki/entities/' WHEN 1 THEN 'wiki/sources/x/' WHEN 2 THEN 'wiki/runbooks/' ELSE 'wiki/entities-old/' END || CAST(doc_id AS VARCHAR) || '.md' AS moved FROM pages1) SELECT moved AS page_path FROM m WHERE doc_id % 4 <> 3 AND doc_id % 17 <> 0 AND status NOT IN {STALE}")
def consolidation_pages(s, d):
    """Pages moved to folders by id."""
    k = F.col("doc_id")
    top = F.when(k % 4 == 0, "wiki/entities/").when(k % 4 == 1, "wiki/sources/x/").when(k % 4 == 2, "wiki/runbooks/").otherwise("wiki/entities-old/")
    return L.consolidation_scope(S.pages(s, d).withColumn("page_path", F.concat(top, k.cast("string"), F.lit(".md")))).select("page_path")


@query("tiling_scale", "SELECT count(*) AS files, CASE WHEN count(*) > 5000 THEN 'fail' WHEN count(*) > 500 THEN 'warn' ELSE 'ok' END AS status FROM documents")
def tiling_scale(s, d):
    """The limits of a scan."""
    return L.scan_scale(tiling_files(s, d))


@query(
    "page_text_packing",
    f"""WITH RECURSIVE {S.PAGES_SQL}, para AS (SELECT page_path, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM pages1 WHERE len({LINES_SQL}) > 5500),
held AS (SELECT page_path, list(x ORDER BY i) AS ps, list(e ORDER BY i) AS es FROM (SELECT *, sum(len(x) + 2) OVER (PARTITION BY page_path ORDER BY i) AS e FROM para) GROUP BY 1),
bins(page_path, spot, txt) AS (SELECT page_path, 0, '' FROM held
  UNION ALL SELECT page_path, CASE WHEN ps[spot + 1] = '' THEN spot + 1 ELSE nx END, CASE WHEN ps[spot + 1] = '' THEN '' ELSE array_to_string(ps[spot + 1 : nx], chr(10) || chr(10)) END
  FROM (SELECT *, greatest(len(list_filter(es, lambda e: e <= coalesce(es[spot], 0) + 5502)), spot + 1) AS nx FROM bins JOIN held USING (page_path) WHERE spot < len(es))),
parts AS (SELECT page_path, row_number() OVER (PARTITION BY page_path ORDER BY spot) - 1 AS part, txt FROM bins WHERE txt <> '')
SELECT page_path, CAST(part AS INTEGER) AS part, sha256(txt) AS text_sha FROM parts UNION ALL SELECT page_path, 0, sha256({LINES_SQL}) FROM pages1 WHERE len({LINES_SQL}) <= 5500""",
)
def page_text_packing(s, d):
    """Bodies, each line a paragraph, as texts for embedding."""
    body = F.regexp_replace("body", "\n", "\n\n")
    return K.pack_pages(S.pages(s, d).withColumn("body", body)).select("page_path", "part", F.sha2("text", 256).alias("text_sha"))


@query("ingest_scan", f"WITH {S.PAGES_SQL} SELECT page_path FROM pages1 WHERE doc_id % 17 <> 0 AND page_path NOT IN ('wiki/log.md', 'wiki/hot.md')")
def ingest_scan(s, d):
    """Pages that ingest takes."""
    return S.pages(s, d).filter(~F.col("page_path").isin(*C.INGEST_SKIP) & X.indexed(F.col("raw"))).select("page_path")


GROWTH_SQL = """
ev AS (SELECT user_id, ts, event_id, CAST(ts AS DATE) AS day, value FROM events),
pg AS (SELECT user_id, count(*) AS dated, sum(value) / 10.0 AS kb, max(CASE WHEN user_id % 3 <> 0 THEN strftime(TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 15 AS INTEGER)), '%Y-%m-%d') END) AS consolidated FROM ev GROUP BY 1),
th AS (SELECT p.user_id, coalesce((SELECT arg_max(value, ts) FROM ev e WHERE e.user_id = p.user_id AND e.day <= CAST(p.consolidated AS DATE)), 0) AS kb_then, (SELECT count(*) FROM ev e WHERE e.user_id = p.user_id AND strftime(e.ts, '%Y-%m-%d') > p.consolidated) AS newer FROM pg p WHERE consolidated IS NOT NULL)
"""


def history(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "events").select(F.col("user_id").alias("page"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


def journal(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as a page's dated headings; its size is a tenth of their values; a class was never consolidated."""
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-10")), (F.col("page") % 15).cast("int")), "yyyy-MM-dd")
    return history(s, d).groupBy("page").agg(F.count("*").alias("dated"), (F.sum("value") / F.lit(10.0)).alias("kb")).withColumn("consolidated", F.when(F.col("page") % 3 != 0, day))


def size_then(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """The last version of each page up to its day, else 0, and how many dated entries are newer."""
    joined = pages.filter("consolidated is not null").select("page", "consolidated").join(versions, "page", "left")
    then = F.max_by(F.when(F.col("day") <= F.col("consolidated"), F.col("value")), F.when(F.col("day") <= F.col("consolidated"), F.col("ts")))
    return joined.groupBy("page").agg(F.coalesce(then, F.lit(0.0)).alias("kb_then"), F.count_if(F.col("day") > F.col("consolidated")).alias("newer"))


@query("asof_page_size", f"WITH {GROWTH_SQL} SELECT user_id AS page, round(kb_then, 6) AS kb_then, newer FROM th")
def asof_page_size(s, d):
    """J13 S20."""
    return size_then(journal(s, d), history(s, d)).withColumn("kb_then", F.round("kb_then", 6))


def due(pages: DataFrame, then: DataFrame, c: C.Settings = C.DEFAULTS) -> DataFrame:
    """the reason for which a page is due, or none."""
    grew = (F.col("kb_then") > 0) & (F.col("kb") >= c.regrow_ratio * F.col("kb_then")) & (F.col("kb") - F.col("kb_then") >= c.regrow_kb)
    reason = (
        F.when(F.col("consolidated").isNull(), F.when((F.col("kb") >= c.journal_kb) & ((F.col("dated") >= c.journal_dated) | (F.col("struck") >= c.journal_struck)), "journal"))
        .when(grew, "grew").when(F.col("newer") >= c.regrow_dated, "dated")
    )
    score = F.col("kb") + 3 * F.col("dated") + F.col("struck")
    return pages.join(then, "page", "left").withColumns({"reason": reason, "score": score})


@query("consolidation_due", f"WITH {GROWTH_SQL}, r AS (SELECT pg.user_id AS page, kb, dated, CASE WHEN consolidated IS NULL THEN CASE WHEN kb >= 15 AND dated >= 5 THEN 'journal' END WHEN kb_then > 0 AND kb >= 1.5 * kb_then AND kb - kb_then >= 5 THEN 'grew' WHEN newer >= 3 THEN 'dated' END AS reason FROM pg LEFT JOIN th USING (user_id)) SELECT page, round(kb, 4) AS kb, dated, reason, round(kb + 3 * dated, 4) AS score FROM r WHERE reason IS NOT NULL")
def consolidation_due(s, d):
    """A21 F10 L06 K13; without struck spans, of which the events have none."""
    j = journal(s, d).withColumn("struck", F.lit(0))
    out = due(j, size_then(j, history(s, d))).filter("reason is not null")
    return out.select("page", F.round("kb", 4).alias("kb"), "dated", "reason", F.round("score", 4).alias("score")).orderBy(F.col("score").desc(), "page")


@query("journal_signals", "WITH b AS (SELECT doc_id, regexp_replace(text, '(^|\\n)([A-Z])', '\\1## 2024-05-17 \\2', 'g') AS body FROM documents) SELECT doc_id, round(strlen(body) / 1024.0, 6) AS kb, CAST(len(regexp_extract_all(body, '(?m)^#{2,3} [^\\n]*?\\b20\\d\\d-\\d\\d-\\d\\d')) AS INTEGER) AS dated FROM b")
def journal_signals(s, d):
    """Size in bytes and dated headings of bodies whose lines became headings."""
    b = S.table(s, d, "documents").select("doc_id", F.regexp_replace("text", r"(?d)(^|\n)([A-Z])", "$1## 2024-05-17 $2").alias("body"))
    return b.select("doc_id", F.round(F.octet_length("body") / F.lit(1024.0), 6).alias("kb"), F.regexp_count("body", F.lit(C.DATED_HEADING)).alias("dated"))


@query("struck_signals")
def struck_signals(s, d):
    """Struck spans of bodies in which every word pair of a class is struck."""
    b = S.table(s, d, "documents").select("doc_id", F.regexp_replace("text", r"(\w+, \w+)", "~~$1~~").alias("body"))
    return b.select("doc_id", F.regexp_count("body", F.lit(C.STRUCK)).alias("struck"), F.length(X.strip_struck(F.col("body"))).alias("left"))


@query("asof_section", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), h AS (SELECT *, len(line) < 60 AS head FROM l) SELECT a.doc_id, CAST(a.idx AS INTEGER) AS idx, CASE WHEN head THEN line ELSE (SELECT arg_max(line, idx) FROM h b WHERE b.doc_id = a.doc_id AND b.head AND b.idx <= a.idx) END AS section FROM h a")
def asof_section(s, d):
    """The last heading at or before each place; here short lines are headings."""
    lines = S.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return lines.select("doc_id", "idx", F.last(F.when(F.length("line") < 60, F.col("line")), ignorenulls=True).over(w).alias("section"))


@query("autofix_plan", "WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'entities/' WHEN 1 THEN 'sources/' WHEN 2 THEN 'meta/profile/' WHEN 3 THEN 'meta/' WHEN 4 THEN 'meta/profile/feedback-' ELSE 'notes/' END || 'doc_' || CAST(doc_id AS VARCHAR) || '-x.md' AS path FROM documents) SELECT path, CASE doc_id % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'source' WHEN 2 THEN 'user' WHEN 3 THEN 'meta' WHEN 4 THEN 'feedback' END AS type, CASE WHEN doc_id % 2 = 0 THEN 'Given' WHEN doc_id % 6 = 4 THEN 'Feedback Doc ' || CAST(doc_id AS VARCHAR) || ' X' ELSE 'Doc ' || CAST(doc_id AS VARCHAR) || ' X' END AS name FROM p")
def autofix_plan(s, d):
    """Type by path, name by title or file."""
    k = F.col("doc_id")
    top = S._pick(k, 6, {0: "entities/", 1: "sources/", 2: "meta/profile/", 3: "meta/", 4: "meta/profile/feedback-"}, "notes/")
    p = S.table(s, d, "documents").select(F.concat(top, F.lit("doc_"), k.cast("string"), F.lit("-x.md")).alias("path"), F.when(k % 2 == 0, " Given ").alias("title"))
    return p.select("path", infer_type(F.col("path")).alias("type"), derive_name(F.col("title"), F.col("path")).alias("name"))


def infer_type(path):
    """A feedback file by its name, wherever it lies; else by folder."""
    return F.when(X.page_name(path).startswith("feedback-"), "feedback").when(path.startswith("entities/"), "entity").when(path.startswith("sources/"), "source").when(path.startswith("meta/profile/"), "user").when(path.startswith("meta/"), "meta")


def derive_name(title, path):
    """P26."""
    given = X.strip(F.coalesce(title, F.lit("")))
    return F.when(given != "", given).otherwise(F.initcap(F.trim(F.translate(X.slug(path), "-_", "  "))))
