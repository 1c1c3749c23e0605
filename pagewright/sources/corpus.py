"""Pages and what is made of them. Readers for markdown trees, and adapters from the plain tables to the engine's schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X


def read_pages(spark: SparkSession, root: str, bypass_exclusions: bool = False) -> DataFrame:
    """All markdown pages below ``root`` as ``page_path, raw``.

    Invalid UTF-8 becomes U+FFFD. Path filters come before bodies: folders that start with a dot, the log, the hot page; then
    pages that opt out of the index. ``bypass_exclusions`` is the single-path mode.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split("://", 1)[-1].replace("file:", "")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), r"^\w+:/+", "/"), "^" + base.replace(".", r"\.") + "/?", "")
    pages = files.withColumn("page_path", path)
    if not bypass_exclusions:
        pages = pages.filter(~F.col("page_path").rlike(r"(^|/)\.[^/]+/") & ~F.col("page_path").isin(*C.INGEST_SKIP))
    pages = pages.select("page_path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    return pages if bypass_exclusions else pages.filter(X.indexed(F.col("raw")))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones fall away."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").dropna(how="all")


def read_gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A gold set as one JSON array; ``schema`` is one of ``GOLD_SHAPES`` by name, or a schema."""
    return spark.read.schema(GOLD_SHAPES.get(schema, schema)).json(path, multiLine=True)


#: Schemas of the four shapes of gold sets: retrieval with answer marks, several needed pages, prompts of the gate, answer places.
GOLD_SHAPES = {
    "retrieval": "q string, gold array<string>, current array<string>, stale array<string>, type string",
    "multi": "id string, q string, required array<string>",
    "recall": "id string, prompt string, kind string, expected_pages array<string>",
    "neighbours": "q string, gold array<string>, current array<string>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, modulus: int, values: dict[int, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key % modulus == k, F.lit(v)).otherwise(out)
    return out


STATUS = {0: "archived", 1: "superseded", 2: "evergreen"}
TYPES = {0: "entity", 1: "source", 2: "meta", 3: "user", 4: "feedback"}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with frontmatter: ``doc_id, page_path, section, declared, status, ptype, body, raw``.

    Status, type and address follow the id; one class has no address, one declares its neighbour's.
    """
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    number = lambda c: F.concat(F.lit("c-"), F.lpad(c.cast("string"), 6, "0"))
    declared = F.when(k % 7 == 3, F.lit(None)).when(k % 13 == 5, number(k - 1)).otherwise(number(k))
    out = d.select(
        "doc_id", F.concat(F.lit("wiki/"), "source", F.lit("/doc-"), k.cast("string"), F.lit(".md")).alias("page_path"), F.col("source").alias("section"),
        declared.alias("declared"), _pick(k, 11, STATUS, "active").alias("status"), _pick(k, 6, TYPES, "note").alias("ptype"), F.coalesce("text", F.lit("")).alias("body"),
    )
    head = F.concat(
        F.lit("---\nname: doc-"), k.cast("string"), F.when(k % 5 != 4, F.lit("\ndescription: \"About a page\"")).otherwise(F.lit("")), F.lit("\ntitle: 'Doc "), k.cast("string"), F.lit("'\ntype: "), F.col("ptype"),
        F.lit("\nstatus: "), F.col("status"), F.coalesce(F.concat(F.lit("\naddress: "), F.col("declared")), F.lit("")), F.when(k % 17 == 0, F.lit("\nindex: false")).otherwise(F.lit("")), F.lit("\n---\n"),
    )
    return out.withColumn("raw", F.concat(head, "body"))


#: The same pages in SQL, as the head of a WITH clause.
PAGES_SQL = """
pages0 AS (
  SELECT doc_id, 'wiki/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '.md' AS page_path, source AS section,
    CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 13 = 5 THEN 'c-' || lpad(CAST(doc_id - 1 AS VARCHAR), 6, '0') ELSE 'c-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS declared,
    CASE WHEN doc_id % 11 = 0 THEN 'archived' WHEN doc_id % 11 = 1 THEN 'superseded' WHEN doc_id % 11 = 2 THEN 'evergreen' ELSE 'active' END AS status,
    CASE doc_id % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'source' WHEN 2 THEN 'meta' WHEN 3 THEN 'user' WHEN 4 THEN 'feedback' ELSE 'note' END AS ptype,
    coalesce(text, '') AS body
  FROM documents),
pages1 AS (
  SELECT *, '---' || chr(10) || 'name: doc-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 5 <> 4 THEN chr(10) || 'description: "About a page"' ELSE '' END
    || chr(10) || 'title: ''Doc ' || CAST(doc_id AS VARCHAR) || '''' || chr(10) || 'type: ' || ptype || chr(10) || 'status: ' || status
    || coalesce(chr(10) || 'address: ' || declared, '') || CASE WHEN doc_id % 17 = 0 THEN chr(10) || 'index: false' ELSE '' END || chr(10) || '---' || chr(10) || body AS raw
  FROM pages0)
"""
