"""What a scan takes: scopes of the page scans, chunk records, candidate lists and stored vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X

RECORD = "page_address string, chunk_index int, contextualized_text string, raw_text string"
CANDIDATE = "array<struct<chunk_id: string, path: string, score: double>>"


def hidden(path: Column) -> Column:
    """True where a part of the path starts with a dot."""
    return path.rlike(r"(^|/)\.")


def section(path: Column, root: str = "wiki/") -> Column:
    """The folder of a page below ``root``; pages at the top have a section of their own."""
    folder = F.regexp_replace(F.regexp_replace(path, f"^{root}", ""), r"/?[^/]*$", "")
    return F.when(folder == "", "(root)").otherwise(folder)


def catalog_scope(pages: DataFrame, sections: Sequence[str] = (), path: str = "page_path") -> DataFrame:
    """Pages that are no navigation and lie in no dot folder, with their ``section``; given sections, only theirs."""
    p = F.col(path)
    kept = pages.filter(~X.page_name(p).isin(*C.CATALOG_SKIP) & ~hidden(p)).withColumn("section", section(p))
    return kept.filter(F.col("section").isin(*(x.strip("/") for x in sections))) if sections else kept


def lint_scope(pages: DataFrame, path: str = "page_path") -> DataFrame:
    """All pages that lie in no folder named ``.lint``."""
    return pages.filter(~F.col(path).rlike(r"(^|/)\.lint/"))


def listed(pages: DataFrame, paths: DataFrame, path: str = "page_path") -> DataFrame:
    """The pages of an explicit list; a path that no page has stays, with ``found`` false. ``paths``: (page_path)."""
    return paths.select(path).distinct().join(pages.withColumn("found", F.lit(True)), path, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def chunk_scan(files: DataFrame) -> DataFrame:
    """``chunk_id, path, text, input_hash`` of chunk records (path, content), in order of path.

    The indexed text is the contextualized one; where that is null or empty, the raw one. Records that do not read as JSON or lack the
    address or the index are skipped.
    """
    r = files.select("path", F.from_json("content", RECORD).alias("r")).select("path", "r.*").filter("page_address is not null and chunk_index is not null")
    text = F.coalesce(F.nullif("contextualized_text", F.lit("")), "raw_text", F.lit(""))
    return r.select(F.concat_ws(":", "page_address", "chunk_index").alias("chunk_id"), "path", text.alias("text"), X.text_hash(text).alias("input_hash")).orderBy("path")


def candidate_lists(raw: DataFrame, column: str = "payload") -> DataFrame:
    """``candidates`` of a JSON list of each row, and ``status``: ``ok``, or ``malformed`` where it is no JSON list."""
    read = F.when(F.col(column).rlike(r"^\s*\["), F.from_json(column, CANDIDATE, {"mode": "PERMISSIVE"}))
    return raw.withColumn("candidates", read).withColumn("status", F.when(F.col("candidates").isNull(), "malformed").otherwise("ok"))


def live_vectors(cache: DataFrame, model: str, version: int = 1) -> DataFrame:
    """The stored vectors of ``model``; those of another model count for nothing. Rows of another format version are an error.

    ``cache``: (version, model, ...). The versions are the few distinct ones of the table, found by one aggregate.
    """
    other = cache.filter(~F.col("version").eqNullSafe(version)).select("version").limit(1).collect()
    if other:
        raise ValueError(f"stored vectors of an unknown version: {other[0].version}")
    return cache.filter(F.col("model") == model)


def prune_counts(cache: DataFrame, scheme: str, tag: str) -> DataFrame:
    """How many vectors of the current scheme and tag a load keeps, and how many it prunes."""
    live = F.coalesce((F.col("scheme") == scheme) & (F.col("tag") == tag), F.lit(False))
    return cache.agg(F.count_if(live).alias("kept"), F.count_if(~live).alias("pruned"))
