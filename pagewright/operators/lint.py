"""Lint of pages: links, orphans, fields, duplicates, age, typed relations, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X
from pagewright.sources.work import save


def wikilinks(pages: DataFrame, path: str = "page_path", raw: str = "raw") -> DataFrame:
    """``src, target`` of the body's links: frontmatter, then code removed; an escaped table bar is trimmed."""
    bare = X.strip_code(F.regexp_replace(raw, r"(?s)\A---\n.*?\n---", ""))
    return pages.select(F.col(path).alias("src"), F.explode(F.regexp_extract_all(bare, F.lit(C.WIKILINK), F.lit(1))).alias("found")).select("src", X.strip(F.rtrim(F.regexp_replace("found", r"\\+$", ""))).alias("target"))


def base_targets(paths: DataFrame, path: str = "path") -> DataFrame:
    """Each base file is a target by full path, by path without suffix and by stem."""
    p = F.col(path)
    return paths.select(F.explode(F.array(p, F.regexp_replace(p, r"\.base$", ""), F.regexp_replace(X.page_name(p), r"\.base$", ""))).alias("target")).distinct()


def link_targets(pages: DataFrame, base: DataFrame | None = None, path: str = "page_path") -> DataFrame:
    """Everything that a link may name: slugs, relative paths without suffix, base files."""
    p = F.col(path)
    own = pages.select(F.explode(F.array(X.slug(p), F.regexp_replace(p, r"\.md$", ""))).alias("target"))
    return (own if base is None else own.unionByName(base)).distinct()


def dead_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that nothing has, with the number and the first of their referrers."""
    return links.join(targets, "target", "left_anti").groupBy("target").agg(F.count_distinct("src").alias("referrers"), F.min("src").alias("first_referrer"))


def orphans(pages: DataFrame, links: DataFrame, path: str = "page_path", skip: tuple[str, ...] = C.ORPHAN_SKIP) -> DataFrame:
    """Pages that no link names by slug or path; links from the page itself count."""
    p = F.col(path)
    named = links.select("target").distinct()
    keys = pages.filter(~X.page_name(p).isin(*skip)).select(p.alias("page_path"), F.explode(F.array(X.slug(p), F.regexp_replace(p, r"\.md$", ""))).alias("target"))
    linked = keys.join(named, "target", "left_semi").select("page_path").distinct()
    return keys.select("page_path").distinct().join(linked, "page_path", "left_anti")


def missing_keys(keys: Column, required: tuple[str, ...] = C.REQUIRED_KEYS) -> Column:
    """the required keys that a frontmatter map lacks."""
    return F.filter(F.array(*(F.lit(k) for k in required)), lambda k: ~F.array_contains(F.map_keys(keys), k))


def duplicates(rows: DataFrame, key: str, path: str = "page_path") -> DataFrame:
    """Keys of several pages, with how many and the first two."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("pages"), F.min(path).alias("first_page"), F.max(path).alias("last_page")).filter("pages > 1")


def stale_pages(pages: DataFrame, today: str, days: int = C.DEFAULTS.stale_days) -> DataFrame:
    """updated more than ``days`` days ago; evergreen and archived pages, unindexed ones, folds and unreadable dates stay out."""
    age = F.datediff(F.to_date(F.lit(today)), F.try_to_timestamp("updated", F.lit("yyyy-MM-dd")).cast("date"))
    live = ~F.lower("status").isin("evergreen", "archived") & F.col("indexed") & ~F.col("page_path").startswith("folds/")
    return pages.filter(live).withColumn("age_days", age).filter(F.col("age_days") > days)


def inverse_table(df: DataFrame) -> DataFrame:
    """The closed vocabulary's inverses, both ways: 18 rows."""
    rows = [p for a, b in C.INVERSE_PAIRS for p in ((a, b), (b, a))]
    return df.sparkSession.createDataFrame(rows, "predicate string, inverse string")


def resolve(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """An edge's target by exact path first, else by slug if only one page has it; unresolved edges and edges to the page itself fall away."""
    by_path = pages.select(F.regexp_replace("page_path", r"\.md$", "").alias("dst_raw"), F.col("page_path").alias("p1"))
    slugs = pages.select(X.slug(F.col("page_path")).alias("dst_raw"), "page_path").groupBy("dst_raw").agg(F.count("*").alias("n"), F.min("page_path").alias("p2")).filter("n = 1").drop("n")
    out = edges.join(by_path, "dst_raw", "left").join(slugs, "dst_raw", "left").withColumn("dst", F.coalesce("p1", "p2"))
    return out.filter("dst is not null and dst <> src").select("src", "predicate", "dst")


def missing_inverses(edges: DataFrame, types: DataFrame) -> DataFrame:
    """On the target page, the predicate that its edge back should have; both pages carry relations by their type."""
    graph = types.filter(F.col("ptype").isin(*C.GRAPH_TYPES))
    typed = edges.join(graph.select(F.col("page_path").alias("src")), "src", "left_semi").join(graph.select(F.col("page_path").alias("dst")), "dst", "left_semi")
    wanted = typed.join(F.broadcast(inverse_table(edges)), "predicate").select(F.col("dst").alias("src"), F.col("inverse").alias("predicate"), F.col("src").alias("dst"))
    return wanted.join(edges, ["src", "predicate", "dst"], "left_anti").distinct()


def unknown_predicates(edges: DataFrame) -> DataFrame:
    known = [p for pair in C.INVERSE_PAIRS for p in pair] + list(C.INVERSE_FREE)
    return edges.filter(~F.col("predicate").isin(*known)).groupBy("predicate").agg(F.count("*").alias("edges"))


def finding(df: DataFrame, kind: str, path: str, target: str | None = None) -> DataFrame:
    """One shape for all findings."""
    return df.select(F.lit(kind).alias("type"), F.col(path).alias("path"), (F.col(target) if target else F.lit(None)).cast("string").alias("target"))


def brief(findings: DataFrame) -> DataFrame:
    """without what only signals maintenance."""
    return findings.filter(~F.col("type").isin(*C.BRIEF_SKIP))


def only(findings: DataFrame, paths: list[str]) -> DataFrame:
    """findings that involve one of the paths, as their page or as their target."""
    return findings.filter(F.col("path").isin(*paths) | F.coalesce(F.col("target").isin(*paths), F.lit(False)))


def address_owner(pages: DataFrame) -> DataFrame:
    """The first page by path keeps a declared address; later ones, and pages without, get one from their path."""
    w = W.partitionBy("declared").orderBy("page_path")
    claimed = pages.filter("declared is not null").withColumn("turn", F.row_number().over(w))
    bare = pages.filter("declared is null").withColumn("turn", F.lit(0))
    return claimed.unionByName(bare).withColumn("address", F.when(F.col("turn") == 1, F.col("declared")).otherwise(X.synthetic_address(F.col("page_path"))))


def consolidation_scope(pages: DataFrame) -> DataFrame:
    """Pages of the folders that are consolidated, without stale and unindexed ones."""
    folder = F.regexp_extract("page_path", r"^(.*)/[^/]*$", 1)
    inside = F.coalesce(*(F.when((folder == x) | folder.startswith(x + "/"), F.lit(True)) for x in C.CONSOLIDATION_SCOPE), F.lit(False))
    return pages.filter(inside & ~X.stale(F.col("status")) & X.indexed(F.col("raw")))


def tiling_reason(settings: C.Settings = C.DEFAULTS) -> Column:
    """The first reason that keeps a file out of a tiling scan, or ``included``.

    Columns: ``is_link``, ``inside`` (its real path lies below the root), ``readable``, ``n_bytes``, ``page_path``, ``type``. A link is
    never read, nor is what lies outside.
    """
    path = F.col("page_path")
    prefix = F.coalesce(*(F.when(path.startswith(x), F.lit(f"under {x}")) for x in C.TILING_SKIP_PREFIXES))
    kind = F.when(F.col("type").isin(*C.TILING_SKIP_TYPES), F.concat(F.lit("type="), "type"))
    guards = (
        F.when(F.col("is_link"), "symlink"), F.when(~F.col("inside"), "escapes vault"), F.when(~F.col("readable"), "read_error"), F.when(F.col("n_bytes") > settings.tiling_bytes, "too_large"),
        F.when(X.page_name(path).isin(*C.TILING_SKIP_NAMES), "excluded filename"),
    )
    return F.coalesce(*guards, prefix, kind, F.lit("included"))


def scan_scale(files: DataFrame, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """One row: how many files a scan would take, and whether that is ``ok``, worth a warning or too many."""
    n = F.col("files")
    return files.agg(F.count("*").alias("files")).withColumn("status", F.when(n > settings.tiling_fail, "fail").when(n > settings.tiling_warn, "warn").otherwise("ok"))


def next_addresses(pages: DataFrame) -> DataFrame:
    """Numbers after the largest address that any first frontmatter block holds, in order of path.

    Pages are numbered within range partitions, and each partition starts where those before it end; no task sees all pages.
    """
    number = F.regexp_extract(X.front_block(F.col("raw")), r"(?dm)^address:[ \t]*c-(\d{6})[ \t]*$", 1)
    top = pages.agg(F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0)).alias("top"))
    bare = save(pages.filter(number == "").select("page_path").repartitionByRange("page_path").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = bare.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.row_number().over(W.partitionBy("part").orderBy("page_path"))
    placed = bare.withColumn("turn", turn).join(F.broadcast(before), "part").crossJoin(F.broadcast(top))
    return placed.select("page_path", F.format_string("c-%06d", F.col("top") + F.col("before") + F.col("turn")).alias("address"))
