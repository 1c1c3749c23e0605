"""Sinks: versioned tables, JSON and TSV, and small reports for people. Reports render rows that a top-k has already bounded."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A table's new version in a folder of its own; the job commit makes it whole or absent, and readers move by name."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def as_json(df: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def write_tsv(df: DataFrame, path: str) -> None:
    """K13."""
    df.write.mode("overwrite").csv(path, sep="\t")


def append_log(df: DataFrame, path: str) -> None:
    """Append; texts are stored as their hash and length."""
    kept = df.withColumns({"prompt_sha": F.substring(F.sha2("prompt", 256), 1, 12), "chars": F.length("prompt")}).drop("prompt")
    kept.write.mode("append").json(path)


def tiling_report(pairs: Iterable[Row], counters: Mapping[str, int]) -> str:
    """Counters, then both bands."""
    rows = list(pairs)
    out = ["# Near-duplicate pages", "", *(f"- {k}: {v}" for k, v in sorted(counters.items()))]
    for band in ("error", "review"):
        out += ["", f"## {band.title()}", ""] + ([f"- {r['cosine']:.3f} {r['a']} — {r['b']}" for r in rows if r["band"] == band] or ["None."])
    return "\n".join(out) + "\n"


def proposals_report(rows: Iterable[Row], title: str) -> str:
    """One section a proposal."""
    parts = [f"# {title}", ""]
    for i, r in enumerate(rows, 1):
        parts += [f"## {i}. {r['title']}", "", *(f"- {k}: {v}" for k, v in r.asDict().items() if k != "title" and v is not None), ""]
    return "\n".join(parts)


def pointers_text(rows: Iterable[Row]) -> str:
    """What a prompt gate injects."""
    return "\n".join(f"[{r['page']}] {r['excerpt']}" for r in rows)


def write_stamp(spark: SparkSession, root: str, job: str, day: str) -> None:
    """That a job ended on a day, as a row appended to a table of stamps."""
    spark.createDataFrame([(job, day)], "job string, day string").coalesce(1).write.mode("append").json(root)


def last_stamps(spark: SparkSession, root: str) -> DataFrame:
    """Each job's last day."""
    return spark.read.schema("job string, day string").json(root).groupBy("job").agg(F.max("day").alias("day"))


def dump_pairs(pairs: DataFrame, path: str, day: str) -> None:
    """The judged pairs of a scan with its day, for a judge elsewhere."""
    pairs.withColumn("day", F.lit(day)).write.mode("overwrite").json(path)


def save_run(rows: DataFrame, path: str) -> None:
    """The rows of an evaluation, one JSON object each, for a later comparison."""
    rows.write.mode("overwrite").json(path)
