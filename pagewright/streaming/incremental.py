"""Incremental ingest and log monitoring. Beyond the batch engine: the same functions behind Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.chunking import chunk_pages


def stream_chunks(pages: DataFrame, target: str, checkpoint: str):
    """Append the chunks of arriving pages (``page_path, body``); file commits and the checkpoint make it exactly once."""
    chunks = chunk_pages(pages).withColumn("body_hash", F.sha2("raw_text", 256))
    return chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")


def gate_activity(log: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of the gate's actions in windows of the log (``ts, action``), late rows up to ``late``."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", every), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("ts timestamp, prompt_sha string, chars int, action string, reason string, top double, pages array<string>, ms int").json(path)
