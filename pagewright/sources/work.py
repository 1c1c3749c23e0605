"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset on one machine (tests), below a temporary one.

    On a cluster a folder of one machine would lose rows without an error, so there the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this session has saved in the shared folder; results that still read from it are lost."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(path) if files.exists(path) else ():
            if re.fullmatch(r"[\w-]+-[0-9a-f]{32}", status.getPath().getName()):
                files.delete(status.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew where a table comes in fewer partitions than there are cores, as one small file does; larger tables stay as they are.

    For work that costs far more than moving its rows once. Only plain scans are looked at: to count the partitions of
    a plan with exchanges would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
