"""A corpus pipeline of five operators. Each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import shared_dir
from pagewright.llm.decontamination import find_contamination
from pagewright.llm.jaccard_join import similar_documents
from pagewright.llm.packing import pack_documents
from pagewright.llm.quality_rules import judge_quality
from pagewright.llm.substring_dedup import drop_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have: the table's own columns keep theirs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _met(docs: DataFrame, judged: DataFrame, how: str) -> DataFrame:
    """Documents joined to judgements by id (null equals null) and a hash of the text."""
    key, ident, of = (_free(docs, f"_pipeline_{x}") for x in ("key", "id", "of"))
    right = judged.withColumnsRenamed({"doc_id": ident, "text_key": of})
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(of))
    return docs.withColumn(key, F.xxhash64("text")).join(right, same, how)


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    return _met(docs, judged.select("doc_id", "text_key").distinct(), "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go; null and empty texts, which have no words, are among them. Repeated rows share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, judge_quality(docs, labels, with_key=True).filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest doc_id.

    Of linked rows that repeat this id, that with the least hash of its text stays; rows that repeat both count once. Rows that nothing
    links stay, also where their ids are null or repeated.
    """
    judged = similar_documents(docs)
    first = judged.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_key")).alias("first"))
    kept = first.select("first.doc_id", "first.text_key")
    out = _met(docs, kept, "left_semi")
    if judged.groupBy("doc_id", "text_key").count().filter("count > 1").take(1):
        out = out.dropDuplicates(["doc_id", _free(docs, "_pipeline_key")])
    return out.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go, and documents of which nothing is left; other documents, null and empty texts too, stay as they are."""
    text = _free(docs, "_pipeline_text")
    judged = drop_repeats(docs, with_text=True).filter("n_removed > 0").select("doc_id", "text_key", F.col("kept_text").alias(text)).distinct()
    joined = _met(docs, judged, "left").filter(F.col(text).isNull() | (F.col(text) != ""))
    changed = {"text": F.coalesce(text, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(changed).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule finds go; null and empty texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, find_contamination(docs, items, with_key=True).filter("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null and empty texts are one end id, repeated rows are packed each."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
