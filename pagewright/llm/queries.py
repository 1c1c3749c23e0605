"""The queries of the driver contract: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import oracles
from pagewright.llm.decontamination import find_contamination
from pagewright.llm.jaccard_join import similar_documents
from pagewright.llm.packing import pack_documents
from pagewright.llm.quality_model import score_quality
from pagewright.llm.quality_rules import judge_quality
from pagewright.llm.substring_dedup import drop_repeats
from pagewright.llm.token_counts import count_tokens
from pagewright.llm.token_files import token_file_digest
from pagewright.llm.url_filter import judge_urls
from pagewright.llm.warc import archive_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": lambda s, d: judge_urls(_table(s, d, "pages")),
        "op2_ngram_jaccard_join": lambda s, d: similar_documents(_table(s, d, "documents")).drop("text_key", "component_key"),
        "op3_best_fit_packing": lambda s, d: pack_documents(_table(s, d, "documents")),
        "op4_token_counts": lambda s, d: count_tokens(_table(s, d, "documents")),
        "op5_warc_archive": lambda s, d: archive_digest(_table(s, d, "pages")),
        "op6_quality_classifier": lambda s, d: score_quality(_table(s, d, "documents"), _table(s, d, "labels")),
        "op7_benchmark_decontamination": lambda s, d: find_contamination(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op8_quality_rules": lambda s, d: judge_quality(_table(s, d, "documents"), _table(s, d, "labels")),
        "op9_token_files": lambda s, d: token_file_digest(_table(s, d, "documents")),
        "op10_substring_dedup": lambda s, d: drop_repeats(_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": oracles.JACCARD_JOIN,
        "op5_warc_archive": oracles.WARC_ARCHIVE,
        "op7_benchmark_decontamination": oracles.DECONTAMINATION,
        "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
    }
