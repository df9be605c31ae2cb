"""Documents to packed training sequences in stages; every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact, near, packing, quality
from tidemark.llm.common import landed, read


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated chance of at least one half of being good stay."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of at least 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    return near.without_near_copies(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a test item go."""
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences of 4096 tokens."""
    return packing.digests(docs)


STAGES = [
    ("quality_classifier", quality_filter), ("exact_dedup", exact_dedup), ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination), ("best_fit_packing", best_fit_packing),
]

# Neither the classifier nor the packing can be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
