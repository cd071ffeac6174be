"""Training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, secrets, token ids.

Each stage works on all rows that the one before kept and is written as
Parquet to the shared checkpoint folder, from which the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.llm import bpe, decontam, dedup, quality, secrets
from lumen.llm.common import materialise, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the rule ledger keeps."""
    return quality.stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dedup.stage(spark, docs, sf_dir)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.stage(spark, docs, sf_dir)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets masked."""
    return secrets.stage(spark, docs, sf_dir)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.stage(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Near duplicates, edit distances, a forest and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
