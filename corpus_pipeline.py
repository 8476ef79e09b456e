"""The corpus pipeline: ordered stages over ``documents``, each one an operator of ``tidemark.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import written
from tidemark.llm.registry import table

STAGES = [
    ("quality_rules", stages.of_quality),
    ("near_dedup", stages.dedup),
    ("benchmark_decontamination", stages.without_benchmark),
    ("secret_scan", stages.without_secrets),
    ("bpe", stages.tokens),
]

# Label models and trained scanners have no SQL; tests compare run() with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to shared space and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
