"""Operators on embeddings, applied to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import whitening
from tidemark.llm.registry import query, table


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened coordinates of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=8)
