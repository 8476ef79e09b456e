"""Operators on the text of single documents, applied to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, byte_bpe, licenses, periodic_runs, quality, secret_scan
from tidemark.llm.registry import query, table


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    return bpe.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, base rules and the label model's verdict on every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: spans of the base patterns and those the network adds."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of every document and the licences they stand for."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.tokenized(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, with repetitions planted in every tenth."""
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), plant=True)
