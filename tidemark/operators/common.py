"""Patterns several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the lowest by ``order``.

    An aggregate, not ``row_number``: copies collapse before the shuffle, so a key that holds a
    large part of all rows never meets in one task.
    """
    rest = [c for c in frame.columns if c not in keys]
    first = F.min_by(F.struct(*map(_name, rest)), F.struct(*map(_name, order)))
    return frame.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def only_best(frame: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """Rows whose rank is the lowest of their key; ties all stay.

    The minimum is aggregated first and joined back: one row per key against the big side, which
    adaptive execution broadcasts or splits as the measured sizes allow.
    """
    ranked = frame.withColumn("_rank", rank)
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*keys, "_rank"], "left_semi").drop("_rank")


def overwrite_columns(frame: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which the columns of ``other`` replace those of the same name."""
    stale = [c for c in other.columns if c in frame.columns and c not in keys]
    return frame.drop(*stale).join(other, list(keys), "left")


def mark_known(frame: DataFrame, known: DataFrame, key: str, yes: str, no: str) -> DataFrame:
    """``status`` tells whether the key of a row is in ``known``; one join, one pass over the rows."""
    ids = known.select(key).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), yes).otherwise(no)
    return frame.join(ids, key, "left").withColumn("status", status).drop("_known")


def require_columns(frame: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def _name(column: str) -> Column:
    return F.col(f"`{column}`")
