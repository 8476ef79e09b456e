"""Profiles of tables from sketches that are kept per day and merged without reading rows again.

A day's sketch of a column counts rows and values exactly and holds a HyperLogLog sketch for its distinct values and, for numbers, a KLL
sketch for its quantiles. Any set of days may be merged, in any order and in steps; the result is within the sketches' error whichever way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_BUCKETS = 12  # of a distinct sketch: relative standard error 1.04 / sqrt(2 ** 12), 1.6 percent
QUANTILE_SIZE = 200  # of a quantile sketch: rank error 1.7 percent with 99 percent confidence
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _usable(frame: DataFrame, column: str) -> Column:
    """The value of a column that counts: NaN is no value."""
    kind = frame.schema[column].dataType
    return F.when(~F.isnan(F.col(column)), F.col(column)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(column)


def daily_sketches(frame: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """``day, column, rows, filled, distinct, quantiles``: a row per day and column; the sketches are binary, quantiles NULL for columns that are no numbers.

    One pass, partial before the shuffle; a day with a large share of all rows arrives as a few sketches. Rows without a day are a day of their own (NULL).
    """
    sketches = []
    for i, c in enumerate(columns):
        value, number = _usable(frame, c), isinstance(frame.schema[c].dataType, T.NumericType)
        # An empty sketch has no binary form that all merges take, so a column without values has none.
        quantiles = F.when(F.count(value) > 0, F.kll_sketch_agg_double(value.cast("double"), F.lit(QUANTILE_SIZE))) if number else F.lit(None).cast("binary")
        sketches.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(value).alias("filled"),
            F.hll_sketch_agg(value.cast("string"), LOG_BUCKETS).alias("distinct"), quantiles.alias("quantiles"),
        ).alias(f"_{i}"))
    by_day = frame.groupBy(F.col(day).alias("day")).agg(*sketches)
    return by_day.select("day", F.inline(F.array(*(f"_{i}" for i in range(len(columns))))))


def merged(sketches: DataFrame, groups: Sequence[str | Column] = ()) -> DataFrame:
    """Sketches of several days as one per column (and group): the same columns without ``day``."""
    return sketches.groupBy(*groups, "column").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
    )


def profile(sketches: DataFrame, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """What merged sketches say: ``rows, filled, distinct`` (estimated) and ``quantiles`` at the probabilities, NULL without numbers."""
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    return sketches.withColumns({
        "distinct": F.when(F.col("filled") > 0, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0)).cast("long"),
        "quantiles": F.kll_sketch_get_quantile_double("quantiles", wanted),
    })
