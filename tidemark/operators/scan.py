"""Running values along series of any length: ranges of the order are scanned apart, one carry row per range goes to the next.

Rows are dealt by ranges of (series, order), so a long series spreads over many ranges and many short ones share one. The dealing is
written to shared space, because ranges are drawn from a sample and must not move when a lost task is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_dir

_PART = "_range"


def ranged(frame: DataFrame, keys: Sequence[str], order: str, ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range; numbers rise with keys and order, equal places share a range."""
    spark = frame.sparkSession
    number = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, "ranges")
    dealt = frame.repartitionByRange(number, *keys, order).withColumn(_PART, F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _with_carries(rows: DataFrame, carries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows joined with the one carry row of their range and series; a NULL key is a series, too."""
    names = {k: f"_of_{i}" for i, k in enumerate([*keys, _PART])}
    other = carries.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in carries.columns if c not in names))
    same = [rows[k].eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(other, same, "left").drop(*names.values())


def carried_fill(frame: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``frame`` with gaps in ``values`` filled from the last row of the series that has one; leading gaps stay NULL.

    What a window per series gives, without a series in one task. A series has one row per place in ``order`` (of
    several, any may come first); rows without a place come before all others.
    """
    rows = ranged(frame, keys, order, ranges)
    here = Window.partitionBy(_PART, *keys).orderBy(order)
    latest = {v: F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(F.col(order).isNotNull(), F.col(order)))).alias(f"_last_{i}") for i, v in enumerate(values)}
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per range of the series
    carries = rows.groupBy(_PART, *keys).agg(*latest.values())
    carries = carries.withColumns({f"_last_{i}": F.last(f"_last_{i}", ignorenulls=True).over(before) for i in range(len(values))})
    filled = rows.withColumns({v: F.last(v, ignorenulls=True).over(here) for v in values})
    joined = _with_carries(filled, carries, keys)
    return joined.withColumns({v: F.coalesce(v, f"_last_{i}") for i, v in enumerate(values)}).select(*frame.columns)


def running_sum(frame: DataFrame, keys: Sequence[str], order: str, value: str, ranges: int | None = None) -> DataFrame:
    """``frame`` with ``total``, the sum of ``value`` along the series up to each row, and ``top``, the largest total so far; NULLs add nothing."""
    rows = ranged(frame, keys, order, ranges)
    here = Window.partitionBy(_PART, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(here)).withColumn("top", F.max("total").over(here))
    sums = rows.groupBy(_PART, *keys).agg(F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("_sum"), F.max("top").alias("_top"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    sums = sums.withColumn("_peak", F.max(F.col("_top") + F.col("_offset")).over(before)).drop("_sum", "_top")
    joined = _with_carries(rows, sums, keys)
    total, top = F.col("total") + F.col("_offset"), F.greatest(F.col("top") + F.col("_offset"), F.col("_peak"))
    return joined.withColumns({"total": total, "top": top}).select(*frame.columns, "total", "top")


def wealth_curve(returns: DataFrame, group: str = "K", r: str = "net", ranges: int | None = None) -> DataFrame:
    """``group, Date, wealth, peak, fall``: compounded wealth of every portfolio from 1 on, its highest value so far and the fall from it.

    The curve behind :func:`portfolio.risk_metrics`; the start counts as a peak. Days without a return keep the wealth, and so,
    as in these metrics, does a return of -1 or less, which has no logarithm.
    """
    logs = returns.select(group, "Date", F.when(F.col(r) > -1, F.log1p(r)).alias("_log"))
    found = running_sum(logs, [group], "Date", "_log", ranges)
    peak = F.greatest(F.col("top"), F.lit(0.0))
    return found.select(group, "Date", F.exp("total").alias("wealth"), F.exp(peak).alias("peak"), (F.exp(F.col("total") - peak) - 1).alias("fall"))
