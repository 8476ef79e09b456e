"""Where a running total over sorted values crosses a mark, for every group, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
ROUNDS = 2


def crossing(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Mapping[str, Column],
    reached: Callable[[Column, dict[str, Column]], Column],
    carried: Sequence[str] = (),
    rounds: int = ROUNDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The least value of each group for which ``reached(value, totals)`` holds; groups without such a value have no row.

    ``totals`` are the sums of the ``measures`` over all rows up to and with the value; ``reached`` must stay true
    once it is. ``carried`` columns are the same in all rows of a group. Returned are the keys, the carried columns, the
    value and the totals of the rows before it, under the measures' names.

    Each round counts the values in a fixed number of buckets between the group's bounds (sums that collapse on
    the map side), and the bounds become the least and largest value of the bucket in which the mark
    is crossed. After the rounds the distinct values of that one bucket are left to be sorted, however often each occurs.
    Rows are joined with one row per group, so a group with a large share of all rows is split by adaptive execution.
    """
    names = list(measures)
    by = [*keys, *carried]
    start = {n: f"_{n}_before" for n in names}
    state = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    state = state.withColumns({s: F.lit(0.0) for s in start.values()})
    bare = rows.select(*keys, F.col(value).alias("_v"), *(m.alias(n) for n, m in measures.items()))

    def inside(bounds: DataFrame) -> DataFrame:
        return bare.join(bounds, list(keys)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    def first_reached(cells: DataFrame, at: str, order: str) -> DataFrame:
        so_far = Window.partitionBy(*keys).orderBy(order)
        totals = {n: F.col(start[n]) + F.sum(n).over(so_far) for n in names}
        found = cells.withColumns({f"_{n}_total": t for n, t in totals.items()})
        found = found.where(reached(F.col(at), {n: F.col(f"_{n}_total") for n in names}))
        return found.withColumn("_rank", F.row_number().over(so_far)).where("_rank = 1")

    width = F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * buckets), F.lit(buckets - 1))).otherwise(0)
    for _ in range(rounds):
        cells = inside(state).withColumn("_bucket", place).groupBy(*by, *start.values(), "_bucket").agg(
            *(F.sum(n).alias(n) for n in names), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        found = first_reached(cells, "_hi", "_bucket")
        state = found.select(*by, "_lo", "_hi", *((F.col(f"_{n}_total") - F.col(n)).alias(start[n]) for n in names))
    cells = inside(state).groupBy(*by, *start.values(), "_v").agg(*(F.sum(n).alias(n) for n in names))
    found = first_reached(cells, "_v", "_v")
    return found.select(*by, F.col("_v").alias(value), *((F.col(f"_{n}_total") - F.col(n)).alias(n) for n in names))
