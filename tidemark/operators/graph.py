"""Correlation graph between assets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.session import shared_dir

# Window length in days and edge threshold.
WINDOW_DAYS = 7
EDGE_THRESHOLD = 0.2

ASSETS_PER_BLOCK = 256
WINDOWS_AT_ONCE = 32
_PAIRS = "a string, b string, Date date, rho double, ra double, rb double"


def rolling_correlation(returns: DataFrame, n: int = WINDOW_DAYS) -> DataFrame:
    """Correlation of every two assets over the last ``n`` days on which both have a return.

    Both sides of the join are the same columns, so their exchange is made once. A window holds the
    days of one pair, which the calendar bounds. NULL where one side is constant. Callers filter right behind.
    """
    left = returns.select(F.col("Ticker").alias("a"), "Date", F.col("r").alias("ra"))
    right = returns.select(F.col("Ticker").alias("b"), "Date", F.col("r").alias("rb"))
    pairs = left.join(right, "Date").where(F.col("a") < F.col("b"))
    window = Window.partitionBy("a", "b").orderBy("Date").rowsBetween(1 - n, 0)
    spread = F.stddev_pop("ra").over(window) * F.stddev_pop("rb").over(window)
    rho = ratio(F.covar_pop("ra", "rb").over(window), spread)
    full = pairs.select("a", "b", "Date", "ra", "rb", rho.alias("rho"), F.count("*").over(window).alias("n")).where(F.col("n") == n)
    return full.select("a", "b", "Date", F.when(F.col("rho").isNotNull(), F.greatest(F.least("rho", F.lit(1.0)), F.lit(-1.0))).alias("rho"), "ra", "rb")


class _Block:
    """Returns of some assets on the days of a grid, and the standardised windows of those without a gap inside."""

    def __init__(self, series: list[tuple[str, np.ndarray, np.ndarray]], grid: np.ndarray, n: int):
        self.names = np.array([name for name, _, _ in series], object)
        self.r = np.full((len(grid), len(series)), np.nan)
        for column, (_, days, r) in enumerate(series):
            self.r[np.searchsorted(grid, days), column] = r
        held = ~np.isnan(self.r)
        first, last = held.argmax(0), len(grid) - held[::-1].argmax(0)
        self.gaps = held.sum(0) < last - first
        self.n = n

    def windows(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that end on the days ``start`` to ``end`` of the grid as unit vectors, and which of them are whole and not constant."""
        view = np.lib.stride_tricks.sliding_window_view(self.r[start - self.n + 1 : end], self.n, axis=0)
        return _unit(view)


def _unit(view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last axis centred and scaled to length 1, zeros where it can't be; and where it can."""
    good = ~np.isnan(view).any(-1) & (view.max(-1) != view.min(-1))
    centred = np.where(good[..., None], view - view.mean(-1, keepdims=True), 0.0)
    return centred / np.where(good, np.sqrt((centred * centred).sum(-1)), 1.0)[..., None], good


def _block_pairs(left: _Block, right: _Block, grid: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Correlations of the assets of two blocks from the threshold on; of one block with itself each pair once."""
    n, upper = left.n, left.names[:, None] < right.names[None, :]
    wanted = upper if left is right else np.ones_like(upper)
    whole = wanted & ~left.gaps[:, None] & ~right.gaps[None, :]

    def rows(a, b, day, rho):
        ra, rb, names_a, names_b = left.r[day, a], right.r[day, b], left.names[a], right.names[b]
        turn = ~upper[a, b]
        ra, rb = np.where(turn, rb, ra), np.where(turn, ra, rb)
        names_a, names_b = np.where(turn, names_b, names_a), np.where(turn, names_a, names_b)
        values = [pa.array(names_a, pa.string()), pa.array(names_b, pa.string()), pa.array(grid[day], pa.int32()).cast(pa.date32())]
        return pa.RecordBatch.from_arrays([*values, *map(pa.array, (np.clip(rho, -1, 1), ra, rb))], names=["a", "b", "Date", "rho", "ra", "rb"])

    for start in range(n - 1, len(grid), WINDOWS_AT_ONCE):
        end = min(start + WINDOWS_AT_ONCE, len(grid))
        (x, x_good), (y, y_good) = left.windows(start, end), right.windows(start, end)
        rho = x @ y.transpose(0, 2, 1)
        day, a, b = np.nonzero((np.abs(rho) >= threshold) & whole & x_good[:, :, None] & y_good[:, None, :])
        if len(day):
            yield rows(a, b, day + start, rho[day, a, b])
    # Where an asset has gaps, the last common days are those of the pair.
    for a, b in zip(*np.nonzero(wanted & ~whole)):
        days = np.flatnonzero(~np.isnan(left.r[:, a]) & ~np.isnan(right.r[:, b]))
        if len(days) >= n:
            (x, x_good), (y, y_good) = (_unit(np.lib.stride_tricks.sliding_window_view(r[days], n)) for r in (left.r[:, a], right.r[:, b]))
            rho = (x * y).sum(-1)
            hit = np.flatnonzero((np.abs(rho) >= threshold) & x_good & y_good)
            if len(hit):
                yield rows(np.full(len(hit), a), np.full(len(hit), b), days[hit + n - 1], rho[hit])


def block_correlation(
    returns: DataFrame, threshold: float = EDGE_THRESHOLD, n: int = WINDOW_DAYS, block: int = ASSETS_PER_BLOCK
) -> DataFrame:
    """The pairs of :func:`rolling_correlation` whose correlation is at least ``threshold`` in size, without a join of rows.

    An asset's days become one row; assets are dealt to blocks of about ``block``, and every two blocks meet in one task, where the
    correlations of a span of days are one matrix product of standardised windows. Only pairs over the threshold leave the task. A
    series is sent once per block instead of a row per asset and day. Pairs with an asset that has days missing inside
    its life are taken one by one. NULL returns are missing days; constant windows have no correlation; ``returns`` holds a row per asset and day.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0, or use rolling_correlation")
    kept = returns.where("r is not null and not isnan(r) and Ticker is not null and Date is not null")
    points = F.array_sort(F.collect_list(F.struct("Date", "r")))
    series = kept.groupBy("Ticker").agg(points["Date"].alias("days"), points["r"].alias("rs"))
    blocks = F.ceil(kept.agg(F.count_distinct("Ticker")).scalar() / block).cast("int")
    mine = F.pmod(F.xxhash64("Ticker"), F.greatest(blocks, F.lit(1))).cast("int")
    met = series.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)))
    met = met.select(F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "Ticker", "days", "rs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
                for at, (p, q, own, ticker) in enumerate(keys):
                    days = batch.column(4)[at].values.cast(pa.int32()).to_numpy()
                    yield (p, q), own, (ticker, days, batch.column(5)[at].values.to_numpy())

        for (p, q), members in groupby(rows(), key=lambda row: row[0]):
            sides: dict[int, list] = {p: [], q: []}
            for _, own, one in members:
                sides[own].append(one)
            grid = np.unique(np.concatenate([days for side in sides.values() for _, days, _ in side]))
            made = {own: _Block(side, grid, n) for own, side in sides.items()}
            yield from _block_pairs(made[p], made[q], grid, threshold)

    return met.repartition("p", "q").sortWithinPartitions("p", "q", "mine").mapInArrow(run, _PAIRS)


def edges(correlations: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """Pairs at or above the threshold, in both directions."""
    strong = correlations.where(F.abs("rho") >= threshold)
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("rb").alias("dst_r")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("ra").alias("dst_r")),
    )
    return strong.select("Date", "rho", F.inline(ends))


def neighbour_mean(graph: DataFrame) -> DataFrame:
    """Degree of every asset and the mean return of its neighbours that day."""
    return graph.groupBy(F.col("src").alias("Ticker"), "Date").agg(
        F.count("*").alias("degree"),
        F.avg("dst_r").alias("neighbour_r"),
        ratio(F.sum(F.col("rho") * F.col("dst_r")), F.sum(F.abs("rho"))).alias("weighted_r"),
    )


def graph_smooth(
    graph: DataFrame, values: DataFrame, mixing: float = 0.5, tolerance: float = 1e-6, most_hops: int = 50, value: str = "r"
) -> DataFrame:
    """``Ticker, Date, smooth, hops``: values spread over the edges of their day, hop by hop, until they settle.

    A hop sets ``x`` to ``(1 - mixing) * own value + mixing * mean of the neighbours' x``, weighted by the size of ``rho``. As ``mixing`` is
    below 1 it settles whatever the graph: each hop shrinks the largest change by ``mixing`` at least. It stops when no value
    changes by more than ``tolerance``, or after ``most_hops`` (``hops`` tells). Assets without neighbours keep their value; neighbours without a value
    are left out. A value per asset and day, NULL ones have no row.

    Edges are dealt by day and receiver once; a hop shuffles values, not edges, and is checkpointed, so that neither plan nor
    lineage grows. The values of a sender are few (one per asset and day), and adaptive execution splits a day's hub.
    """
    if not 0 <= mixing < 1:
        raise ValueError("mixing must lie in [0, 1)")
    context = graph.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(graph.sparkSession, "checkpoints"))
    own = values.select("Ticker", "Date", F.col(value).cast("double").alias("own")).where("own is not null and not isnan(own)")
    links = graph.select("src", "dst", "Date", F.abs("rho").alias("weight")).where("weight > 0").repartition("dst", "Date").checkpoint()
    now = own.withColumn("x", F.col("own")).checkpoint()
    hops, settled = 0, False
    while not settled and hops < most_hops:
        sent = links.join(now.select(F.col("Ticker").alias("dst"), "Date", "x"), ["dst", "Date"])
        mean = sent.groupBy(F.col("src").alias("Ticker"), "Date").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("mean"))
        mixed = F.when(F.col("mean").isNull(), F.col("own")).otherwise((1 - mixing) * F.col("own") + mixing * F.col("mean"))
        moved = now.join(mean, ["Ticker", "Date"], "left").select("Ticker", "Date", "own", mixed.alias("x"), F.abs(mixed - F.col("x")).alias("change"))
        now, hops = moved.checkpoint(), hops + 1
        settled = now.where(F.col("change") > tolerance).isEmpty()
    return now.select("Ticker", "Date", F.col("x").alias("smooth"), F.lit(hops).alias("hops"))


def edge_sweep(correlations: DataFrame, thresholds: list[float]) -> DataFrame:
    """Edges kept per threshold, counted in one pass."""
    return _sweep(correlations, [F.abs("rho") >= t for t in thresholds], thresholds, "edges")


def credibility_sweep(articles: DataFrame, thresholds: list[float]) -> DataFrame:
    """Articles kept per credibility threshold, counted in one pass."""
    return _sweep(articles, [F.col("p_cred") >= t for t in thresholds], thresholds, "articles")


def _sweep(frame: DataFrame, tests: list, thresholds: list[float], kept: str) -> DataFrame:
    counts = frame.agg(*(F.count_if(test).alias(f"n{i}") for i, test in enumerate(tests)))
    rows = F.array(
        *(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("kept")) for i, t in enumerate(thresholds))
    )
    return counts.select(F.lit(kept).alias("of"), F.inline(rows))
