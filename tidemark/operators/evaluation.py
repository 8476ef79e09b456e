"""Evaluation: forecasts, regimes, events, backtest folds and rater agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.portfolio import annualised

# Months of training and test, number of folds.
TRAIN_MONTHS = 18
TEST_MONTHS = 3
FOLDS = 3


def forecast_metrics(forecasts: DataFrame, groups: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Root mean square error and share of right directions; a zero matches only a zero."""
    error = F.col("r") - F.col("forecast")
    right = (F.signum("r") == F.signum("forecast")).cast("double")
    return forecasts.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(right).alias("direction")
    )


def previous_return(returns: DataFrame) -> DataFrame:
    """The last return as the forecast of the next."""
    by_day = Window.partitionBy("Ticker").orderBy("Date")
    return returns.withColumn("forecast", F.lag("r").over(by_day)).where(F.col("forecast").isNotNull())


def in_regimes(frame: DataFrame, regimes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows with each regime their date falls into. The few regimes stand in the plan, not in a join."""
    spans = F.array(
        *(
            F.struct(F.lit(n).alias("regime"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
            for n, a, b in regimes
        )
    )
    hit = F.filter(spans, lambda s: F.col("Date").between(s["a"], s["b"]))
    return frame.withColumn("_hit", F.explode(hit)).withColumn("regime", F.col("_hit.regime")).drop("_hit")


def regime_metrics(returns: DataFrame, regimes: Sequence[tuple[str, str, str]], r: str = "r") -> DataFrame:
    return in_regimes(returns, regimes).groupBy("Ticker", "regime").agg(
        F.count("*").alias("days"),
        F.avg(r).alias("mean_r"),
        annualised(F.avg(r), F.stddev_pop(r)).alias("sharpe"),
    )


def event_study(returns: DataFrame, events: DataFrame, k: int = 3) -> DataFrame:
    """Mean return by ticker on the days around its events."""
    days = events.select("Ticker", F.col("Date").alias("event_day")).distinct()
    offsets = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    around = days.withColumn("day_offset", offsets).withColumn("Date", F.date_add("event_day", F.col("day_offset")))
    joined = around.join(returns, ["Ticker", "Date"])
    return joined.groupBy("Ticker", "day_offset").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"))


def market_return(returns: DataFrame) -> DataFrame:
    """Equally weighted mean return of all assets of a day."""
    return returns.groupBy("Date").agg(F.avg("r").alias("market"))


def abnormal_returns(
    returns: DataFrame, events: DataFrame, market: DataFrame, k: int = 3, estimation: tuple[int, int] = (-120, -11), least_days: int = 20
) -> DataFrame:
    """Returns around events less what the market model expects: ``Ticker, event_day, day_offset, r, expected, abnormal, t, cumulated, cumulated_t``.

    For every event, ``r = alpha + beta * market`` is fitted by least squares to the days of the ``estimation`` window (offsets from
    the event day, both included) on which asset and market have a return. ``t`` is the abnormal return over the residual deviation (n - 2
    degrees of freedom), ``cumulated`` the sum over the days up to here on which there is a return, with ``cumulated_t`` for as many
    independent days. Events with fewer than ``least_days`` days, or a market that never moves in them, have NULL
    from ``expected`` on; a fit without residuals has NULL t values. Events on the same day count once; days
    without a return have no row; NULL returns are no returns. ``returns`` and ``market`` hold one row per key.

    Events meet returns by asset and day, so no asset's days are gathered in one task.
    """
    first, last = estimation
    if not first <= last < -k:
        raise ValueError("the estimation window must end before the event window")
    days = events.select("Ticker", F.col("Date").alias("event_day")).where("Ticker is not null and event_day is not null").distinct()
    pairs = returns.select("Ticker", "Date", "r").where("r is not null").join(market.select("Date", "market").where("market is not null"), "Date")

    def around(start: int, end: int) -> DataFrame:
        offsets = days.withColumn("day_offset", F.explode(F.sequence(F.lit(start), F.lit(end))))
        return offsets.withColumn("Date", F.date_add("event_day", F.col("day_offset"))).join(pairs, ["Ticker", "Date"])

    fits = around(first, last).groupBy("Ticker", "event_day").agg(
        F.count("*").alias("days"), F.regr_slope("r", "market").alias("beta"), F.regr_intercept("r", "market").alias("alpha"),
        F.regr_syy("r", "market").alias("syy"), F.regr_sxy("r", "market").alias("sxy"),
    )
    residual = F.col("syy") - F.col("beta") * F.col("sxy")
    residual = F.when(residual > 1e-12 * F.col("syy"), residual)  # below it is rounding
    fits = fits.where((F.col("days") >= max(least_days, 3)) & F.col("beta").isNotNull()).select(
        "Ticker", "event_day", "alpha", "beta", F.sqrt(residual / (F.col("days") - 2)).alias("s")
    )
    own = around(-k, k).join(fits, ["Ticker", "event_day"], "left")
    own = own.withColumn("expected", F.col("alpha") + F.col("beta") * F.col("market")).withColumn("abnormal", F.col("r") - F.col("expected"))
    so_far = Window.partitionBy("Ticker", "event_day").orderBy("day_offset")  # at most 2k + 1 rows
    summed, number = F.sum("abnormal").over(so_far), F.count("abnormal").over(so_far)
    own = own.withColumns({"cumulated": summed, "_days": number})
    return own.select(
        "Ticker", "event_day", "day_offset", "r", "expected", "abnormal", ratio(F.col("abnormal"), F.col("s")).alias("t"),
        "cumulated", ratio(F.col("cumulated"), F.col("s") * F.sqrt("_days")).alias("cumulated_t"),
    )


def average_abnormal(abnormal: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean abnormal and cumulated return over events by day offset, with t values across the events."""

    def t(column: str) -> Column:
        return ratio(F.avg(column) * F.sqrt(F.count(column)), F.nullif(F.stddev_samp(column), F.lit(0.0)))

    return abnormal.where("abnormal is not null").groupBy(*groups, "day_offset").agg(
        F.count("*").alias("events"), F.avg("abnormal").alias("mean_abnormal"), t("abnormal").alias("t"),
        F.avg("cumulated").alias("mean_cumulated"), t("cumulated").alias("cumulated_t"),
    )


def fold_bounds(first: Column, last: Column, mode: str = "rolling", folds: int = FOLDS) -> Column:
    """Array of folds ending at ``last``: train and test bounds, both ends included."""
    if mode not in ("rolling", "expanding"):
        raise ValueError(f"unknown mode {mode}")

    def fold(i: Column) -> Column:
        test_end = F.add_months(last, (i - folds) * TEST_MONTHS)
        test_start = F.date_add(F.add_months(test_end, -TEST_MONTHS), 1)
        train_start = F.add_months(test_start, -TRAIN_MONTHS) if mode == "rolling" else first
        return F.struct(
            i.alias("fold"), train_start.alias("train_start"), F.date_sub(test_start, 1).alias("train_end"),
            test_start.alias("test_start"), test_end.alias("test_end"),
        )

    return F.transform(F.sequence(F.lit(1), F.lit(folds)), fold)


def backtest_folds(bars: DataFrame, mode: str = "rolling", folds: int = FOLDS) -> DataFrame:
    """The folds a set of bars is tested on."""
    ends = bars.agg(F.min("Date").alias("a"), F.max("Date").alias("b"))
    return ends.select(F.inline(fold_bounds(F.col("a"), F.col("b"), mode, folds)))


def assign_folds(bars: DataFrame, mode: str = "rolling", folds: int = FOLDS) -> DataFrame:
    """Bars with the folds they take part in and their role there. The broadcast side has ``folds`` rows."""
    bounds = F.broadcast(backtest_folds(bars, mode, folds))
    rows = bars.join(bounds, F.col("Date").between(F.col("train_start"), F.col("test_end")))
    return rows.withColumn("role", F.when(F.col("Date") >= F.col("test_start"), "test").otherwise("train"))


def fold_membership(bars: DataFrame, mode: str = "rolling", folds: int = FOLDS) -> DataFrame:
    """Per asset and fold: listed too late to train on all of it (cold start), or gone before its end.

    Assets without a bar in a fold have no row there; delisted ones stay until their last bar.
    """
    spans = bars.groupBy("Ticker").agg(F.min("Date").alias("first_day"), F.max("Date").alias("last_day"))
    bounds = F.broadcast(backtest_folds(bars, mode, folds))
    overlaps = (F.col("first_day") <= F.col("test_end")) & (F.col("last_day") >= F.col("train_start"))
    return spans.join(bounds, overlaps).select(
        "Ticker",
        "fold",
        (F.col("first_day") > F.col("train_start")).cast("int").alias("cold_start"),
        (F.col("last_day") < F.col("test_end")).cast("int").alias("delisted"),
    )


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Agreement of many raters on many items: items, raters per item, and kappa."""
    cells = ratings.groupBy("item", "category").agg(F.count("*").alias("n"))
    items = cells.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    agreement = ratio(F.col("sq") - F.col("m"), F.col("m") * (F.col("m") - 1))
    observed = items.agg(F.count("*").alias("items"), F.avg("m").alias("raters"), F.avg(agreement).alias("p"))
    shares = cells.groupBy("category").agg(F.sum("n").alias("t"))
    square_sum = ratio(F.sum(F.col("t").cast("double") * F.col("t")), F.pow(F.sum("t"), 2))
    expected = shares.agg(square_sum).scalar()
    return observed.select("items", "raters", ratio(F.col("p") - expected, 1 - expected).alias("kappa"))
