"""Portfolios: selection, costs, net returns and risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.selection import crossing
from tidemark.session import parameter_frame

# Weight bound, fee ranges and slippage in basis points, days per year.
MAX_WEIGHT = 0.3
MAKER_BPS = (2.0, 5.0)
TAKER_BPS = (5.0, 10.0)
LIQUID_SLIPPAGE_BPS = 7.5
ILLIQUID_SLIPPAGE_BPS = 50.0
DAYS_PER_YEAR = 365


def top_k(signals: DataFrame, sizes: Sequence[int], signal: str = "forecast") -> DataFrame:
    """The K best assets of every day for every K, equally weighted; equal signals go by ticker."""
    best_first = Window.partitionBy("Date").orderBy(F.col(signal).desc(), "Ticker")
    ranked = signals.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= max(sizes))
    sized = F.filter(F.array(*map(F.lit, sizes)), lambda k: F.col("rank") <= k)
    held = ranked.withColumn("K", F.explode(sized))
    weight = F.lit(1.0) / F.count("*").over(Window.partitionBy("Date", "K"))
    return held.withColumn("w", weight)


def audit_weights(weights: DataFrame, bound: float = MAX_WEIGHT, groups: Sequence[str] = ("K", "Date")) -> DataFrame:
    """Range and sum of the weights of every day, and how many exceed the bound."""
    return weights.groupBy(*groups).agg(
        F.min("w").alias("min_w"),
        F.max("w").alias("max_w"),
        F.sum("w").alias("sum_w"),
        F.count_if(F.abs("w") > bound).alias("violations"),
    )


def project_weights(
    weights: DataFrame, low: float = -MAX_WEIGHT, high: float = MAX_WEIGHT, groups: Sequence[str] = ("Date",), w: str = "w"
) -> DataFrame:
    """The nearest weights (least squares) that lie in ``[low, high]`` and sum to 1 in every group: ``w``, and ``feasible``.

    They are the given weights less one shift per group, cut to the bounds. As the shift grows, an asset leaves the upper bound at
    one point and meets the lower one at another; between these points the sum falls linearly, so the shift
    follows from the point before which the sum is still above 1. That point is selected by counts
    (:func:`selection.crossing`), which sorts no group in one task.

    Weights that are NULL, NaN or infinite stay NULL and do not count as assets. A group of too few or too many assets for the bounds is
    not feasible, its weights are NULL. Equal weights stay equal; repeated rows are assets of their own.
    """
    if not low <= high:
        raise ValueError(f"no weight between {low} and {high}")
    keys = list(groups)
    raw = F.col(w).cast("double")
    usable = F.when(~F.isnan(raw) & (F.abs(raw) < float("inf")), raw)
    assets = weights.withColumn(w, usable)
    sizes = assets.groupBy(*keys).agg(F.count(w).alias("_n"))
    feasible = (F.col("_n") * low <= 1) & (F.col("_n") * high >= 1) & (F.col("_n") > 0)
    sizes = sizes.withColumn("feasible", feasible)
    same_day = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_key{i}") for i, k in enumerate(keys)]
    marks = [f"_key{i}" for i in range(len(keys))]
    points = F.array(F.struct((F.col(w) - high).alias("at"), F.lit(-1.0).alias("slope")), F.struct((F.col(w) - low).alias("at"), F.lit(1.0).alias("slope")))
    sizes = sizes.select(*same_day, "_n", "feasible")
    turns = assets.where(F.col(w).isNotNull()).select(*same_day, F.inline(points)).join(sizes.where("feasible"), marks)

    def sum_at(at: Column, totals: Mapping[str, Column]) -> Column:
        return F.col("_n") * high + totals["slope"] * at - totals["moment"]

    measures = {"slope": F.col("slope"), "moment": F.col("slope") * F.col("at")}
    found = crossing(turns, marks, "at", measures, lambda at, totals: sum_at(at, totals) <= 1, carried=["_n"])
    # Before this point the sum is n * high + slope * shift - moment.
    shift = F.coalesce(F.try_divide(F.col("moment") + 1 - F.col("_n") * high, F.nullif(F.col("slope"), F.lit(0.0))), F.col("at"))
    shifts = found.select(*marks, shift.alias("_shift"))
    cut = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(w) - F.col("_shift")))
    tagged = assets.select("*", *same_day).join(sizes.drop("_n"), marks, "left").join(shifts, marks, "left")
    return tagged.withColumn(w, F.when(F.col(w).isNotNull() & F.col("_shift").isNotNull(), cut)).drop(*marks, "_shift")


def tail_risk(returns: DataFrame, levels: Sequence[float] = (0.9, 0.95, 0.99), group: str = "K", r: str = "net") -> DataFrame:
    """Value at risk and mean loss in the tail (CVaR) of every group at every level, both as losses.

    The tail is the worst ``1 - level`` share of the ``n`` returns; where that is no whole number of them, the next one counts in
    part, so ties and small groups need no rule of their own. The boundary is selected by counts (:func:`selection.crossing`): no
    group is sorted in one task. NULL and NaN returns do not count; a group without any other has no row.
    """
    if not all(0 < x < 1 for x in levels):
        raise ValueError(f"levels must lie between 0 and 1: {levels}")
    kept = returns.select(F.col(group).alias("_group"), F.col(r).cast("double").alias("_r")).where("_r is not null and not isnan(_r)")
    # Each level is selected on its own; rows are copied before the join with the groups' bounds, after which most are gone.
    each = F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level")
    sizes = kept.groupBy("_group").agg(F.count("*").alias("n"))
    tail = F.round(F.col("n") * (1 - F.col("level")), 9)  # 0.1 * 30 must not be a little more than 3
    sizes = sizes.select("_group", "n", each).withColumn("_tail", tail)
    groups = sizes.select(F.coalesce(F.col("_group").cast("string"), F.lit("\0")).alias("_key"), F.col("_group").alias(group), "level", "n", "_tail")
    rows = kept.select(F.coalesce(F.col("_group").cast("string"), F.lit("\0")).alias("_key"), "_r").join(groups, "_key")
    measures = {"count": F.lit(1.0), "total": F.col("_r")}
    found = crossing(rows, ["_key", "level"], "_r", measures, lambda at, t: t["count"] >= F.col("_tail"), carried=[group, "n", "_tail"])
    rest = (F.col("_tail") - F.col("count")) * F.col("_r")
    return found.select(
        group, "level", F.col("n").alias("days"), (-F.col("_r")).alias("var"), (-(F.col("total") + rest) / F.col("_tail")).alias("cvar")
    )


def tail_reward(returns: DataFrame, lambdas: Sequence[float], level: float = 0.95, group: str = "K", r: str = "net") -> DataFrame:
    """Mean return minus lambda times its CVaR, for every lambda: the risk-averse counterpart of :func:`reward_sweep`."""
    means = returns.where(~F.isnan(r)).groupBy(F.col(group).alias("_g")).agg(F.avg(r).alias("mean"))
    risks = tail_risk(returns, [level], group, r)
    both = risks.join(means, F.col(group).eqNullSafe(F.col("_g")))
    each = both.withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas))))
    return each.select(group, "lambda", (F.col("mean") - F.col("lambda") * F.col("cvar")).alias("reward"))


def trades(weights: DataFrame) -> DataFrame:
    """Change of weight per asset and day, including assets that left the portfolio.

    Every weight counts positive on its day and negative on the portfolio's next day.
    """
    days = weights.select("K", "Date").distinct()
    following = days.withColumn("next", F.lead("Date").over(Window.partitionBy("K").orderBy("Date")))
    dated = weights.select("K", "Date", "Ticker", "w").join(following, ["K", "Date"])
    both = F.array(
        F.struct(F.col("Date").alias("day"), F.col("w").alias("dw")),
        F.struct(F.col("next").alias("day"), (-F.col("w")).alias("dw")),
    )
    moves = dated.select("K", "Ticker", F.inline(both)).where(F.col("day").isNotNull())
    return moves.groupBy("K", F.col("day").alias("Date"), "Ticker").agg(F.sum("dw").alias("dw"))


def net_returns(
    weights: DataFrame,
    slippage_bps: Mapping[str, float],
    fee_bps: float = sum(TAKER_BPS) / 2,
    default_slippage_bps: float = ILLIQUID_SLIPPAGE_BPS,
) -> DataFrame:
    """Gross return, cost and net return of every portfolio and day.

    ``weights`` carry the return ``r`` of their asset and day. Cost is the traded weight times fee
    plus the asset's slippage.
    """
    slippage = parameter_frame(weights.sparkSession, slippage_bps.items(), "Ticker string, bps double")
    gross = weights.groupBy("K", "Date").agg(F.sum(F.col("w") * F.col("r")).alias("gross"))
    bps = F.coalesce("bps", F.lit(default_slippage_bps)) + F.lit(fee_bps)
    costs = (
        trades(weights)
        .join(F.broadcast(slippage), "Ticker", "left")
        .groupBy("K", "Date")
        .agg(F.sum(F.abs("dw") * bps / 1e4).alias("cost"))
    )
    return gross.join(costs, ["K", "Date"]).withColumn("net", F.col("gross") - F.col("cost"))


def reward_sweep(returns: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """Mean return minus lambda times its variance, for every lambda."""
    moments = returns.groupBy("K").agg(F.avg("net").alias("mean"), F.var_pop("net").alias("var"))
    each = moments.withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas))))
    return each.select("K", "lambda", (F.col("mean") - F.col("lambda") * F.col("var")).alias("reward"))


def annualised(mean: Column, deviation: Column) -> Column:
    return ratio(mean, F.nullif(deviation, F.lit(0.0))) * F.sqrt(F.lit(float(DAYS_PER_YEAR)))


def downside(r: str) -> Column:
    """Root mean square of the losses, over all days."""
    return F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), 2)))


def risk_metrics(returns: DataFrame, group: str = "K", r: str = "net") -> DataFrame:
    """Sharpe, Sortino and maximum drawdown, the risk-free rate being 0.

    The wealth window holds one row per day of a portfolio. Wealth starts at 1, which counts as a
    peak.
    """
    so_far = Window.partitionBy(group).orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.withColumn("_log", F.sum(F.log1p(r)).over(so_far))
    peak = F.greatest(F.max("_log").over(so_far), F.lit(0.0))
    falls = wealth.withColumn("_fall", F.exp(F.col("_log") - peak) - 1)
    return falls.groupBy(group).agg(
        F.count("*").alias("days"),
        annualised(F.avg(r), F.stddev_pop(r)).alias("sharpe"),
        annualised(F.avg(r), downside(r)).alias("sortino"),
        F.min("_fall").alias("max_drawdown"),
    )
