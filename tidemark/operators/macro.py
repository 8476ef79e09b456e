"""Macroeconomic series: long form, wide form, forward fill and point-in-time join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_even, to_number

# Column name and series id, quarterly and monthly.
QUARTERLY_SERIES = {
    "GDP_Growth_Rate": "A191RL1Q225SBEA",
    "GDP_Annual_Growth_Rate": "A191RO1Q156NBEA",
    "Current_Account": "NETFI",
    "Current_Account_to_GDP": "IEABCA",
    "Government_Debt_to_GDP": "GGGDTAUSA188N",
    "Government_Budget": "M318501Q027NBEA",
}
MONTHLY_SERIES = {
    "Unemployment_Rate": "UNRATE",
    "Non_Farm_Payrolls": "PAYEMS",
    "Inflation_Rate": "CPIAUCSL",
    "Inflation_Rate_MoM": "CPIAUCNS",
    "Interest_Rate": "FEDFUNDS",
    "Balance_of_Trade": "BOPGSTB",
    "Business_Confidence": "BSCICP03USM665S",
    "Manufacturing_PMI": "MANPM",
    "Non_Manufacturing_PMI": "NMFCI",
    "Services_PMI": "SRVPRD",
    "Consumer_Confidence": "UMCSENT",
    "Retail_Sales_MoM": "RSXFS",
    "Building_Permits": "PERMIT",
}

# Decimals per column.
DIGITS = {
    "Non_Farm_Payrolls": 0, "Building_Permits": 0,
    "Balance_of_Trade": 2, "Current_Account": 2,
    "GDP_Growth_Rate": 1, "GDP_Annual_Growth_Rate": 1, "Unemployment_Rate": 1, "Interest_Rate": 1,
    "Ten_Year_Yield": 1, "Current_Account_to_GDP": 1, "Government_Debt_to_GDP": 1, "Government_Budget": 1,
    "Inflation_Rate": 2, "Inflation_Rate_MoM": 2,
    "Business_Confidence": 2, "Manufacturing_PMI": 2, "Non_Manufacturing_PMI": 2, "Services_PMI": 2,
    "Consumer_Confidence": 2,
}
DEFAULT_DIGITS = 6


def usable_observations(raw: DataFrame) -> DataFrame:
    """series_id, date, value of observations whose value is a number."""
    typed = raw.select("series_id", F.to_date("date").alias("date"), to_number(F.col("value")).alias("value"))
    return typed.dropna(subset=["date", "value"])


def widen(long: DataFrame, names: Mapping[str, str], keys: Sequence[str] = ("date",)) -> DataFrame:
    """One column per series (column name to series id), one row per date any series has.

    Of several values for one date the largest counts; :func:`latest_vintage` picks the newest before, where the
    feed says which that is.

    One aggregation stands for the chain of outer joins; the fixed list saves a job to find it.
    """
    ids = list(names.values())
    wide = long.groupBy(*keys).pivot("series_id", ids).agg(F.max("value"))
    return wide.select(*keys, *(F.col(f"`{i}`").alias(n) for n, i in names.items()))


def latest_vintage(long: DataFrame, vintage: str) -> DataFrame:
    """One value per series and date: that of the newest ``vintage``, the larger of two equally new ones."""
    newest = F.max(F.struct(F.col(vintage), F.col("value"))).alias("newest")
    return long.groupBy("series_id", "date").agg(newest).select("series_id", "date", F.col("newest.value").alias("value"))


def forward_fill(long: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Every series on every date of any series, gaps filled from before; ``next_date`` ends a row's validity.

    The windows run per series over dates, which the calendar bounds.
    """
    spine = long.select("date").distinct().withColumn("series_id", F.explode(F.array(*map(F.lit, ids))))
    by_date = Window.partitionBy("series_id").orderBy("date")
    single = long.groupBy("series_id", "date").agg(F.max("value").alias("value"))
    known = spine.join(single, ["series_id", "date"], "left")
    return known.select(
        "series_id",
        "date",
        F.last("value", ignorenulls=True).over(by_date).alias("value"),
        F.lead("date").over(by_date).alias("next_date"),
    )


def rounded(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.withColumns({n: half_even(F.col(n), DIGITS.get(n, DEFAULT_DIGITS)) for n in names})


def monthly_table(long: DataFrame, names: Mapping[str, str], date_format: str = "MM/dd/yyyy") -> DataFrame:
    """The published table: filled, rounded, oldest first, Date as text."""
    wide = rounded(widen(forward_fill(long, list(names.values())), names), list(names))
    return wide.orderBy("date").select(F.date_format("date", date_format).alias("Date"), *names)


def as_of(bars: DataFrame, long: DataFrame, names: Mapping[str, str], lag_days: int = 0) -> DataFrame:
    """Bars with the latest macro row at or before their date; ``lag_days`` delays its publication.

    A macro row holds until the next one. Its validity is spread over the months it touches, so
    that the join has an equality key. The last row holds to the end of the bars.
    """
    filled = forward_fill(long, list(names.values()))
    wide = widen(filled, names, keys=("date", "next_date"))
    end = F.date_add(bars.agg(F.max("Date")).scalar(), 1)
    valid = wide.select(
        F.col("date").alias("macro_date"),
        F.date_add("date", lag_days).alias("valid_from"),
        F.coalesce(F.date_add("next_date", lag_days), end).alias("valid_to"),
        *names,
    ).where(F.col("valid_from") < F.col("valid_to"))
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc("valid_to", "month"), F.expr("interval 1 month"))
    valid = valid.withColumn("_month", F.explode(months))
    left = bars.withColumn("_month", F.trunc("Date", "month"))
    holds = (left["Date"] >= valid["valid_from"]) & (left["Date"] < valid["valid_to"])
    joined = left.join(valid, (left["_month"] == valid["_month"]) & holds, "left")
    return joined.drop("_month", "valid_from", "valid_to")
