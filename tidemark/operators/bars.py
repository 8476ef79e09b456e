"""Price bars: one row per asset and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.common import require_columns
from tidemark.schemas import BAR_COLUMNS


def canonical_bars(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Bars with the fixed columns in the fixed order; a feed without one of them is an error."""
    if "Ticker" not in raw.columns and ticker is not None:
        raw = raw.withColumn("Ticker", F.lit(ticker))
    require_columns(raw, BAR_COLUMNS, "bars")
    return raw.select(*(F.col(f"`{c}`") for c in BAR_COLUMNS))


def daily_returns(bars: DataFrame) -> DataFrame:
    """Close-to-close return ``r`` of every bar but the first of an asset.

    A window per asset holds at most one row per day, so its size is bounded by the calendar.
    """
    by_day = Window.partitionBy("Ticker").orderBy("Date")
    r = ratio(F.col("Close"), F.lag("Close").over(by_day)) - 1
    return bars.select("Ticker", "Date", r.alias("r")).where(F.col("r").isNotNull())


def forward_return(bars: DataFrame, rows: int = 7, name: str = "FwdRet_7d") -> DataFrame:
    """Return over the next ``rows`` bars; NULL at the end of an asset's history."""
    by_day = Window.partitionBy("Ticker").orderBy("Date")
    ahead = ratio(F.lead("Close", rows).over(by_day), F.col("Close")) - 1
    return bars.withColumn(name, ahead)


def lookback(frame: DataFrame, value: str, rows: int = 30) -> DataFrame:
    """The last ``rows`` values of an asset, oldest first; only where that many exist."""
    window = Window.partitionBy("Ticker").orderBy("Date").rowsBetween(1 - rows, 0)
    return frame.select(
        "Ticker", "Date", F.collect_list(value).over(window).alias("history")
    ).where(F.size("history") == rows)
