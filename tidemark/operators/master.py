"""The master feature table: one row per bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import overwrite_columns
from tidemark.schemas import NEWS_FEATURES

KEYS = ("Ticker", "Date")


def master_with_sentiment(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars with daily sentiment, NULL on days without comments.

    A ticker without a single comment leaves the table.
    """
    heard = daily.select("Ticker").distinct()
    return bars.join(heard, "Ticker", "left_semi").join(daily, list(KEYS), "left")


def refresh_news(master: DataFrame, *daily: DataFrame, known: str | None = None) -> DataFrame:
    """Replace the news and event columns by those of the daily frames; days without articles get 0.

    ``known`` names a column that is 1 on days with articles, since a 0 does not tell. Running it twice changes
    nothing.
    """
    fresh = master
    for frame in daily:
        fresh = overwrite_columns(fresh, frame, KEYS)
    for name in NEWS_FEATURES:
        if name not in fresh.columns:
            fresh = fresh.withColumn(name, F.lit(None).cast("int"))
    if known:
        fresh = fresh.withColumn(known, F.coalesce(*(F.col(c).cast("double") for c in NEWS_FEATURES)).isNotNull().cast("int"))
    return fresh.fillna(0, subset=list(NEWS_FEATURES)).drop("FwdRet_7d")
