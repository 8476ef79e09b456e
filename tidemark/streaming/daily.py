"""Daily sentiment kept up to date while comment files land.

Same rules as the batch operators; days are UTC days and state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import epoch_date
from tidemark.functions.numbers import ratio
from tidemark.functions.text import strip_edges


def drop_copies(comments: DataFrame, stamp: str = "ts", text: str = "Text", delay: str = "2 days") -> DataFrame:
    """First copy of a text per ticker and day, for copies that arrive within ``delay``."""
    keyed = comments.withColumn("_digest", F.sha2(strip_edges(F.col(text)), 256)).withColumn("_day", epoch_date(F.unix_seconds(stamp)))
    return (
        keyed.withWatermark(stamp, delay)
        .dropDuplicatesWithinWatermark(["Ticker", "_day", "_digest"])
        .drop("_digest", "_day")
    )


def _daily(scored: DataFrame, stamp: str, delay: str) -> DataFrame:
    return (
        scored.withWatermark(stamp, delay)
        .groupBy("Ticker", F.window(stamp, "1 day"))
        .agg(
            F.sum("Score").alias("Sent_CumScore"),
            F.avg("Confidence").alias("Sent_Confidence"),
            F.count("Text").alias("Sent_TextCount"),
        )
    )


def daily_sentiment_stream(scored: DataFrame, stamp: str = "ts", delay: str = "2 days") -> DataFrame:
    """Sentiment columns per ticker and day of a stream of scored texts."""
    return _daily(scored, stamp, delay).select(
        "Ticker",
        epoch_date(F.unix_seconds("window.start")).alias("Date"),
        "Sent_CumScore",
        "Sent_Confidence",
        "Sent_TextCount",
        ratio(F.col("Sent_CumScore"), F.col("Sent_TextCount")).alias("Sent_NormScore"),
    )


def master_stream(bars: DataFrame, scored: DataFrame, stamp: str = "ts", delay: str = "2 days") -> DataFrame:
    """Bars, each once, with the sentiment of their day; NULL where no text of it came. Both sides have ``stamp``.

    A bar appears when no more texts of its day can come, that is when both feeds have moved ``delay`` beyond its day;
    then its state goes too, as does that of days without a bar. Texts and bars that come later than that are left out, as
    are NULL stamps. Bars of NULL tickers never meet texts, and texts of NULL tickers don't move their feed on, as Spark filters
    them before it takes the time. Publish it in ``append`` mode.
    """
    daily = _daily(scored.where(F.col(stamp).isNotNull()), stamp, delay)
    # A stream may have one event time only; after this that is the window.
    plain = F.timestamp_micros(F.unix_micros(stamp))
    timed = bars.where(F.col(stamp).isNotNull()).withWatermark(stamp, delay)
    days = timed.withColumn("window", F.window(stamp, "1 day")).withColumn(stamp, plain)
    joined = days.join(daily, ["Ticker", "window"], "left_outer")
    return joined.select(
        *bars.columns,
        "Sent_CumScore",
        "Sent_Confidence",
        "Sent_TextCount",
        ratio(F.col("Sent_CumScore"), F.col("Sent_TextCount")).alias("Sent_NormScore"),
    )


def heard(published: DataFrame, scored: DataFrame) -> DataFrame:
    """Published bars of the tickers that have a text at all, as in the batch master."""
    return published.join(scored.select("Ticker").distinct(), "Ticker", "left_semi").drop("batch")


def publish(stream: DataFrame, table: str, checkpoint: str, mode: str = "update") -> None:
    """Process what has landed and stop. Each batch becomes its own folder under ``table``.

    A batch that is run again after a failure overwrites its folder, so rows are never doubled. In
    ``update`` mode the latest batch that holds a day has its current values.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()


def current(updates: DataFrame) -> DataFrame:
    """Current values of every ticker and day out of the published batches."""
    rest = [c for c in updates.columns if c not in ("Ticker", "Date", "batch")]
    last = updates.groupBy("Ticker", "Date").agg(F.max_by(F.struct(*rest), "batch").alias("_"))
    return last.select("Ticker", "Date", "_.*")
