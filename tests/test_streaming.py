import datetime as dt
import os

from pyspark.sql import functions as F

from tidemark.operators import master
from tidemark.operators.sentiment import daily_sentiment
from tidemark.streaming import daily

SCHEMA = "Ticker string, Text string, Score int, Confidence double, ts timestamp"


def rows(spark, *items):
    stamp = lambda d: dt.datetime(2024, 1, d, 12, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(t, x, s, c, stamp(d)) for t, x, s, c, d in items], SCHEMA)


def test_files_that_land_later_update_their_day(spark, tmp_path):
    feed, table, state = (str(tmp_path / p) for p in ("feed", "table", "state"))
    first = rows(spark, ("A", "x", 1, 0.5, 1), ("B", "y", -1, 0.7, 1))
    second = rows(spark, ("A", "z", 1, 0.9, 1), ("A", "w", -1, 0.1, 2))
    for batch in (first, second):
        batch.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        daily.publish(daily.daily_sentiment_stream(stream), table, state)
    got = daily.current(spark.read.parquet(table))
    day = F.to_date(F.date_format("ts", "yyyy-MM-dd"))
    want = daily_sentiment(first.unionByName(second).withColumn("Date", day))
    columns = ["Ticker", "Date", "Sent_CumScore", "Sent_TextCount", "Sent_Confidence", "Sent_NormScore"]
    read = lambda f: sorted((r[0], r[1], r[2], r[3], round(r[4], 9), r[5]) for r in f.select(columns).collect())
    assert read(got) == read(want) and got.count() == 3


def test_master_as_a_stream_equals_the_batch(spark, tmp_path):
    """Late texts, a day without texts, two bars of one day, a hot ticker, a restart after every file and a batch that runs twice."""
    texts, quotes, table, state = (str(tmp_path / p) for p in ("texts", "quotes", "table", "state"))
    bar_schema = "Ticker string, Close double, ts timestamp"
    stamp = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    bars = lambda *items: spark.createDataFrame([(t, c, stamp(d)) for t, c, d in items], bar_schema)
    land = [
        (bars(("A", 1.0, 1), ("A", 1.5, 1), ("A", 2.0, 2), ("B", 5.0, 1)), rows(spark, ("A", "x", 1, 0.5, 1), ("C", "no bar", 1, 0.5, 1))),
        (bars(("A", 3.0, 3), ("B", 6.0, 3)), rows(spark, ("A", "late", -1, 0.7, 1), ("B", "y", 1, 0.7, 3), *[("H", str(i), 1, 0.5, 3) for i in range(300)])),
        (bars(("H", 9.0, 3), ("H", 9.5, 4)), rows(spark, ("A", "z", 1, 0.9, 4))),
        (bars(("~", 0.0, 20)), rows(spark, ("~", "marker", 0, 0.0, 20))),
        (bars(("~", 0.0, 20)), rows(spark, ("~", "marker", 0, 0.0, 20))),
    ]
    for quote, text in land:
        quote.write.mode("append").parquet(quotes)
        text.write.mode("append").parquet(texts)
        read = lambda schema, path: spark.readStream.schema(schema).parquet(path)
        daily.publish(daily.master_stream(read(bar_schema, quotes), read(SCHEMA, texts)), table, state, mode="append")
    got = spark.read.parquet(table).where("Ticker <> '~'")
    day = F.to_date(F.date_format("ts", "yyyy-MM-dd"))
    all_bars = spark.read.parquet(quotes).where("Ticker <> '~'").withColumn("Date", day)
    scored = spark.read.parquet(texts).where("Ticker <> '~'")
    want = master.master_with_sentiment(all_bars, daily_sentiment(scored.withColumn("Date", day)))
    columns = ["Ticker", "ts", "Close", "Sent_CumScore", "Sent_TextCount", "Sent_NormScore"]
    listed = lambda f: sorted(map(str, f.select(columns).collect()))
    assert got.count() == 8 and listed(daily.heard(got, scored)) == listed(want)
    # The stream remembers what it has published: without new files nothing is added.
    daily.publish(daily.master_stream(read(bar_schema, quotes), read(SCHEMA, texts)), table, state, mode="append")
    assert spark.read.parquet(table).where("Ticker <> '~'").count() == 8


def test_empty_feeds_publish_nothing(spark, tmp_path):
    texts, quotes, table, state = (str(tmp_path / p) for p in ("texts", "quotes", "table", "state"))
    bar_schema = "Ticker string, Close double, ts timestamp"
    spark.createDataFrame([], bar_schema).write.parquet(quotes)
    rows(spark).write.parquet(texts)
    read = lambda schema, path: spark.readStream.schema(schema).parquet(path)
    daily.publish(daily.master_stream(read(bar_schema, quotes), read(SCHEMA, texts)), table, state, mode="append")
    assert not os.path.exists(table) or spark.read.schema(bar_schema).parquet(table).count() == 0


def test_copies_are_dropped_across_batches(spark, tmp_path):
    feed, table, state = (str(tmp_path / p) for p in ("feed", "table", "state"))
    for batch in (rows(spark, ("A", "x", 1, 0.5, 1)), rows(spark, ("A", " x ", 1, 0.5, 1), ("A", "x", 1, 0.5, 2))):
        batch.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        daily.publish(daily.drop_copies(stream), table, state, mode="append")
    got = sorted((r.Text, r.ts.day) for r in spark.read.parquet(table).collect())
    assert got == [("x", 1), ("x", 2)]
