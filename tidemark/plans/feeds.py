"""Round trips: the tables written as feeds into the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.dates import day_epoch, epoch_date
from tidemark.functions.numbers import polarity
from tidemark.operators import bars as bars_ops
from tidemark.operators import comments as comment_ops
from tidemark.operators import master as master_ops
from tidemark.operators import universe as universe_ops
from tidemark.operators import sentiment as sent
from tidemark.plans.press import NEWS_DAILY, NEWS_FLAGS, NEWS_SCORED, press_features
from tidemark.plans.registry import query
from tidemark.plans.social import SOCIAL_DAILY, TEST_LEXICON, raw_comments, social_sql, verdicts_sql
from tidemark.plans.tables import Tables, with_entities
from tidemark.session import shared_dir
from tidemark.sources import files, sinks
from tidemark.streaming import daily


@query("universe_scan", with_entities("SELECT * FROM universe", "universe"))
def universe_scan(t: Tables):
    path = shared_dir(t.spark, "universe")
    t.universe.write.option("header", True).csv(path)
    return files.read_universe(t.spark, path)


@query("bars_scan", with_entities("""
SELECT CAST(Date AS VARCHAR) AS Date, Ticker, Open, High, Low, Close, Close AS "Adj Close", CAST(Volume AS DOUBLE) AS Volume
FROM bars_long""", "bars_long"))
def bars_scan(t: Tables):
    """One folder per ticker; the ticker comes back from the path."""
    path = shared_dir(t.spark, "bars")
    bars = bars_ops.canonical_bars(t.bars_long.withColumn("Adj Close", F.col("Close")))
    in_file = bars.withColumn("folder", F.col("Ticker")).withColumn("Ticker", F.lit("from the file"))
    in_file.write.partitionBy("folder").option("header", True).csv(path)
    return files.read_bars(t.spark, f"{path}/*/*.csv")


@query("comments_scan", with_entities("""
SELECT Ticker, conv_id * 100 + turn AS idx, CAST(Date AS VARCHAR) AS day,
       CASE WHEN turn = 0 THEN Text ELSE '' END AS content,
       CAST(CASE WHEN turn = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_replies FROM comment_rows""", "comment_rows"))
def comments_scan(t: Tables):
    path = shared_dir(t.spark, "comments")
    comments = raw_comments(t).select(
        "Ticker", F.lit("a_comments.json").alias("file"), (F.col("conv_id") * 100 + F.col("turn")).alias("idx"),
        F.date_format("Date", "yyyy-MM-dd").alias("time"), "content", "replies",
    )
    sinks.write_json_lines(comments, path)
    rows = files.read_comment_lines(t.spark, path)
    first = F.coalesce(F.get("content", F.lit(0))["text"], F.lit(""))
    return rows.select(
        "Ticker", "idx", F.col("time").alias("day"), first.alias("content"), F.size("replies").alias("n_replies")
    )


@query("master_publish", with_entities(f"""
, {NEWS_SCORED}, {NEWS_DAILY}, {NEWS_FLAGS}
SELECT b.Ticker, CAST(b.Date AS VARCHAR) AS Date, Close, coalesce(News_Score, 0) AS News_Score,
  CAST(coalesce(News_Cnt, 0) AS BIGINT) AS News_Cnt, round(coalesce(News_Conf, 0), 6) AS News_Conf,
  round(coalesce(News_Norm, 0), 6) AS News_Norm, coalesce(Event_Flag, 0) AS Event_Flag
FROM bars b LEFT JOIN daily d ON b.Ticker = d.Ticker AND b.Date = d.Date
            LEFT JOIN flags f ON b.Ticker = f.Ticker AND b.Date = f.Date""", "bars", "articles"))
def master_publish(t: Tables):
    """The master is published, read, refreshed, published as the next version and read again."""
    base = shared_dir(t.spark, "master")
    sinks.publish_master(t.bars.select("Ticker", "Date", "Close"), base)
    sinks.publish_master(master_ops.refresh_news(sinks.read_master(t.spark, base), press_features(t)), base)
    latest = sinks.read_master(t.spark, base)
    return latest.withColumns({c: F.round(c, 6) for c in ("News_Conf", "News_Norm")})


@query("category_scan", with_entities("""
SELECT Ticker, "Coin Name", Category, "Category Rank" FROM category_files""", "category_files"))
def category_scan(t: Tables):
    """Category rows written with the fixed header and read back."""
    path = shared_dir(t.spark, "categories")
    columns = ("Ticker", "Coin Name", "Category", "Category Rank")
    sinks.write_categories(universe_ops.union_categories([t.category_files.select(*columns)]), path)
    return files.read_categories(t.spark, path).select(*columns)


@query("comment_days_scan", with_entities("""
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, Text, Type, 'Merged' AS Source FROM comment_rows WHERE length(Text) > 0""",
    "comment_rows"))
def comment_days_scan(t: Tables):
    """Comments nested by day, written, read back and unnested to snippets."""
    path = shared_dir(t.spark, "days")
    rows = raw_comments(t).withColumn("file", F.lit("a")).withColumn("idx", F.col("conv_id") * 100 + F.col("turn"))
    sinks.write_json_lines(comment_ops.nest_by_day(rows.drop("conv_id", "turn")), path)
    schema = f"Ticker string, Date date, file string, block bigint, comments array<struct<idx bigint, {schemas.COMMENT}>>"
    return comment_ops.comment_snippets(comment_ops.unnest_days(t.spark.read.schema(schema).json(path)))


@query("daily_sentiment_stream", with_entities(f"""
, {verdicts_sql('comment_rows', 'conv_id, turn', social_sql('Text'))},
per_text AS (SELECT conv_id, turn, count(*) FILTER (label = 'Positive') - count(*) FILTER (label = 'Negative') AS s,
             avg(score) AS conf FROM verdicts GROUP BY conv_id, turn)
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, CAST(sum(coalesce(s, 0)) AS BIGINT) AS Sent_CumScore,
       round(avg(coalesce(conf, 0)), 6) AS Sent_Confidence, count(Text) AS Sent_TextCount,
       round(sum(coalesce(s, 0)) / count(Text), 6) AS Sent_NormScore
FROM comment_rows c LEFT JOIN per_text p ON c.conv_id = p.conv_id AND c.turn = p.turn
GROUP BY Ticker, Date""", "comment_rows"))
def daily_sentiment_stream(t: Tables):
    """The comments land as files and are read as a stream; the result is that of the batch."""
    feed, table, state = (shared_dir(t.spark, p) for p in ("landing", "daily", "state"))
    t.comment_rows.withColumn("ts", F.timestamp_seconds(day_epoch(F.col("Date")))).write.parquet(feed)
    schema = "conv_id bigint, turn bigint, Type string, Ticker string, Date date, Text string, ts timestamp"
    landed = t.spark.readStream.schema(schema).parquet(feed)
    scored = sent.score_snippets(landed, sent.lexicon_scorer(TEST_LEXICON))
    daily.publish(daily.daily_sentiment_stream(scored), table, state)
    out = daily.current(t.spark.read.parquet(table))
    return out.withColumns({c: F.round(c, 6) for c in ("Sent_Confidence", "Sent_NormScore")})


@query("master_stream", with_entities(f"""
, {SOCIAL_DAILY} SELECT b.Ticker, CAST(b.Date AS VARCHAR) AS Date, Close, CAST(cum AS BIGINT) AS Sent_CumScore,
  round(conf, 6) AS Sent_Confidence, n AS Sent_TextCount, round(cum / n, 6) AS Sent_NormScore
FROM bars b LEFT JOIN daily d ON b.Ticker = d.Ticker AND b.Date = d.Date
WHERE b.Ticker IN (SELECT Ticker FROM daily)""", "bars", "scored_snippets"))
def master_stream(t: Tables):
    """Bars and scored texts land as files and are joined as streams; a later marker in both feeds closes their days."""
    quotes, texts, table, state = (shared_dir(t.spark, p) for p in ("quotes", "texts", "master", "state"))
    stamped = F.timestamp_seconds(day_epoch(F.col("Date"))).alias("ts")
    far = F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts")
    marker = F.lit("").alias("Ticker")
    one = t.spark.range(1)
    score = polarity(F.col("Sentiment")).cast("int").alias("Score")
    t.bars.select("Ticker", F.col("Close").cast("double"), stamped).write.parquet(quotes)
    t.scored_snippets.select("Ticker", "Text", score, F.col("Confidence").cast("double"), stamped).write.parquet(texts)

    def advance() -> None:
        bars = t.spark.readStream.schema("Ticker string, Close double, ts timestamp").parquet(quotes)
        scored = t.spark.readStream.schema("Ticker string, Text string, Score int, Confidence double, ts timestamp").parquet(texts)
        daily.publish(daily.master_stream(bars, scored), table, state, mode="append")

    advance()
    one.select(marker, F.lit(0.0).alias("Close"), far).write.mode("append").parquet(quotes)
    one.select(marker, F.lit("").alias("Text"), F.lit(0).alias("Score"), F.lit(0.0).alias("Confidence"), far).write.mode("append").parquet(texts)
    advance()
    published = t.spark.read.schema(
        "Ticker string, Close double, ts timestamp, Sent_CumScore bigint, Sent_Confidence double, Sent_TextCount bigint, Sent_NormScore double"
    ).parquet(table)
    out = daily.heard(published, t.scored_snippets).withColumn("Date", epoch_date(F.unix_seconds("ts"))).drop("ts")
    return out.withColumns({c: F.round(c, 6) for c in ("Sent_Confidence", "Sent_NormScore")})
