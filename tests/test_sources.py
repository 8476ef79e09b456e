import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import universe
from tidemark.operators.comments import comment_snippets, merge_comments, project_comment, unnest_days
from tidemark.schemas import CATEGORY_COLUMNS
from tidemark.sources import files, sinks


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")


def test_comment_files(spark, tmp_path):
    put(tmp_path / "BTC-USD" / "BTC-USD_comments.json", [
        {"time": "2024-01-01", "content": [{"text": "a"}], "replies": [{"text": "r"}, "plain"], "additional_data": {"x": 1}},
        {"time": "2024-01-01", "content": [{"text": "b"}]},
    ])
    put(tmp_path / "BTC-USD" / "BTC-USD_reddit_comments.json", [{"time": "2024-01-01", "content": [{"text": "b"}]}])
    put(tmp_path / "BTC-USD" / "BTC-USD_merge_comments.json", [{"Date": "2024-01-01", "comments": []}])
    put(tmp_path / "ETH-USD" / "ETH-USD_comments.json", [])
    rows = files.read_comments(spark, f"{tmp_path}/*")
    got = {(r.Ticker, r.file, r.idx, r.content[0].text) for r in rows.collect()}
    assert got == {
        ("BTC-USD", "BTC-USD_comments.json", 0, "a"), ("BTC-USD", "BTC-USD_comments.json", 1, "b"),
        ("BTC-USD", "BTC-USD_reddit_comments.json", 0, "b"),
    }
    merged = merge_comments([rows])
    assert merged.count() == 2
    texts = {(r.Type, r.Text) for r in comment_snippets(merged).collect()}
    assert texts == {("Main", "a"), ("Main", "b"), ("Reply", "r"), ("Reply", "plain")}


def test_raw_crawl_files(spark, tmp_path):
    put(tmp_path / "T" / "T_comments.json", [{"time": 86400, "written_at": 86400, "content": [{"text": "<p>x</p>"}], "rank": {"ranks_up": 2}}])
    row = project_comment(files.read_comments(spark, f"{tmp_path}/*", raw=True)).first()
    assert (row.time, row.content[0].text, row.rank.ranks_up, row.rank.ranks_down) == ("1970-01-02", "x", 2, 0)


def test_day_nested_files(spark, tmp_path):
    put(tmp_path / "T" / "T_merge_comments.json", [
        {"Date": "2024-01-02", "comments": [{"content": [{"text": "a"}], "replies": [{"content": [{"text": "r"}]}]}]},
    ])
    days = files.read_comment_days(spark, f"{tmp_path}/*")
    rows = comment_snippets(unnest_days(days))
    assert {(r.Ticker, r.Date.isoformat(), r.Text) for r in rows.collect()} == {("T", "2024-01-02", "a"), ("T", "2024-01-02", "r")}


def test_article_files_in_both_shapes(spark, tmp_path):
    put(tmp_path / "A_news.json", {"articles": [{"Date": "2024-01-01T05:00:00Z", "Title": "t", "Body": ["x", {"k": "y"}]}]})
    put(tmp_path / "B_news.json", [{"date": "", "published_date": "2024-01-02", "headline": "h", "abstract": "s", "body": "b"}])
    put(tmp_path / "C_news.json", [])
    got = {tuple(r) for r in files.read_articles(spark, str(tmp_path)).withColumn("Date", F.col("Date").cast("string")).collect()}
    assert got == {("A", "2024-01-01", "t", None, "x y"), ("B", "2024-01-02", "h", "s", "b")}


def test_bars_take_the_ticker_from_the_folder(spark, tmp_path):
    put(tmp_path / "BTC-USD" / "BTC-USD.csv", "Date,Ticker,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,wrong,1,2,0.5,1.5,1.5,10\n")
    row = files.read_bars(spark, f"{tmp_path}/*/*.csv").first()
    assert (row.Ticker, row.Date.isoformat(), row["Adj Close"]) == ("BTC-USD", "2024-01-01", 1.5)


def test_universe_with_and_without_category(spark, tmp_path):
    put(tmp_path / "a.csv", "Coin Name,Ticker,Category,X-Spot-Id,X-Post-Id,Conversation Id\nBitcoin,BTC-USD,Currency,s,finmb$BTC$CCC,s_finmb$BTC$CCC\n")
    put(tmp_path / "b.csv", "Coin Name,Ticker,X-Spot-Id,X-Post-Id,Conversation Id\nBitcoin,BTC-USD,s,finmb$BTC$CCC,s_finmb$ETH$CCC\n")
    assert universe.audit_universe(files.read_universe(spark, f"{tmp_path}/a.csv")).count() == 0
    (bad,) = universe.audit_universe(files.read_universe(spark, f"{tmp_path}/b.csv", with_category=False)).collect()
    assert (bad.bad_conversation, bad.bad_post) == (1, 0)


def test_preferred_category_file(spark, tmp_path):
    head = ",".join(CATEGORY_COLUMNS)
    put(tmp_path / "A" / "A_categories.csv", f"{head}\nA,a,,Meme,1,,\n")
    put(tmp_path / "A" / "old.csv", f"{head}\nA,a,,Old,1,,\n")
    put(tmp_path / "B" / "x.csv", f"{head}\nB,b,,Chain,1,,\n")
    put(tmp_path / "B" / "y.csv", f"{head}\nB,b,,Unknown,1,,\n")
    rows = files.read_categories(spark, f"{tmp_path}/*/*.csv")
    assert {(r.Ticker, r.Category) for r in rows.collect()} == {("A", "Meme"), ("B", "Chain"), ("B", "Unknown")}
    filled = universe.union_categories([rows])
    assert tuple(universe.category_summary(filled).first()) == (3, 2, 2)
    assert filled.columns == list(CATEGORY_COLUMNS) and {r.Description for r in filled.collect()} == {""}


def test_unexpected_category_column_is_an_error(spark):
    with pytest.raises(ValueError, match="Extra"):
        universe.union_categories([spark.sql("SELECT 'A' AS Ticker, 1 AS Extra")])


def test_missing_bar_column_is_an_error(spark):
    from tidemark.operators.bars import canonical_bars

    with pytest.raises(ValueError, match="Adj Close"):
        canonical_bars(spark.sql("SELECT 1 AS Date, 1 AS Open, 1 AS High, 1 AS Low, 1 AS Close, 1 AS Volume"), "T")


def test_macro_csv_has_four_decimals(spark, tmp_path):
    sinks.write_macro(spark.sql("SELECT '06-01-2025' AS Date, 1.5D AS a, CAST(NULL AS DOUBLE) AS b"), f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ["Date,a,b", "06-01-2025,1.5000,"]


def test_news_urls_and_records(spark, tmp_path):
    urls = spark.sql("SELECT 'c' AS `News Content`, 'u' AS URL, 'd' AS Date, 't' AS `News Title`, 'a' AS `News Abstract`, 1 AS extra")
    sinks.write_news_urls(urls, f"{tmp_path}/u")
    assert [r.value for r in spark.read.text(f"{tmp_path}/u").collect()][1] == "d,u,t,a,c"
    sinks.write_records(spark.sql("SELECT map('Holder', 'x', 'Shares', '1') AS record"), f"{tmp_path}/r")
    assert json.loads(spark.read.text(f"{tmp_path}/r").first().value) == {"Holder": "x", "Shares": "1"}


def test_master_versions(spark, tmp_path):
    base = f"{tmp_path}/master"
    with pytest.raises(FileNotFoundError):
        sinks.read_master(spark, base)
    one = spark.sql("SELECT 'A' AS Ticker, DATE'2024-01-01' AS Date, 1 AS x")
    sinks.publish_master(one, base)
    (tmp_path / "master" / "v2").mkdir()  # a version that was never finished
    assert sinks.read_master(spark, base).first().x == 1
    sinks.publish_master(sinks.read_master(spark, base).withColumn("x", F.col("x") + 1), base)
    assert sinks.read_master(spark, base).first().x == 2


def test_reading_one_ticker_reads_one_folder(spark, tmp_path):
    frame = spark.range(10).select(F.concat(F.lit("T"), F.col("id") % 3).alias("Ticker"), F.current_date().alias("Date"), "id")
    sinks.write_by_ticker(frame, f"{tmp_path}/p")
    plan = spark.read.parquet(f"{tmp_path}/p").where("Ticker = 'T1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Ticker" in plan
