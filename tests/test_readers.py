"""Readers on files as users have them: permuted columns, quotes, broken JSON."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_bars_by_header(spark, tmp_path):
    put(tmp_path / "BTC-USD", "a.csv", "Date,Open,High,Low,Close,Adj Close,Volume,Ticker\n2024-01-01,1,2,0.5,1.5,1.4,10,x\n")
    put(tmp_path / "ETH-USD", "b.csv", "﻿Ticker,Date,Close,Open\r\ny,2024-01-02,4,3\r\ny,soon,?,3\r\n")
    put(tmp_path / "NO-USD", "c.csv", "")
    rows = {(r.Ticker, str(r.Date)): r for r in files.read_bars(spark, f"{tmp_path}/*/*.csv").collect()}
    one, two, bad = rows["BTC-USD", "2024-01-01"], rows["ETH-USD", "2024-01-02"], rows["ETH-USD", "None"]
    assert len(rows) == 3
    assert (one.Open, one.High, one.Low, one.Close, one["Adj Close"], one.Volume) == (1.0, 2.0, 0.5, 1.5, 1.4, 10.0)
    assert (two.Open, two.Close, two.High, two.Volume) == (3.0, 4.0, None, None)
    assert (bad.Open, bad.Close) == (3.0, None)


def test_header_names(value):
    for line, names in [("a,b", ["a", "b"]), (",a,,", ["", "a", "", ""]), ('"a,b","c ""d""",e', ["a,b", 'c "d"', "e"]), ("", [""]), ('"",x', ["", "x"])]:
        assert value(files.header_names(F.lit(line))) == names


def test_files_are_read_once_whatever_their_headers(spark, tmp_path):
    """Many layouts, an index column without a name and a repeated name; one scan for the headers and one for the rows."""
    for i in range(12):
        extra = "".join(f",x{j}" for j in range(i))
        put(tmp_path / f"T{i}-USD", "a.csv", f",Close,Date{extra},Close\n0,{i}.5,2024-01-01{',' * i},9\n")
    rows = files.read_bars(spark, f"{tmp_path}/*/*.csv")
    assert {r.Ticker: r.Close for r in rows.collect()} == {f"T{i}-USD": i + 0.5 for i in range(12)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert files.csv_by_header(spark, f"{tmp_path}/*/*.csv")[1][:3] == ["", "Close", "Date"]


def test_universe_by_header(spark, tmp_path):
    put(tmp_path, "u.csv", "Ticker,Coin Name,X-Spot-Id\nBTC,Bitcoin,s1\n")
    row = files.read_universe(spark, str(tmp_path)).first()
    assert (row.Ticker, row["Coin Name"], row["X-Spot-Id"], row.Category) == ("BTC", "Bitcoin", "s1", None)


def test_categories_with_quotes_and_line_breaks(spark, tmp_path):
    put(tmp_path / "BTC", "BTC_categories.csv", 'Category,Ticker,Coin Name,Description\nchain,BTC,Bitcoin,"He said ""hi"", then\nleft"\n')
    put(tmp_path / "BTC", "other.csv", "Ticker,Category\nBTC,not preferred\n")
    put(tmp_path / "ETH", "x.csv", "Ticker,Category\nETH,chain\n")
    rows = {r.Ticker: r for r in files.read_categories(spark, f"{tmp_path}/*/*.csv").collect()}
    assert set(rows) == {"BTC", "ETH"}
    assert rows["BTC"].Description == 'He said "hi", then\nleft' and rows["BTC"].Category == "chain" and rows["BTC"]["Coin Name"] == "Bitcoin"
    assert rows["ETH"].Category == "chain" and rows["ETH"].Description is None
    put(tmp_path / "ETH", "y.csv", "Ticker,Colour\nETH,red\n")
    with pytest.raises(ValueError, match="Colour"):
        files.read_categories(spark, f"{tmp_path}/*/*.csv")


def test_truncated_comments_are_told(spark, tmp_path):
    whole = json.dumps([{"time": "1", "content": [{"text": f"t{i}"}], "replies": []} for i in range(2500)])
    put(tmp_path / "BTC", "a_comments.json", whole)
    put(tmp_path / "BTC", "b_comments.json", whole[: len(whole) - 30])
    put(tmp_path / "ETH", "c_comments.json", '{"not": "a list"}')
    put(tmp_path / "ETH", "d_comments.json", '[{"time": "2"}, 7, {"best_score": "x y"}, {"time": "3"}] ')
    put(tmp_path / "ETH", "e_comments.json", "[]")
    put(tmp_path / "ETH", "f_merge_comments.json", "[")
    good = files.read_comments(spark, f"{tmp_path}/*").groupBy("file").count().collect()
    bad = files.unreadable_comments(spark, f"{tmp_path}/*").select("file", "idx", "error").collect()
    assert {r.file: r["count"] for r in good} == {"a_comments.json": 2500, "b_comments.json": 2499, "d_comments.json": 2}
    assert sorted((r.file, r.idx) for r in bad) == sorted([("b_comments.json", 2499), ("c_comments.json", None), ("d_comments.json", 1), ("d_comments.json", 2)], key=str)
    assert all(r.error for r in bad)


def test_days_with_either_name(spark, tmp_path):
    days = [{"Date": "2024-01-01", "comments": [{"text": "a"}]}, {"date": "2024-01-02", "comments": []}, {"date": "soon", "comments": []}, {"Date": "2024-01-03"}]
    put(tmp_path / "BTC", "x_merge_comments.json", json.dumps(days))
    good = files.read_comment_days(spark, f"{tmp_path}/*").collect()
    assert sorted((str(r.Date), len(r.comments)) for r in good) == [("2024-01-01", 1), ("2024-01-02", 0)]
    bad = files.unreadable_days(spark, f"{tmp_path}/*").collect()
    assert sorted((r.idx, r.error) for r in bad) == [(2, "no day"), (3, "no comments")]


def test_articles_and_their_rest(spark, tmp_path):
    put(tmp_path, "BTC_news.json", json.dumps([{"Date": "2024-01-01", "Title": "T"}, "text"]))
    put(tmp_path, "ETH_news.json", '{"count": 2, "articles": [{"date": "2024-01-02", "headline": "H"}, {"date"')
    good = files.read_articles(spark, str(tmp_path)).select("Ticker", "Title").collect()
    assert sorted(map(tuple, good)) == [("BTC", "T"), ("ETH", "H")]
    bad = files.unreadable_articles(spark, str(tmp_path)).select("Ticker", "idx").collect()
    assert sorted(map(tuple, bad)) == [("BTC", 1), ("ETH", 1)]
