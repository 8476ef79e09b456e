import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines, master, news, sentiment

VERDICTS = "array<struct<label: string, score: double>>"


def scores(*pairs):
    return F.array(*(F.struct(F.lit(l).alias("label"), F.lit(s).alias("score")) for l, s in pairs)).cast(VERDICTS)


@pytest.mark.parametrize(
    "pairs, label, balance",
    [
        ([("Positive", 0.9), ("Negative", 0.9)], "Positive", 0),
        ([("Neutral", 0.9), ("Negative", 0.9)], "Neutral", -1),
        ([("Negative", 0.9)], "Negative", -1),
        ([], "Positive", 0),
    ],
)
def test_majority(value, pairs, label, balance):
    assert value(sentiment.majority_label(scores(*pairs))) == label
    assert value(sentiment.vote_balance(scores(*pairs))) == balance


def test_confidences(value):
    three = scores(*[("Neutral", 0.9)] * 3)
    assert value(sentiment.opinion_confidence(three)) == pytest.approx(2.7)
    assert value(sentiment.mean_confidence(three)) == pytest.approx(0.9)
    assert value(sentiment.mean_confidence(scores())) == 0.0


def test_empty_text_is_kept(spark):
    texts = spark.createDataFrame([("a", "!!!"), ("b", None), ("c", "Good good bad")], "id string, Text string")
    out = sentiment.score_snippets(texts, sentiment.lexicon_scorer({"good": 1.0, "bad": -1.0}))
    got = {r.id: (r.Sentiment, r.Score, r.Confidence) for r in out.collect()}
    assert got["a"] == got["b"] == ("Positive", 0, 0.0)
    assert got["c"] == ("Positive", 1, pytest.approx(2 / 3))


def test_model_gets_whole_batches(spark):
    def load():
        return lambda texts: [("Negative" if "loss" in t else "Positive", float(len(texts) > 0)) for t in texts]

    texts = spark.createDataFrame([(1, "big loss"), (2, "fine"), (3, "")], "id int, Text string")
    out = sentiment.score_snippets(texts, sentiment.model_scorer(load))
    assert {r.id: r.Score for r in out.collect()} == {1: -1, 2: 1, 3: 0}


@pytest.mark.parametrize("n, chunks", [(0, 0), (462, 1), (463, 2), (925, 3)])
def test_model_sees_the_same_chunks(spark, n, chunks):
    text = " ".join(f"w{i}" for i in range(n))
    frame = spark.createDataFrame([(text,)], "t string")
    count = sentiment.model_scorer(lambda: lambda texts: [(t.split()[0], float(len(t.split()))) for t in texts])
    (row,) = frame.select(count(F.col("t")).alias("s")).collect()
    assert [(s.label, s.score) for s in row.s] == [(f"w{i * 462}", min(512, n - i * 462)) for i in range(chunks)]


def test_model_may_bring_its_tokeniser(spark):
    frame = spark.createDataFrame([("abcde",)], "t string")
    letters = sentiment.model_scorer(
        lambda: lambda texts: [(t, 1.0) for t in texts], length=3, overlap=1, cut=list, glue="".join
    )
    (row,) = frame.select(letters(F.col("t")).alias("s")).collect()
    assert [s.label for s in row.s] == ["abc", "cde", "e"]


def test_daily_drops_undated_and_adds_up(spark):
    rows = [("T", "2024-01-01", 1, 0.5, "x"), ("T", "2024-01-01", -1, 0.7, "y"), ("T", None, 1, 0.9, "z")]
    scored = spark.createDataFrame(rows, "Ticker string, Date string, Score int, Confidence double, Text string")
    (row,) = sentiment.daily_sentiment(scored).collect()
    assert (row.Sent_CumScore, row.Sent_TextCount, row.Sent_NormScore) == (0, 2, 0.0)
    assert row.Sent_Confidence == pytest.approx(0.6)


def bars(spark):
    return spark.createDataFrame(
        [("A", "d1", 1.0), ("A", "d2", 2.0), ("B", "d1", 3.0)], "Ticker string, Date string, Close double"
    )


def test_master_keeps_bars_of_heard_tickers(spark):
    daily = spark.createDataFrame([("A", "d1", 5)], "Ticker string, Date string, Sent_CumScore int")
    got = {(r.Ticker, r.Date): r.Sent_CumScore for r in master.master_with_sentiment(bars(spark), daily).collect()}
    assert got == {("A", "d1"): 5, ("A", "d2"): None}


def test_refresh_twice_is_once(spark):
    fresh = spark.createDataFrame(
        [("A", "d1", 2.0, 1, 0.5, 2.0)],
        "Ticker string, Date string, News_Score double, News_Cnt bigint, News_Conf double, News_Norm double",
    )
    flags = spark.createDataFrame([("A", "d2", 1)], "Ticker string, Date string, Event_Flag int")
    stale = bars(spark).withColumn("News_Score", F.lit(9.0)).withColumn("FwdRet_7d", F.lit(1.0))
    once = master.refresh_news(stale, fresh, flags)
    twice = master.refresh_news(once, fresh, flags)
    assert sorted(once.columns) == sorted(twice.columns) and "FwdRet_7d" not in once.columns
    rows = lambda f: sorted(map(tuple, f.select(sorted(f.columns)).collect()))
    assert rows(once) == rows(twice)
    assert {(r.Ticker, r.Date): (r.News_Score, r.Event_Flag) for r in once.collect()} == {
        ("A", "d1"): (2.0, 0), ("A", "d2"): (0.0, 1), ("B", "d1"): (0.0, 0),
    }


def test_refresh_without_news_gives_zeros(spark):
    none = spark.createDataFrame(
        [], "Ticker string, Date string, News_Score double, News_Cnt bigint, News_Conf double, News_Norm double"
    )
    flags = spark.createDataFrame([], "Ticker string, Date string, Event_Flag int")
    stale = bars(spark).withColumn("News_Score", F.lit(9.0))
    assert {r.News_Score for r in master.refresh_news(stale, none, flags).collect()} == {0.0}


def test_one_pass_gives_the_same_days(spark):
    rows = [("A", "d1", "hack", None, "good bad good"), ("A", "d1", "x", "y", "bad"), ("A", "d2", None, None, "Ban"), ("A", None, "a", "b", "c")]
    articles = spark.createDataFrame(rows, "Ticker string, Date string, Title string, Summary string, Body string")
    scorer = sentiment.lexicon_scorer({"good": 1.0, "bad": -1.0})
    apart = news.daily_news(news.score_articles(articles, scorer)).join(news.daily_events(articles), ["Ticker", "Date"])
    together = news.daily_features(articles, scorer)
    columns = sorted(apart.columns)
    read = lambda f: sorted(map(tuple, f.select(columns).collect()))
    assert read(apart) == read(together) and {r.Event_Flag for r in together.collect()} == {1}


def test_undated_rows_are_counted(spark):
    raw = spark.createDataFrame([("2024-01-01",), ("",), (None,), ("soon",)], "Date string")
    assert tuple(news.undated(raw).first()) == (2, 1)


def hit(ticker, pass_, page, pos, url, section, desk="x"):
    return (ticker, pass_, page, pos, url, section, desk)


HITS = "Ticker string, pass int, page int, pos int, web_url string, section_name string, news_desk string"


def test_url_is_used_up_by_a_rejected_section(spark):
    docs = spark.createDataFrame(
        [
            hit("A", 1, 0, 0, "u1", "World"), hit("A", 1, 0, 1, "u1", "Business"), hit("A", 1, 1, 0, "u2", "", "Business"),
            hit("A", 1, 1, 10, "u3", "Business"), hit("A", 1, 2, 0, "u3", "Technology"), hit("A", 1, 2, 1, "", "Business"),
            hit("B", 1, 0, 0, "u1", "Business"),
        ],
        HITS,
    )
    got = {(r.Ticker, r.web_url, r.section) for r in news.dedupe_articles(docs).collect()}
    assert got == {("A", "u2", "Business"), ("A", "u3", "Technology"), ("B", "u1", "Business")}


def test_second_pass_counts_only_without_the_first(spark):
    docs = spark.createDataFrame(
        [hit("A", 1, 0, 0, "u", ""), hit("A", 2, 0, 0, "v", ""), hit("B", 2, 0, 0, "w", "")], HITS
    )
    assert {r.web_url for r in news.first_pass_with_hits(docs).collect()} == {"u", "w"}


def test_tfidf_against_brute_force(spark):
    import math
    from collections import Counter

    docs = {1: "a a b", 2: "a c", 3: "a b d d", 4: ""}
    frame = spark.createDataFrame(list(docs.items()), "id int, t string")
    df = Counter(w for t in docs.values() for w in set(t.split()))
    want = {
        (i, w): n * math.log((len(docs) + 1) / (df[w] + 1)) for i, t in docs.items() for w, n in Counter(t.split()).items()
    }
    for common in (1, 3, 10_000):  # all terms rare, some common, all common
        got = {(r.id, r.term): r.tfidf for r in baselines.tfidf(frame, "id", "t", common).collect()}
        assert got == pytest.approx(want)
