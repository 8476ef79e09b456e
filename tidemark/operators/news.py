"""News: search pages, articles, daily scores and event flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import lenient_day, offset_day
from tidemark.functions.numbers import ratio
from tidemark.functions.text import EVENT_KEYWORDS, article_text, clean_news, event_flag, event_hits
from tidemark.operators.common import keep_first, only_best
from tidemark.operators.sentiment import Scorer, mean_confidence, opinion_confidence, vote_balance

# Fixed values.
SECTIONS = ("Technology", "Business")
ARTICLES_PER_PAGE = 10


def news_section(section: Column, desk: Column) -> Column:
    """The section, or the desk where the section is missing or empty."""
    return F.coalesce(F.nullif(section, F.lit("")), desk, F.lit(""))


def search_docs(pages: DataFrame, docs: str = "docs") -> DataFrame:
    """One row per search hit with its position on the page."""
    keep = [c for c in pages.columns if c != docs]
    return pages.select(*keep, F.posexplode(docs).alias("pos", "doc")).select(*keep, "pos", "doc.*")


def news_urls(docs: DataFrame) -> DataFrame:
    """Search hits as the flat URL table; missing fields are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(
        "Ticker",
        offset_day(F.col("pub_date")).alias("Date"),
        text("web_url").alias("URL"),
        text("headline.main").alias("News Title"),
        text("abstract").alias("News Abstract"),
        text("snippet").alias("News Content"),
    )


def first_pass_with_hits(docs: DataFrame) -> DataFrame:
    """Hits of the second, unfiltered pass count only for tickers without any in the first."""
    return only_best(docs, ["Ticker"], F.col("pass"))


def dedupe_articles(
    docs: DataFrame, sections: Iterable[str] = SECTIONS, per_page: int = ARTICLES_PER_PAGE
) -> DataFrame:
    """First sighting of every URL, if it is in a wanted section.

    The page cut comes first and the section test last: a URL first seen in another section is
    used up, also for later sightings in a wanted one.
    """
    usable = docs.where((F.col("pos") < per_page) & (F.coalesce("web_url", F.lit("")) != ""))
    first = keep_first(usable, ["Ticker", "web_url"], ["pass", "page", "pos"])
    section = news_section(F.col("section_name"), F.col("news_desk"))
    return first.withColumn("section", section).where(F.col("section").isin(*sections))


def unify_articles(raw: DataFrame) -> DataFrame:
    """Ticker, Date, Title, Summary, Body from either article layout; an undated row keeps a NULL date."""
    have = set(raw.columns)

    def first_of(*names: str) -> Column:
        found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return raw.select(
        "Ticker",
        lenient_day(first_of("Date", "date", "published_date")).alias("Date"),
        first_of("Title", "headline").alias("Title"),
        first_of("Summary", "abstract").alias("Summary"),
        first_of("Body", "body").alias("Body"),
    )


def undated(raw: DataFrame, column: str = "Date") -> DataFrame:
    """How many rows carry no date, and how many one that no known layout fits; for the job's report."""
    text = F.nullif(F.trim(column), F.lit(""))
    return raw.agg(
        F.count_if(text.isNull()).alias("missing"),
        F.count_if(text.isNotNull() & lenient_day(text).isNull()).alias("unreadable"),
    )


def full_text(articles: DataFrame) -> DataFrame:
    return articles.withColumn("Text", article_text(F.col("Title"), F.col("Summary"), F.col("Body")))


def score_articles(articles: DataFrame, scorer: Scorer, confidence: str = "per_opinion") -> DataFrame:
    """News_Score and News_Conf of every article.

    ``per_opinion`` divides the summed confidence by the non-neutral chunks only; ``mean`` by all.
    """
    measure = {"per_opinion": opinion_confidence, "mean": mean_confidence}[confidence]
    scored = full_text(articles).withColumn("_scores", scorer(clean_news(F.col("Text"))))
    scores = F.col("_scores")
    return scored.select(
        *articles.columns,
        vote_balance(scores).cast("double").alias("News_Score"),
        measure(scores).alias("News_Conf"),
    )


def daily_features(
    articles: DataFrame, scorer: Scorer, words: Iterable[str] = EVENT_KEYWORDS, confidence: str = "per_opinion"
) -> DataFrame:
    """News columns and event flag of every ticker and day, out of one pass over the articles."""
    flag = event_flag(article_text(F.col("Title"), F.col("Summary"), F.col("Body")), words)
    scored = score_articles(articles.withColumn("Event_Flag", flag), scorer, confidence)
    return _daily(scored, F.max("Event_Flag").alias("Event_Flag"))


def daily_news(scored: DataFrame) -> DataFrame:
    """Per ticker and day: summed score, articles, mean confidence and score per article."""
    return _daily(scored)


def _daily(scored: DataFrame, *more: Column) -> DataFrame:
    daily = (
        scored.where(F.col("Date").isNotNull())
        .groupBy("Ticker", "Date")
        .agg(
            F.sum("News_Score").alias("News_Score"),
            F.count("News_Score").alias("News_Cnt"),
            F.avg("News_Conf").alias("News_Conf"),
            *more,
        )
    )
    return daily.withColumn("News_Norm", ratio(F.col("News_Score"), F.col("News_Cnt")))


def daily_events(articles: DataFrame, words: Iterable[str] = EVENT_KEYWORDS) -> DataFrame:
    """1 on days with any article that holds an event keyword."""
    flagged = full_text(articles).select("Ticker", "Date", event_flag(F.col("Text"), words).alias("f"))
    return (
        flagged.where(F.col("Date").isNotNull())
        .groupBy("Ticker", "Date")
        .agg(F.max("f").alias("Event_Flag"))
    )


def keyword_counts(articles: DataFrame, words: Iterable[str] = EVENT_KEYWORDS) -> DataFrame:
    """Articles per ticker and event keyword."""
    return (
        full_text(articles)
        .select("Ticker", F.explode(event_hits(F.col("Text"), words)).alias("keyword"))
        .groupBy("Ticker", "keyword")
        .agg(F.count("*").alias("articles"))
    )


def credible(articles: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Articles whose credibility is known and not below the threshold."""
    return articles.where(F.col("p_cred") >= threshold)
