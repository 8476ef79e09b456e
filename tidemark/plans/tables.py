"""The test tables, and the market entities derived from them.

Every entity is one SQL text that means the same in Spark and in DuckDB, so a query and its check
start from the same rows. The labels stand in for a model's output.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession



def ticker(number: str) -> str:
    """SQL for one of five tickers."""
    return (
        f"CASE {number} WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' "
        "WHEN 3 THEN 'error' ELSE 'signup' END"
    )


# One row per asset and day.
BARS = """
SELECT event_type AS Ticker, CAST(ts AS DATE) AS Date, min_by(value, event_id) AS Open,
       max(value) AS High, min(value) AS Low, max_by(value, event_id) AS Close, count(*) AS Volume
FROM {events} GROUP BY event_type, CAST(ts AS DATE)"""

# The same shape over seven years; grows with the data.
BARS_LONG = """
SELECT o_orderpriority AS Ticker, CAST(o_orderdate AS DATE) AS Date,
       min_by(o_totalprice, o_orderkey) AS Open, max(o_totalprice) AS High,
       min(o_totalprice) AS Low, max_by(o_totalprice, o_orderkey) AS Close, count(*) AS Volume
FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)"""

# Texts that carry a label and a confidence already.
SCORED_SNIPPETS = f"""
SELECT d.doc_id AS text_id, {ticker('d.doc_id % 4')} AS Ticker,
       DATE '2024-01-01' + CAST(floor(d.doc_id / 4) % 28 AS INT) AS Date, d.text AS Text,
       CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive'
            ELSE 'Neutral' END AS Sentiment,
       CAST(50 + d.doc_id % 50 AS DOUBLE) / 100 AS Confidence
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id"""

# Turn 0 opens a thread, later turns reply.
COMMENT_ROWS = f"""
SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'Main' ELSE 'Reply' END AS Type,
       {ticker('conv_id % 4')} AS Ticker,
       DATE '2024-01-01' + CAST(floor(conv_id / 4) % 28 AS INT) AS Date, text AS Text
FROM {{conversations}}"""

# The last day of the bars has no article.
ARTICLES = f"""
SELECT doc_id AS article_id, {ticker('CAST(floor(doc_id / 5) AS BIGINT) % 5')} AS Ticker,
       DATE '2024-01-01' + CAST(doc_id % 29 AS INT) AS Date, split_part(text, chr(10), 1) AS Title,
       CAST(NULL AS STRING) AS Summary, text AS Body,
       CAST(doc_id % 100 AS DOUBLE) / 100 AS p_cred
FROM {{documents}}"""

# Two of the five series come only four times a year.
MACRO_LONG = """
SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
       round(avg(o_totalprice), 4) AS value
FROM {orders}
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR month(o_orderdate) IN (1, 4, 7, 10)
GROUP BY o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE)"""

# Search results: pages of 12, two passes, empty sections, repeated URLs.
NEWS_DOCS = f"""
SELECT doc_id, {ticker('doc_id % 5')} AS Ticker,
       CASE WHEN doc_id % 5 = 0 THEN 2
            ELSE 1 + CAST(floor(doc_id / 5) AS BIGINT) % 2 END AS pass,
       CAST(floor(doc_id / 60) AS BIGINT) AS page, CAST(floor(doc_id / 5) AS BIGINT) % 12 AS pos,
       concat('http://n.example.com/', CAST(doc_id % 97 AS STRING)) AS web_url,
       CASE doc_id % 7 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Business' WHEN 2 THEN ''
            ELSE 'World' END AS section_name,
       CASE doc_id % 3 WHEN 0 THEN 'Business' ELSE 'Culture' END AS news_desk,
       concat(CAST(DATE '2024-01-01' + CAST(doc_id % 29 AS INT) AS STRING),
              CASE WHEN doc_id % 2 = 0 THEN 'T23:30:00-0500' ELSE 'T00:30:00+0000' END) AS pub_date,
       split_part(text, chr(10), 1) AS headline, text AS abstract
FROM {{documents}}"""

# 25 raters per item.
RATINGS = """
SELECT CAST(floor(doc_id / 25) AS BIGINT) AS item, doc_id % 25 AS rater, lang AS category
FROM {documents}"""

# Listing rows as they stand in a table: name with symbol, price, cap, volume, change.
LISTING_CELLS = """
SELECT p_partkey AS row_id, p_type AS category,
       concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ''
              ELSE concat(' (', upper(substr(p_name, 1, 3)), ')') END) AS c0,
       CASE WHEN p_partkey % 11 = 0 THEN 'n/a'
            ELSE concat('$', CAST(p_size AS STRING), '.5') END AS c1,
       concat('$', CAST(p_size AS STRING),
              CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'M' WHEN 2 THEN 'K' ELSE '' END) AS c2,
       CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE concat('$', CAST(p_size * 1000 AS STRING)) END AS c3,
       concat(CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '' END,
              CAST(p_size AS STRING), '.2%') AS c4
FROM {part}"""

# Coins: one per supplier, with the ids a crawl needs; every seventh post id names another coin.
UNIVERSE = """
SELECT concat('Coin ', CAST(s_suppkey AS STRING)) AS "Coin Name",
       concat('S', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '-USD' END) AS "Ticker",
       CASE s_nationkey % 4 WHEN 0 THEN 'Chain' WHEN 1 THEN 'Currency' WHEN 2 THEN 'Meme'
            ELSE 'Unheard-of' END AS "Category",
       'sp_1' AS "X-Spot-Id",
       concat('finmb$S', CAST(CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS STRING), '$CCC') AS "X-Post-Id",
       concat('sp_1_finmb$S', CAST(CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey + 1 WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1
              ELSE s_suppkey END AS STRING), '$CCC') AS "Conversation Id"
FROM {supplier}"""

# Category files: the preferred file of a ticker, and others that count only without it.
CATEGORY_FILES = """
SELECT concat('C', CAST(c_custkey % 50 AS STRING)) AS folder,
       CASE WHEN c_custkey % 50 < 30 AND c_nationkey % 2 = 0
            THEN concat('C', CAST(c_custkey % 50 AS STRING), '_categories.csv')
            ELSE concat('extra_', CAST(c_nationkey AS STRING), '.csv') END AS file,
       c_custkey AS line, concat('C', CAST(c_custkey % 50 AS STRING)) AS "Ticker",
       c_name AS "Coin Name", CASE WHEN c_nationkey = 3 THEN 'Unknown' ELSE c_mktsegment END AS "Category",
       CAST(c_nationkey AS STRING) AS "Category Rank"
FROM {customer}"""

# Forum submissions: one per order; the comment of an order is its priority text.
SUBMISSIONS = """
SELECT o_orderkey AS id, o_orderpriority AS forum, o_orderstatus AS Ticker,
       800000000 + o_orderkey * 7919 AS created,
       o_totalprice AS score, o_custkey AS customer
FROM {orders}"""

ENTITIES = {
    "bars": BARS,
    "bars_long": BARS_LONG,
    "scored_snippets": SCORED_SNIPPETS,
    "comment_rows": COMMENT_ROWS,
    "articles": ARTICLES,
    "macro_long": MACRO_LONG,
    "news_docs": NEWS_DOCS,
    "ratings": RATINGS,
    "listing_cells": LISTING_CELLS,
    "universe": UNIVERSE,
    "category_files": CATEGORY_FILES,
    "submissions": SUBMISSIONS,
}

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

class _Names(dict):
    """Lets a text name a base table in braces; in DuckDB it is just the view."""

    def __missing__(self, key: str) -> str:
        return key


def with_entities(sql: str, *names: str) -> str:
    """Check SQL with the entities it names defined in front."""
    bodies = [f"{n} AS ({ENTITIES[n].format_map(_Names())})" for n in names]
    return f"WITH {', '.join(bodies)}{',' if sql.lstrip().startswith(',') else ''} {sql.lstrip().lstrip(',')}"


class Tables:
    """The tables of one folder: ``tables.orders``, ``tables.bars`` and so on, lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @cache
    def _base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self._base(name)
        if name in ENTITIES:
            text = ENTITIES[name].replace('"', "`")
            used = {t: self._base(t) for t in BASE if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)
