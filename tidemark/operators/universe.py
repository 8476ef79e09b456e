"""The universe of assets: symbols, categories, audits and routing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.listing import plain_symbol
from tidemark.operators.common import mark_known
from tidemark.schemas import CATEGORY_COLUMNS

# The categories that are listed.
LISTED_CATEGORIES = (
    "currency", "chain", "stablecoin", "meme", "defi", "cefi", "blockchain-infrastructure",
    "blockchain-service", "gamefi", "nft", "social",
)


def audit_universe(universe: DataFrame) -> DataFrame:
    """Assets whose ids contradict each other or are missing, with what is wrong (1) or right (0)."""
    missing = F.col("X-Spot-Id").isNull() | F.col("X-Post-Id").isNull()
    joined = F.concat_ws("_", "X-Spot-Id", "X-Post-Id")
    post_symbol = F.regexp_extract("X-Post-Id", r"\$(.*)\$", 1)
    checked = universe.select(
        "Ticker",
        post_symbol.alias("post_symbol"),
        (missing | ~joined.eqNullSafe(F.col("Conversation Id"))).cast("int").alias("bad_conversation"),
        (~post_symbol.eqNullSafe(plain_symbol(F.col("Ticker")))).cast("int").alias("bad_post"),
    )
    return checked.where((F.col("bad_conversation") == 1) | (F.col("bad_post") == 1))


def union_categories(tables: Sequence[DataFrame]) -> DataFrame:
    """Category tables with the fixed columns; a missing one is empty, an unknown one is an error."""
    extra = sorted({c for t in tables for c in t.columns} - set(CATEGORY_COLUMNS))
    if extra:
        raise ValueError(f"categories: unexpected columns {extra}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    text = lambda c: (F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")).alias(c)
    return rows.select(*map(text, CATEGORY_COLUMNS))


def category_summary(categories: DataFrame) -> DataFrame:
    known = F.when(F.col("Category") != "Unknown", F.col("Category"))
    return categories.agg(
        F.count("*").alias("rows"),
        F.countDistinct("Ticker").alias("tickers"),
        F.countDistinct(known).alias("categories"),
    )


def is_listed(category: Column, listed: Iterable[str] = LISTED_CATEGORIES) -> Column:
    return F.lower(category).isin(*listed)


def split_categories(frame: DataFrame, column: str = "Category") -> tuple[DataFrame, DataFrame]:
    """Rows of listed categories, and the unlisted category names with their number of rows."""
    listed = F.coalesce(is_listed(F.col(column)), F.lit(False))
    return frame.where(listed), frame.where(~listed).groupBy(column).agg(F.count("*").alias("rows"))


def found_and_failed(universe: DataFrame, found: DataFrame) -> DataFrame:
    """Every asset with status ``found`` or ``failed``."""
    return mark_known(universe, found, "Ticker", "found", "failed")


def route_feeds(feeds: DataFrame, known: DataFrame) -> DataFrame:
    """Feed rows of known tickers as ``routed``, the others as ``unknown``."""
    return mark_known(feeds, known, "Ticker", "routed", "unknown")


def completeness(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in total, and those with a non-empty string, per column; one pass."""
    filled = (F.count_if(F.col(f"`{c}`") != "").alias(f"with_{c}") for c in columns)
    return frame.agg(F.count("*").alias("total"), *filled)


def frame_profile(frame: DataFrame) -> DataFrame:
    """Row count, width and non-NULL count of every column; one pass."""
    counts = (F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in frame.columns)
    return frame.agg(F.count("*").alias("rows"), F.lit(len(frame.columns)).alias("width"), *counts)


def preview(frame: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by key, as a report shows them."""
    return frame.orderBy(*keys).limit(n)
