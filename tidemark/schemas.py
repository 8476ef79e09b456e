"""Schemas of the feeds and tables. Nothing is inferred."""

from __future__ import annotations

# Column names and their order.
BAR_COLUMNS = ("Date", "Ticker", "Open", "High", "Low", "Close", "Adj Close", "Volume")
CATEGORY_COLUMNS = (
    "Ticker", "Coin Name", "CoinGecko ID", "Category", "Category Rank", "Description", "All Categories",
)
NEWS_URL_COLUMNS = ("Date", "URL", "News Title", "News Abstract", "News Content")
NEWS_FEATURES = ("News_Score", "News_Cnt", "News_Conf", "News_Norm", "Event_Flag")
SCREENER_COLUMNS = (
    "Symbol", "Name", "Price", "Change", "% Change", "Volume", "Avg Vol (3M)", "Market Cap",
    "PE Ratio", "52 Week Range",
)

UNIVERSE = (
    "`Coin Name` string, Ticker string, Category string, `X-Spot-Id` string, "
    "`X-Post-Id` string, `Conversation Id` string"
)
UNIVERSE_PLAIN = (
    "`Coin Name` string, Ticker string, `X-Spot-Id` string, `X-Post-Id` string, "
    "`Conversation Id` string"
)
BARS = (
    "Date date, Ticker string, Open double, High double, Low double, Close double, "
    "`Adj Close` double, Volume double"
)
CATEGORIES = ", ".join(f"`{c}` string" for c in CATEGORY_COLUMNS)

# A reply is an object or a plain string, so replies arrive as raw JSON text.
COMMENT = (
    "time string, Date string, source string, replies_count bigint, "
    "rank struct<ranks_up: bigint, ranks_down: bigint, ranked_by_current_user: bigint>, "
    "replies array<string>, content array<struct<text: string>>, text string, best_score bigint, "
    "total_replies_count bigint, user_reputation bigint, additional_data string"
)
RAW_COMMENT = COMMENT.replace("time string", "time bigint, written_at bigint", 1)
REPLY = "content array<struct<text: string>>, text string, _corrupt_record string"

SEARCH_PAGE = (
    "response struct<docs: array<struct<web_url: string, pub_date: string, section_name: string, "
    "news_desk: string, headline: struct<main: string>, abstract: string, snippet: string>>>"
)
OBSERVATIONS = "observations array<struct<date: string, value: string>>"
