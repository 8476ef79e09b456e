"""Macro series, universe, categories and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import listing
from tidemark.operators import macro as macro_ops
from tidemark.operators import pages as page_ops
from tidemark.operators import profile, scan
from tidemark.operators import universe as universe_ops
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables, with_entities
from tidemark.schemas import SCREENER_COLUMNS
from tidemark.session import spread, spread_evenly
from tidemark.sources import files

# The test series under published names, so that every rounding rule occurs.
TEST_SERIES = {
    "Non_Farm_Payrolls": "1-URGENT",
    "Current_Account": "2-HIGH",
    "Interest_Rate": "3-MEDIUM",
    "Consumer_Confidence": "4-NOT SPECIFIED",
    "Retail_Sales_MoM": "5-LOW",
}

# -- macro ------------------------------------------------------------------------------------


@query("macro_long", with_entities(
    "SELECT series_id, CAST(date AS VARCHAR) AS date, value FROM macro_long", "macro_long"))
def macro_long(t: Tables):
    """Landed responses with one usable and one missing observation each."""
    day = F.date_format("date", "yyyy-MM-dd")
    entry = lambda value: F.struct(day.alias("date"), value.alias("value"))
    response = F.to_json(F.struct(F.array(entry(F.col("value").cast("string")), entry(F.lit("."))).alias("observations")))
    landed = t.macro_long.select("series_id", response.alias("json"))
    return macro_ops.usable_observations(files.parse_observations(landed, "json"))


_WIDE = ", ".join(f"max(value) FILTER (series_id = '{i}') AS {n}" for n, i in TEST_SERIES.items())
MACRO_FILLED = f"""
wide AS (SELECT date, {_WIDE} FROM macro_long GROUP BY date),
filled AS (SELECT date, {', '.join(f'last_value({n} IGNORE NULLS) OVER w AS {n}' for n in TEST_SERIES)}
  FROM wide WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_ROUNDED = ", ".join(
    f"round_even({n}, {macro_ops.DIGITS.get(n, macro_ops.DEFAULT_DIGITS)}) AS {n}" for n in TEST_SERIES
)


@query("macro_wide", with_entities(f"""
, wide AS (SELECT date, {_WIDE} FROM macro_long GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, {', '.join(TEST_SERIES)} FROM wide""", "macro_long"))
def macro_wide(t: Tables):
    return macro_ops.widen(t.macro_long, TEST_SERIES)


@query("macro_ffill", with_entities(f"""
, {MACRO_FILLED} SELECT strftime(date, '%m/%d/%Y') AS Date, {_ROUNDED} FROM filled""", "macro_long"))
def macro_ffill(t: Tables):
    return macro_ops.monthly_table(t.macro_long, TEST_SERIES)


@query("carried_fill", with_entities("""
, spine AS (SELECT date, series_id FROM (SELECT DISTINCT date FROM macro_long), (SELECT DISTINCT series_id FROM macro_long))
SELECT s.series_id, CAST(s.date AS VARCHAR) AS date, last_value(value IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY s.date) AS value
FROM spine s LEFT JOIN macro_long m ON m.series_id = s.series_id AND m.date = s.date""", "macro_long"))
def carried_fill(t: Tables):
    """Every series on every date, filled by a scan over ranges of the dates."""
    ids = list(TEST_SERIES.values())
    spine = t.macro_long.select("date").distinct().withColumn("series_id", F.explode(F.array(*map(F.lit, ids))))
    gaps = spine.join(t.macro_long, ["series_id", "date"], "left")
    return scan.carried_fill(gaps, ["series_id"], "date", ["value"], ranges=12).select("series_id", "date", "value")


@query("sketch_profile", """
SELECT c AS column, count(*) AS rows, count(*) AS filled, true AS distinct_close, CASE WHEN c <> 'o_orderpriority' THEN true END AS median_close
FROM orders, (SELECT unnest(['o_custkey', 'o_totalprice', 'o_orderpriority']) AS c) GROUP BY c""")
def sketch_profile(t: Tables):
    """Columns of all orders from sketches of their days: counts, and whether distinct values and median are within the stated error."""
    columns = ["o_custkey", "o_totalprice", "o_orderpriority"]
    orders = spread_evenly(t.orders.select("o_orderdate", *columns))
    found = profile.profile(profile.merged(profile.daily_sketches(orders, "o_orderdate", columns)), [0.5])
    estimates = found.select("column", "rows", "filled", "distinct", F.col("quantiles")[0].alias("median"))
    values = orders.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), F.col(c).try_cast("double").alias("x")) for c in columns))))
    # The estimates have a row per column, so the values stay where they are.
    exact = values.join(F.broadcast(estimates.select("column", "median")), "column").groupBy("column").agg(
        F.count_distinct("v").alias("exact"), F.avg((F.col("x") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("median")).cast("double")).alias("upto")
    )
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(0.08) * F.col("exact"), F.lit(1))
    return estimates.join(exact, "column").select(
        "column", "rows", "filled", close.alias("distinct_close"), ((F.col("below") <= 0.525) & (F.col("upto") >= 0.475)).alias("median_close")
    )


@query("macro_asof", with_entities(f"""
, {MACRO_FILLED} SELECT b.Ticker, CAST(b.Date AS VARCHAR) AS Date, Close, CAST(f.date AS VARCHAR) AS macro_date, {', '.join(TEST_SERIES)}
FROM bars_long b ASOF LEFT JOIN filled f ON b.Date >= f.date + 10""", "bars_long", "macro_long"))
def macro_asof(t: Tables):
    bars = t.bars_long.select("Ticker", "Date", "Close")
    return macro_ops.as_of(bars, t.macro_long, TEST_SERIES, lag_days=10)


# -- universe and categories ------------------------------------------------------------------


@query("universe_audit", with_entities("""
, checked AS (SELECT Ticker, regexp_extract("X-Post-Id", '[$](.*)[$]', 1) AS post_symbol,
  CAST(concat("X-Spot-Id", '_', "X-Post-Id") <> "Conversation Id" AS INTEGER) AS bad_conversation FROM universe),
both_checks AS (SELECT *, CAST(post_symbol <> replace(Ticker, '-USD', '') AS INTEGER) AS bad_post FROM checked)
SELECT * FROM both_checks WHERE bad_conversation = 1 OR bad_post = 1""", "universe"))
def universe_audit(t: Tables):
    return universe_ops.audit_universe(t.universe)


@query("symbol_normalize", with_entities("""
SELECT "Coin Name", replace(Ticker, '-USD', '') AS symbol, replace(Ticker, '-USD', '') AS from_label FROM universe""",
    "universe"))
def symbol_normalize(t: Tables):
    label = F.concat("Coin Name", F.lit(" NASDAQ: "), "Ticker")
    return t.universe.select(
        "Coin Name", listing.plain_symbol(F.col("Ticker")).alias("symbol"), listing.plain_symbol(label).alias("from_label")
    )


_PREFERRED = """
, best AS (SELECT folder, min(CAST(file <> concat(folder, '_categories.csv') AS INTEGER)) AS rank FROM category_files GROUP BY folder),
kept AS (SELECT c.* FROM category_files c JOIN best b ON c.folder = b.folder
  AND CAST(file <> concat(c.folder, '_categories.csv') AS INTEGER) = b.rank)"""


def _categories(t: Tables):
    """Two layouts of the same feed: one has the rank, the other does not."""
    kept = files.preferred_files(t.category_files, "folder", "file", "_categories.csv")
    odd = F.col("line") % 2 == 1
    return universe_ops.union_categories([
        kept.where(odd).select("Ticker", "Coin Name", "Category"),
        kept.where(~odd).select("Ticker", "Coin Name", "Category", "Category Rank"),
    ])


@query("category_union", with_entities(f"""
{_PREFERRED} SELECT Ticker, "Coin Name", '' AS "CoinGecko ID", Category,
  CASE WHEN line % 2 = 1 THEN '' ELSE "Category Rank" END AS "Category Rank", '' AS Description, '' AS "All Categories"
FROM kept""", "category_files"))
def category_union(t: Tables):
    return _categories(t)


@query("category_summary", with_entities(f"""
{_PREFERRED} SELECT count(*) AS rows, count(DISTINCT Ticker) AS tickers,
  count(DISTINCT CASE WHEN Category <> 'Unknown' THEN Category END) AS categories FROM kept""", "category_files"))
def category_summary(t: Tables):
    return universe_ops.category_summary(_categories(t))


@query("category_filter", with_entities("""
SELECT Category, lower(Category) IN ('chain', 'currency', 'meme') AS is_listed, count(*) AS rows
FROM universe GROUP BY Category""", "universe"))
def category_filter(t: Tables):
    listed, invalid = universe_ops.split_categories(t.universe)
    counted = listed.groupBy("Category").agg(F.count("*").alias("rows"))
    return counted.withColumn("is_listed", F.lit(True)).unionByName(invalid.withColumn("is_listed", F.lit(False)))


@query("feed_routing", with_entities("""
, feeds AS (SELECT concat('S', CAST(o_custkey AS VARCHAR)) AS Ticker FROM orders)
SELECT Ticker, CASE WHEN Ticker IN (SELECT replace(Ticker, '-USD', '') FROM universe) THEN 'routed' ELSE 'unknown' END AS status,
       count(*) AS n FROM feeds GROUP BY Ticker""", "universe"))
def feed_routing(t: Tables):
    file = F.concat(F.lit("/feeds/S"), "o_custkey", F.lit("_news.json"))
    feeds = t.orders.select(files.ticker_of_news_file(file).alias("Ticker"))
    known = t.universe.select(listing.plain_symbol(F.col("Ticker")).alias("Ticker"))
    return universe_ops.route_feeds(feeds, known).groupBy("Ticker", "status").agg(F.count("*").alias("n"))


# -- listings ---------------------------------------------------------------------------------

_NAME = "CASE WHEN regexp_extract(c0, '[(]([A-Z]{2,10})[)]', 1) = '' THEN c0 ELSE trim(regexp_replace(c0, '[(][A-Z]{2,10}[)]', '')) END"
_CELLS = "unnest([c0, c1, c2, c3, c4])"


def _first_cell(condition: str) -> str:
    return f"coalesce(list_filter([c0, c1, c2, c3, c4], lambda c: {condition})[1], '')"


_FIELDS = f"""fields AS (SELECT row_id, category, {_NAME} AS name, regexp_extract(c0, '[(]([A-Z]{{2,10}})[)]', 1) AS symbol,
  {_first_cell("contains(c, '$') AND regexp_matches(c, '[0-9]')")} AS price,
  {_first_cell("(contains(c, '$') AND regexp_matches(c, '[BMK]')) OR contains(lower(c), 'cap')")} AS market_cap,
  {_first_cell("contains(lower(c), 'volume') OR (contains(c, '$') AND length(c) > 5)")} AS volume_24h,
  {_first_cell("contains(c, '%') AND (contains(c, '+') OR contains(c, '-'))")} AS change_24h
  FROM listing_cells),
shown AS (SELECT row_id, category, name, CASE WHEN row_id % 6 = 5 THEN 'TAG' ELSE symbol END AS symbol,
  CASE WHEN row_id % 6 = 5 THEN '$7' ELSE price END AS price,
  CASE WHEN row_id % 6 = 5 THEN '' ELSE market_cap END AS market_cap,
  CASE WHEN row_id % 6 = 5 THEN '' ELSE volume_24h END AS volume_24h,
  CASE WHEN row_id % 6 = 5 THEN '' ELSE change_24h END AS change_24h FROM fields)"""


def listing_pages(t: Tables):
    """A page per part: a table row, or a card on every sixth page, whose table row is too short."""
    cells = spread(t.listing_cells).withColumn("plain", listing.without_symbol(F.col("c0"), listing.symbol_in(F.col("c0"))))
    cell = lambda c: F.concat(F.lit("<td> <b>"), c, F.lit("</b>\n</td>"))
    row = F.concat(
        F.lit("<table><tr><th>Name</th></tr><tr>"), *(cell(F.col(f"c{i}")) for i in range(5)), F.lit("</tr></table>")
    )
    card = F.concat(
        F.lit('<table><tr><td>only one</td></tr></table><div class="coin-card"><h3 class="name"> '), "plain",
        F.lit(' </h3><span class="ticker">TAG</span><div class="price">$<i>7</i></div></div>'),
    )
    html = F.when(F.col("row_id") % 6 == 5, card).otherwise(row)
    return cells.select("row_id", "category", html.alias("html"))


def _listings(t: Tables):
    return page_ops.listings(listing_pages(t), "row_id", "html", F.col("category"))


@query("listing_fields", with_entities(f", {_FIELDS} SELECT * FROM shown", "listing_cells"))
def listing_fields(t: Tables):
    return _listings(t)


@query("listing_profile", with_entities(f"""
, {_FIELDS} SELECT count(*) AS total, count(*) FILTER (price <> '') AS with_price,
  count(*) FILTER (market_cap <> '') AS with_market_cap, count(*) FILTER (volume_24h <> '') AS with_volume_24h
FROM shown""", "listing_cells"))
def listing_profile(t: Tables):
    return universe_ops.completeness(_listings(t), ["price", "market_cap", "volume_24h"])


@query("frame_profile", """
SELECT count(*) AS rows, CAST(4 AS INTEGER) AS width, count(item) AS n_item, count(quality) AS n_quality,
       count(toxic) AS n_toxic, count(lang) AS n_lang
FROM (SELECT d.doc_id AS item, quality, toxic, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def frame_profile(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return universe_ops.frame_profile(rows.select(F.col("doc_id").alias("item"), "quality", "toxic", "lang"))


@query("listing_symbol", with_entities(f"""
SELECT row_id, regexp_extract(c0, '[(]([A-Z]{{2,10}})[)]', 1) AS symbol, {_NAME} AS name FROM listing_cells""",
    "listing_cells"))
def listing_symbol(t: Tables):
    symbol = listing.symbol_in(F.col("c0"))
    return t.listing_cells.select("row_id", symbol.alias("symbol"), listing.without_symbol(F.col("c0"), symbol).alias("name"))


def coin_pages(t: Tables):
    """A coin page per supplier; fields stand in different places, some pages lack a price."""
    k = F.col("s_suppkey")
    money = F.concat(F.lit("$"), k.cast("string"), F.lit(".25"))
    price = (
        F.when(k % 5 == 0, F.concat(F.lit('<span class="coin-price">n/a</span><div class="price">'), money, F.lit("</div>")))
        .when(k % 5 == 1, F.concat(F.lit('<b data-testid="price">'), money, F.lit("</b>")))
        .when(k % 5 == 2, F.concat(F.lit("<p><span>"), money, F.lit("</span></p>")))
        .when(k % 5 == 3, F.concat(F.lit('<span class="coin-price"> '), money, F.lit("</span>")))
        .otherwise(F.lit("<span>no quote</span>"))
    )
    cap = F.when(k % 2 == 0, F.lit('<div class="market-cap">$1.2B</div>')).otherwise(
        F.lit("<p><span>Market Cap</span><i>$3.4M</i></p>")
    )
    rank = F.concat(F.lit('<span class="rank">#'), k.cast("string"), F.lit("</span>"))
    change = F.lit('<div class="change">2.5%</div><em data-testid="change">-2.5%</em>')
    # Prices come last: the plain span with a dollar sign must not be an earlier field.
    return spread(t.supplier.select("s_suppkey")).select(
        F.concat(F.lit("S"), k.cast("string")).alias("Ticker"),
        F.concat(F.lit("<html><body>"), rank, price, F.lit("<div>"), cap, F.lit("</div>"), change, F.lit("</body></html>")).alias("html"),
    )


_DETAIL = """
, money AS (SELECT s_suppkey AS k, concat('S', CAST(s_suppkey AS VARCHAR)) AS Ticker, s_suppkey % 5 <> 4 AS priced FROM supplier)"""


@query("detail_fields", f"""
WITH {_DETAIL.lstrip().lstrip(',')}
SELECT Ticker, CASE WHEN k % 2 = 0 THEN '$1.2B' ELSE 'Market Cap$3.4M' END AS market_cap, '' AS volume_24h,
       '-2.5%' AS change_24h, concat('#', CAST(k AS VARCHAR)) AS rank, concat('$', CAST(k AS VARCHAR), '.25') AS price
FROM money WHERE priced""")
def detail_fields(t: Tables):
    return page_ops.detail_fields(coin_pages(t), "Ticker", "html")


@query("found_failed", f"""
WITH {_DETAIL.lstrip().lstrip(',')} SELECT Ticker, CASE WHEN priced THEN 'found' ELSE 'failed' END AS status FROM money""")
def found_failed(t: Tables):
    coins = coin_pages(t)
    return universe_ops.found_and_failed(
        coins.select("Ticker"), page_ops.detail_fields(coins, "Ticker", "html").select("Ticker")
    )


@query("table_records", """
SELECT s_suppkey, CAST(0 AS INTEGER) AS row_no, s_name AS holder, CAST(s_nationkey AS VARCHAR) AS shares,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('last ', CAST(s_suppkey AS VARCHAR)) END AS note,
       CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS fields
FROM supplier
UNION ALL SELECT s_suppkey, 1, 'total', '0', NULL, 2 FROM supplier""")
def table_records(t: Tables):
    """Holder tables with a repeated header and rows that are shorter than it."""
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    more = F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(
        F.concat(cell(F.lit("first")), cell(F.concat(F.lit("last "), F.col("s_suppkey").cast("string"))))
    )
    html = F.concat(
        F.lit('<table><tbody><tr><td>other</td></tr></tbody></table><section data-testid="holders-top-institutional-holders">'
              '<div class="x tableContainer"><table><thead><tr><th>Holder</th><th> Shares</th><th>Note</th><th>Note</th></tr></thead>'
              "<tbody><tr>"),
        cell(F.col("s_name")), cell(F.col("s_nationkey").cast("string")), more,
        F.lit("</tr><tr><td>total</td><td>0</td></tr></tbody></table></div></section>"),
    )
    suppliers = spread(t.supplier.select("s_suppkey", "s_name", "s_nationkey"))
    records = page_ops.section_tables(suppliers.select("s_suppkey", html.alias("html")), "s_suppkey", "html")
    value = lambda k: F.try_element_at("record", F.lit(k))
    return records.select(
        "s_suppkey", "row_no", value("Holder").alias("holder"), value("Shares").alias("shares"),
        value("Note").alias("note"), F.size("record").alias("fields"),
    )


@query("screener_rows", f"""
SELECT p_partkey, CAST(0 AS INTEGER) AS row_no, p_name AS "Symbol", p_brand AS "Name", p_type AS "Price",
  {', '.join(f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size + {i} AS VARCHAR) END AS {chr(34)}{c}{chr(34)}" for i, c in enumerate(SCREENER_COLUMNS[3:]))}
FROM part""")
def screener_rows(t: Tables):
    cell = lambda c: F.concat(F.lit("<td>\n"), c, F.lit(" </td>"))
    tail = F.concat(*(cell((F.col("p_size") + i).cast("string")) for i in range(7)))
    html = F.concat(
        F.lit('<table class="other"><tbody><tr><td>x</td></tr></tbody></table><table class="W(100%) M(0)"><tbody><tr>'),
        cell(F.col("p_name")), cell(F.col("p_brand")), cell(F.col("p_type")),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(tail), F.lit("</tr></tbody></table>"),
    )
    parts = spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return page_ops.screener_rows(parts.select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("preview_limit", with_entities("""
SELECT row_id, c0, c1 FROM listing_cells ORDER BY row_id LIMIT 5""", "listing_cells"))
def preview_limit(t: Tables):
    return universe_ops.preview(t.listing_cells.select("row_id", "c0", "c1"), ["row_id"], 5)
