"""Strings of listing tables and coin pages, told apart by their look."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a ticker in a name.
SYMBOL = r"\(([A-Z]{2,10})\)"


def first_match(items: Column, test) -> Column:
    """First element that passes, '' if none does."""
    return F.coalesce(F.get(F.filter(items, test), F.lit(0)), F.lit(""))


def _magnitude(text: Column, letters: str) -> Column:
    return text.contains("$") & text.rlike(f"[{letters}]")


def price_cell(cells: Column) -> Column:
    return first_match(cells, lambda c: c.contains("$") & c.rlike("[0-9]"))


def cap_cell(cells: Column) -> Column:
    return first_match(cells, lambda c: _magnitude(c, "BMK") | F.lower(c).contains("cap"))


def volume_cell(cells: Column) -> Column:
    return first_match(cells, lambda c: F.lower(c).contains("volume") | (c.contains("$") & (F.length(c) > 5)))


def _is_change(text: Column) -> Column:
    return text.contains("%") & (text.contains("+") | text.contains("-"))


def change_cell(cells: Column) -> Column:
    return first_match(cells, _is_change)


def symbol_in(name: Column) -> Column:
    """Ticker in parentheses, '' if there is none."""
    return F.regexp_extract(name, SYMBOL, 1)


def without_symbol(name: Column, symbol: Column) -> Column:
    return F.when(symbol == "", name).otherwise(
        F.trim(F.replace(name, F.concat(F.lit("("), symbol, F.lit(")")), F.lit("")))
    )


def row_fields(cells: Column, tag: Column) -> Column:
    """Name, symbol, price, cap, volume and change of a table row.

    The symbol stands in parentheses in the first cell, else in an element tagged as such.
    """
    name = cells[0]
    symbol = F.coalesce(F.nullif(symbol_in(name), F.lit("")), tag, F.lit(""))
    return F.struct(
        without_symbol(name, symbol).alias("name"),
        symbol.alias("symbol"),
        price_cell(cells).alias("price"),
        cap_cell(cells).alias("market_cap"),
        volume_cell(cells).alias("volume_24h"),
        change_cell(cells).alias("change_24h"),
    )


def detail_value(places: Column, field: str) -> Column:
    """Value of a field out of its candidate places ``array<struct<text, around>>``."""
    own = {
        "price": lambda p: p["text"].contains("$"),
        "change_24h": lambda p: _is_change(p["text"]),
        "rank": lambda p: p["text"].contains("#") | F.lower(p["text"]).contains("rank"),
    }
    if field in own:
        return F.coalesce(F.get(F.filter(places, own[field]), F.lit(0))["text"], F.lit(""))
    # Sums may be written next to their caption, so the enclosing element counts as well.
    options = F.transform(
        places,
        lambda p: F.when(_magnitude(p["text"], "BMKT"), p["text"]).when(
            _magnitude(p["around"], "BMKT"), p["around"]
        ),
    )
    return first_match(options, lambda text: text.isNotNull())


def record_map(headers: Column, cells: Column) -> Column:
    """Header to cell, cut to the shorter list; of repeated headers the last one counts."""
    n = F.least(F.size(headers), F.size(cells))
    names, values = F.slice(headers, F.lit(1), n), F.slice(cells, F.lit(1), n)
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    distinct = F.array_distinct(names)
    return F.map_from_arrays(distinct, F.transform(distinct, last))


def plain_symbol(text: Column) -> Column:
    """``Name EXCHANGE: SYM`` to ``SYM``, and ``SYM-USD`` to ``SYM``."""
    tail = F.trim(F.element_at(F.split(text, ":"), -1))
    return F.when(tail.endswith("-USD"), F.replace(tail, F.lit("-USD"), F.lit(""))).otherwise(tail)
