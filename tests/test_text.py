import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates, listing, numbers, text
from tidemark.functions.json_text import flat_json

NBSP = " "


@pytest.mark.parametrize(
    "clean, raw, expected",
    [
        (text.clean_social, "Café http://a.b #1!", "Caf 1"),
        (text.clean_social, None, ""),
        (text.clean_social, "!!!", ""),
        (text.clean_news, "Café http://a.b #1!", "Café 1"),
        (text.clean_news, "snake_case, ok", "snake_case ok"),
        (text.clean_news, f"a{NBSP}b \tc", "a b c"),
        (text.clean_forum, "Über www.x.y okay, gut! (ja) https://q", "Uber okay, gut! ja"),
        (text.clean_forum, "Straße Æon", "Strasse AEon"),
        (text.strip_tags, " <p>a<br/>b</p>\n", "ab"),
        (text.strip_edges, f"\t a {NBSP}\n\x1c", "a"),
        (text.strip_paywall, "x We are HAVING trouble retrieving\nthe. Subscribe . y subscribe.", "x  y subscribe."),
    ],
)
def test_cleaners(value, clean, raw, expected):
    assert value(clean(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "raw, flag",
    [("Hack", 1), ("hacks", 0), ("éban", 0), ("ban.", 1), ("(IPO)", 1), ("a token_x", 0), (None, 0)],
)
def test_event_flag(value, raw, flag):
    assert value(text.event_flag(F.lit(raw).cast("string"))) == flag


def test_event_hits_are_distinct_and_lower_case(value):
    assert sorted(value(text.event_hits(F.lit("Ban ban HACK bans")))) == ["ban", "hack"]


def test_keyword_rules():
    assert text.keyword_list(["Merge", "ab", "c3po", "merge", "fork"]) == ("fork", "merge")


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (462, 1), (463, 2), (512, 2), (924, 2), (925, 3)])
def test_chunk_count(value, n, chunks):
    words = F.lit(" ".join(["w"] * n))
    got = value(text.chunk_arrays(text.tokens(words)))
    assert [len(c) for c in got] == [min(512, n - i * 462) for i in range(chunks)]


def test_article_text_keeps_blanks_of_missing_parts(value):
    assert value(text.article_text(F.lit("a"), F.lit(None), F.lit("b"))) == "a  b"


def test_flat_json(value):
    raw = '{"Body": ["a", {"k": "b", "n": null, "z": [1, "c"]}, "d"]}'
    v = F.variant_get(F.parse_json(F.lit(raw)), "$.Body", "variant")
    assert value(flat_json(v)) == "a b  1 c d"


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00", max_codepoint=0x2FFF), max_size=30))
def test_social_cleaner_against_python(spark, raw):
    def plain(t):
        t = re.sub(r"http\S+", "", t)
        return re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z0-9\s]", "", t)).strip()

    frame = spark.createDataFrame([(raw,)], "t string")
    assert frame.select(text.clean_social(F.col("t")).alias("x")).first().x == plain(raw)


@pytest.mark.parametrize(
    "stamp, day",
    [("2024-08-01T23:30:00-0500", "2024-08-01"), (None, ""), ("", ""), ("2024-08-01", None), ("2024-13-01T00:00:00Z", None)],
)
def test_offset_day(value, stamp, day):
    assert value(dates.offset_day(F.lit(stamp).cast("string"))) == day


def test_epochs(value):
    assert value(dates.epoch_day_text(F.lit(0))) == "1970-01-01"
    assert value(dates.epoch_day_text(F.lit(-1))) == "1969-12-31"
    assert value(dates.epoch_day_text(F.lit(None).cast("long"))) is None
    assert value(dates.day_epoch(F.lit("1970-01-02").cast("date"))) == 86400


@pytest.mark.parametrize(
    "raw, day",
    [
        ("2024-03-05", "2024-03-05"), ("2024-03-05T23:59:00-0800", "2024-03-05"), ("March 5, 2024", "2024-03-05"),
        ("03/05/2024", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("soon", None), ("2024-02-30", None),
    ],
)
def test_lenient_day(value, raw, day):
    got = value(dates.lenient_day(F.lit(raw)))
    assert (got and got.isoformat()) == day


def test_strict_day_raises(spark):
    with pytest.raises(Exception, match="yyyy-MM-dd|parse|PARSE"):
        spark.sql("SELECT 'x' AS d").select(dates.strict_day(F.col("d"))).collect()


@pytest.mark.parametrize("x, digits, y", [(2.5, 0, 2.0), (3.5, 0, 4.0), (0.125, 2, 0.12), (0.25, 1, 0.2), (0.575, 2, 0.57)])
def test_half_even_as_numpy(value, x, digits, y):
    import numpy as np

    assert value(numbers.half_even(F.lit(x), digits)) == y == np.round(x, digits)


def test_numbers(value):
    assert value(numbers.to_number(F.lit("."))) is None
    assert value(numbers.to_number(F.lit("4.2"))) == 4.2
    assert value(numbers.ratio(F.lit(1), F.lit(0))) is None


def test_listing_rules(value):
    cells = F.array(*map(F.lit, ["Bitcoin (BTC)", "no", "$5", "$1.2B", "Volume 7", "2%", "+2%"]))
    got = value(listing.row_fields(cells, F.lit(None).cast("string"))).asDict()
    assert got == {
        "name": "Bitcoin", "symbol": "BTC", "price": "$5", "market_cap": "$1.2B", "volume_24h": "Volume 7", "change_24h": "+2%",
    }
    assert value(listing.price_cell(F.array().cast("array<string>"))) == ""


def test_record_map(value):
    record = listing.record_map(F.array(*map(F.lit, "abb")), F.array(*map(F.lit, "123")))
    assert value(record) == {"a": "1", "b": "3"}
    assert value(listing.record_map(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "12")))) == {"a": "1", "b": "2"}


@pytest.mark.parametrize("raw, symbol", [("Apple Inc NASDAQ: AAPL", "AAPL"), ("BTC-USD", "BTC"), ("ETH", "ETH"), ("X-USD-Y", "X-USD-Y")])
def test_plain_symbol(value, raw, symbol):
    assert value(listing.plain_symbol(F.lit(raw))) == symbol


def test_no_usable_keyword_flags_nothing(value):
    assert value(text.event_flag(F.lit("the case of c3po in it"), [])) == 0
    assert value(text.event_flag(F.lit("c3po in it"), ["c3po", "in", "it"])) == 0


@pytest.mark.parametrize("raw", [
    "Mon, 05 Aug 2024 10:00:00 GMT", "08/05/2024 10:00", "Aug. 5, 2024", "5 August 2024", "August 5, 2024 10:00 AM", "20240805", "2024/08/05",
    "2024-08-05T23:30:00-0500", "2024-08-05 10:00:00.123", "Monday, August 5, 2024", "Aug 5, 2024", " 2024-8-5 ", "05 Aug 2024 10:00 +0200",
])
def test_usual_spellings_of_a_day(value, raw):
    from tidemark.functions.dates import lenient_day

    assert str(value(lenient_day(F.lit(raw)))) == "2024-08-05"


def test_day_first_where_the_month_cannot_be(value):
    from tidemark.functions.dates import lenient_day

    assert str(value(lenient_day(F.lit("13/02/2024")))) == "2024-02-13"
    assert str(value(lenient_day(F.lit("02/13/2024")))) == "2024-02-13"
    assert value(lenient_day(F.lit("31/31/2024"))) is None and value(lenient_day(F.lit("soon"))) is None


def test_ten_thousand_weights(value):
    lexicon = {f"w{i}": i / 7 for i in range(10_000)}
    words = F.array(*(F.lit(w) for w in ("w3", "w9999", "unknown", "w3")))
    assert value(text.weight_sum(words, lexicon)) == pytest.approx((3 + 9999 + 3) / 7)
    assert value(text.weight_sum(words, {})) == 0.0


def test_nested_json_at_any_depth(value):
    deep = '{"a": ' * 40 + '[1, 2.50, null, [], "x", {"b": true}]' + "}" * 40
    assert value(flat_json(F.parse_json(F.lit(deep)))) == "1 2.5   x true"
