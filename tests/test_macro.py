import datetime as dt

import pytest

from tidemark.operators import macro
from tidemark.sources import files

LONG = "series_id string, date date, value double"


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, *rows):
    return spark.createDataFrame([(s, day(d), v) for s, d, v in rows], LONG)


def test_fill_keeps_leading_gaps(spark):
    long = series(
        spark, ("m", "2024-01-01", 9.0), ("m", "2024-02-01", 8.0), ("m", "2024-03-01", 7.0), ("m", "2024-04-01", 6.0),
        ("q", "2024-02-01", 1.0), ("q", "2024-04-01", 3.0),
    )
    got = {r.date.isoformat(): r.value for r in macro.forward_fill(long, ["m", "q"]).where("series_id = 'q'").collect()}
    assert got == {"2024-01-01": None, "2024-02-01": 1.0, "2024-03-01": 1.0, "2024-04-01": 3.0}


def test_carried_and_new_values_of_the_last_month(spark):
    names = {"Inflation_Rate": "cpi", "Balance_of_Trade": "trade", "Non_Farm_Payrolls": "jobs"}
    long = series(
        spark, ("cpi", "2025-05-01", 320.58), ("trade", "2025-05-01", -71517.0), ("jobs", "2025-05-01", 159577.0),
        ("jobs", "2025-06-01", 159724.4),
    )
    rows = macro.monthly_table(long, names, "MM-dd-yyyy").collect()
    assert [tuple(r) for r in rows] == [
        ("05-01-2025", 320.58, -71517.0, 159577.0), ("06-01-2025", 320.58, -71517.0, 159724.0),
    ]


def test_every_published_series_has_an_id():
    ids = [*macro.QUARTERLY_SERIES.values(), *macro.MONTHLY_SERIES.values()]
    assert len(ids) == len(set(ids)) == 19


def test_missing_observations_are_dropped(spark):
    raw = spark.createDataFrame(
        [("s", '{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-02-01","value":"4.5"},{"value":"1"}]}')],
        "series_id string, json string",
    )
    rows = macro.usable_observations(files.parse_observations(raw, "json")).collect()
    assert [(r.date, r.value) for r in rows] == [(day("2024-02-01"), 4.5)]


@pytest.mark.parametrize("lag", [0, 10, 45])
def test_no_bar_sees_a_later_macro_row(spark, lag):
    dates = [f"2024-{m:02d}-01" for m in range(1, 7)]
    long = series(spark, *(("s", d, float(i)) for i, d in enumerate(dates)))
    first = day("2023-12-20")
    bars = spark.createDataFrame([("T", first + dt.timedelta(i)) for i in range(300)], "Ticker string, Date date")
    out = macro.as_of(bars, long, {"v": "s"}, lag_days=lag).collect()
    assert len(out) == 300
    for row in out:
        known = [i for i, d in enumerate(dates) if day(d) + dt.timedelta(lag) <= row.Date]
        assert row.v == (float(known[-1]) if known else None), row


def test_wide_form_has_no_chain_of_joins(spark):
    long = series(spark, ("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0))
    plan = macro.widen(long, {"x": "a", "y": "b"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
