"""Scans over ranges against plain loops, with a series that holds nearly all rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import macro, portfolio, scan

DAY = dt.date(1990, 1, 1)


def series(spark, sizes, gaps=0.5, seed=1):
    draw = random.Random(seed)
    rows = [(k, i, None if draw.random() < gaps else draw.uniform(-1, 1), None if draw.random() < 0.99 else float(i)) for k, n in sizes.items() for i in range(n)]
    shuffled = draw.sample(rows, len(rows))
    return rows, spark.createDataFrame(shuffled, "k string, i int, x double, y double")


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_fill_equals_a_loop(spark, ranges):
    rows, frame = series(spark, {"hot": 5000, "a": 3, "b": 1, None: 40, "c": 200})
    last, want = {}, {}
    for k, i, x, y in rows:
        old = last.get(k, (None, None))
        last[k] = (old[0] if x is None else x, old[1] if y is None else y)
        want[k, i] = last[k]
    filled = scan.carried_fill(frame, ["k"], "i", ["x", "y"], ranges)
    assert filled.columns == frame.columns
    assert {(r.k, r.i): (r.x, r.y) for r in filled.collect()} == want
    if ranges == 40:
        assert scan.ranged(frame, ["k"], "i", ranges).where("k = 'hot'").select("_range").distinct().count() > 20


def test_sums_and_tops_equal_a_loop(spark):
    rows, frame = series(spark, {"hot": 4000, "a": 5, None: 30}, 0.2, 2)
    state, want = {}, {}
    for k, i, x, _ in rows:
        total, top = state.get(k, (0.0, -math.inf))
        total += x or 0.0
        state[k] = want[k, i] = (total, max(top, total))
    got = scan.running_sum(frame, ["k"], "i", "x", 16).collect()
    assert len(got) == len(want)
    assert all((r.total, r.top) == pytest.approx(want[r.k, r.i]) for r in got)


def test_wealth_is_that_of_the_metrics(spark):
    draw = random.Random(5)
    rows = [(k, DAY + dt.timedelta(i), draw.gauss(0.0, 0.02)) for k, n in {1: 3000, 2: 10, 3: 1}.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "K int, Date date, net double").repartition(5)
    lowest = {r.K: r.worst for r in scan.wealth_curve(frame, ranges=9).groupBy("K").agg(F.min("fall").alias("worst")).collect()}
    assert lowest == pytest.approx({r.K: r.max_drawdown for r in portfolio.risk_metrics(frame).collect()})
    end = scan.wealth_curve(frame, ranges=9).where("K = 2").orderBy(F.desc("Date")).first()
    assert end.wealth == pytest.approx(math.prod(1 + r for k, _, r in rows if k == 2))


def test_fill_is_that_of_the_macro_table(spark):
    draw = random.Random(6)
    rows = [(s, DAY + dt.timedelta(30 * i), draw.random()) for s in ("A", "B", "C") for i in range(300) if draw.random() < 0.4]
    long = spark.createDataFrame(rows, "series_id string, date date, value double")
    want = {(r.series_id, r.date): r.value for r in macro.forward_fill(long, ["A", "B", "C"]).collect()}
    spine = long.select("date").distinct().join(long.select("series_id").distinct())
    got = scan.carried_fill(spine.join(long, ["series_id", "date"], "left"), ["series_id"], "date", ["value"], 11)
    assert {(r.series_id, r.date): r.value for r in got.collect()} == want


def test_empty_tables_and_rows_without_a_place(spark):
    _, frame = series(spark, {"a": 3})
    assert scan.carried_fill(frame.limit(0), ["k"], "i", ["x"]).collect() == []
    assert scan.wealth_curve(spark.createDataFrame([], "K int, Date date, net double")).collect() == []
    odd = spark.createDataFrame([("a", None, 1.0), ("a", 1, None), ("a", 2, 3.0), ("a", 3, None)], "k string, i int, x double")
    assert {r.i: r.x for r in scan.carried_fill(odd, ["k"], "i", ["x"], 4).collect()} == {None: 1.0, 1: 1.0, 2: 3.0, 3: 3.0}
