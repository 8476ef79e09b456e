"""Merged sketches against exact figures."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import profile

COLUMNS = ["x", "name", "n"]


@pytest.fixture(scope="module")
def rows():
    """One day holds nearly all rows; values repeat; some are missing."""
    draw = random.Random(1)
    out = [(0 if draw.random() < 0.9 else draw.randrange(1, 30), draw.gauss(0, 1), f"n{draw.randrange(3000)}", draw.randrange(50)) for _ in range(40_000)]
    return out + [(5, None, None, None), (5, math.nan, "a", 1), (None, 0.5, "b", 2)]


def check(r, values, total):
    assert (r.rows, r.filled) == (total, len(values))
    exact = len(set(values))
    assert abs(r.distinct - exact) <= max(5 * 0.0163 * exact, 1)
    if r.column == "name":
        assert r.quantiles is None
        return
    ordered = np.sort(values)
    for p, q in zip(profile.PROBABILITIES, r.quantiles, strict=True):
        low, high = np.searchsorted(ordered, q, "left") / len(ordered), np.searchsorted(ordered, q, "right") / len(ordered)
        assert low - 0.025 <= p <= high + 0.025


def of(rows, column):
    return [v for v in (r[1 + COLUMNS.index(column)] for r in rows) if v is not None and v == v]


def test_merged_days_are_within_the_error(spark, rows):
    frame = spark.createDataFrame(rows, "day int, x double, name string, n int").repartition(6)
    stored = profile.daily_sketches(frame, "day", COLUMNS)
    assert stored.count() == 31 * 3
    for r in profile.profile(profile.merged(stored)).collect():
        check(r, of(rows, r.column), len(rows))


def test_some_days_and_any_order(spark, rows):
    frame = spark.createDataFrame(rows, "day int, x double, name string, n int")
    stored = profile.daily_sketches(frame, "day", COLUMNS)
    some = stored.where("day between 3 and 9")
    chosen = [r for r in rows if r[0] is not None and 3 <= r[0] <= 9]
    one = {r.column: r for r in profile.profile(profile.merged(some)).collect()}
    two = {r.column: r for r in profile.profile(profile.merged(some.orderBy("column", "day").repartition(5))).collect()}
    twice = profile.merged(profile.merged(some, [(some.day % 2).alias("half")]).drop("half"))
    three = {r.column: r for r in profile.profile(twice).collect()}
    for column, r in one.items():
        check(r, of(chosen, column), len(chosen))
        check(two[column], of(chosen, column), len(chosen))
        check(three[column], of(chosen, column), len(chosen))


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([(1, None, None, None)], "day int, x double, name string, n int")
    found = {r.column: r for r in profile.profile(profile.merged(profile.daily_sketches(empty, "day", COLUMNS))).collect()}
    assert {c: (r.rows, r.filled, r.distinct, r.quantiles) for c, r in found.items()} == {c: (1, 0, 0, None) for c in COLUMNS}
    assert profile.daily_sketches(empty.limit(0), "day", COLUMNS).collect() == []
