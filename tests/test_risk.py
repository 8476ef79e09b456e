"""Weight projection, tail risk and abnormal returns against brute force."""

import datetime as dt
import math
import re

import numpy as np
import pytest

from tidemark.operators import evaluation, portfolio

DAY = dt.date(2024, 1, 1)


def projected(v, low, high):
    """The same by bisection of the shift."""
    a, b = min(v) - high - 1, max(v) - low + 1
    for _ in range(200):
        shift = (a + b) / 2
        a, b = (shift, b) if np.clip(np.array(v) - shift, low, high).sum() > 1 else (a, shift)
    return np.clip(np.array(v) - (a + b) / 2, low, high)


def weights(spark, table):
    rows = [(d, f"A{i}", None if x is None else float(x)) for d, xs in table.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "Date int, Ticker string, w double").repartition(3)


def by_day(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.Date, {})[r.Ticker] = (r.w, r.feasible)
    return out


def test_projection_equals_bisection(spark):
    draw = np.random.default_rng(1)
    table = {d: draw.normal(scale=10.0 ** draw.integers(-3, 4), size=draw.integers(4, 40)).tolist() for d in range(40)}
    table[100] = draw.choice([0.1, 0.2, 0.5], 30).tolist()  # ties
    table[101] = [0.25] * 4  # already right
    table[102] = [5.0, 5.0, 5.0, -5.0]
    got = by_day(portfolio.project_weights(weights(spark, table)))
    for day, v in table.items():
        own = np.array([got[day][f"A{i}"][0] for i in range(len(v))])
        assert own == pytest.approx(projected(v, -0.3, 0.3), abs=1e-9)
        assert abs(own.sum() - 1) < 1e-9 and (np.abs(own) <= 0.3).all()


def test_projection_of_days_without_answer(spark):
    table = {1: [0.5, 0.5, 0.5], 2: [None, None], 3: [None, 9.0, math.nan, 1.0, math.inf, 2.0, 3.0], 4: [0.1] * 3 + [None]}
    got = by_day(portfolio.project_weights(weights(spark, table)))
    assert all(got[d] == {t: (None, False) for t in got[d]} for d in (1, 2, 4))
    assert {t for t, (w, ok) in got[3].items() if w is None} == {"A0", "A2", "A4"} and all(ok for _, ok in got[3].values())
    assert sum(w for w, _ in got[3].values() if w is not None) == pytest.approx(1)
    assert portfolio.project_weights(weights(spark, {1: [1.0]}).limit(0)).collect() == []
    with pytest.raises(ValueError, match="no weight"):
        portfolio.project_weights(weights(spark, {1: [1.0]}), 1, 0)


def test_projection_of_a_day_with_most_rows(spark):
    """One day holds nearly all rows, half of them equal."""
    draw = np.random.default_rng(2)
    hot = np.where(draw.random(30_000) < 0.5, 0.01, draw.normal(size=30_000)).tolist()
    got = by_day(portfolio.project_weights(weights(spark, {1: hot, 2: [1.0, 2.0, 3.0, 4.0], 3: [0.0] * 5}), -0.001, 0.001, ["Date"]))
    own = np.array([got[1][f"A{i}"][0] for i in range(len(hot))])
    assert own == pytest.approx(projected(hot, -0.001, 0.001), abs=1e-9) and abs(own.sum() - 1) < 1e-9
    assert not got[2]["A0"][1]


def test_projection_keeps_columns_and_null_days(spark):
    frame = spark.createDataFrame([(None, "A", 0.9, "x")] * 4 + [(1, "B", 0.2, "y")] * 5, "Date int, at string, w double, slope string")
    got = portfolio.project_weights(frame)
    assert got.columns == ["Date", "at", "w", "slope", "feasible"]
    assert sorted((r.Date or 0, round(r.w, 9)) for r in got.collect()) == [(0, 0.25)] * 4 + [(1, 0.2)] * 5


def tail(rs, level):
    rs = sorted(rs)
    m = round(len(rs) * (1 - level), 9)
    whole = int(m)
    rest = m - whole
    at = rs[math.ceil(m) - 1]
    return -at, -(sum(rs[:whole]) + (rest * rs[whole] if rest else 0)) / m


def test_tail_risk_against_sorting(spark):
    draw = np.random.default_rng(3)
    groups = {1: draw.normal(size=1000), 2: draw.integers(-2, 3, 500).astype(float), 3: np.array([0.5]), 4: np.full(37, -0.25), 5: draw.standard_cauchy(20_000)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, None), (2, math.nan), (6, None), (None, 1.0), (None, -1.0)]
    frame = spark.createDataFrame(rows, "K int, net double").repartition(4)
    got = {(r.K, r.level): (r.days, r["var"], r.cvar) for r in portfolio.tail_risk(frame).collect()}
    groups[None] = np.array([1.0, -1.0])
    assert set(got) == {(k, x) for k in groups for x in (0.9, 0.95, 0.99)}
    for (k, level), (days, var, cvar) in got.items():
        assert days == len(groups[k])
        assert (var, cvar) == pytest.approx(tail(groups[k].tolist(), level))
    assert portfolio.tail_risk(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="levels"):
        portfolio.tail_risk(frame, [1.0])


def test_tail_reward(spark):
    frame = spark.createDataFrame([(1, x / 100) for x in range(-10, 10)], "K int, net double")
    got = {r["lambda"]: r.reward for r in portfolio.tail_reward(frame, [0.0, 2.0], 0.9).collect()}
    assert got == pytest.approx({0.0: -0.005, 2.0: -0.005 - 2 * 0.095})


def test_selection_sorts_no_group(spark):
    """Windows run over buckets and distinct values of one bucket, after aggregates."""
    frame = spark.createDataFrame([(1, 0.5)], "K int, net double")
    text = portfolio.tail_risk(frame)._jdf.queryExecution().optimizedPlan().toString()
    windows = [m.end() for m in re.finditer(r"Window \[", text)]
    assert windows and all("Aggregate" in re.split(r"\bJoin\b", text[at:])[0] for at in windows)


def event_rows(spark, seed=4, days=60, tickers="AB"):
    draw = np.random.default_rng(seed)
    market = {i: draw.normal(scale=0.02) for i in range(days)}
    rs = {(t, i): 0.001 + b * market[i] + draw.normal(scale=0.01) for t, b in zip(tickers, (0.5, 1.5)) for i in range(days) if (t, i) not in {("A", 30), ("B", 12)}}
    returns = spark.createDataFrame([(t, DAY + dt.timedelta(i), float(r)) for (t, i), r in rs.items()], "Ticker string, Date date, r double")
    index = spark.createDataFrame([(DAY + dt.timedelta(i), float(m)) for i, m in market.items()], "Date date, market double")
    return market, rs, returns, index


def test_abnormal_returns_against_numpy(spark):
    market, rs, returns, index = event_rows(spark)
    events = [("A", 40), ("A", 40), ("B", 45), ("B", 5), ("A", 29), ("C", 40), (None, 40)]
    frame = spark.createDataFrame([(t, DAY + dt.timedelta(i)) for t, i in events], "Ticker string, Date date")
    got = {(r.Ticker, (r.event_day - DAY).days, r.day_offset): r for r in evaluation.abnormal_returns(returns, frame, index, 2, (-25, -5), 10).collect()}
    assert set(got) == {(t, e, k) for t, e in {("A", 40), ("B", 45), ("B", 5), ("A", 29)} for k in range(-2, 3) if (t, e + k) in rs}
    for t, e in {("A", 40), ("B", 45), ("A", 29)}:
        window = [i for i in range(e - 25, e - 4) if (t, i) in rs]
        x, y = np.array([market[i] for i in window]), np.array([rs[t, i] for i in window])
        beta, alpha = np.polyfit(x, y, 1)
        s = math.sqrt(((y - alpha - beta * x) ** 2).sum() / (len(x) - 2))
        total = n = 0
        for k in range(-2, 3):
            if (t, e + k) not in rs:
                continue
            row, off = got[t, e, k], rs[t, e + k] - alpha - beta * market[e + k]
            total, n = total + off, n + 1
            assert (row.abnormal, row.t, row.cumulated, row.cumulated_t) == pytest.approx((off, off / s, total, total / s / math.sqrt(n)))
    assert all(got["B", 5, k].abnormal is None and got["B", 5, k].t is None for k in range(-2, 3))  # too few days before


def test_abnormal_returns_without_a_model(spark):
    _, _, returns, index = event_rows(spark)
    events = spark.createDataFrame([("A", DAY + dt.timedelta(40))], "Ticker string, Date date")
    flat = index.withColumn("market", index.market * 0)
    assert {r.abnormal for r in evaluation.abnormal_returns(returns, events, flat, 2, (-25, -5), 10).collect()} == {None}
    same = returns.join(index, "Date").withColumn("r", index.market * 2).drop("market")
    rows = evaluation.abnormal_returns(same, events, index, 2, (-25, -5), 10).collect()
    assert all(abs(r.abnormal) < 1e-12 and r.t is None for r in rows)
    assert evaluation.abnormal_returns(returns, events.limit(0), index).collect() == []
    with pytest.raises(ValueError, match="estimation"):
        evaluation.abnormal_returns(returns, events, index, 3, (-20, -3))


def test_average_abnormal(spark):
    frame = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 3.0), (1, 2.0, 5.0), (1, None, None)], "day_offset int, abnormal double, cumulated double")
    got = {r.day_offset: (r.events, r.mean_abnormal, r.t, r.mean_cumulated) for r in evaluation.average_abnormal(frame).collect()}
    assert got == {0: (2, 2.0, pytest.approx(2.0), 2.0), 1: (1, 2.0, None, 5.0)}
