import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, evaluation, features, graph, portfolio

START = dt.date(2024, 1, 1)


def returns(spark, table):
    """``{ticker: [r, ...]}`` as daily returns from the first day on; None leaves a day out."""
    rows = [(t, START + dt.timedelta(i), float(r)) for t, rs in table.items() for i, r in enumerate(rs) if r is not None]
    return spark.createDataFrame(rows, "Ticker string, Date date, r double")


def test_correlation_against_numpy(spark):
    rng = np.random.default_rng(1)
    table = {t: rng.normal(size=12) for t in "ABCD"}
    got = {(r.a, r.b, (r.Date - START).days): r.rho for r in graph.rolling_correlation(returns(spark, table)).collect()}
    want = {
        (a, b, i): np.corrcoef(table[a][i - 6 : i + 1], table[b][i - 6 : i + 1])[0, 1]
        for a in "ABCD" for b in "ABCD" if a < b for i in range(6, 12)
    }
    assert got == pytest.approx(want)


def test_constant_series_and_gaps(spark):
    flat, up, gap = [0.1] * 8, list(range(8)), [0, 1, 2, None, 4, 5, 6, 9]
    got = graph.rolling_correlation(returns(spark, {"A": flat, "B": up, "C": gap})).collect()
    common = [0, 1, 2, 4, 5, 6, 7]  # the days that B and C share
    rho = np.corrcoef([up[i] for i in common], [gap[i] for i in common])[0, 1]
    assert {(r.a, r.b, (r.Date - START).days): r.rho for r in got} == {
        ("A", "B", 6): None, ("A", "B", 7): None, ("A", "C", 7): None, ("B", "C", 7): pytest.approx(rho),
    }
    assert graph.edges(graph.rolling_correlation(returns(spark, {"A": flat, "B": up}))).count() == 0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_give_the_same_correlations(spark, block):
    """With days missing at the ends and inside, constant windows, ties, a lone asset, and one with fewer days than a window."""
    rng = np.random.default_rng(5)
    table = {f"T{i}": rng.normal(size=90).tolist() for i in range(9)}
    table["FLAT"], table["STEP"] = [0.1] * 90, [0.1] * 40 + [0.2] * 50
    table["LATE"], table["GONE"] = [None] * 30 + rng.normal(size=60).tolist(), rng.normal(size=50).tolist()
    table["GAPS"] = [None if rng.random() < 0.3 else x for x in rng.normal(size=90).tolist()]
    table["HOLE"] = rng.normal(size=30).tolist() + [None] * 40 + rng.normal(size=20).tolist()
    table["FEW"], table["COPY"] = [1.0, 2.0, 4.0], table["T0"]
    frame = returns(spark, table)
    want = {(r.a, r.b, r.Date): (r.rho, r.ra, r.rb) for r in graph.rolling_correlation(frame).where("abs(rho) >= 0.2").collect()}
    rows = graph.block_correlation(frame, block=block).collect()
    got = {(r.a, r.b, r.Date): (r.rho, r.ra, r.rb) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want) and len(want) > 1000
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_blocks_join_no_rows(spark):
    frame = returns(spark, {"A": [1, 2, 3]})
    text = graph.block_correlation(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text
    odd = frame.selectExpr("Ticker", "Date", "if(Date > '2024-01-01', null, r) as r")
    assert graph.block_correlation(odd).collect() == [] and graph.block_correlation(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        graph.block_correlation(frame, 0)


def test_edges_are_mirrored(spark):
    rhos = spark.sql("SELECT 'A' AS a, 'B' AS b, DATE'2024-01-01' AS Date, -0.2D AS rho, 1.0D AS ra, 3.0D AS rb")
    got = {(r.src, r.dst, r.dst_r) for r in graph.edges(rhos).collect()}
    assert got == {("A", "B", 3.0), ("B", "A", 1.0)}
    assert graph.edges(rhos, 0.21).count() == 0
    means = {r.Ticker: (r.degree, r.neighbour_r, r.weighted_r) for r in graph.neighbour_mean(graph.edges(rhos)).collect()}
    assert means == {"A": (1, 3.0, pytest.approx(-3.0)), "B": (1, 1.0, pytest.approx(-1.0))}


def test_forward_return_and_lookback(spark):
    frame = spark.createDataFrame([("T", START + dt.timedelta(i), float(2**i)) for i in range(9)], "Ticker string, Date date, Close double")
    ahead = [r.FwdRet_7d for r in bars.forward_return(frame).orderBy("Date").collect()]
    assert ahead == [127.0, 127.0] + [None] * 7
    back = bars.lookback(frame, "Close", rows=8).orderBy("Date").collect()
    assert [r.history for r in back] == [[float(2**i) for i in range(8)], [float(2**i) for i in range(1, 9)]]


def test_net_returns_charge_exits(spark):
    d0, d1, d2 = (START + dt.timedelta(i) for i in range(3))
    held = [(1, d0, "A", 1.0, 0.1), (1, d1, "A", 0.5, 0.1), (1, d1, "B", 0.5, -0.1), (1, d2, "B", 1.0, 0.2)]
    weights = spark.createDataFrame(held, "K int, Date date, Ticker string, w double, r double")
    got = {r.Date: (r.gross, r.cost) for r in portfolio.net_returns(weights, {"A": 10.0}, fee_bps=5.0).collect()}
    a, b = 15 / 1e4, 55 / 1e4
    assert got == {
        d0: (pytest.approx(0.1), pytest.approx(a)),
        d1: (pytest.approx(0.0), pytest.approx(0.5 * a + 0.5 * b)),
        d2: (pytest.approx(0.2), pytest.approx(0.5 * a + 0.5 * b)),
    }


def test_risk_against_numpy(spark):
    net = np.array([0.1, -0.2, 0.05, -0.1, 0.3])
    frame = returns(spark, {"T": net}).select(F.lit(1).alias("K"), "Date", F.col("r").alias("net"))
    row = portfolio.risk_metrics(frame).first()
    wealth = np.concatenate([[1.0], np.cumprod(1 + net)])
    year = math.sqrt(365)
    assert row.sharpe == pytest.approx(net.mean() / net.std() * year)
    assert row.sortino == pytest.approx(net.mean() / np.sqrt(np.mean(np.minimum(net, 0) ** 2)) * year)
    assert row.max_drawdown == pytest.approx(min(wealth / np.maximum.accumulate(wealth) - 1))
    rewards = {r["lambda"]: r.reward for r in portfolio.reward_sweep(frame, [0.5, 1.0]).collect()}
    assert rewards == pytest.approx({x: net.mean() - x * net.var() for x in (0.5, 1.0)})


def test_flat_portfolio_has_no_sharpe(spark):
    frame = returns(spark, {"T": [0.0, 0.0]}).select(F.lit(1).alias("K"), "Date", F.col("r").alias("net"))
    row = portfolio.risk_metrics(frame).first()
    assert (row.sharpe, row.sortino, row.max_drawdown) == (None, None, 0.0)


def test_top_k_ties_go_by_ticker(spark):
    signals = spark.createDataFrame([(START, t, 1.0) for t in "CAB"], "Date date, Ticker string, forecast double")
    got = {(r.K, r.Ticker, r.w) for r in portfolio.top_k(signals, [1, 2]).collect()}
    assert got == {(1, "A", 1.0), (2, "A", 0.5), (2, "B", 0.5)}
    audit = {r.K: (r.max_w, r.sum_w, r.violations) for r in portfolio.audit_weights(portfolio.top_k(signals, [1, 2])).collect()}
    assert audit == {1: (1.0, 1.0, 1), 2: (0.5, 1.0, 2)}


def test_forecast_metrics(spark):
    frame = spark.createDataFrame([("T", 1.0, 1.0), ("T", -1.0, 1.0), ("T", 0.0, 0.0), ("T", 0.0, 1.0)], "Ticker string, r double, forecast double")
    row = evaluation.forecast_metrics(frame).first()
    assert (row.n, row.rmse, row.direction) == (4, pytest.approx(math.sqrt(5 / 4)), 0.5)


def test_regimes_may_overlap(spark):
    frame = returns(spark, {"T": [1, 2, 3]})
    days = evaluation.in_regimes(frame, [("x", "2024-01-01", "2024-01-02"), ("y", "2024-01-02", "2024-01-09")])
    assert sorted((r.regime, r.r) for r in days.collect()) == [("x", 1.0), ("x", 2.0), ("y", 2.0), ("y", 3.0)]


def test_event_offsets(spark):
    events = spark.createDataFrame([("T", START + dt.timedelta(2))], "Ticker string, Date date")
    got = {r.day_offset: r.mean_r for r in evaluation.event_study(returns(spark, {"T": [1, 2, 3, 4]}), events, k=2).collect()}
    assert got == {-2: 1.0, -1: 2.0, 0: 3.0, 1: 4.0}


@pytest.mark.parametrize("mode", ["rolling", "expanding"])
def test_folds_do_not_overlap(spark, mode):
    frame = spark.sql("SELECT 'T' AS Ticker, explode(sequence(DATE'2020-01-01', DATE'2024-12-31')) AS Date")
    folds = evaluation.backtest_folds(frame, mode).orderBy("fold").collect()
    assert len(folds) == 3 and folds[-1].test_end == dt.date(2024, 12, 31)
    for f in folds:
        assert f.train_start < f.train_end < f.test_start < f.test_end
        assert (f.test_start - f.train_end).days == 1
        assert (f.train_start == dt.date(2020, 1, 1)) == (mode == "expanding")
    for a, b in zip(folds, folds[1:]):
        assert (b.test_start - a.test_end).days == 1
    with pytest.raises(ValueError):
        evaluation.backtest_folds(frame, "other")


def test_membership(spark):
    frame = spark.sql("""
        SELECT 'old' AS Ticker, explode(sequence(DATE'2020-01-01', DATE'2024-12-31')) AS Date UNION ALL
        SELECT 'new', explode(sequence(DATE'2024-11-01', DATE'2024-12-31')) UNION ALL
        SELECT 'gone', explode(sequence(DATE'2020-01-01', DATE'2024-11-30'))""")
    got = {(r.Ticker, r.fold): (r.cold_start, r.delisted) for r in evaluation.fold_membership(frame).collect()}
    assert got[("old", 3)] == (0, 0) and got[("new", 3)] == (1, 0) and got[("gone", 3)] == (0, 1) and ("new", 2) not in got


def test_kappa_of_a_known_table(spark):
    counts = [  # ten items, fourteen raters, five categories; kappa is 0.210 to three digits
        [0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1],
        [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7],
    ]
    rows = [(i, f"c{j}") for i, cells in enumerate(counts) for j, n in enumerate(cells) for _ in range(n)]
    row = evaluation.fleiss_kappa(spark.createDataFrame(rows, "item int, category string")).first()
    assert (row.items, row.raters) == (10, 14) and round(row.kappa, 3) == 0.210


def test_fused_rows_mark_absent_blocks(spark):
    frame = spark.sql("SELECT 1.5D AS a, CAST(NULL AS INT) AS b, CAST(NULL AS DOUBLE) AS c")
    row = features.fuse(frame, {"one": ["a", "b"], "two": ["c"]}).first()
    assert (row.x, row.has_one, row.has_two) == ([1.5, 0.0, 0.0], 1, 0)


def smoothed(table, links, mixing, hops):
    """The same hops as matrix products."""
    names = sorted(table)
    weights = np.zeros((len(names),) * 2)
    for a, b, rho in links:
        weights[names.index(a), names.index(b)] += abs(rho)
    own = np.array([table[n] for n in names])
    total = weights.sum(1)
    x = own
    for _ in range(hops):
        mean = np.divide(weights @ x, total, out=own.copy(), where=total > 0)
        x = np.where(total > 0, (1 - mixing) * own + mixing * mean, own)
    return dict(zip(names, x, strict=True))


def test_values_spread_until_they_settle(spark):
    draw = np.random.default_rng(8)
    names = [f"T{i}" for i in range(12)]
    table = {n: float(x) for n, x in zip(names, draw.normal(size=12))}
    links = [(a, b, float(draw.uniform(-1, 1))) for i, a in enumerate(names[:11]) for b in names[i + 1 : 11] if a == "T0" or draw.random() < 0.3]
    links += [(b, a, rho) for a, b, rho in links]  # T0 is a hub, T11 has no neighbour
    frame = spark.createDataFrame([(a, b, START, rho) for a, b, rho in links], "src string, dst string, Date date, rho double")
    values = spark.createDataFrame([(n, START, x) for n, x in table.items()] + [("NONE", START, None)], "Ticker string, Date date, r double")
    rows = graph.graph_smooth(frame, values, 0.5, 1e-9).collect()
    hops = rows[0].hops
    assert 5 < hops < 50 and {r.Ticker: r.smooth for r in rows} == pytest.approx(smoothed(table, links, 0.5, 200), abs=1e-8)
    two = graph.graph_smooth(frame, values, 0.8, 0.0, most_hops=2).collect()
    assert {r.hops for r in two} == {2} and {r.Ticker: r.smooth for r in two} == pytest.approx(smoothed(table, links, 0.8, 2))
    alone = graph.graph_smooth(frame.limit(0), values).collect()
    assert {r.Ticker: r.smooth for r in alone} == pytest.approx(table) and alone[0].hops == 1
    with pytest.raises(ValueError, match="mixing"):
        graph.graph_smooth(frame, values, 1.0)
