"""Whitening against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import whitening
from tidemark.llm.vector_queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors):
    """Covariance in fractions, and the exact deviations."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(size)]
    off = [[n * r[j] - sums[j] for j in range(size)] for r in x]
    covariance = [[Fraction(sum(o[i] * o[j] for o in off), n**3) for j in range(size)] for i in range(size)]
    return covariance, [sum(v * v for v in o) for o in off], [[Fraction(v, n) for v in o] for o in off]


def check(rows, vectors, k=8):
    covariance, deviations, off = exact([v for _, v in vectors])
    values, basis = np.linalg.eigh(np.array([[float(c) for c in r] for r in covariance]))
    values, basis = values[::-1], basis[:, ::-1]
    y = np.array([[float(v) for v in o] for o in off])
    k = min(k, len(values))
    assert len(rows) == k * len(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    for place, (vec_id, _) in enumerate(vectors):
        for c in range(k):
            row = by[vec_id, c + 1]
            assert row.n == len(vectors) and row.deviation == deviations[place]
            assert abs(abs(row.whitened) - abs(y[place] @ basis[:, c] / math.sqrt(values[c]))) < 1e-8
            assert row.explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
            assert row.identity_error < 1e-9
    signs = {c: {np.sign(by[i, c + 1].whitened * (y[p] @ basis[:, c])) for p, (i, _) in enumerate(vectors) if abs(by[i, c + 1].whitened) > 1e-6} for c in range(k)}
    assert all(len(s) == 1 for s in signs.values())


def test_query_over_all_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op12_whitening(spark, folder).collect(), vectors)


def test_nulls_and_odd_vectors_are_left_out(spark):
    draw = np.random.default_rng(3)
    good = [(i, draw.normal(size=10).tolist()) for i in range(40)]
    bad = [(90, None), (91, []), (92, [1.0] * 9 + [None]), (93, [float("nan")] * 10), (94, [float("inf")] + [0.0] * 9), (95, [3e38] * 10), (96, [1.0] * 9)]
    frame = spark.createDataFrame(good + bad, SCHEMA).repartition(5)
    check(whitening.whitened(frame).collect(), good)


def test_repeated_rows_null_ids_and_other_columns(spark):
    draw = np.random.default_rng(4)
    rows = [(1, draw.normal(size=3).tolist()) for _ in range(2)] + [(None, draw.normal(size=3).tolist()), (2, [0.5, 0.25, 0.0]), (2, [0.5, 0.25, 0.0])]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", n int, component string")
    found = whitening.whitened(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted((i or 0, c) for i, _ in rows for c in (1, 2, 3))
    assert {r.n for r in found} == {5}


def test_few_directions_and_nothing(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, -i * 1.0]) for i in range(9)], SCHEMA)
    found = whitening.whitened(line).collect()
    assert {r.component for r in found} == {1} and len(found) == 9 and found[0].explained == pytest.approx(1)


def test_long_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=300).tolist()) for i in range(400)]
    check(whitening.whitened(spark.createDataFrame(rows, SCHEMA), k=2).collect(), rows, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 10**6), st.floats(-9, 0))
def test_factor_and_rotations(size, rank, seed, spread):
    """Any rank, and eigenvalues over many magnitudes."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(size, min(rank, size))) * np.logspace(0, spread, min(rank, size))
    matrix = base @ base.T
    factor = whitening.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix, atol=1e-13 * np.trace(matrix))
    order = np.argsort(-np.count_nonzero(factor, axis=1), kind="stable")[::-1]
    assert np.allclose(np.triu(factor[order][: factor.shape[1]], 1), 0)
    values, basis = whitening.jacobi(factor)
    assert np.allclose((basis * values) @ basis.T, matrix, atol=1e-13 * np.trace(matrix))
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12) and (np.diff(values) <= 0).all()


@pytest.mark.parametrize("size", [2, 3, 7, 8])
def test_every_pair_of_columns_meets_once(size):
    met = [tuple(sorted((int(a), int(b)))) for left, right in whitening.rounds(size) for a, b in zip(left, right)]
    assert sorted(met) == [(a, b) for a in range(size) for b in range(a + 1, size)]


def test_deviation_beyond_64_bits_is_null():
    rows = np.array([[0, 10**12], [10**6, 5]])
    assert whitening.deviations(rows, 10**6, np.array([5, 6], object))[0] is None
    assert whitening.deviations(rows[1:], 10**3, np.array([5, 6], object)) == [(10**9 - 5) ** 2 + (5000 - 6) ** 2]
