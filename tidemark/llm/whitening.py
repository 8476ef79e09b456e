"""Whitening of embeddings on fixed-point entries.

Two passes over the vectors give their number and exact sums, then the scatter of the vectors centred before they are
multiplied. The scatter, as large as the square of the dimension, is factored on the driver by Cholesky with pivoting,
and one-sided Jacobi rotations make the columns of the triangular factor orthogonal: their squared
norms are the eigenvalues, the normalised columns the components. A third pass projects the vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000  # entry c becomes floor(SCALE * c) + SHIFT
LARGEST = 1 << 40  # of scaled entries; beyond it an entry counts as not finite
ROWS_AT_ONCE = 4096
MAX_SWEEPS = 60
NEGLIGIBLE = 1e-15  # cosine of two columns that count as orthogonal


class Fit(NamedTuple):
    """What whitening needs to know of the fit list: a few numbers and matrices of the dimension's size."""

    n: int
    sums: np.ndarray  # of each dimension, exact
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """A factor ``L`` with ``L @ L.T`` equal to ``scatter``: the rows in the order of ``scatter``, a column per rank.

    In the order of the pivots ``L`` is lower triangular. Pivots are the largest of the remaining diagonal, so the columns come
    with falling norms; it ends when what remains is rounding.
    """
    rest = np.array(scatter, float)
    size = len(rest)
    factor = np.zeros((size, size))
    floor = size * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    open_rows = np.ones(size, bool)
    for k in range(size):
        diagonal = np.where(open_rows, rest.diagonal(), -np.inf)
        pivot = int(np.argmax(diagonal))
        if diagonal[pivot] <= floor:
            return factor[:, :k]
        column = np.where(open_rows, rest[:, pivot], 0.0) / np.sqrt(rest[pivot, pivot])
        factor[:, k] = column
        rest -= np.outer(column, column)
        open_rows[pivot] = False
    return factor


def rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns in rounds of disjoint pairs, so that every two columns meet once (circle method)."""
    circle = np.arange(size + size % 2)
    half = len(circle) // 2
    for _ in range(len(circle) - 1):
        left, right = circle[:half], circle[half:][::-1]
        real = (left < size) & (right < size)
        yield left[real], right[real]
        circle = np.concatenate((circle[:1], circle[-1:], circle[1:-1]))


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and components of ``factor @ factor.T``, by rotating the columns of ``factor`` in pairs."""
    columns = np.array(factor, float)
    size = columns.shape[1]
    for _ in range(MAX_SWEEPS if size > 1 else 0):
        worst = 0.0
        for left, right in rounds(size):
            a, b = columns[:, left], columns[:, right]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            cosine = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(cosine.max()))
            turn = cosine > NEGLIGIBLE
            if not turn.any():
                continue
            zeta = (beta - alpha)[turn] / (2 * gamma[turn])
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, tangent)
            s = c * tangent
            a, b = a[:, turn], b[:, turn]
            columns[:, left[turn]], columns[:, right[turn]] = c * a - s * b, s * a + c * b
        if worst <= size * NEGLIGIBLE:
            break
    norms = np.sqrt((columns * columns).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, columns[:, order] / norms[order]


def fixed_point(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors of a batch, and their entries as integers. Null, empty or holding what is no finite number: not usable."""
    lists = vectors.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int)
    ends = np.cumsum(sizes)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * flat)
        bad = np.flatnonzero(~(np.abs(scaled) < LARGEST))
    good = sizes > 0
    good[np.searchsorted(ends, bad, side="right")] = False
    places = np.flatnonzero(good)
    return places, [scaled[ends[p] - sizes[p] : ends[p]].astype(np.int64) + SHIFT for p in places]


def _matrices(batches: Iterable[pa.RecordBatch], column: int, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, the places of usable vectors (of ``size`` entries) in them, and these as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            places, rows = fixed_point(part.column(column))
            for length in [size] if size else sorted({len(r) for r in rows}):
                of = [i for i, r in enumerate(rows) if len(r) == length]
                if of:
                    yield part, places[of], np.array([rows[i] for i in of])


def _triangle(square: np.ndarray) -> list[float]:
    return square[np.triu_indices(len(square))].tolist()


def _square(triangle: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = triangle
    return out + np.triu(out, 1).T


def _by_place(partials: DataFrame, kind: str) -> DataFrame:
    """Sums of the tasks' arrays, place by place, as one row; ``size`` and ``n`` come along."""
    entries = partials.select("size", "n", F.posexplode("entries").alias("at", "x"))
    added = entries.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).cast(f"array<{kind}>")
    return added.groupBy("size").agg(F.max("n").alias("n"), listed.alias("entries"))


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number and exact sums of the vectors of the most frequent length (the longest of equally frequent ones)."""

    def run(batches):
        total: dict[int, list] = {}
        for _, _, rows in _matrices(batches, 0):
            had = total.setdefault(rows.shape[1], [0, np.zeros(rows.shape[1], object)])
            had[0] += len(rows)
            had[1] = had[1] + rows.sum(0).astype(object)
        for size, (n, sums) in total.items():
            values = [pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(x) for x in sums]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(values, names=["size", "n", "entries"])

    partials = vectors.mapInArrow(run, "size int, n long, entries array<string>")
    partials = partials.withColumn("entries", F.col("entries").cast("array<decimal(38,0)>"))
    row = _by_place(partials, "string").orderBy(F.desc("n"), F.desc("size")).first()  # one row per length
    return (0, np.zeros(0, object)) if row is None else (row["n"], np.array([int(x) for x in row["entries"]], object))


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S/n``, with one rounding: the whole part of the mean is taken off in integers."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return (rows - whole) - rest


def _scatter(vectors: DataFrame, n: int, sums: np.ndarray, project: np.ndarray | None = None, mean: np.ndarray | None = None) -> np.ndarray:
    """Sum over the vectors of the outer products of what is centred; of its projections less ``mean`` where these are given."""
    size = len(sums)

    def run(batches):
        total, count = None, 0
        for _, _, rows in _matrices(batches, 0, size):
            own = centred(rows, n, sums)
            if project is not None:
                own = own @ project - mean
            total = own.T @ own if total is None else total + own.T @ own
            count += len(rows)
        if total is not None:
            values = [pa.array([size], pa.int32()), pa.array([count], pa.int64()), pa.array([_triangle(total)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(values, names=["size", "n", "entries"])

    row = _by_place(vectors.mapInArrow(run, "size int, n long, entries array<double>"), "double").first()
    return _square(np.array(row["entries"]), size if project is None else project.shape[1])


def _projected_mean(vectors: DataFrame, n: int, sums: np.ndarray, project: np.ndarray) -> np.ndarray:
    size = len(sums)

    def run(batches):
        total, count = np.zeros(project.shape[1]), 0
        for _, _, rows in _matrices(batches, 0, size):
            total += (centred(rows, n, sums) @ project).sum(0)
            count += len(rows)
        if count:
            values = [pa.array([size], pa.int32()), pa.array([count], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(values, names=["size", "n", "entries"])

    row = _by_place(vectors.mapInArrow(run, "size int, n long, entries array<double>"), "double").first()
    return np.array(row["entries"]) / n


def fit(vectors: DataFrame, column: str = "embedding") -> Fit | None:
    """Fit to all usable vectors of ``column``; None where there is none. Only sums reach the driver, none larger than the square of the dimension."""
    own = vectors.select(column)
    n, sums = _sums(own)
    if not n:
        return None
    covariance = _scatter(own, n, sums) / n
    eigenvalues, components = jacobi(pivoted_cholesky(covariance))
    return Fit(n, sums, components, eigenvalues, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, fitted: Fit, k: int, column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the first ``k`` whitened coordinates less the identity, over all vectors."""
    project = fitted.components[:, :k] / np.sqrt(fitted.eigenvalues[:k])
    own = vectors.select(column)
    mean = _projected_mean(own, fitted.n, fitted.sums, project)
    covariance = _scatter(own, fitted.n, fitted.sums, project, mean) / fitted.n
    return float(np.abs(covariance - np.eye(project.shape[1])).max())


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of ``(n*x - S)**2``, exact; None where 64 bits can't hold it."""
    widest = max((abs(n * int(rows.max()) - int(s)) for s in sums), default=0)
    widest = max(widest, max((abs(n * int(rows.min()) - int(s)) for s in sums), default=0))
    if rows.shape[1] * widest * widest < 1 << 63 and all(abs(int(s)) < 1 << 62 for s in sums):
        off = n * rows - sums.astype(np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((n * x - int(s)) ** 2 for x, s in zip(row, sums, strict=True)) for row in rows.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whitened(embeddings: DataFrame, k: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component up to ``k``.

    Vectors that are null, empty or hold null, non-finite or immense entries (from 2^40 / 1024 on) are left out, and so are those
    whose length is not the most frequent one. Components are numbered from 1 by falling eigenvalue; where vectors vary in fewer
    than ``k`` directions there are as many components as these, none if all are equal or nothing is left. Components
    of equal eigenvalues are any basis of their space. ``deviation`` is null where 64 bits can't hold it. Repeated rows are
    fitted and returned like any, a null ``vec_id`` stays null, other columns are not read. Vectors of any length are held one
    slice at a time; the matrices on the driver grow with the square of the dimension, not with the rows.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(embeddings, column)
    count = 0 if fitted is None else min(k, len(fitted.eigenvalues))
    if not count:
        return spark.createDataFrame([], schema)
    error = identity_error(embeddings, fitted, count, column)
    shared = spark.sparkContext.broadcast(fitted)  # of the dimension's size

    def run(batches):
        n, sums, components, eigenvalues, trace = shared.value
        project = components[:, :count] / np.sqrt(eigenvalues[:count])
        explained = eigenvalues[:count] / trace
        for batch, places, rows in _matrices(batches, 1, len(sums)):
            out = centred(rows, n, sums) @ project
            ids = batch.column(0).take(pa.array(np.repeat(places, count)))
            numbers = len(places) * count
            arrays = [
                ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(places))), pa.array(np.full(numbers, n)),
                pa.array([d for d in deviations(rows, n, sums) for _ in range(count)], pa.int64()), pa.array(out.ravel()),
                pa.array(np.tile(explained, len(places))), pa.array(np.full(numbers, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return embeddings.select(F.col(key).cast("long").alias("vec_id"), column).mapInArrow(run, schema)
