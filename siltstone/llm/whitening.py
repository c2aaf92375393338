"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become whole numbers, so sums and the centred scatter are exact: tasks multiply in slices whose products a double
holds exactly, and their sums meet by pair of dimensions. The driver has the covariance, dimensions squared, and applies
symmetric Jacobi rotations to disjoint pairs in turn until every off-diagonal entry vanishes beside its two diagonal ones,
which gives small eigenvalues accurately; eigenvectors, sorted and divided by their deviations, are broadcast.

Defined results: vectors that are null or hold a null, NaN or infinite entry have none, nor have those whose number of
entries isn't the commonest (of equals the greater). Entries are cut to 2**34 either way. A component without variance,
to working precision, has no rows, so one vector or equal vectors give none; deviation is null beyond 63 bits. Null and
repeated ids stay; further columns don't enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Steps to one; added to each whole entry.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Vectors that a task takes at once.
SLICE = 4096
_MOST = float(SCALE) * 2.0**34


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def whole(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(64 c) of vectors of one length, as doubles."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat), -_MOST, _MOST).reshape(len(vectors), -1)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part, whole(part.column(column))


def _exact(x: np.ndarray) -> np.ndarray:
    """Products of all pairs of columns, summed, as whole numbers."""
    most = float(np.abs(x).max(initial=0)) ** 2
    if most * len(x) < 2**53:
        return (x.T @ x).astype(np.int64).astype(object)
    if most < 2**53:
        step = max(1, int(2**53 // most))
        return sum((_exact(x[i : i + step]) for i in range(0, len(x), step)), np.zeros((x.shape[1],) * 2, object))
    own = np.array([[int(v) for v in row] for row in x], dtype=object)
    return own.T.dot(own)


def sums(rows: DataFrame, column: str) -> tuple[int, int, list[int]]:
    """Dimension, vectors and sum by dimension of the vectors of the commonest length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                x = whole(batch.column(column).filter(pa.array(sizes == d))) if d else np.zeros((int((sizes == 0).sum()), 0))
                had = total.setdefault(d, [0, np.zeros(d, object)])
                had[0] += len(x)
                for i in range(0, len(x), SLICE):
                    had[1] = had[1] + x[i : i + SLICE].sum(0).astype(np.int64).astype(object)
        for d, (n, s) in total.items():
            # entry -1 counts the vectors
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * (d + 1), pa.int32()), "i": pa.array(range(-1, d), pa.int32()), "v": [str(n), *map(str, s)]})

    got = rows.select(F.size(column).alias("d"), column).mapInArrow(task, "d int, i int, v string").groupBy("d", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    most = got.filter("i = -1").orderBy(F.desc("v"), F.desc("d")).first()
    if most is None or not most["d"]:
        return 0, 0, []
    by = {r["i"]: int(r["v"]) for r in got.filter(F.col("d") == most["d"]).collect()}  # a row for each dimension
    return most["d"], by[-1], [by[i] for i in range(most["d"])]


def covariance(rows: DataFrame, column: str, n: int, s: list[int]) -> np.ndarray:
    """Of whole entries, divisor n. They are centred at the whole number next to the mean; what that leaves is taken off exactly."""
    d = len(s)
    near = [(2 * v + n) // (2 * n) for v in s]
    centre, (low, high) = np.array(near, float), np.triu_indices(d)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _slices(batches, column):
            total = total + _exact(x - centre)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"i": pa.array(low, pa.int32()), "j": pa.array(high, pa.int32()), "v": [str(v) for v in total[low, high]]})

    got = rows.select(column).mapInArrow(task, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    rest = [v - n * m for v, m in zip(s, near)]
    out = np.zeros((d, d))
    for r in got.toLocalIterator():  # dimensions squared
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["v"]) - rest[i] * rest[j]) / (n * n)
    return out


def turns(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d, in turns of disjoint ones, as in a tournament."""
    ring = list(range(d + d % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[::-1]) if max(p, q) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray, tolerance: float = 2.0**-53, sweeps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix."""
    a, v = np.array(matrix, float), np.eye(len(matrix))
    least = 1e-60 * np.abs(a).max(initial=0)
    for _ in range(sweeps):
        turned = 0
        for p, q in turns(len(a)):
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            some = np.abs(off) > np.maximum(tolerance * np.sqrt(np.abs(dp * dq)), least)
            if not some.any():
                continue
            p, q, off, dp, dq = p[some], q[some], off[some], dp[some], dq[some]
            turned += len(p)
            theta = (dq - dp) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            ap, aq = a[p], a[q]
            a[p], a[q] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
            ap, aq = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            a[p, p], a[q, q], a[p, q], a[q, p] = dp - t * off, dq + t * off, 0.0, 0.0
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if len(v) else v
    return np.diag(a)[order], v


@dataclass
class Whitening:
    """What whitens: vectors of the fit, sums by dimension, eigenvalues, and a column for each component."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    matrix: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole entries."""
        return (x - np.array([v / self.n for v in self.sums])) @ self.matrix


def fit(rows: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """None without vectors or variance. rows: usable ones."""
    d, n, s = sums(rows, column)
    if not n:
        return None
    same = rows.filter(F.size(column) == d)
    values, vectors = jacobi(covariance(same, column, n, s))
    trace = float(values.sum())
    some = min(components, int((values > d * 2.0**-52 * max(values[0], 0)).sum())) if values[0] > 0 else 0
    if not some:
        return None
    return Whitening(n, s, values[:some], trace, vectors[:, :some] / np.sqrt(values[:some]))


def identity_error(rows: DataFrame, column: str, model: Whitening) -> float:
    """Largest entry, without sign, of the whitened vectors' covariance minus the identity, from the rows. Their mean, 0 but for rounding, is taken off too."""
    shared, k = rows.sparkSession.sparkContext.broadcast(model), len(model.values)
    low, high = np.triu_indices(k)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, total = np.zeros(k), np.zeros((k, k))
        for _, x in _slices(batches, column):
            w = shared.value.apply(x)
            mean += w.sum(0)
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array([*low, *range(k)], pa.int32()), "j": pa.array([*high, *[-1] * k], pa.int32()), "v": np.r_[total[low, high], mean]})

    got = rows.select(column).mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    by = {(r["i"], r["j"]): r["v"] / model.n for r in got.collect()}  # components squared
    return max(abs(by[i, j] - by[i, -1] * by[j, -1] - (i == j)) for i, j in zip(low.tolist(), high.tolist()))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector")).filter(usable(F.col("vector")))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, "vector", components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    same = rows.filter(F.size("vector") == len(model.sums))
    error, shared = identity_error(same, "vector", model), rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, most = len(m.values), max(map(abs, m.sums))
        for part, x in _slices(batches, "vector"):
            size = len(x)
            far = m.n * float(np.abs(x).max(initial=0)) + most
            z = m.n * x.astype(np.int64) - np.array(m.sums, np.int64) if far < 2**53 and far**2 * x.shape[1] < 2**63 else np.array([[m.n * int(v) - s for v, s in zip(row, m.sums)] for row in x], dtype=object)
            deviation = [v if v < 2**63 else None for v in map(int, (z * z).sum(1))]
            own = {"key": part.column("key").take(pa.array(np.repeat(np.arange(size), k))), "component": pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), "n": pa.array(np.full(size * k, m.n), pa.int64())}
            own |= {"deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(size), k))), "whitened": m.apply(x).reshape(-1)}
            yield pa.RecordBatch.from_pydict(own | {"explained": np.tile(m.values / m.trace, size), "identity_error": np.full(size * k, error)})

    return same.mapInArrow(task, schema).withColumnRenamed("key", key)
