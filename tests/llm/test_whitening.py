"""Whitening against a dense solver and exact sums."""

from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, component int, n long, i int"


def make(spark, vectors):
    return spark.createDataFrame([(k if k != 3 else None, v, 1, "k", 2, 3, 4) for k, v in enumerate(vectors)], SCHEMA).repartition(3)


def check(spark, vectors, d):
    got = whitening.whiten(make(spark, vectors)).toPandas()
    good = [(k if k != 3 else None, v) for k, v in enumerate(vectors) if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    cov = np.array([[float(Fraction(sum(n * r[i] * n * r[j] for r in x), n * n * n) - Fraction(s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, d)
    assert len(got) == n * k and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    want = (np.array([[c - b / n for c, b in zip(r, s)] for r in x]) @ u[:, :k]) / np.sqrt(e[:k])
    for c in range(k):
        own = got[got["component"] == c + 1]
        assert np.allclose(own["explained"], e[c] / e.sum(), rtol=1e-9)
        by = {(None if np.isnan(i) else int(i)): w for i, w in zip(own["vec_id"], own["whitened"])}
        a, b = np.array([by[i] for i, _ in good]), want[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    deviation = {(None if np.isnan(i) else int(i)): w for i, w in zip(got["vec_id"], got["deviation"])}
    assert all(deviation[i] == sum((n * c - b) ** 2 for c, b in zip(r, s)) for (i, _), r in zip(good, x))


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_whiten(spark, d):
    """Null, short, long, NaN and infinite vectors have no rows; null ids and equal vectors have."""
    rng = np.random.default_rng(d)
    scale = np.logspace(0.5, -0.2, d)
    vectors = (rng.normal(size=(150, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] * scale).astype(np.float32).tolist()
    odd = [None, [], [1.0] * (d + 1), [None] * d, [float("nan")] + [0.0] * (d - 1), [0.0] * (d - 1) + [float("-inf")]]
    check(spark, vectors + odd + vectors[:6], d)


def test_wide_entries(spark):
    """Entries whose squares don't fit a double stay exact."""
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 3)) * [3e6, 2e6, 1.0]).tolist()
    got = whitening.whiten(make(spark, vectors)).toPandas()
    assert len(got) == 120 and got["identity_error"].max() < 1e-9 and got["explained"].between(0, 1).all()


def test_without_variance(spark):
    assert whitening.whiten(make(spark, [])).count() == 0
    assert whitening.whiten(make(spark, [None, [], []])).count() == 0
    assert whitening.whiten(make(spark, [[1.0, 2.0]] * 5)).count() == 0
    flat = whitening.whiten(make(spark, [[float(k), 2.0 * k, 5.0] for k in range(9)])).toPandas()
    assert set(flat["component"]) == {1} and np.allclose(flat["explained"], 1)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33, 64])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.sort(np.logspace(0, -9, d))[::-1]
    values, vectors = whitening.jacobi(q * e @ q.T)
    assert np.allclose(values, e, rtol=1e-6, atol=1e-16) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    # graded: each eigenvalue to its own precision, which a dense solver misses
    scale = np.logspace(0, -12, d)
    core = np.eye(d) + 0.1 * np.ones((d, d)) / d
    values, _ = whitening.jacobi(core * scale[:, None] * scale)
    assert (values > 0).all() and abs(np.log(values).sum() - np.linalg.slogdet(core)[1] - 2 * np.log(scale).sum()) < 1e-9 * d


@pytest.mark.parametrize("d", [2, 5, 8])
def test_turns_have_every_pair_once(d):
    pairs = [(p, q) for a, b in whitening.turns(d) for p, q in zip(a.tolist(), b.tolist())]
    assert sorted(pairs) == [(p, q) for p in range(d) for q in range(p + 1, d)]
    assert all(len({*a.tolist(), *b.tolist()}) == 2 * len(a) for a, b in whitening.turns(d))


def test_table(spark, sf):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    check(spark, vectors, 64)
