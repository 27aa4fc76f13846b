"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from safesight.llm import queries as q
from safesight.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def check(rows, got, k=4):
    """rows: id, vector of one length, sound ones."""
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rank = min(k, int((e > 1e-9 * e.max()).sum()) if e.max() > 0 else 0)
    own = sorted((r for r in got), key=lambda r: (r.vec_id, r.deviation, r.component))
    assert len(own) == rank * len(rows) and {r.n for r in own} <= {n}
    want = sorted((i, int(((n * a.astype(object) - s.astype(object)) ** 2).sum()), k) for (i, _), a in zip(rows, x) for k in range(1, rank + 1))
    assert [(r.vec_id, r.deviation, r.component) for r in own] == want
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], int(((n * x[i].astype(object) - s.astype(object)) ** 2).sum())))
    w = np.array([[r.whitened for r in own if r.component == c] for c in range(1, rank + 1)]).T
    wanted = ((x - s / n) @ u[:, :rank] / np.sqrt(e[:rank]))[order]
    assert np.allclose(w * np.sign((w * wanted).sum(0)), wanted, atol=1e-8)
    assert np.allclose([next(r.explained for r in own if r.component == c) for c in range(1, rank + 1)], e[:rank] / e.sum(), rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in own)


def test_against_numpy(spark):
    """Nulls, bad entries, repeated rows and vectors, minus zero, clashing names, other lengths."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5] + 40).round(3).tolist()) for i in range(80)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(40)] + [rows[5], rows[5], (None, rows[9][1]), (7, [0.0, -0.0, 1.0, 2.0, 3.0, 4.0])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [1.0] * 5), (204, [])]
    short = [(300 + i, [float(i % 4), float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows + bad + short, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("dim", "n", "x", "s", "mean", "e")})
    got = whitening.components_of(df).collect()
    rows = [r for r in rows if r[0] is not None]
    assert sum(r.vec_id is None for r in got) == 4
    check(rows, [r for r in got if r.vec_id is not None and r.vec_id < 300])
    check(short, [r for r in got if r.vec_id is not None and r.vec_id >= 300])


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0, 3.0]] * 3, [[1.0, 2.0, 3.0], [2.0, 2.0, 3.0]], [[1.0, 5.0, 0.0], [2.0, 5.0, 1.0], [4.0, 5.0, 7.0]]])
def test_low_rank(spark, vectors):
    """Empty tables, one vector, two, and a constant dimension: only components there are."""
    rows = list(enumerate(vectors))
    got = whitening.components_of(spark.createDataFrame(rows, SCHEMA)).collect()
    if rows:
        check(rows, got)
    else:
        assert got == []


def test_large_entries(spark):
    """Entries near 2^55 saturate nothing; a deviation beyond a long is null there."""
    rows = [(i, [float(2**46 + i * 2**30), float(i % 3)]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 1).collect()
    assert all(r.deviation is not None for r in got) and len(got) == 10
    assert {r.deviation for r in whitening.components_of(spark.createDataFrame(rows, SCHEMA)).collect()} == {None}


def test_factor_and_rotations():
    """Small eigenvalues keep their digits."""
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    e = np.logspace(8, -2, 40)
    low = whitening.pivoted_cholesky((u * e) @ u.T)
    assert np.allclose(low @ low.T, (u * e) @ u.T, atol=1e-6)
    found, axes = whitening.jacobi(low)
    assert np.allclose(found, e, rtol=1e-4) and np.allclose(np.abs((axes * u).sum(0))[:30], 1, atol=1e-6)
    assert np.abs(axes.T @ axes - np.eye(40)).max() < 1e-12


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, q.op13_whitening(spark, sf).collect())
