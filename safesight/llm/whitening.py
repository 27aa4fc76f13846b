"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors become whole numbers x = floor(scale * c). The fit list has each distinct x
once. Its sums are exact, its scatter is summed over values that are centred first, in
blocks within tasks; a d x d matrix a task is all that is shuffled. The scatter is
factored with pivots as L L^T; rotations of L's columns in pairs make them orthogonal.
Then the squared norms of the columns are the scatter's eigenvalues, and the columns,
normalised, its eigenvectors: the scatter is never multiplied out again, so small
eigenvalues keep their digits. The factoring sees d rows, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import discard, table_path, written

#: Models up to so many bytes are broadcast.
MODEL_BYTES = 64 << 20
#: Rounds of rotations at most; they converge quadratically, in about ten.
SWEEPS = 60


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def sound(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and rows of the vectors of one length after another."""
    lists = batch.column(column)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
    size = np.diff(ends)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, values[ends[at][:, None] + np.arange(d)]


def sums(fit: DataFrame) -> DataFrame:
    """Per length dim: n and the exact sums (decimal) of a fit list (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for at, x in _blocks(b, "x"):
                n, total = held.get(x.shape[1], [0, 0])
                # in two halves, so that no sum overflows
                held[x.shape[1]] = [n + len(at), total + (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)]
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["dim", "n", "s"])

    parts = fit.mapInArrow(run, "dim int, n long, s array<string>")
    entries = parts.select("dim", "n", F.posexplode("s").alias("i", "s")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    return entries.groupBy("dim").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("s"))


def scatter(fit: DataFrame) -> DataFrame:
    """Rows (dim, i, row) of the centred scatter of a fit list (x, and the mean of its length), summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            means = b.column("mean")
            for at, x in _blocks(b, "x"):
                own = x - np.array(means[int(at[0])].as_py())
                total[x.shape[1]] = total.get(x.shape[1], 0) + own.T @ own
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "i", "row"])

    rows = fit.mapInArrow(run, "dim int, i int, row array<double>")
    entries = rows.select("dim", "i", F.posexplode("row").alias("j", "v")).groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    return entries.groupBy("dim", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("row"))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L^T, rows in a's order: triangular in the order of its pivots, a column per pivot over rounding error."""
    a, d = a.copy(), len(a)
    columns, left = [], np.ones(d, bool)
    limit = d * np.finfo(float).eps * max(np.diag(a).max(initial=0.0), 0.0)
    while left.any():
        at = int(np.argmax(np.where(left, np.diag(a), -np.inf)))
        if a[at, at] <= limit:
            break
        column = np.where(left, a[:, at] / np.sqrt(a[at, at]), 0.0)
        a -= np.outer(column, column)
        left[at] = False
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((d, 0))


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and directions of factor's columns after rotations that make all of them orthogonal.

    A sweep meets every pair once, in rounds of pairs without a common column, each
    round one array operation.
    """
    u = factor.copy()
    d, r = u.shape
    tolerance = np.finfo(float).eps * max(d, 1)
    size = r + r % 2
    ring = np.arange(size)
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(size - 1):
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = u[:, p], u[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > tolerance * np.sqrt(a * b)
            if turn.any():
                rotated = True
                p, q, x, y, a, b, c = p[turn], q[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                u[:, p], u[:, q] = cos * x - sin * y, sin * x + cos * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not rotated:
            break
    else:
        raise RuntimeError("the rotations did not settle")
    e = (u * u).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order] / np.sqrt(e[order])


def components(scattered: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Per length: the first k components (fewer, if the rank is lower) as arrays: e, explained, axes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(rows.sort_values("i")["row"].to_numpy())
        n = int(rows["n"].iloc[0])
        e, axes = jacobi(pivoted_cholesky((a + a.T) / 2))
        trace = np.trace(a)
        return pd.DataFrame([(key[0], (e[:k] / n).tolist(), (e[:k] / trace).tolist(), [v.tolist() for v in axes.T[:k]])], columns=["dim", "e", "explained", "axes"])

    return scattered.join(totals.select("dim", "n"), "dim").groupBy("dim").applyInPandas(run, "dim int, e array<double>, explained array<double>, axes array<array<double>>")


def _whitened(x: Column, mean: Column, axes: Column, e: Column) -> Column:
    """Centred x on every component, over the root of its eigenvalue."""
    centred = F.zip_with(x, mean, lambda v, m: v.cast("double") - m)
    dot = lambda axis: F.aggregate(F.zip_with(F.col("_centred"), axis, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return centred, F.zip_with(axes, e, lambda axis, own: dot(axis) / F.sqrt(own))


def _projected(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (.., x) with their length's model and whitened, an array of k."""
    met = rows.withColumn("dim", F.size("x")).join(model, "dim")
    centred, whitened = _whitened(F.col("x"), F.col("mean"), F.col("axes"), F.col("e"))
    return met.withColumn("_centred", centred).withColumn("whitened", whitened).drop("_centred")


def whiten(rows: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, x, n, deviation (decimal), whitened, explained and identity_error; arrays have an entry per component, k at most.

    Left out: vectors that are null or hold null or non-finite entries. Vectors of another
    length are a fit of their own. A component whose eigenvalue is rounding error (fewer
    distinct vectors than components, or a constant dimension) has no entry; without any,
    identity_error is null. Repeated and equal rows are kept, the fit counts them once; other columns
    of rows don't matter. Entries of 2^63 / scale and more saturate;
    a deviation over 38 digits is null.
    """
    spark = rows.sparkSession
    paths = [table_path(spark) for _ in range(4)]
    clean = rows.where(sound(F.col(vector_col))).select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("x")).where(F.size("x") > 0)
    fit = written(clean.select("x").distinct(), paths[0])
    totals = written(sums(fit), paths[1])
    size = totals.agg(F.coalesce(F.sum(F.col("dim") * (k + 3) * 8), F.lit(0))).first()[0]
    sent = F.broadcast if size <= MODEL_BYTES else lambda df: df
    means = totals.select("dim", F.transform("s", lambda s: s.cast("double") / F.col("n")).alias("mean"))
    found = written(components(scatter(fit.withColumn("dim", F.size("x")).join(sent(means), "dim").select("x", "mean")), totals, k), paths[2])
    model = sent(found.join(totals, "dim").join(means, "dim").select("dim", "n", "s", "mean", "e", "explained", "axes"))
    errors = written(_identity_error(_projected(fit, model).select("dim", "whitened"), k), paths[3])
    far = F.zip_with("x", "s", lambda v, s: (v.cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)") - s).cast("decimal(38,0)"))
    deviation = F.aggregate(far, F.lit(0).cast("decimal(38,0)"), lambda t, v: F.try_add(t, F.try_multiply(v, v)).cast("decimal(38,0)"))
    out = _projected(clean, model).withColumn("deviation", deviation).join(sent(errors), "dim", "left")
    discard(spark, paths[0])
    return out.select(F.col("id").alias(id_col), "x", "n", "deviation", "whitened", "explained", "identity_error")


def _identity_error(projected: DataFrame, k: int) -> DataFrame:
    """Per length: the largest absolute entry of whitened's covariance (centred, divisor n) minus the identity."""
    w = lambda i: F.get("whitened", F.lit(i))  # noqa: E731  null beyond the rank
    entries = [F.abs(F.covar_pop(w(i), w(j)) - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    return projected.groupBy("dim").agg(F.array_max(F.array(*entries)).alias("identity_error"))


def components_of(rows: DataFrame, k: int = 4) -> DataFrame:
    """Whitened embeddings as one row per vector and component: vec_id, component, n, deviation (long), whitened, explained, identity_error."""
    long = whiten(rows, k).select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
