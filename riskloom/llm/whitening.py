"""Embedding whitening: float32 eigenvectors refined in higher precision.

Every entry c of a vector becomes the integer floor(1024 * c) + 100000. The tasks
reduce their rows to exact sums, then to one matrix of products of the centred
integers each; the matrices meet in Spark (by matrix row, in two steps), and the
covariance alone (one d x d matrix) reaches the driver. There its eigenvectors are
found in float32 and corrected by Ogita-Aishima steps, which are matrix products:
in float64 until they converge, then in extended precision. Eigenvalues that the
steps cannot tell apart are a cluster; a small eigenproblem inside the space of the
cluster, shifted by its mean, separates them. The rows are projected in a last pass,
after a pass that measures the covariance of the result.

Centring is exact: products are taken of x minus the rounded mean, and the rest of
the mean (at most one half) is taken off afterwards.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries
(or entries too large for a long) are left out. Of vectors of several lengths those of
the commonest length are fitted and returned (ties: the longest). Rows that repeat are
rows like any other, a null id stays. ``deviation`` is null where the exact number does
not fit a long. A component whose eigenvalue is zero up to rounding has no whitened
value and is left out, so equal vectors and an empty table give no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, sum_arrays

SCALE, SHIFT = 1024.0, 100_000
#: Entries beyond this do not fit a long after scaling.
LARGEST = 2.0 ** 62
HIGH = np.longdouble


def integer_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Lengths of the usable vectors (0: left out) of all rows, and the integers of
    those rows, one flat array with offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    off = np.concatenate(([0], np.cumsum(size)))
    value = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    scaled = np.floor(value * SCALE)
    bad = ~(np.abs(scaled) < LARGEST)
    if bad.any():
        wrong = np.unique(np.searchsorted(off, np.flatnonzero(bad), side="right") - 1)
        keep = np.ones(n, bool)
        keep[wrong] = False
        scaled = scaled[np.repeat(keep, size)]
        size = np.where(keep, size, 0)
        off = np.concatenate(([0], np.cumsum(size)))
    return size, scaled.astype(np.int64) + SHIFT, off


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of ``dim`` entries, and their integers."""
    size, flat, off = integer_vectors(column)
    rows = np.flatnonzero(size == dim)
    return rows, flat[np.repeat(size == dim, size)].reshape(len(rows), dim)


def vector_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, rows, exact sums) of the commonest length; (0, 0, []) without rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            size, flat, off = integer_vectors(batch.column("v"))
            for dim in np.unique(size[size > 0]).tolist():
                x = flat[np.repeat(size == dim, size)].reshape(-1, dim)
                # halves of the numbers, so that their sums fit a long
                part = [len(x), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]
                have = total.get(dim)
                total[dim] = part if have is None else [a + b for a, b in zip(have, part)]
        for dim, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)),
                 pa.array(np.full(dim, n, np.int64)), pa.array(high), pa.array(low)], ["dim", "i", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "dim int, i int, n long, high long, low long")
    sums = scratch(parts.groupBy("dim", "i").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("high").cast("decimal(38,0)")) * F.lit(1 << 32).cast("decimal(11,0)")
         + F.sum(F.col("low").cast("decimal(38,0)"))).cast("decimal(38,0)").alias("s")), "vector-sums")
    first = sums.filter("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return 0, 0, []
    rows = sums.filter(F.col("dim") == first["dim"]).orderBy("i").collect()     # one row per dimension
    return first["dim"], first["n"], [int(r["s"]) for r in rows]


def products(vectors: DataFrame, dim: int, size: int, centred) -> np.ndarray:
    """Sum over all vectors of y y', where y = ``centred``(integer matrix) has ``size`` columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = centred(matrix(batch.column("v"), dim)[1])
            total += y.T @ y
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, task, np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * size), pa.array(total.ravel()))],
            ["i", "task", "g"])

    parts = vectors.mapInArrow(run, "i int, task int, g array<double>")
    rows = sum_arrays(parts).orderBy("i").collect()     # size x size numbers
    return np.array([r["g"] for r in rows]) if rows else np.zeros((size, size))


def _clusters(lam: np.ndarray, delta: float) -> list[np.ndarray]:
    """Index sets of eigenvalues that lie within ``delta`` of a neighbour (two and more)."""
    order = np.argsort(lam)
    cuts = np.flatnonzero(np.diff(lam[order]) > delta) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _correction(a: np.ndarray, x: np.ndarray):
    """One Ogita-Aishima step: (E, eigenvalues, delta), to be used as x + x E."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    lam = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(lam)
    top = np.abs(lam).max()
    delta = 2 * (np.sqrt((off ** 2).sum()) + top * np.sqrt((r ** 2).sum()))
    # gaps below the rounding of the products say nothing
    delta = max(delta, len(a) * np.finfo(a.dtype).eps * top)
    gap = lam[None, :] - lam[:, None]
    far = np.abs(gap) > delta
    e = np.where(far, (s + lam[None, :] * r) / np.where(far, gap, 1), r / 2)
    return e, lam, delta


def _separate(a: np.ndarray, x: np.ndarray, lam: np.ndarray, delta: float) -> np.ndarray:
    """Eigenvectors inside each cluster from the eigenproblem of its space, shifted by its mean."""
    x = x.copy()
    for c in _clusters(lam, delta):
        basis = x[:, c]
        shifted = basis.T @ (a @ basis - lam[c].mean() * basis)
        overlap = basis.T @ basis
        # orthonormal up to rounding: one symmetric correction of the basis suffices
        fix = 1.5 * np.eye(len(c), dtype=a.dtype) - overlap / 2
        inner = fix.T @ shifted @ fix
        width = np.abs(inner).max()
        if width > 0:
            turn = np.linalg.eigh(((inner + inner.T) / (2 * width)).astype(np.float64))[1]
            x[:, c] = basis @ fix @ turn.astype(a.dtype)
    return x


def refined_eigenvectors(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the symmetric ``a``."""
    scale = np.abs(a).max()
    if not scale > 0:
        return np.zeros(len(a)), np.eye(len(a))
    high = a.astype(HIGH) / HIGH(scale)
    x = np.linalg.eigh(high.astype(np.float32))[1].astype(np.float64)
    for kind, goal in ((np.float64, 1e-11), (HIGH, 1e-17)):
        m, x = high.astype(kind), x.astype(kind)
        for step in range(steps):
            e, lam, delta = _correction(m, x)
            x = x + x @ e
            size = np.abs(e).max()
            if size < 1e-5:        # the spaces of the clusters have settled
                x = _separate(m, x, lam, delta)
            if step and size < goal:
                break
    for _ in range(2):         # rounding left by small gaps: symmetric orthonormalisation
        x = 1.5 * x - x @ (x.T @ x) / 2
    lam = (x * (high @ x)).sum(0)
    order = np.argsort(-lam, kind="stable")
    return (lam[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Per row the exact sum of (n * x - total) ** 2; null where it does not fit a long."""
    dim = x.shape[1]
    nearest = np.array([_rounded(n, s) for s in total], np.int64)
    rest = [s - n * int(r) for s, r in zip(total, nearest)]        # at most n / 2
    away = x - nearest
    largest = np.abs(away).max(1, initial=0)
    out, valid = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    plain = (largest.astype(np.float64) * n + n) ** 2 * dim < 2.0 ** 62
    if plain.any():
        t = away[plain] * np.int64(n) - np.array(rest, np.int64)
        out[plain] = (t * t).sum(1)
    for k in np.flatnonzero(~plain).tolist():
        exact = sum((n * int(v) - q) ** 2 for v, q in zip(away[k], rest))
        valid[k] = exact < 1 << 63
        out[k] = exact if valid[k] else 0
    return pa.array(out, mask=~valid)


def _rounded(n: int, total: int) -> int:
    return (2 * total + n) // (2 * n)


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector and component (up to ``k``): vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    vectors = rows.select("v")
    dim, n, total = vector_sums(vectors)
    if not n:
        return spark.createDataFrame([], fields)
    nearest = np.array([_rounded(n, s) for s in total], np.int64)
    rest = np.array([float(Fraction(s, n) - int(r)) for s, r in zip(total, nearest)])

    gram = products(vectors, dim, dim, lambda x: (x - nearest).astype(np.float64))
    cov = (gram / n - np.outer(rest, rest))
    values, vecs = refined_eigenvectors((cov + cov.T) / 2)
    real = int((values[:k] > max(values[0], 0) * dim * 2.0 ** -50).sum())
    if not real:
        return spark.createDataFrame([], fields)
    turn = vecs[:, :real] / np.sqrt(values[:real])
    explained = values[:real] / np.trace(cov)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - nearest).astype(np.float64) - rest) @ turn

    # sums and products of the whitened values: a column of ones beside them
    moments = products(vectors, dim, real + 1, lambda x: np.column_stack([project(x), np.ones(len(x))])) / n
    mean = moments[-1, :-1]
    error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(real)).max())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = matrix(batch.column("v"), dim)
            if not len(keep):
                continue
            take = pa.array(np.repeat(keep, real))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array(np.tile(np.arange(1, real + 1, dtype=np.int32), len(keep))),
                 pa.array(np.full(len(take), n, np.int64)),
                 deviations(x, n, total).take(pa.array(np.repeat(np.arange(len(keep)), real))),
                 pa.array(project(x).ravel()), pa.array(np.tile(explained, len(keep))),
                 pa.array(np.full(len(take), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, fields)
