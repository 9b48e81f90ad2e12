"""Whitening against exact sums, a dense eigensolver and known spectra."""
import math
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import whitening as W
from riskloom.llm.registry import op11_whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, k=8):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, dev, y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def test_query_equals_brute_force(spark):
    got = op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    src = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, dev, white, share = brute(src["embedding"].tolist())
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert got["deviation"].tolist() == np.repeat(np.array(dev, object), 8).tolist()
    have = got["whitened"].to_numpy().reshape(n, 8)
    sign = np.sign((have * white).sum(0))
    assert np.abs(have * sign - white).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(n, 8), share, rtol=1e-10)
    cov = have.T @ have / n - np.outer(have.mean(0), have.mean(0))
    error = got["identity_error"].unique()
    assert len(error) == 1 and abs(error[0] - np.abs(cov - np.eye(8)).max()) < 1e-12 and error[0] < 1e-10


@pytest.mark.parametrize("width", [1e-3, 1e-7, 1e-10, 0.0])
def test_clusters_are_separated(width):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    lam = np.sort(np.concatenate([3 + width * np.arange(6), 2 + width * np.arange(5), rng.random(29)]))[::-1]
    a = (q * lam) @ q.T
    a = (a + a.T) / 2
    e, x = W.refined_eigenvectors(a)
    assert np.allclose(e, lam, atol=1e-13)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
    assert np.abs(a @ x - x * e).max() < 1e-14
    plain = W._correction(a, np.linalg.eigh(a.astype(np.float32))[1].astype(float))
    assert np.abs(a @ x - x * e).max() < np.abs(plain[0]).max()      # float32 alone is far off


def test_refinement_corrects_float32():
    a = np.diag([5.0, 3, 2, 1]) + 0.3
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    e, x = W.refined_eigenvectors(a)
    want = np.linalg.eigh(a)[1][:, ::-1]
    assert np.abs(np.abs(x) - np.abs(want)).max() < 1e-14 < np.abs(np.abs(start[:, ::-1]) - np.abs(want)).max()


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(30, 4)).round(3)
    good[5] = good[4]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(good)]
    rows[7] = (None, rows[7][1], 1)
    rows[8] = (3, rows[8][1], 1)
    odd = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0, 3.0], 1), (103, [float("nan")] * 4, 1),
           (104, [float("inf"), 0.0, 0.0, 0.0], 1), (105, [1.0, 2.0], 1), (106, [1e300, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component int").repartition(5)
    got = W.whiten(df).toPandas()
    n, dev, white, share = brute(good.tolist())
    assert len(got) == 30 * 4 and got["vec_id"].isna().sum() == 4 and (got["vec_id"] == 3).sum() == 8
    assert sorted(got["deviation"]) == sorted(np.repeat(dev, 4).tolist())
    first = got[got.component == 1]["whitened"].to_numpy()
    assert np.allclose(np.sort(np.abs(first)), np.sort(np.abs(white[:, 0])), atol=1e-10)


def test_no_rows_and_no_spread(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [0.5, 1.0])], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(i, [0.5, 1.0]) for i in range(4)], kind)).count() == 0
    flat = W.whiten(spark.createDataFrame([(i, [0.5, float(i)]) for i in range(4)], kind)).collect()
    assert len(flat) == 4 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_large_numbers_are_exact_or_null():
    x = np.array([[2 ** 40, 1], [0, 1], [3, 3]], np.int64)
    total = [2 ** 40 + 3, 5]
    got = W.deviations(x, 3, total).to_pylist()
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, total)) for r in x]
    assert got == [w if w < 1 << 63 else None for w in want] and None in got
    assert W.deviations(np.array([[5, 7]], np.int64), 1, [4, 9]).to_pylist() == [5]
