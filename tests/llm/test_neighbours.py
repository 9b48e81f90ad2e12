"""Recall against brute force, exact scores and order, balance, odd vectors."""
import numpy as np
import pytest

from riskloom.llm import neighbours as N

KIND = "vec_id long, embedding array<float>, label int"


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def run(spark, ids, x, **args):
    df = spark.createDataFrame([(int(i), [float(f) for f in v], 0) for i, v in zip(ids, x, strict=True)], KIND)
    rows = N.search(df.repartition(3), "id % 100 = 0", **args).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_embeddings(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = sorted(df.collect())
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got = {}
    for r in N.search(df, "id % 100 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (10 * len(want))
    assert hit >= 0.9


def test_learned_parts_find_clustered_neighbours_in_a_few_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 300)
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(0, 40, 4000)] + rng.normal(scale=0.1, size=(4000, 16))).astype(np.float32)
    x[:1300] = x[0]  # one vector holds a third of the rows
    ids = rng.permutation(4000).tolist()
    want = brute(ids, x.astype(np.float64), [i for i in range(0, 4000, 100)])
    got = run(spark, ids, x)
    same = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(same) >= 9
    for q, rows in got.items():  # exact scores, nearest first, ties to the smaller id
        i = ids.index(q)
        for v, s in rows:
            assert s == pytest.approx(np.sqrt(((x[ids.index(v)].astype(float) - x[i]) ** 2).sum()), abs=1e-12)
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
    router = N.Router.fit(x[rng.permutation(4000)[:2000]].astype(np.float64))
    assert router.routes(x[1300:].astype(np.float64)).mean() < 0.4


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(8, 8)) * 5, 100, axis=0) + rng.normal(size=(800, 8))
    graph = N.neighbour_graph(x)
    part = N.partition_graph(graph, x, 8)
    assert np.bincount(part, minlength=8).max() <= 106
    assert (part[graph] != part[:, None]).mean() < 0.2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (200, [0.0, 0.0], 0),
            (300, None, 0), (400, [nan, 1.0], 0), (500, [inf, 1.0], 0), (600, [None, 1.0], 0), (700, [], 0),
            (None, [1.0, 0.0], 0), (800, [1.0, 2.0, 3.0], 0), (3, [1.0, 0.0], None), (0, [5.0, 5.0], 1)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS part", "2 AS rank")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in N.search(df, "id % 100 = 0").collect())
    # every row asks, also the two that share the id 0, and is a candidate of the other
    first = [(3, 0.0), (1, 1.0), (2, 1.0), (100, 1.414214), (0, 6.403124)]
    second = [(1, 5.656854), (2, 5.656854), (0, 6.403124), (3, 6.403124), (100, 6.403124)]
    third = [(1, 1.0), (2, 1.0), (0, 1.414214), (3, 1.414214), (0, 6.403124)]
    assert got == sorted((q, n + 1, v, d) for q, rows in ((0, first), (0, second), (100, third))
                         for n, (v, d) in enumerate(rows))
    assert N.search(df.limit(0), "id % 100 = 0").count() == 0


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e150, 0.0]), (1, [2e150, 0.0]), (2, [1e160, 1e160]), (3, [1e-170, 2e-170]), (4, [3e-170, 0.0]),
            (100, [1e-170, 0.0]), (5, [1.0, 1.0]), (6, [1.7e308, 0.0]), (200, [-1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.search(df, "id % 100 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[0]][:5] == [1, 3, 4, 5, 100] and [v for v, _ in got[100]][:3] == [3, 4, 5]
    assert dict(got[0])[1] == pytest.approx(1e150) and dict(got[0])[2] == pytest.approx(np.hypot(1e160, 1e160))
    assert dict(got[100])[3] == pytest.approx(2e-170) and dict(got[100])[4] == pytest.approx(2e-170)
    assert got[200][-1] == (6, float("inf")) and len(got[200]) == 8
    assert all(np.isfinite(s) for q in (0, 100) for v, s in got[q] if v not in (6, 200))
