"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (``SAMPLE`` vectors in hash order): the exact neighbour
graph of the sample is partitioned into ``PARTS`` parts of nearly equal size by
capacity-limited label propagation; a small classifier learns the part of a
vector, a second one the share of its neighbours in each part. Index: every
vector goes into its most probable part. Search: a query visits its most probable
parts until they hold enough probability (chosen on a held-out fifth of the
sample for a recall of ``RECALL``), and the members of these parts are ranked by
their exact distance.

Parts and the queries routed to one are cut into blocks by hash, and each pair of
blocks is one unit of work of bounded size; a unit gives the ``k`` best of each
query, which are merged in a last aggregation.

Defined results: vectors that are null, empty, all zero or hold null or
non-finite components take no part, as rows with a null id; vectors of another
length than the most frequent take no part; equal distances rank by smaller id;
rows that share an id each stand for themselves, as candidates and as queries (whose
answers then share query_id); components of any finite size are compared (a distance
beyond the largest double is infinite); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, ship

SAMPLE, PARTS, GRAPH_K, HIDDEN, STEPS, SEED = 6144, 16, 10, 48, 300, 11
RECALL, LEAST_PARTS = 0.95, 2
BLOCK, QUERY_BLOCK = 16_384, 2_048


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """The k nearest other rows of each row (by blocks of rows)."""
    norm = (x * x).sum(1)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = norm[None, :] - 2 * (x[a:a + 512] @ x.T)
        d[np.arange(d.shape[0]), np.arange(a, a + d.shape[0])] = np.inf
        out[a:a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def partition_graph(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 30, seed: int = SEED) -> np.ndarray:
    """Part of each node: balanced, with few edges between parts.

    Starts from balanced splits along principal directions; then every node moves
    to the part that holds most of its neighbours (edges taken both ways) as long
    as that part has room.
    """
    n = len(graph)
    rng = np.random.default_rng(seed)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups.sort(key=len)
        rows = groups.pop()
        y = x[rows] - x[rows].mean(0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):  # power iteration
            axis = y.T @ (y @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order = np.argsort(y @ axis, kind="stable")
        groups += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    part = np.zeros(n, np.int64)
    for i, rows in enumerate(groups):
        part[rows] = i
    room = int(np.ceil(1.05 * n / parts))
    src = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.concatenate((src, graph.reshape(-1))), np.concatenate((graph.reshape(-1), src))
    for _ in range(rounds):
        near = np.zeros((n, parts))
        np.add.at(near, (a, part[b]), 1)
        best = near.argmax(1)
        gain = near[np.arange(n), best] - near[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:(gain > 0).sum()].tolist():
            if size[best[i]] < room:
                size[part[i]] -= 1
                part[i] = best[i]
                size[best[i]] += 1
                moved += 1
        if not moved:
            break
    return part


def _train(x: np.ndarray, want: np.ndarray, seed: int) -> dict:
    """Softmax classifier with one hidden layer, fitted to the (soft) targets by Adam."""
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1], want.shape[1]
    w = {"a": rng.normal(0, dim ** -0.5, (dim, HIDDEN)), "ab": np.zeros(HIDDEN),
         "c": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, parts)), "cb": np.zeros(parts)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, len(x), 512)
        q = x[rows]
        h = np.maximum(q @ w["a"] + w["ab"], 0)
        z = h @ w["c"] + w["cb"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - want[rows]) / len(rows)
        dh = (dz @ w["c"].T) * (h > 0)
        grad = {"a": q.T @ dh + 2e-4 * w["a"], "ab": dh.sum(0), "c": h.T @ dz + 2e-4 * w["c"], "cb": dz.sum(0)}
        rate = 0.01 * min(1, 2 * (1 - step / (STEPS + 1)))
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return w


def _softmax(w: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(x @ w["a"] + w["ab"], 0)
    z = h @ w["c"] + w["cb"]
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Router:
    """Two small classifiers: the part of a vector, and where its neighbours are."""

    def __init__(self, index: dict | None, route: dict | None, scale: float, parts: int, mass: float):
        self.index, self.route, self.scale, self.parts, self.mass = index, route, scale, parts, mass

    @classmethod
    def fit(cls, x: np.ndarray, parts: int = PARTS, recall: float = RECALL, seed: int = SEED) -> Router:
        """Partition the neighbour graph of the sample, learn the parts, and choose the
        probability mass to visit on the fifth of the sample that routing is not
        learned from."""
        parts = max(1, min(parts, len(x) // (4 * GRAPH_K)))
        if parts == 1:
            return cls(None, None, 1.0, 1, 1.0)
        scale = max(float(np.sqrt((x * x).mean())), 1e-12)
        x = x / scale
        graph = neighbour_graph(x)
        part = partition_graph(graph, x, parts, seed=seed)
        index = _train(x, np.eye(parts)[part], seed)
        part = _softmax(index, x).argmax(1)
        # share of each vector's neighbours per part, as the index places them
        share = np.zeros((len(x), parts))
        np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].reshape(-1)), 1 / graph.shape[1])
        tested = np.arange(len(x)) % 5 == 0
        route = _train(x[~tested], share[~tested], seed + 1)
        router = cls(index, route, scale, parts, 1.0)
        for mass in (0.5, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 1.0):
            router.mass = mass
            if (share[tested] * router.routes(x[tested] * scale)).sum(1).mean() >= recall:
                break
        return router

    def part_of(self, x: np.ndarray) -> np.ndarray:
        if self.index is None:
            return np.zeros(len(x), np.int64)
        return _softmax(self.index, x / self.scale).argmax(1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        """Boolean matrix of the parts that each query visits, most probable first."""
        if self.route is None:
            return np.ones((len(x), 1), bool)
        p = _softmax(self.route, x / self.scale)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        before = np.cumsum(ranked, 1) - ranked
        go = (before < self.mass) | (np.arange(self.parts)[None, :] < LEAST_PARTS)
        out = np.zeros_like(go)
        np.put_along_axis(out, order, go, 1)
        return out


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec array<double>) of the rows that take part, and the vector length."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(
        "id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0"
        " AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(vec, x -> x != 0)")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = length[0].n if length else 0
    return rows.filter(F.size("vec") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_router(vectors: DataFrame, dim: int, sample: int = SAMPLE, parts: int = PARTS,
               recall: float = RECALL) -> Router:
    """Fit on at most ``sample`` rows (in hash order) of the valid vectors (id, vec)."""
    rows = (vectors.orderBy(F.xxhash64("id"), "id", "vec").limit(sample)).toPandas()
    x = np.array(rows["vec"].tolist(), np.float64).reshape(len(rows), dim)
    return Router.fit(np.unique(x, axis=0), parts, recall)


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, also where squares leave the range of doubles."""
    with np.errstate(over="ignore"):
        away = np.abs(rows - q)
        d = np.sqrt((away ** 2).sum(1))
    odd = np.flatnonzero(~((d > 1e-140) & (d < 1e140)))
    if len(odd):
        top = away[odd].max(1)
        some = np.isfinite(top) & (top > 0)
        d[odd] = top
        part = away[odd[some]] / top[some][:, None]
        with np.errstate(over="ignore"):
            d[odd[some]] = np.sqrt((part ** 2).sum(1)) * top[some]
    return d


def nearest(q: np.ndarray, v: np.ndarray, q_row: np.ndarray, v_row: np.ndarray, v_id: np.ndarray, k: int):
    """(query, vector, distance) of the k nearest of each query but its own row, ties by id.

    The product form only preselects, on vectors scaled by their largest component and
    with room for the rounding of each pair; distances and order come from the
    differences themselves.
    """
    out = []
    scale = max(np.abs(v).max(initial=0), np.abs(q).max(initial=0), 1e-300)
    small = v / scale
    vv = (small * small).sum(1)
    for a in range(0, len(q), 256):
        part = q[a:a + 256] / scale
        both = vv[None, :] + (part * part).sum(1)[:, None]
        approx, room = both - 2 * (part @ small.T), 1e-9 * both
        own = q_row[a:a + 256][:, None] == v_row[None, :]
        approx[own] = np.inf
        n = min(k, len(v)) - 1
        kth = np.partition(approx + room, n, axis=1)[:, n]
        for i in range(len(part)):
            rows = np.flatnonzero((approx[i] - room[i] <= kth[i]) & ~own[i])
            d = distances(v[rows], q[a + i])
            best = np.lexsort((v_id[rows], d))[:k]
            out.append((np.full(len(best), a + i), rows[best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           parts: int = PARTS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """The k nearest other rows found for each row that satisfies ``queries`` (SQL over ``id``).

    Columns query_id, rank (from 1), vec_id and score (Euclidean distance).
    """
    spark = vectors.sparkSession
    ship(spark)
    valid, dim = _valid(vectors, id_col, vec_col)
    kind = valid.schema["id"].dataType.simpleString()
    # every row has a number of its own: it tells a query from the candidates
    valid = scratch(valid.withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    router = fit_router(valid, dim, sample, parts, recall)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.part_of(_matrix(batch.column("vec"), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))],
                                             ["id", "vec", "row", "part"])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, part = np.nonzero(router.routes(_matrix(batch.column("vec"), dim)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(row)) for c in batch.columns), pa.array(part.astype(np.int32))],
                    ["id", "vec", "row", "part"])

    schema = f"id {kind}, vec array<double>, row long, part int"
    members = scratch(valid.mapInArrow(index, schema), "ann-members")
    asked = scratch(valid.filter(queries).mapInArrow(route, schema), "ann-queries")
    # one row per part
    blocks = (members.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vbs"))
              .join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qbs")), "part"))
    blocks = F.broadcast(blocks)
    salt = F.xxhash64("row")
    left = (members.join(blocks, "part").withColumn("vb", F.pmod(salt, "vbs").cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).drop("vbs", "qbs"))
    right = (asked.join(blocks, "part").withColumn("qb", F.pmod(salt, "qbs").cast("int"))
             .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vbs") - 1))).drop("vbs", "qbs"))

    def rank(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            empty, rows = pa.array([], q.schema.field("id").type), pa.array([], pa.int64())
            return pa.table({"query_row": rows, "query_id": empty, "vec_id": empty, "score": pa.array([], pa.float64())})
        q_id, v_id = q.column("id").to_numpy(), v.column("id").to_numpy()
        q_row, v_row = q.column("row").to_numpy(), v.column("row").to_numpy()
        a, b, d = nearest(_matrix(q.column("vec"), dim), _matrix(v.column("vec"), dim), q_row, v_row, v_id, k)
        return pa.table({"query_row": pa.array(q_row[a]), "query_id": pa.array(q_id[a]), "vec_id": pa.array(v_id[b]),
                         "score": pa.array(d)})

    key = ["part", "vb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        rank, f"query_row long, query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
