"""Exact quantiles by radix selection: all columns and groups at once, no sketch, no fallback.

A double maps to a 64-bit key of the same order (sign bit set for positive numbers, all
bits turned for negative ones). Four passes over one written copy count 16 bits of the
keys each: the first for all values of a column (and group), the next ones only where the
leading bits equal those of a wanted rank. A task sums its counts in arrays of 65,536
cells and gives the cells in use; one small group per column then finds the cell that
holds the rank. After the last pass the key, and so the value, is known.

What a task holds is bounded by columns x groups x quantiles, whatever the rows; a value
that fills most rows is one count. The groups are meant to be few (classes).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import shared_path

# tasks run these functions on workers that need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 16
CELLS = 1 << BITS
SIGN = np.uint64(1 << 63)


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Keys (uint64) in the order of the doubles; both zeros are one value."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def key_value(key: int) -> float:
    """The double of a key."""
    k = np.array([key], np.uint64)
    return float(np.where(k & SIGN, k ^ SIGN, ~k).view(np.float64)[0])


_COUNTS = "id int, cell int, n long"


def _count(data: DataFrame, wanted: dict[int, tuple], level: int) -> DataFrame:
    """(id, cell, n): per wanted (group, column, leading bits) the counts of the next bits."""
    shift = np.uint64(64 - BITS * (level + 1))
    by_column: dict[str, list] = {}
    for i, (g, c, prefix) in wanted.items():
        by_column.setdefault(c, []).append((i, g, prefix))

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            groups = b.column("g")
            masks = {}
            for c, items in by_column.items():
                x = b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                there = ~np.isnan(x)
                keys = ordered_keys(x) >> shift
                for i, g, prefix in items:
                    if g not in masks:
                        masks[g] = pc.equal(groups, g).to_numpy(zero_copy_only=False).astype(bool)
                    here = there & masks[g]
                    if level:
                        here &= (keys >> np.uint64(BITS)) == np.uint64(prefix)
                    cells = np.bincount((keys[here] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                    total[i] = total[i] + cells if i in total else cells
        for i, cells in total.items():
            used = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)),
                                              pa.array(used.astype(np.int32)), pa.array(cells[used])],
                                             ["id", "cell", "n"])

    return data.mapInArrow(run, _COUNTS).groupBy("id", "cell").agg(F.sum("n").alias("n"))


def _find(counts: DataFrame, ranks: dict[int, list[int]] | None, probs: list[float]) -> list:
    """(id, rank, cell, below, total) of every wanted rank; without ranks those of the probabilities."""
    def run(rows: pa.Table) -> pa.Table:
        cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(cell)
        cell, upto = cell[order], np.cumsum(n[order])
        i, total = rows["id"][0].as_py(), int(upto[-1])
        if ranks is None:
            pos = [p * (total - 1) for p in probs]
            want = sorted({r for x in pos for r in (int(np.floor(x)), int(np.ceil(x)))})
        else:
            want = ranks[i]
        at = np.searchsorted(upto, want, side="right")
        below = np.where(at > 0, upto[at - 1], 0)
        return pa.table({"id": pa.array([i] * len(want), pa.int32()), "rank": pa.array(want, pa.int64()),
                         "cell": pa.array(cell[at], pa.int32()), "below": pa.array(below, pa.int64()),
                         "total": pa.array([total] * len(want), pa.int64())})
    out = counts.groupBy("id").applyInArrow(run, "id int, rank long, cell int, below long, total long")
    return out.collect()                                   # a few rows per column, group and quantile


def select_quantiles(df: DataFrame, cols: list[str], probs: list[float], group: Column | None = None) -> dict:
    """{(group, column, prob): value}: exact, linearly interpolated; NULLs and NaNs are skipped.

    ``group`` is a column of text (null rows are left out); without one the group is "". A
    column without a value in a group has no entry.
    """
    spark = df.sparkSession
    path = shared_path(spark, "selection")
    names = [f"c{i}" for i in range(len(cols))]
    g = group.cast("string") if group is not None else F.lit("")
    df.select(g.alias("g"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]).write.parquet(path)
    data = spark.read.parquet(path)
    groups = [""] if group is None else [r["g"] for r in data.where("g IS NOT NULL").select("g").distinct().collect()]
    wanted = {i: (g, c, 0) for i, (g, c) in enumerate((g, c) for g in groups for c in names)}
    if not wanted:
        return {}
    first = _find(_count(data, wanted, 0), None, probs)
    total = {wanted[r["id"]][:2]: r["total"] for r in first}
    # rank within the group and column -> (leading bits, rank among the values that share them)
    state = {(*wanted[r["id"]][:2], r["rank"]): (r["cell"], r["rank"] - r["below"]) for r in first}
    for level in range(1, 64 // BITS):
        places = sorted({(g, c, bits) for (g, c, _), (bits, _) in state.items()})
        ids = {place: i for i, place in enumerate(places)}
        ranks: dict[int, set] = {}
        for (g, c, _), (bits, rank) in state.items():
            ranks.setdefault(ids[(g, c, bits)], set()).add(rank)
        found = _find(_count(data, dict(enumerate(places)), level), {i: sorted(r) for i, r in ranks.items()}, probs)
        hit = {(r["id"], r["rank"]): (r["cell"], r["below"]) for r in found}
        for key, (bits, rank) in state.items():
            cell, below = hit[(ids[(*key[:2], bits)], rank)]
            state[key] = ((bits << BITS) | cell, rank - below)
    out = {}
    for (g, n), size in total.items():
        for p in probs:
            pos = p * (size - 1)
            lo, hi = (key_value(state[(g, n, int(f(pos)))][0]) for f in (np.floor, np.ceil))
            out[(g, cols[names.index(n)], p)] = lo + (hi - lo) * (pos - np.floor(pos))
    return out
