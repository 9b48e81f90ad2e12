"""Isotonic regression without a merge on the driver (T5).

Equal scores meet first (a grouped sum, exact). The distinct scores are range-partitioned
and every range is pooled where it lies: adjacent violators become blocks (rows, sum of
labels, first and last score). Neighbouring ranges are then merged pairwise, which pools
their blocks again; pooling is associative, so after the last merge the blocks are those
of the whole. A range that has lost its rows to blocks is small, so a merge moves blocks
only. All keys (folds) are fitted in the same jobs.

The fitted curve is the table (key columns, lo, hi, value), linear between blocks and
constant beyond the ends.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import shared_path

# tasks run these functions on workers that need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pool(lo, hi, w, s) -> tuple[list, list, list, list]:
    """Adjacent blocks (in rising order) pooled until their means rise."""
    a, b, c, d = [], [], [], []
    for l, h, x, y in zip(lo, hi, w, s):
        while c and d[-1] * x >= y * c[-1]:          # mean of the last block >= mean of this one
            l, x, y = a.pop(), x + c.pop(), y + d.pop()
            b.pop()
        a.append(l)
        b.append(h)
        c.append(x)
        d.append(y)
    return a, b, c, d


def isotonic_fit(df: DataFrame, keys: list[str], x: str = "p", y: str = "label", w: str | None = None) -> DataFrame:
    """(keys, lo, hi, value): the rising step curve of y on x per key; null x or y are left out."""
    spark = df.sparkSession
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")))
            .select(*keys, F.col(x).cast("double").alias("lo"), weight.alias("w"),
                    (weight * F.col(y).cast("double")).alias("s")).where("w > 0"))
    steps = rows.groupBy(*keys, "lo").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    order = [*keys, "lo"]
    sorted_ = (steps.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
               .withColumn("hi", F.col("lo")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema.fields if f.name in keys)
    fields = f"{kinds}, part int, lo double, hi double, w double, s double"

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lo", "ascending")])
        blocks = pool(*(rows[c].to_pylist() for c in ("lo", "hi", "w", "s")))
        n = len(blocks[0])
        same = [pa.chunked_array([pa.array([rows[k][0].as_py()] * n, rows[k].type)]) for k in keys]
        part = pa.array(np.full(n, rows["part"][0].as_py(), np.int32))
        return pa.table([*same, part, *(pa.array(b, pa.float64()) for b in blocks)],
                        names=[*keys, "part", "lo", "hi", "w", "s"])

    blocks = sorted_.select(*keys, "part", "lo", "hi", "w", "s").groupBy(*keys, "part").applyInArrow(merge, fields)
    while parts > 1:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / 4).cast("int"))
        blocks = blocks.groupBy(*keys, "part").applyInArrow(merge, fields)
        parts = -(-parts // 4)
    path = shared_path(spark, "isotonic")
    blocks.select(*keys, "lo", "hi", (F.col("s") / F.col("w")).alias("value")).write.parquet(path)
    return spark.read.parquet(path)


def curve(lo, hi, value) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of one key's blocks: both ends of each block."""
    lo, hi, value = (np.asarray(a, float) for a in (lo, hi, value))
    order = np.argsort(lo)
    lo, hi, value = lo[order], hi[order], value[order]
    x = np.stack([lo, hi], 1).ravel()
    keep = np.ones(len(x), bool)
    keep[1::2] = hi > lo                      # a block of one score is one knot
    return x[keep], np.repeat(value, 2)[keep]


def isotonic_curves(fitted: DataFrame, keys: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Knots per key. A curve of binary labels has far fewer blocks than rows."""
    found: dict[tuple, list] = {}
    for r in fitted.select(*keys, "lo", "hi", "value").toLocalIterator():
        found.setdefault(tuple(r[k] for k in keys), []).append((r["lo"], r["hi"], r["value"]))
    return {k: curve(*zip(*v)) for k, v in found.items()}


def isotonic_apply(df: DataFrame, keys: list[str], curves: dict, x: str = "p", out: str = "cal_p") -> DataFrame:
    """``df`` with ``out``: the curve of the row's key at x (null without a curve or x)."""
    known = df.sparkSession.sparkContext.broadcast(curves)

    def run(batches):
        for b in batches:
            at = b.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            value = np.full(len(at), np.nan)
            which = list(zip(*(b.column(k).to_pylist() for k in keys)))
            for key in set(which):
                if key in known.value:
                    here = np.array([w == key for w in which])
                    value[here] = np.interp(at[here], *known.value[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value, mask=np.isnan(value))],
                                             [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
