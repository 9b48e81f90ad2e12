"""Shared helpers: table input, code shipping, scratch tables, vectorised words.

Python code of the operators runs only inside tasks (``mapInArrow`` /
``applyInPandas``) on Arrow slices of bounded size. ``ship`` hands the package
to the executors with ``addPyFile``, so that workers need no installed copy.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir, shared_path

_SHIPPED = "_riskloom_llm_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's Python files to the executors, once per Spark context."""
    sc = spark.sparkContext
    ensure_checkpoint_dir(spark)
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="riskloom-py-"), "riskloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table; other columns never enter an operator."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: the files survive a lost executor, and later reads prune
    columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions set by the cluster (AQE coalesces them)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows so that ``column`` holds about ``max_bytes`` each.

    A row larger than the bound is a slice of its own: texts stay whole. Arrow's free
    memory goes back to the system after each batch, not into the next stage: an
    executor's idle workers count towards its memory.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
        pa.default_memory_pool().release_unused()


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array (nulls count as empty) and the row offsets into them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


#: Bytes that belong to a word: ASCII letters and digits, and every non-ASCII byte.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes that belong to a word: all but space, tab, line feed and other ASCII white space.
NOT_SPACE = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])


def word_spans(buf: np.ndarray, off: np.ndarray, keep: np.ndarray):
    """Word starts and ends (bytes), and the word offsets of each document.

    A word is a maximal run of ``keep`` bytes inside one document.
    """
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = keep[buf]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n (base is odd, so invertible)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(x: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading 0, in the type of ``x`` (64-bit hashes wrap around)."""
    total = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=total[1:])
    return total


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of values[start:end] for many ranges, from one prefix sum."""
    power, inverse = _powers(base, len(values))
    total = running(values.astype(np.uint64) * power[:len(values)])
    return mix((total[end] - total[start]) * inverse[start])


BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def word_hashes(buf: np.ndarray, off: np.ndarray, keep: np.ndarray):
    """64-bit hash of every word, and the word offsets of each document."""
    start, end, words = word_spans(buf, off, keep)
    if not len(start):
        return np.zeros(0, np.uint64), words, start, end
    return range_hash(buf.astype(np.uint64) + np.uint64(1), start, end, BYTE_BASE), words, start, end


def doc_shingles(hashes: np.ndarray, words: np.ndarray, k: int):
    """Hashes of all k-word shingles, and the shingle offsets of each document.

    A document of 1 to k-1 words is one shingle; one without words has none.
    """
    n = np.diff(words)
    per_doc = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per_doc, out=out[1:])
    start = np.arange(out[-1]) - np.repeat(out[:-1] - words[:-1], per_doc)
    end = start + np.repeat(np.minimum(n, k), per_doc)
    if not len(start):
        return np.zeros(0, np.uint64), out
    return range_hash(hashes, start, end, WORD_BASE), out


def lower_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The column in lower case, nulls as empty text."""
    return df.withColumn(column, F.lower(F.coalesce(F.col(column), F.lit(""))))


#: First-step groups of ``sum_arrays``; each takes an equal share of the tasks' rows.
GROUPS = 64


def _add(rows: pa.Table) -> pa.Table:
    """Sum of the arrays of one group, in the order of their tasks."""
    total = None
    for k in np.argsort(np.asarray(rows["task"]), kind="stable").tolist():
        row = np.asarray(rows["g"][k].values)
        total = row.copy() if total is None else total + row
    return pa.table({"i": rows["i"][:1], "task": rows["task"][:1], "g": pa.array([total], pa.list_(pa.float64()))})


def sum_arrays(parts: DataFrame) -> DataFrame:
    """Sum of the arrays g per i of (i, task, g): every task's row meets 1/64 of the
    others first, so no group grows with all tasks at once."""
    fields = "i int, task int, g array<double>"
    part = (F.col("task") % GROUPS).alias("part")
    return (parts.groupBy("i", part).applyInArrow(_add, fields)
            .withColumn("task", F.col("task") % GROUPS).groupBy("i").applyInArrow(_add, fields))
