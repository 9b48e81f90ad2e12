"""Target-distribution importance resampling on hashed n-grams.

A task turns its texts into arrays: word spans, the crc32 of every word and of every
pair of neighbouring words (the checksum of a pair continues that of its first word),
buckets, and sums per document. Two passes over the texts: the first counts the
buckets of the whole corpus, the second scores every document with the gains of its
buckets. The scored rows, five numbers each, are written once.

The best share is then cut without sorting everything: a quantile sketch brackets the
cutoff, exact counts above and inside the bracket confirm it or widen it, and the
bracket alone is sorted to find the last row that is drawn. Only drawn rows are sorted
for their rank, by ranges; a row's position follows from its place in its range and the
counts of the ranges before. Ranges end with the row's own number, so that equal rows
never gather in one task.

Defined results: a null text counts as empty (no features, weight 0, never drawn);
texts are whole, of any length. Equal scores go by doc_id, null ids last; rows that
repeat an id by n_features, then in the order in which they were written. A null id
has the noise of the text ``7:``. Repeated rows count as often as they occur. Empty
tables give no rows, an empty target counts no features. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, partitions, running, scratch, ship, slices, sum_arrays, utf8, word_spans

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
SLICE_BYTES = 8 << 20
#: Words above this length take the library's checksum, one by one.
LONG_WORD = 64
#: Accuracy of the quantile sketch (rank error 1 / ACCURACY).
ACCURACY = 2000


def _crc_table() -> np.ndarray:
    """Checksum states after one byte (reflected polynomial 0xEDB88320 of crc32)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc_states(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksum states (before the last inversion) after feeding buf[start:end] to each state."""
    size = end - start
    out = state.copy()
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = zlib.crc32(buf[start[k]:end[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.where(size > LONG_WORD, 0, size).astype(np.int16)
    order = np.argsort(-short, kind="stable")                  # the longest first: a step feeds a prefix
    counts = len(size) - np.cumsum(np.bincount(short, minlength=1))
    cur, at = out[order], start[order]
    for p in range(int(short.max(initial=0))):
        n = counts[p]
        cur[:n] = CRC[(cur[:n] ^ buf[at[:n] + p]) & np.uint32(255)] ^ (cur[:n] >> np.uint32(8))
    out[order] = cur
    return out


def features(texts: pa.Array):
    """(buckets of all words, buckets of all pairs, word offsets of the documents); the pair
    of a document's last word is missing, marked by -1."""
    buf, off = utf8(texts)
    upper = (buf >= 65) & (buf <= 90)
    buf = np.where(upper, buf + 32, buf).astype(np.uint8)
    start, end, words = word_spans(buf, off, ALNUM)
    state = crc_states(np.full(len(start), 0xFFFFFFFF, np.uint32), buf, start, end)
    one = ((~state) % np.uint32(BUCKETS)).astype(np.int64)
    two = np.full(len(start), -1, np.int64)
    if len(start) > 1:
        space = CRC[(state[:-1] ^ np.uint32(32)) & np.uint32(255)] ^ (state[:-1] >> np.uint32(8))
        two[:-1] = (~crc_states(space, buf, start[1:], end[1:])) % np.uint32(BUCKETS)
        last = words[1:] - 1
        two[last[np.diff(words) > 0]] = -1
    return one, two, words


def bucket_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all texts (exact whole numbers below 2**53)."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for part in slices(batches, "text", SLICE_BYTES):
            one, two, _ = features(part.column("text"))
            total += np.bincount(one, minlength=BUCKETS) + np.bincount(two + 1, minlength=BUCKETS + 1)[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
             pa.array([total], pa.list_(pa.float64()))], ["i", "task", "g"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(run, "i int, task int, g array<double>")
    found = sum_arrays(rows).collect()                        # one row of BUCKETS numbers
    return np.array(found[0]["g"]) if found else np.zeros(BUCKETS)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket: floored thousandths of the log ratio of smoothed shares."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    padded = np.concatenate((gains, [0]))                     # the missing pair gains nothing

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            one, two, words = features(part.column("text"))
            n = np.diff(words)
            total = running(padded[one] + padded[two])
            number = n + np.maximum(n - 1, 0)
            weight = (total[words[1:]] - total[words[:-1]]) // np.maximum(number, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(number), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED):
    """Column: seeded Gumbel noise of an id, in floored thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


#: Best first: higher score, smaller id (null last), fewer features, earlier row.
ORDER = ("-score", "doc_id IS NULL", "doc_id", "n_features", "row")


def _keys() -> list:
    return [F.expr(t) for t in ORDER]


def positions(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its ``position`` (from 1) in ORDER, sorted in ranges."""
    cut = (df.repartitionByRange(partitions(df), *_keys()).sortWithinPartitions(*_keys())
           .withColumn("_at", F.monotonically_increasing_id()))
    cut = scratch(cut, name)              # fixes every row's place
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    total, first = 0, []
    for r in cut.groupBy(part.alias("part")).count().orderBy("part").collect():      # one row per range
        first.append((r["part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(first, "_part long, _first long")
    return (cut.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn("position", F.col("_first") + place + 1).drop("_at", "_part", "_first"))


def bracket(rows: DataFrame, k: int, n: int) -> tuple[int, int, int]:
    """(low, high, rows above high) of scores so that the k-th best of n rows lies in [low, high]."""
    width = 2.0 / ACCURACY
    while True:
        ends = [max(0.0, 1 - k / n - width), min(1.0, 1 - k / n + width)]
        low, high = rows.agg(F.percentile_approx("score", ends, ACCURACY).alias("q")).first()["q"]
        if width >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, inside = rows.agg(F.count_if(F.col("score") > high),
                                 F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        width *= 8


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_features, weight, score and rank among the drawn rows (null: not drawn)."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = scratch(weights(docs, gains, id_col, text_col).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("able"), F.monotonically_increasing_id().alias("row")), "scored")
    able = scored.filter("able")
    n = able.count()
    k = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return scored.select(*out, none)
    low, high, above = bracket(able, k, n)
    inside = positions(able.filter(F.col("score").between(low, high)), "bracket")
    last = inside.filter(F.col("position") == k - above)
    last = last.select(*(c.alias(f"k{i}") for i, c in enumerate(_keys()))).first()
    fields = [f.dataType for f in able.select(*_keys()).schema]
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_keys())))
    cutoff = F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(last, fields, strict=True))))
    drawn = F.col("able") & (key <= cutoff)
    best = positions(scored.filter(drawn), "drawn").select(*out, F.col("position").alias("rank"))
    return best.unionByName(scored.filter(~drawn).select(*out, none))
