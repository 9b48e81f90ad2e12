"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described
by counts over its bytes and words (letter case, punctuation, symbols, digits,
repetition, line breaks, lengths), encoded by a learned layer, weighted by
learned gated attention (tanh times sigmoid), and the weighted passage
representation gives the score. Only document labels are used; the weights are
fitted on a bounded sample (``MAX_DOCS`` documents in hash order, one row of each, at
most ``MAX_PASSAGES`` passages), scoring covers all passages of all documents. If the
documents of the sample have more passages, the longest give evenly spaced ones, as many
each as fit; no document leaves the sample.

Defined results: a null or empty text is one passage of zeros and gets that
score; rows with a null doc_id are scored, but never held out; rows that repeat
a labelled doc_id share its label (mean of its labels, 0.5 and above is 1) and one
of them, the first in hash order of its passages, is fitted on; null
labels are ignored; without labels of both classes every score is the mean label
(0.5 without labels); other columns are ignored (``keep_good`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, scratch, ship, slices, utf8, word_hashes

PASSAGE, MAX_DOCS, MAX_PASSAGES = 64, 2500, 40_000
HIDDEN, ATTENTION, STEPS, SEED = 16, 8, 200, 7
SLICE_BYTES = 2 << 20

_BYTES = [chr(b) if b < 128 else "é" for b in range(256)]
#: Byte classes that are counted per passage.
CLASSES = np.stack([np.array([f(c) for c in _BYTES]) for f in (
    str.isupper, str.islower, str.isdigit, lambda c: c in ".,;:?", lambda c: c == "!",
    lambda c: c in "#$%&*@^~+=<>/\\_", lambda c: c in "|[]{}()", lambda c: c == "\n", lambda c: c >= "\x80")])
N_FEATURES = len(CLASSES) + 9


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and the passage offsets of each text."""
    buf, off = utf8(texts)
    h, words, start, end = word_hashes(buf, off, NOT_SPACE)
    n = np.diff(words)
    per_doc = np.maximum(-(-n // PASSAGE), 1)
    poff = np.concatenate(([0], np.cumsum(per_doc)))
    out = np.zeros((poff[-1], N_FEATURES), np.float32)
    full = np.repeat(n > 0, per_doc)
    which = np.arange(poff[-1]) - np.repeat(poff[:-1], per_doc)
    first = (np.repeat(words[:-1], per_doc) + which * PASSAGE)[full]
    last = np.minimum(first + PASSAGE, np.repeat(words[1:], per_doc)[full])
    if not len(first):
        return out, poff
    size = (last - first).astype(np.float64)
    lo, hi = start[first], end[last - 1]
    # bytes from the first word to the start of the next passage of the text, or its end
    to = np.where(last < np.repeat(words[1:], per_doc)[full], start[np.minimum(last, len(start) - 1)], hi)
    length = np.maximum(to - lo, 1).astype(np.float64)
    rows = []
    for table in CLASSES:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(table[buf], out=total[1:])
        rows.append((total[to] - total[lo]) / length)
    letters = np.maximum(rows[0] + rows[1], 1e-9)
    rows.append(rows[0] / letters)
    rows.append((hi - lo) / size)
    wide = end - start

    def mean(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(flag, dtype=np.float64)))
        return (total[last] - total[first]) / size

    rows.append(mean(wide <= 3))
    rows.append(mean(wide >= 12))
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[words[:-1][n > 0]] = False
    rows.append(mean(again))
    # words that the same passage has had before
    passage = np.repeat(np.arange(len(first), dtype=np.uint64), (last - first))
    keys = np.sort((passage << np.uint64(36)) | (h >> np.uint64(28)))
    same = np.concatenate(([0], np.cumsum(keys[1:] == keys[:-1]), [0]))
    edge = np.concatenate(([0], np.cumsum(last - first)))
    rows.append((same[edge[1:] - 1] - same[edge[:-1]]) / size)
    tail = buf[np.maximum(end - 1, 0)]
    rows.append(mean(~CLASSES[:2].any(0)[tail] & ~CLASSES[8][tail]))
    head = buf[start]
    rows.append(mean(CLASSES[0][head]))
    rows.append(np.log1p(size))
    out[full] = np.stack(rows, axis=1)
    return out, poff


class AttentionModel:
    """Gated-attention multiple-instance model in numpy (weights as plain arrays)."""

    def __init__(self, weights: dict, base: float):
        self.w, self.base = weights, base

    @staticmethod
    def _forward(w: dict, x: np.ndarray, off: np.ndarray):
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        per = np.diff(off)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, off[:-1]), per))
        a = s / np.repeat(np.add.reduceat(s, off[:-1]), per)
        z = np.add.reduceat(a[:, None] * h, off[:-1], axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-(z @ w["c"] + w["cb"])))

    def score(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of each bag x[off[i]:off[i+1]]."""
        if not self.w:
            return np.full(len(off) - 1, self.base)
        if len(off) == 1:
            return np.zeros(0)
        x = (x.astype(np.float64) - self.w["mean"]) / self.w["std"]
        return self._forward(self.w, np.clip(x, -8, 8), off)[-1]

    @classmethod
    def fit(cls, x: np.ndarray, off: np.ndarray, y: np.ndarray) -> AttentionModel:
        """Adam on the log loss, classes weighted equally; deterministic."""
        base = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return cls({}, base)
        rng = np.random.default_rng(SEED)
        x = x.astype(np.float64)
        mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = np.clip((x - mean) / std, -8, 8)
        d = x.shape[1]
        w = {"e": rng.normal(0, d ** -0.5, (d, HIDDEN)), "eb": np.zeros(HIDDEN),
             "v": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)),
             "u": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)),
             "a": rng.normal(0, ATTENTION ** -0.5, ATTENTION), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN),
             "cb": np.zeros(1)}
        m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
        per = np.diff(off)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        for step in range(1, STEPS + 1):
            h, t, g, a, z, p = cls._forward(w, x, off)
            dz_out = (p - y) * weight
            grad = {"c": z.T @ dz_out, "cb": dz_out.sum(keepdims=True)}
            dz = np.repeat(dz_out[:, None] * w["c"], per, axis=0)
            da = (dz * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, off[:-1]), per))
            dtg = ds[:, None] * w["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = a[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T
            pre = dh * (1 - h * h)
            grad |= {"a": (t * g).T @ ds, "v": h.T @ dt, "u": h.T @ dg, "e": x.T @ pre, "eb": pre.sum(0)}
            rate = 0.02 * min(1, 3 * (1 - step / (STEPS + 1)))
            for k in w:
                grad[k] = grad[k] + 1e-5 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls(w | {"mean": mean, "std": std}, base)


def held_out(id_col: str = "doc_id"):
    """Column: crc32 of the id as text leaves 1 modulo 3 (such rows are never learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def per_bag(sizes: np.ndarray, total: int) -> int:
    """The largest number of passages a bag may keep so that all bags keep at most
    ``total`` (and one at least)."""
    sizes = np.sort(sizes)
    # bags before the i-th are kept whole, it and those after it keep as many each
    room = (total - np.concatenate(([0], np.cumsum(sizes)))[:-1]) // np.arange(len(sizes), 0, -1)
    short = np.flatnonzero(room < sizes)
    return max(int(room[short[0]]), 1) if len(short) else total


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows of x, evenly spaced."""
    return x if len(x) <= most else x[np.arange(most) * len(x) // most]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text") -> AttentionModel:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    ship(docs.sparkSession)
    order = F.xxhash64("label_id")
    picked = (labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
              .filter("label_id IS NOT NULL AND label IS NOT NULL").filter(~held_out("label_id"))
              .groupBy("label_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
              .orderBy(order, "label_id").limit(MAX_DOCS))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample has at most MAX_DOCS rows of two numbers
    src = src.join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("label_id", "label", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            x, off = passage_features(part.column("text"))
            rows = [spread(x[a:b], MAX_PASSAGES) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("label_id"), part.column("label"), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["label_id", "label", "n", "x"])

    kind = src.schema["label_id"].dataType.simpleString()
    fields = f"label_id {kind}, label int, n long, x binary"
    # one row per id, reduced in every task before the exchange: at most MAX_DOCS rows
    bags = (src.mapInArrow(run, fields).groupBy("label_id", "label")
            .agg(F.min(F.struct(F.xxhash64("x").alias("h"), "n", "x")).alias("bag"))
            .select("label_id", "label", "bag.n", "bag.x"))
    bags = scratch(bags, "bags")
    sizes = bags.select("n").toPandas()["n"].to_numpy(np.int64)
    most = per_bag(sizes, MAX_PASSAGES)

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [spread(np.frombuffer(b, np.float32).reshape(-1, N_FEATURES), most)
                    for b in part.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("label_id"), part.column("label"), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["label_id", "label", "n", "x"])

    rows = bags.mapInArrow(bounded, fields).toPandas()
    # a fixed order makes the fit independent of the partitioning
    rows = rows.sort_values(["label_id", "n", "x"])
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, N_FEATURES)
    off = np.concatenate(([0], np.cumsum(rows["n"].to_numpy(np.int64)))).astype(np.int64)
    return AttentionModel.fit(x, off, rows["label"].to_numpy(np.float64))


def scores(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            p = model.score(*passage_features(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model scores below 0.5."""
    ship(docs.sparkSession)
    cols = docs.columns
    src = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    text = f"c{cols.index(text_col)}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            yield part.filter(pa.array(model.score(*passage_features(part.column(text))) >= 0.5))

    return src.mapInArrow(run, src.schema).toDF(*cols)
