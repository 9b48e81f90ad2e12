"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and
exact verification.

Words are lower-case runs of letters and digits, shingles are five words (a text
of fewer words is one shingle) and weigh as often as they occur. A document holds
an item when some window of as many words as the item has (the whole document,
if it is shorter) has a weighted Jaccard similarity (sum of the smaller over sum
of the larger counts) of at least the threshold.

1. A bitmap of fixed size over (shingle) and (shingle, item length) marks the
   places of a document that can belong to an item. A window whose marks cannot
   reach the threshold has no item; all others, at every start and for every item
   length, get a 64-bit SimHash of their shingles.
2. Windows and items meet in a join on blocks of the fingerprint: with ``BLOCKS``
   blocks, two fingerprints within ``RADIUS`` differ by at most 2 bits in some
   block, and the item side lists all block values within 2 bits, so no pair
   within the radius is missed.
3. Each pair is verified exactly on its weighted shingles.

Defined results: null or empty texts hold nothing and items without words are
never found; of repeated rows or items each pair of ids appears once; a null
doc_id is left out; an item with a null item_id is no row of ``matches``, but
``drop_contaminated`` removes the documents that hold its text; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WORD_BASE, mix, range_hash, ship, slices, utf8, word_hashes
from .word_bpe import ragged

SHINGLE, THRESHOLD = 5, (4, 5)
BLOCKS, NEAR = 7, 2
#: Two fingerprints within this distance differ by at most NEAR bits in some block.
RADIUS = BLOCKS * (NEAR + 1) - 1
_EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
#: Bits of the bitmap (2 MB); fixed, so that what is sent to the tasks does not grow.
BITMAP = 1 << 24
SLICE_BYTES = 2 << 20
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def _words(texts: pa.Array):
    buf, off = utf8(pc.utf8_lower(texts.fill_null("")))
    h, words, _, _ = word_hashes(buf, off, ALNUM)
    return h, words


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (places near the end are not used)."""
    i = np.arange(max(len(h) - k + 1, 0))
    return range_hash(h, i, i + k, WORD_BASE) if len(i) else np.zeros(0, np.uint64)


def _slots(values: np.ndarray, length=None) -> tuple[np.ndarray, np.ndarray]:
    if length is not None:
        values = mix(values + np.uint64(length * int(_OTHER) & (2**64 - 1)))
    return ((values >> np.uint64(40)) & np.uint64(BITMAP - 1)).astype(np.int64), (
        values & np.uint64(BITMAP - 1)).astype(np.int64)


def _marked(bitmap: np.ndarray, values: np.ndarray, length=None) -> np.ndarray:
    a, b = _slots(values, length)
    hit = np.zeros(len(values), bool)
    first = np.flatnonzero(bitmap[a >> 3] >> (a & 7).astype(np.uint8) & 1)
    b = b[first]
    hit[first] = (bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def fingerprints(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of ``size`` shingle hashes (repeats weigh more)."""
    out = np.zeros(len(size), np.uint64)
    if not len(size):
        return out
    start = np.cumsum(size) - size
    for b in range(64):
        ones = np.add.reduceat(((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64), start)
        out |= (2 * ones > size).astype(np.uint64) << np.uint64(b)
    return out


def weighted(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shingle hashes told apart by occurrence within each run: multisets as sets."""
    run = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, run))
    v, r = values[order], run[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(v))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(v + nth.astype(np.uint64) * _OTHER)


def _rows(cols: dict, values: np.ndarray, size: np.ndarray, n_words: np.ndarray) -> pa.RecordBatch:
    """Arrow rows of windows or items with fingerprint and weighted shingles."""
    fp = fingerprints(values, size).view(np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    shingles = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(weighted(values, size).view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [*cols.values(), pa.array(n_words.astype(np.int32)), pa.array(fp), shingles],
        [*cols, "n_words", "fp", "shingles"])


def _items(bench: DataFrame, kind: str) -> DataFrame:
    """item, n_words, fp, shingles and the bits that the item sets in the bitmap."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            h, words = _words(part.column("text"))
            n = np.diff(words)
            rows = np.flatnonzero(n)
            size = np.maximum(n[rows] - SHINGLE + 1, 1)
            start = ragged(words[:-1][rows], size)
            values = range_hash(h, start, start + np.repeat(np.minimum(n[rows], SHINGLE), size), WORD_BASE)
            length = np.repeat(n[rows], size).astype(np.uint64)
            bits = np.stack([*_slots(values), *_slots(mix(values + length * _OTHER))], axis=1).reshape(-1)
            batch = _rows({"item": part.column("item").take(pa.array(rows))}, values, size, n[rows])
            off = np.concatenate(([0], np.cumsum(size * 4)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(bits.astype(np.int32)))],
                [*batch.schema.names, "bits"])

    return bench.mapInArrow(run, f"item {kind}, n_words int, fp long, shingles array<long>, bits array<int>")


def _bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap of all items; at most BITMAP / 64 rows reach the driver."""
    words = (items.select(F.explode("bits").alias("bit"))
             .select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, bit & 63)").alias("bits"))
             .groupBy("word").agg(F.bit_or("bits").alias("bits"))).toPandas()
    full = np.zeros(BITMAP // 64, np.int64)
    full[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return full.astype("<i8").view(np.uint8)


def candidate_windows(h, words, bitmap, lengths, num, den):
    """(document, first word, item length, shingle count) of all windows that may reach
    the threshold."""
    out = []
    grams = {}
    n = np.diff(words)
    for length in lengths:
        k = min(length, SHINGLE)
        if k not in grams:
            g = _grams(h, k)
            doc = np.searchsorted(words, np.arange(len(g)), side="right") - 1
            inside = np.arange(len(g)) + k <= words[1:][doc]
            at = np.flatnonzero(_marked(bitmap, g) & inside)
            grams[k] = (at, g[at], doc[at])
        at, g, doc = grams[k]
        hit = _marked(bitmap, g, length)
        at, doc = at[hit], doc[hit]
        if not len(at):
            continue
        full = length - k + 1
        need = -(-num * 2 * full // (num + den))
        # documents of at least the item's length: windows with at most full - need other shingles
        long_at, long_doc = at[n[doc] >= length], doc[n[doc] >= length]
        span = full - need + 1
        start = (long_at[:, None] - np.arange(span)[None, :]).reshape(-1)
        owner = np.repeat(long_doc, span)
        ok = (start >= words[:-1][owner]) & (start + length <= words[1:][owner])
        start, first = np.unique(start[ok], return_index=True)
        owner = owner[ok][first]
        count = np.searchsorted(at, start + full) - np.searchsorted(at, start)
        ok = count >= need
        out.append((owner[ok], start[ok], np.full(ok.sum(), length), np.full(ok.sum(), full)))
        # shorter documents are one window
        short = np.unique(doc[(n[doc] < length) & (n[doc] >= k)])
        size = n[short] - k + 1
        count = np.searchsorted(at, words[short] + size) - np.searchsorted(at, words[short])
        ok = (num + den) * count >= num * (size + full)
        out.append((short[ok], words[short[ok]], np.full(ok.sum(), length), size[ok]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def _windows(src: DataFrame, kind: str, bitmap, lengths: list[int], num: int, den: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for part in slices(batches, "text", SLICE_BYTES):
            h, words = _words(part.column("text"))
            doc, start, length, size = candidate_windows(h, words, bits, lengths, num, den)
            for a in range(0, len(doc), 4096):
                d, s, w, m = doc[a:a + 4096], start[a:a + 4096], length[a:a + 4096], size[a:a + 4096]
                place = ragged(s, m)
                values = range_hash(h, place, place + np.repeat(np.minimum(w, SHINGLE), m), WORD_BASE)
                yield _rows({"id": part.column("id").take(pa.array(d)),
                             "start": pa.array((s - words[d]).astype(np.int32))}, values, m, w)

    return src.mapInArrow(run, f"id {kind}, start int, n_words int, fp long, shingles array<long>")


def _block(fp: str, b: int):
    """Bits of block b of a fingerprint column."""
    width = _EDGES[b + 1] - _EDGES[b]
    return F.shiftrightunsigned(fp, _EDGES[b]).bitwiseAND(F.lit((1 << width) - 1))


def _near_masks(b: int) -> list[int]:
    width = _EDGES[b + 1] - _EDGES[b]
    return [sum(1 << i for i in c) for r in range(NEAR + 1) for c in combinations(range(width), r)]


def matches(docs: DataFrame, bench: DataFrame, threshold: tuple[int, int] = THRESHOLD,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text") -> DataFrame:
    """One row per (doc_id, item_id) held: start_word, n_words and similarity of the
    best window (the first on ties). Rows with a null doc_id or item_id are left out."""
    spark = docs.sparkSession
    ship(spark)
    num, den = threshold
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    items = bench.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item IS NOT NULL")
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((src, "id"), (items, "item")))
    items = _items(items, item_kind)
    # one value per item length
    lengths = sorted(r.n_words for r in items.select("n_words").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(items).tobytes())
    windows = _windows(src, kind, bitmap, lengths, num, den)
    keyed = windows.select("*", F.posexplode(F.array(*[_block("fp", b) for b in range(BLOCKS)])).alias("block", "key"))
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in _near_masks(b)]) for b in range(BLOCKS)])
    near = (items.select("item", "n_words", F.col("fp").alias("item_fp"), F.col("shingles").alias("item_shingles"),
                         F.posexplode(F.array(*[_block("fp", b) for b in range(BLOCKS)])).alias("block", "value"),
                         masks.alias("masks"))
            .select("*", F.explode(F.element_at("masks", F.col("block") + 1)).alias("mask"))
            .withColumn("key", F.col("value").bitwiseXOR(F.col("mask"))).drop("masks", "mask", "value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that meets in several blocks counts in the first
    earlier = reduce(lambda x, y: x | y, [
        (F.col("block") > b) & (F.bit_count(F.shiftrightunsigned(apart, _EDGES[b]).bitwiseAND(
            F.lit((1 << (_EDGES[b + 1] - _EDGES[b])) - 1))) <= NEAR) for b in range(BLOCKS - 1)])
    pairs = keyed.join(near, ["n_words", "block", "key"]).filter((F.bit_count(apart) <= RADIUS) & ~earlier)
    common = F.size(F.array_intersect("shingles", "item_shingles"))
    both = F.size("shingles") + F.size("item_shingles")
    good = pairs.select("id", "item", "start", "n_words", common.alias("common"), both.alias("both")).filter(
        (num + den) * F.col("common") >= num * F.col("both"))
    return (good.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
            .agg(F.max(F.struct((F.col("common") / (F.col("both") - F.col("common"))).alias("similarity"),
                                (-F.col("start")).alias("before"), "n_words")).alias("best"))
            .select("doc_id", "item_id", (-F.col("best.before")).alias("start_word"), "best.n_words",
                    "best.similarity"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, threshold: tuple[int, int] = THRESHOLD,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item (rows without doc_id stay)."""
    cols = docs.columns
    # any item counts here, also without an item_id: its text stands for it
    items = bench.select(F.xxhash64("text").alias("item_id"), "text")
    bad = matches(docs, items, threshold, id_col, text_col).select(F.col("doc_id").alias("bad_id")).distinct()
    src = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))
    return src.join(bad, F.col(f"c{cols.index(id_col)}") == F.col("bad_id"), "left_anti").toDF(*cols)
