"""Token-id files: Simple-8b word-aligned coding with escapes and block offsets.

Format. A shard holds consecutive documents in ascending doc_id order as pages;
a page holds whole documents and is one row of a Parquet file (Spark's
committer makes the files appear whole, also after a lost executor):

* ``shard``, ``first`` - shard number, ids of the shard before this page;
* ``doc_id``, ``doc_end`` - documents, and where each ends among the page's ids;
* ``words`` - little-endian 64-bit words. The top 4 bits select how many ids the
  word packs and with how many bits each (``COUNT``, ``BITS``);
* ``block_word`` - uint32 offsets of the blocks of ``BLOCK`` ids into ``words``,
  so that any block, or all at once, can be decoded;
* ``escape_at``, ``escape_value`` - place (uint32) and value (uint64) of the ids
  of 2**60 and above, which stand as 0 in the words.

Shards are cut by range partitioning on (doc_id, text hash), so equal ids split
over shards too. Defined results: null or empty text is the end id alone; a null
doc_id sorts first; repeated rows each keep their own ids; an empty table gives
empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, ship, slices
from .word_bpe import encoder, ragged

BLOCK = 1024
#: Ids and bits per selector (Simple-8b; selectors 0 and 1 are runs of zeros).
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SMALL_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
ESCAPE = np.uint64(1) << np.uint64(60)
SLICE_BYTES = 8 << 20
PAGES = ("shard int, first long, doc_id {id}, doc_end array<int>, n_ids int, words binary, "
         "block_word binary, escape_at binary, escape_value binary")


def _fits(width: np.ndarray, count: int, bits: int, known: dict) -> np.ndarray:
    """Whether ids i .. i+count-1 of each row all have at most ``bits`` bits."""
    span = 1
    best = known[1]
    while span * 2 <= count:
        span *= 2
        if span not in known:
            wider = best.copy()
            np.maximum(best[:, :-span // 2], best[:, span // 2:], out=wider[:, :-span // 2])
            known[span] = wider
        best = known[span]
    if span < count:
        rest = count - span
        out = best.copy()
        np.maximum(best[:, :-rest], best[:, rest:], out=out[:, :-rest])
        best = out
    return best <= bits


def pack(ids: np.ndarray):
    """Simple-8b words of the ids, block offsets into the words, escape places and values."""
    ids = ids.astype(np.uint64)
    escape_at = np.flatnonzero(ids >= ESCAPE)
    escape_value = ids[escape_at]
    if len(escape_at):
        ids = ids.copy()
        ids[escape_at] = 0
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), escape_at, escape_value
    pad = int(COUNT[0])
    grid = np.zeros((blocks, BLOCK + pad), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:len(ids)] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = np.zeros(grid.shape, np.uint8)
    if int(ids.max()) < len(SMALL_WIDTH):
        width[:, :BLOCK] = SMALL_WIDTH[flat].reshape(blocks, BLOCK)
    else:  # rounding to a double may give one bit more, which still fits
        width[:, :BLOCK] = np.minimum(np.frexp(flat.astype(np.float64))[1], 60).reshape(blocks, BLOCK)
    # at every place the selector that packs the most ids
    choice = np.full((blocks, BLOCK), len(COUNT) - 1, np.uint8)
    known = {1: width}
    for s in range(len(COUNT) - 1, -1, -1):
        ok = _fits(width, int(COUNT[s]), int(BITS[s]), known)
        np.copyto(choice, np.uint8(s), where=ok[:, :BLOCK])
    size = np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    found = []
    while len(live):  # all blocks step from word to word together
        selector = choice[live, at[live]]
        found.append((live, at[live], selector))
        at[live] += COUNT[selector]
        live = live[at[live] < size[live]]
    block = np.concatenate([f[0] for f in found])
    start = np.concatenate([f[1] for f in found])
    selector = np.concatenate([f[2] for f in found])
    order = np.argsort(block, kind="stable")  # words of a block stay in order
    block, start, selector = block[order], start[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    row = grid.reshape(-1)
    base = block * (BLOCK + pad) + start
    for s in range(2, len(COUNT)):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            value = words[rows]
            for j in range(COUNT[s]):
                value |= row[base[rows] + j] << np.uint64(BITS[s] * j)
            words[rows] = value
    return words, np.searchsorted(block, np.arange(blocks + 1)), escape_at, escape_value


def unpack(words: np.ndarray, block_word: np.ndarray, n_ids: int,
           escape_at: np.ndarray, escape_value: np.ndarray) -> np.ndarray:
    """The ids of a page, all blocks at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    block = np.repeat(np.arange(len(block_word) - 1), np.diff(block_word))
    total = np.concatenate(([0], np.cumsum(count)))
    begin = block * BLOCK + total[:-1] - total[block_word[:-1]][block]
    out = np.zeros((len(block_word) - 1) * BLOCK + int(COUNT[0]), np.uint64)
    for s in range(2, len(COUNT)):
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNT[s] if len(rows) else 0):
            # the last word of a block may hold zeros beyond the block's end
            where = begin[rows] + j
            inside = where < (block[rows] + 1) * BLOCK
            out[where[inside]] = (words[rows[inside]] >> np.uint64(BITS[s] * j)) & mask
    out = out[:n_ids]
    out[escape_at] = escape_value
    return out


def write_ids(docs: DataFrame, path: str, vocab_path: str, end_id: int = 2,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write its ids, ``end_id`` appended, to ``path``."""
    ship(docs.sparkSession)
    src = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    kind = src.schema["id"].dataType.simpleString()
    schema = PAGES.format(id=f"array<{kind}>")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", SLICE_BYTES):
            ids, off = encoder(vocab_path).encode(part.column("text"))
            n = np.diff(off) + 1
            end = np.cumsum(n)
            page = np.full(int(end[-1]), end_id, np.uint32)
            page[ragged(end - n, n - 1)] = ids
            words, block_word, at, value = pack(page)
            row = [shard, first, part.column("id").to_pylist(), end.tolist(), len(page),
                   words.astype("<u8").tobytes(), block_word.astype("<u4").tobytes(),
                   at.astype("<u4").tobytes(), value.astype("<u8").tobytes()]
            first += len(page)
            kinds = [pa.int32(), pa.int64(), pa.list_(part.schema.field("id").type), pa.list_(pa.int32()),
                     pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    salt = F.xxhash64("text")
    (src.repartitionByRange(partitions(src), "id", salt).sortWithinPartitions("id", salt)
        .mapInArrow(run, schema).write.option("compression", "zstd").parquet(path))


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Read the files: doc_id, start (ids of all documents before it), n_tokens, and
    the ids (array<long>) or, with ``digest``, ids_crc32 of their uint32 bytes."""
    ship(spark)
    files = spark.read.parquet(path)
    # one row per shard: its number is the partition count of the write
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    src = files.join(F.broadcast(shards), "shard").withColumn("first", F.col("first") + F.col("ahead")).drop(
        "shard", "ahead")
    kind = src.schema["doc_id"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_id").type.value_type
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = unpack(np.frombuffer(row["words"], "<u8"),
                             np.frombuffer(row["block_word"], "<u4").astype(np.int64), row["n_ids"],
                             np.frombuffer(row["escape_at"], "<u4"), np.frombuffer(row["escape_value"], "<u8"))
                end = np.array(row["doc_end"], np.int64)
                start = np.concatenate(([0], end[:-1]))
                if digest:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    value = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start, end, strict=True)],
                                     pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.append(start, end[-1]), pa.int32()),
                                                     pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], id_type), pa.array(start + row["first"]),
                     pa.array(end - start), value],
                    ["doc_id", "start", "n_tokens", last.split()[0]])

    return src.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {last}")
