"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts every text into chunks whose borders
depend on content only, so that passages shared by documents give the same
chunks. Distinct chunks of a slice are encoded once. A chunk border inside a
word is repaired: the window around the border grows to both sides until it
meets white space, where the encodings of both sides agree exactly with that of
the whole text, and the window is encoded anew. No shuffle; each task works on
its own rows.

Defined results: a null or empty text has no tokens and decodes to an empty
text; rows with a null or repeated doc_id are encoded like any other row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, ship, slices, utf8
from .word_bpe import cut_before, encoder, ragged

#: Mean chunk length is 2**CHUNK_BITS bytes.
CHUNK_BITS = 8
SLICE_BYTES = 4 << 20
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunk_borders(buf: np.ndarray, off: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Flags of the bytes at which a chunk starts (inside texts, at character starts)."""
    h = GEAR[buf]
    for step in (1, 2, 4, 8, 16):  # sum of GEAR[b[i-j]] << j over 32 bytes, by doubling
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
    cut = np.zeros(len(buf), bool)
    cut[1:] = (h[:-1] >> np.uint32(32 - bits)) == 0
    # the hash must not reach into the text before: no border in the first 32 bytes
    near = ragged(off[:-1], np.minimum(np.diff(off), 32))
    cut[near] = False
    cut &= (buf & 0xC0) != 0x80
    return cut


def units(buf: np.ndarray, off: np.ndarray, bits: int = CHUNK_BITS):
    """Chunk bodies and repaired joins of the texts, in order: array, offsets per text."""
    border = np.flatnonzero(chunk_borders(buf, off, bits))
    space = (buf == 32) | (buf == 10)
    word = np.flatnonzero(_word_starts(space, off))  # words with the space before them
    end = np.append(word[1:], len(buf))
    at = np.searchsorted(word, border, side="right") - 1
    torn = np.unique(at[word[at] != border])  # words with a border inside
    flag = np.zeros(len(buf) + 1, bool)
    flag[border[word[at] == border]] = True
    flag[word[torn]] = True
    flag[end[torn]] = True
    return cut_before(buf, off, flag[:-1])


def _word_starts(space: np.ndarray, off: np.ndarray) -> np.ndarray:
    start = space.copy()
    start[off[:-1][off[:-1] < off[1:]]] = True
    return start


class ChunkCoder:
    """Encodes slices of texts and decodes their ids."""

    def __init__(self, path: str, bits: int = CHUNK_BITS):
        self.words = encoder(path)
        self.bits = bits
        lib = self.words.library
        size = lib.get_vocab_size(with_added_tokens=True)
        self.token = [lib.id_to_token(i) for i in range(size)]
        self.number = [str(i) for i in range(size)]

    def slice(self, texts: pa.Array):
        """Distinct units and, per text, which units it consists of."""
        buf, off = utf8(texts)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        parts, per_text = units(buf, off, self.bits)
        coded = parts.dictionary_encode()
        ids, ends = self.words.encode(coded.dictionary)
        return ids, ends, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), per_text

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        ids, ends, code, per_text = self.slice(texts)
        size = (ends[1:] - ends[:-1])[code]
        total = np.concatenate(([0], np.cumsum(size)))
        return ids[ragged(ends[:-1][code], size)], total[per_text]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)`` (file without a decoder)."""
        token = self.token
        return " ".join([token[i] for i in ids])

    def digests(self, texts: pa.Array):
        """n_tokens, sha256 of the decimal ids and sha256 of the decoded text, per text."""
        ids, ends, code, per_text = self.slice(texts)
        size = ends[1:] - ends[:-1]
        flat, number, token = ids.tolist(), self.number, self.token
        bounds = ends.tolist()
        numbers, decoded = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = flat[a:b]
            numbers.append(" ".join([number[i] for i in part]).encode())
            decoded.append(" ".join([token[i] for i in part]).encode())
        n = np.concatenate(([0], np.cumsum(size[code])))[per_text]
        out_ids, out_text = [], []
        used = code[size[code] > 0]  # a unit of white space alone has no tokens
        kept = np.concatenate(([0], np.cumsum(size[code] > 0)))[per_text]
        used, kept = used.tolist(), kept.tolist()
        for a, b in zip(kept[:-1], kept[1:], strict=True):
            mine = used[a:b]
            out_ids.append(hashlib.sha256(b" ".join([numbers[u] for u in mine])).hexdigest())
            out_text.append(hashlib.sha256(b" ".join([decoded[u] for u in mine])).hexdigest())
        return np.diff(n), out_ids, out_text


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    ship(docs.sparkSession)
    src = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return src, src.schema["id"].dataType.simpleString()


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                 text_col: str = "text", bits: int = CHUNK_BITS) -> DataFrame:
    """Per row: doc_id, ids (array<int>) and decoded, the text that the ids decode to."""
    src, kind = _source(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in slices(batches, "text", SLICE_BYTES):
            coder = coder or ChunkCoder(vocab_path, bits)
            ids, off = coder.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            text = [coder.decode(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(text, pa.string())],
                                             ["doc_id", "ids", "decoded"])

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                   text_col: str = "text", bits: int = CHUNK_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (ids and texts stay in the task).

    ``carry`` names further columns of ``docs`` to keep.
    """
    ship(docs.sparkSession)
    # fixed inner names, so that carried columns of any name do not clash
    src = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text",
                          *(f"`{c}` AS c{i}" for i, c in enumerate(carry)))
    kind = src.schema["id"].dataType.simpleString()
    more = "".join(f", c{i} {src.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in slices(batches, "text", SLICE_BYTES):
            coder = coder or ChunkCoder(vocab_path, bits)
            n, numbers, texts = coder.digests(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n), pa.array(numbers, pa.string()), pa.array(texts, pa.string()),
                 *(part.column(f"c{i}") for i in range(len(carry)))],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(f"c{i}" for i in range(len(carry)))])

    out = src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256", *carry)
