"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of ``DIM`` entries 1 and -1, drawn from its code
point, so no alphabet is stored. A letter at distance j from the end of an n-gram is
rotated by j places, and the product of the rotated vectors binds them into the vector
of the n-gram. The vectors of all trigrams of a text (words in lower case, with their
two borders) are added up: its profile. A language's profile is the sum over all
learned texts of that language; a text belongs to the language whose profile has the
largest cosine with its own.

Counts come first: a task counts the distinct trigrams of its texts and multiplies the
counts with the trigram vectors. Training reduces each task's texts to one profile per
language; only these sums are exchanged. Texts are counted whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing could be learned. ``score`` is the cosine, 0 where it is negative.
Equal cosines: the first language in order. Rows with a null doc_id are never held out
and are learned from; rows that repeat count as often as they occur. The labels are the
``MAX_LANGUAGES`` commonest values of lang (ties in order of the name), which bounds the
model; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship, slices, sum_arrays, utf8
from .quality import held_out

DIM, MAX_LANGUAGES = 1024, 256
SLICE_BYTES = 4 << 20
#: Cells of one block of counts, and trigrams of one block of vectors.
CELLS, VECTORS = 1 << 22, 4096
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Table over all code points: does the character count as a letter?"""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vectors (1 and -1, int8) of code points."""
    block = np.arange(dim // 64, dtype=np.uint64)
    bits = mix((codes.astype(np.uint64)[:, None] << np.uint64(12) | block) * np.uint64(0x9E3779B97F4A7C15)
               + np.uint64(0xD1B54A32D192ED03))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigrams(texts: pa.Array):
    """(document of every trigram, its number, (K, 3) letters of the distinct ones, letters per document).

    0 stands for the border of a word.
    """
    buf, off = utf8(pc.utf8_lower(texts))
    chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    ends = starts[off]
    code = np.where(is_letter()[chars], chars, 0).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    # one border between words and between documents
    border = np.zeros(len(code) + 1, bool)
    border[ends[1:-1]] = True
    keep = code != 0
    letters = np.bincount(doc[keep], minlength=len(texts))
    word = np.cumsum(~keep) + np.cumsum(border)[:-1]
    code, doc, word = code[keep], doc[keep], word[keep]
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 3), np.uint32), letters
    table = np.zeros(0x110000, np.int64)
    table[code] = 1
    used = np.flatnonzero(table)
    table[used] = np.arange(1, len(used) + 1)
    mid = table[code]
    same = word[1:] == word[:-1]
    before, after = np.zeros_like(mid), np.zeros_like(mid)
    before[1:], after[:-1] = np.where(same, mid[:-1], 0), np.where(same, mid[1:], 0)
    base = len(used) + 1
    key = (before * base + mid) * base + after
    if base ** 3 <= 1 << 24:
        seen = np.bincount(key, minlength=base ** 3)
        distinct = np.flatnonzero(seen)
        number = np.zeros(base ** 3, np.int64)
        number[distinct] = np.arange(len(distinct))
        key = number[key]
    else:
        distinct, key = np.unique(key, return_inverse=True)
    used = np.concatenate(([0], used)).astype(np.uint32)
    parts = np.stack([used[distinct // (base * base)], used[distinct // base % base], used[distinct % base]], 1)
    return doc, key, parts, letters


def trigram_vectors(parts: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of trigrams: each letter's vector rotated by its distance from the end."""
    codes, at = np.unique(parts, return_inverse=True)
    at = at.reshape(parts.shape)
    v = letter_vectors(codes, dim)
    return np.roll(v, 2, 1)[at[:, 0]] * np.roll(v, 1, 1)[at[:, 1]] * v[at[:, 2]]


def bundles(row: np.ndarray, key: np.ndarray, parts: np.ndarray, rows: int, dim: int = DIM) -> np.ndarray:
    """Sums of the trigram vectors per row (float64, whole numbers)."""
    out = np.zeros((rows, dim))
    order = np.argsort(row, kind="stable")
    row, key = row[order], key[order]
    step = max(1, CELLS // max(len(parts), 1))
    for k in range(0, len(parts), VECTORS):
        vectors = trigram_vectors(parts[k:k + VECTORS], dim).astype(np.float32)
        inside = (key >= k) & (key < k + VECTORS)
        r, c = (row, key) if inside.all() else (row[inside], key[inside] - k)
        for lo in range(0, rows, step):
            hi = min(lo + step, rows)
            a, b = np.searchsorted(r, (lo, hi))
            counts = np.bincount((r[a:b] - lo) * len(vectors) + c[a:b], minlength=(hi - lo) * len(vectors))
            # float32 holds the sums of such products exactly while a text has fewer than 2**24 trigrams
            kind = np.float32 if b - a < 1 << 24 else np.float64
            out[lo:hi] += counts.reshape(hi - lo, -1).astype(kind) @ vectors
    return out


class Profiles:
    """Languages (in order) and their profiles, scaled to length 1."""

    def __init__(self, languages: list, sums: np.ndarray):
        length = np.sqrt((sums ** 2).sum(1))
        self.languages = [l for l, n in zip(languages, length) if n > 0]
        self.unit = sums[length > 0] / length[length > 0][:, None]

    def predict(self, texts: pa.Array) -> tuple[list, np.ndarray]:
        """Language and score of every text."""
        doc, key, parts, letters = trigrams(texts)
        label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages or not len(doc):
            return label, score
        sums = bundles(doc, key, parts, len(texts), self.unit.shape[1])
        cosine = sums @ self.unit.T / np.maximum(np.sqrt((sums ** 2).sum(1)), 1e-300)[:, None]
        best = cosine.argmax(1)
        score = np.where(letters > 0, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist())], score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages, from all labelled texts that are not held out."""
    ship(docs.sparkSession)
    learn = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
             .filter("lang IS NOT NULL").filter(~held_out("id")).drop("id"))
    # MAX_LANGUAGES short strings at most
    languages = sorted(r["lang"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang")
                       .limit(MAX_LANGUAGES).collect())
    if not languages:
        return Profiles([], np.zeros((0, DIM)))
    number = pa.array(languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), DIM))
        for part in slices(batches, "text", SLICE_BYTES):
            doc, key, parts, _ = trigrams(part.column("text"))
            lang = np.asarray(pc.fill_null(pc.index_in(part.column("lang"), number), -1))[doc]
            known = lang >= 0
            total += bundles(lang[known], key[known], parts, len(languages))
        task = TaskContext.get().partitionId()
        size = len(languages)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, task, np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * DIM), pa.array(total.ravel()))],
            ["i", "task", "g"])

    rows = sum_arrays(learn.mapInArrow(run, "i int, task int, g array<double>")).collect()
    sums = np.zeros((len(languages), DIM))
    for r in rows:                     # one row per language
        sums[r["i"]] = r["g"]
    return Profiles(languages, sums)


def predict(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            label, score = model.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(label, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
