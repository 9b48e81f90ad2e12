"""Token counts by rank-synchronous array merging (byte-level BPE).

Texts are cut into pre-tokens; the distinct pre-tokens of a slice are held as
one ragged numpy array of symbols, every sequence applies its own lowest-rank
pair in the same step, and the surviving symbols are counted. No shuffle: each
task counts its own rows.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows with a
null or repeated doc_id are counted like any other row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import ship, slices, utf8

#: The pre-token pattern of byte-level BPE (fixed value of the tokenizer family).
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Texts in which a space touches other white space or an end are cut by the full pattern.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_PLAIN = rf"(?s)(^ )|( $)|( {_SPACE})|({_SPACE} )"
NONE = np.int32(2**31 - 1)
SLICE_BYTES = 16 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


class RankMerger:
    """Merge ranks of one byte-level BPE file as hash-table arrays."""

    SLOTS = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.uint64)
        b = np.array([vocab[y] for _, y in pairs], np.uint64)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        # every occurrence of a pair may be merged in one step only if no merge
        # that uses a symbol ranks before the merge that makes the symbol
        made = {}
        for rank, (x, y) in enumerate(pairs):
            made.setdefault(x + y, rank)
        self.all_at_once = len(made) == len(pairs) and all(
            made.get(x, -1) < rank and made.get(y, -1) < rank
            for rank, (x, y) in enumerate(pairs))
        keys = (a << np.uint64(32)) | b
        size = 1 << self.SLOTS
        self.key = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE)
        self.probes = 1
        for rank, (k, s) in enumerate(zip(keys, self._slot(keys).tolist(), strict=True)):
            step = 0
            while self.rank[s] != NONE:
                s = (s + 1) % size
                step += 1
            self.key[s], self.rank[s] = k, rank
            self.probes = max(self.probes, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each symbol pair, ``NONE`` where they do not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.rank[slot], NONE)
        for _ in range(self.probes - 1):
            todo = np.flatnonzero((out == NONE) & (self.rank[slot] != NONE))
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.SLOTS) - 1)
            hit = todo[self.key[slot[todo]] == keys[todo]]
            out[hit] = self.rank[slot[hit]]
        return out

    def merge(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Token count of each byte sequence data[off[i]:off[i+1]]."""
        counts = np.diff(off).astype(np.int64)
        live = np.flatnonzero(counts > 1)
        if not len(live):
            return counts
        take = np.repeat(off[live] - np.concatenate(([0], np.cumsum(counts[live])[:-1])),
                         counts[live]) + np.arange(counts[live].sum())
        sym = self.byte_id[data[take]]
        size = counts[live]
        rank = self._all_ranks(sym, size)
        while len(live):
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            best = np.minimum.reduceat(rank, start)
            on = best != NONE
            if not on.all():  # finished sequences leave the arrays
                counts[live[~on]] = size[~on]
                keep = np.repeat(on, size)
                sym, rank, live, size, best = sym[keep], rank[keep], live[on], size[on], best[on]
                if not len(live):
                    break
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.flatnonzero(rank == np.repeat(best, size))
            seq = np.searchsorted(start, at, side="right") - 1
            if self.all_at_once:  # of overlapping equal pairs every second one, from the left
                fresh = np.ones(len(at), bool)
                fresh[1:] = at[1:] != at[:-1] + 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                pick = (np.arange(len(at)) - run) % 2 == 0
            else:  # the leftmost pair of each sequence
                pick = np.ones(len(at), bool)
                pick[1:] = seq[1:] != seq[:-1]
            at, seq = at[pick], seq[pick]
            sym[at] = self.merged[best[seq]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank = sym[keep], rank[keep]
            size -= np.bincount(seq, minlength=len(size))
            at = at - np.arange(len(at))  # places after the removal
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            first = np.zeros(len(sym) + 1, bool)
            first[start] = True
            first[-1] = True
            todo = np.concatenate((at, at[~first[at]] - 1))
            rank[todo] = NONE
            todo = todo[~first[todo + 1]]
            rank[todo] = self.ranks(sym[todo], sym[todo + 1])
        return counts

    def _all_ranks(self, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NONE
        return rank


class TextCounter:
    """Token counts of texts: distinct chunks, distinct pre-tokens, then merging."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.cut = regex.compile("|".join(map(regex.escape, self.merger.special))) if self.merger.special else None
        special = "".join(f"|({regex.escape(s)})" for s in self.merger.special)
        self.odd = _NOT_PLAIN + special

    def counts(self, texts: pa.Array) -> np.ndarray:
        """One count per text; special strings count one token each."""
        total = np.zeros(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        # a single space between non-space characters always starts a new pre-token
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        words = parts.flatten().dictionary_encode()
        off = parts.offsets.to_numpy().astype(np.int64)
        off -= off[0]
        code = words.indices.to_numpy().astype(np.int64) * 2 + 1
        code[off[:-1]] -= 1  # the first piece has no space before it
        used, code = _compact(code)
        spaced, bare = used[used & 1 == 1], used[used & 1 == 0]
        # all pieces after a space at once: each starts at the token that starts with the space
        joined = pc.binary_join_element_wise(
            " ", words.dictionary.take(pa.array(spaced >> 1)), "").to_pylist()
        tokens = self.pattern.findall("".join(joined)) if joined else []
        marks = [len(tokens)]
        for piece in words.dictionary.take(pa.array(bare >> 1)).to_pylist():
            tokens += self.pattern.findall(piece)
            marks.append(len(tokens))
        odd_rows = np.flatnonzero(odd)
        for i in odd_rows.tolist():
            text = texts[i].as_py()
            pieces = self.cut.split(text) if self.cut else [text]
            total[i] = len(pieces) - 1
            for p in pieces:
                tokens += self.pattern.findall(p)
            marks.append(len(tokens))
        distinct = pa.array(tokens, pa.large_string()).dictionary_encode()
        data, where = utf8(distinct.dictionary)
        count = np.append(self.merger.merge(data, where), 0)
        of_token = distinct.indices.to_numpy(zero_copy_only=False)
        running = np.concatenate(([0], np.cumsum(count[of_token])))
        first = data[where[:-1]] == 32 if len(where) > 1 else np.zeros(0, bool)
        begin = np.flatnonzero(first[of_token[:marks[0]]])
        per_piece = np.zeros(len(used), np.int64)
        per_piece[used & 1 == 1] = np.diff(running[np.append(begin, marks[0])])
        rest = np.diff(running[marks])
        per_piece[used & 1 == 0] = rest[:len(bare)]
        total[plain] += _sums(per_piece[code], np.diff(off))
        total[odd_rows] += rest[len(bare):]
        return total


def _compact(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and each row's place among them (codes are dense, so no sort)."""
    seen = np.zeros(int(code.max(initial=-1)) + 1, bool)
    seen[code] = True
    used = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    return used, place[code]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``sizes`` values."""
    total = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in slices(batches, "text", SLICE_BYTES):
            counter = counter or TextCounter(vocab_path)
            text = part.column("text").fill_null("")
            tokens = counter.counts(text)
            _, off = utf8(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
