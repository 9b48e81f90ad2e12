"""Whole-text encoding with the ``tokenizers`` library, each distinct word once.

The word-level BPE vocabulary drops white space, so a text may be cut before any
space or line feed without changing its ids. A slice of texts becomes its
distinct pieces; pieces already seen by this worker come from a bounded memo,
the rest go to the library. Plain Latin words skip the library's normaliser and
pre-tokeniser, which leave them as they are, and go straight to its BPE model.
"""

from __future__ import annotations

import gc
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

#: Entries after which a worker's memo starts anew (bounds its memory).
MEMO_ENTRIES = 1 << 20
_ENCODERS: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """This worker's encoder of the vocabulary file; its memo lasts across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i], ..., start[i] + size[i] - 1 for all i, in a row."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(start - (total - size), size) + np.arange(total[-1])


def cut_before(buf: np.ndarray, off: np.ndarray, at: np.ndarray):
    """Pieces of the texts, cut before the flagged bytes: array, offsets per text."""
    flag = at.copy()
    flag[off[:-1][off[:-1] < off[1:]]] = True
    start = np.flatnonzero(flag)
    ends = np.append(start, len(buf)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf)))
    return pieces, np.searchsorted(start, off)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .token_counts import byte_alphabet
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def lookup(self, words: list[str], plain: np.ndarray):
        """(ids, start, size) of each distinct word; ``plain``: lower-case Latin letters only."""
        if len(self.memo) + len(words) > MEMO_ENTRIES:
            self.reset()
        place = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        simple, rest = new[plain[new]], new[~plain[new]]
        collecting = gc.isenabled()
        gc.disable()  # many short-lived token objects, no cycles
        try:
            tokenize, table, memo, ids, ends = (
                self.model.tokenize, self.alphabet, self.memo, self.ids, self.ends)
            n = len(ends) - 1
            for w in map(words.__getitem__, simple.tolist()):
                form = w if w.isascii() else w.encode().decode("latin-1").translate(table)
                ids.extend([t.id for t in tokenize(form)])
                ends.append(len(ids))
                memo[w] = n
                n += 1
            others = [words[i] for i in rest.tolist()]
            for w, e in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False),
                            strict=True):
                ids.extend(e.ids)
                ends.append(len(ids))
                memo[w] = n
                n += 1
        finally:
            if collecting:
                gc.enable()
        first = n - len(new)
        place[simple] = np.arange(first, first + len(simple))
        place[rest] = np.arange(first + len(simple), n)
        ids = np.array(self.ids, np.uint32)
        ends = np.array(self.ends, np.int64)
        return ids, ends[place], ends[place + 1] - ends[place]

    def distinct(self, pieces: pa.Array):
        """(ids, start, size) of each distinct piece (with its leading space)."""
        text = pc.ascii_ltrim(pieces, characters=" \n")
        latin = pc.match_substring_regex(text, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$")
        text = pc.if_else(latin, pc.utf8_lower(text), text)
        # a full stop or comma after letters is a pre-token of its own
        tail = np.zeros(len(pieces), np.int64)
        for code, mark in ((1, "."), (2, ",")):
            has = pc.and_(latin, pc.ends_with(text, mark))
            tail[has.to_numpy(zero_copy_only=False)] = code
        text = pc.if_else(latin, pc.utf8_rtrim(text, characters=".,"), text)
        words = text.dictionary_encode()
        plain = pc.match_substring_regex(words.dictionary, "^[a-zß-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        number = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, start, size = self.lookup(number + [".", ","], np.append(plain, [False, False]))
        marks = [ids[start[i]:start[i] + size[i]] for i in (-2, -1)]
        of = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, size = start[of], size[of]
        # words followed by a mark get entries of their own
        extra = np.array([0, len(marks[0]), len(marks[1])])[tail]
        end = np.cumsum(size + extra)
        flat = np.zeros(int(end[-1]) if len(end) else 0, np.uint32)
        first = end - size - extra
        flat[ragged(first, size)] = ids[ragged(start, size)]
        for code in (1, 2):
            rows = np.flatnonzero(tail == code)
            for j, t in enumerate(marks[code - 1]):
                flat[first[rows] + size[rows] + j] = t
        return flat, first, size + extra

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the offsets of each text."""
        buf, off = utf8(texts)
        pieces, per_text = cut_before(buf, off, (buf == 32) | (buf == 10))
        coded = pieces.dictionary_encode()
        flat, start, size = self.distinct(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        length = size[code]
        total = np.concatenate(([0], np.cumsum(length)))
        return flat[ragged(start[code], length)], total[per_text]
