"""Repeated passages by a sparse suffix array.

Words are maximal runs of non-space bytes, compared exactly. In every window of
``WINDOW`` consecutive word triples the smallest hash (the leftmost on ties)
selects a position; the suffixes at these positions are all that is kept, about
2 in 33. A passage of at least ``min_words`` words holds a selected position
whose next min_words - WINDOW + 1 words (the head) lie inside the passage, in every copy.

1. The suffixes of all documents are sorted by their leading words, with a fingerprint
   of the head as tie-break (range partitions that end with the document, so a hot
   suffix spans partitions), and neighbours are compared; a suffix whose head no
   neighbour of another text shares goes.
2. The suffixes that are left carry the words before and after their head. Those of one
   head are sorted in suffix order by the words after it; common prefixes with the
   neighbour give the extension to the right, and likewise the words before it, read
   backwards, the extension to the left. For every division of the rest of a passage
   between the two sides the suffixes that agree on both are copies of each other: one
   place of a repeated passage. A place is asked at the position that its own window
   selects, so each is found once; their union per document gives the maximal passages.
3. Heads that more than ``HOT`` suffixes share would make one task's group large. Their
   places are fingerprinted (96 bits) and grouped instead, which has the same result and
   is aggregated before it is exchanged.
4. The first document (smallest doc_id) keeps a place, later ones lose it.

Exact copies meet as whole texts before step 1, so a group of copies is one
document there; partial aggregation and skew-split joins take the hot windows.

Defined results: texts of fewer than min_words words, null and empty texts and
rows with a null doc_id have no passage; repetition inside one document does not
count; rows that share doc_id and text are one document, rows that share only
the doc_id are different documents ordered by text hash; other columns are
ignored (``remove_repeats`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (NOT_SPACE, WORD_BASE, WORD_BASE_2, partitions, range_hash, scratch, ship, slices,
                     utf8, word_hashes)

MIN_WORDS, WINDOW, GRAM = 50, 32, 3
#: Suffixes of one head that are extended in one task, and rows that a task sorts at once.
HOT, ROWS = 1024, 8192
SLICE_BYTES = 2 << 20
_PLACE = np.uint64((1 << 28) - 1)
_HIGH = np.uint64(0xFFFFFFFF << 32)


def select_positions(hashes: np.ndarray, words: np.ndarray, min_words: int):
    """Starts of all windows of min_words words inside documents, and the selected
    position of each."""
    n = np.diff(words)
    per_doc = np.maximum(n - min_words + 1, 0)
    if not per_doc.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.cumsum(per_doc)
    start = np.repeat(words[:-1] - (end - per_doc), per_doc) + np.arange(end[-1])
    span = min(WINDOW, min_words - GRAM + 1)
    i = np.arange(len(hashes) - GRAM + 1)
    gram = range_hash(hashes, i, i + GRAM, WORD_BASE)
    best = (gram & ~_PLACE) | i.astype(np.uint64)  # leftmost of equal hashes
    done = 1
    while done < span:
        step = min(done, span - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    return start, (best[start] & _PLACE).astype(np.int64)


def _hashes(texts: pa.Array):
    buf, off = utf8(texts)
    h, words, _, _ = word_hashes(buf, off, NOT_SPACE)
    return h, words


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _suffixes(src: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Distinct suffixes per document (leading words, fingerprint of the head), and one row
    without key per document (n words)."""
    right = max(min_words - WINDOW + 1, GRAM)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            h, words = _hashes(part.column("text"))
            _, at = select_positions(h, words, min_words)
            at = np.unique(at)
            key = range_hash(h, at, at + right, WORD_BASE) if len(at) else np.zeros(0, np.uint64)
            lead = h[at] & _HIGH | h[at + 1] >> np.uint64(32) if len(at) else key
            doc = np.searchsorted(words, at, side="right") - 1
            order = np.lexsort((key, doc))
            doc, key, lead = doc[order], key[order], lead[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            doc, key, lead = doc[new], key[new], lead[new]
            rows = np.concatenate((doc, np.arange(part.num_rows)))
            take = pa.array(rows)
            n = np.concatenate((np.zeros(len(doc), np.int32), np.diff(words).astype(np.int32)))
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([_long(lead), none]), pa.concat_arrays([_long(key), none]), part.column("th").take(take), part.column("th2").take(take),
                 part.column("id").take(take), pa.array(n)],
                ["lead", "key", "th", "th2", "id", "n"])

    return src.mapInArrow(run, f"lead long, key long, th long, th2 long, id {kind}, n int")


def _shared_suffixes(suffixes: DataFrame, kind: str) -> DataFrame:
    """Sorted suffixes whose neighbour of another text has the same key.

    The first and the last key of each sorted partition stay too, as their
    neighbours are not seen here; step 2 decides on them exactly.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_sure = None, True  # the last run of a (key, text) so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            key = rows.column("key").to_numpy()
            th = rows.column("th").to_numpy()
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (th[1:] != th[:-1])
            at = np.flatnonzero(first)
            same = key[at][1:] == key[at][:-1]
            sure = np.zeros(len(at), bool)
            sure[0] = held_sure
            sure[1:] |= same
            sure[:-1] |= same
            out = rows.take(pa.array(at[:-1][sure[:-1]]))
            held, held_sure = rows.slice(int(at[-1]), 1).to_batches()[0], bool(sure[-1])
            yield from out.to_batches()
        if held is not None:
            yield held

    n = partitions(suffixes)
    order = ["lead", "key", "th", "id"]
    return (suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("lead")
            .mapInArrow(run, f"key long, th long, id {kind}"))


def _windows(src: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Fingerprints (a, b) of all windows around the document's shared suffixes of hot heads
    (column keys), with the window starts (one row per distinct window and document)."""
    right = max(min_words - WINDOW + 1, GRAM)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            h, words = _hashes(part.column("text"))
            start, at = select_positions(h, words, min_words)
            if not len(start):
                continue
            doc = np.searchsorted(words, start, side="right") - 1
            key = range_hash(h, at, at + right, WORD_BASE)
            wanted = part.column("keys")
            per_doc = np.diff(wanted.offsets.to_numpy())
            keys = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            # per document membership: sort (document, key) pairs and look them up
            pair = np.sort(_pairs(np.repeat(np.arange(len(per_doc)), per_doc), keys))
            probe = _pairs(doc, key)
            place = np.minimum(np.searchsorted(pair, probe), max(len(pair) - 1, 0))
            hit = pair[place] == probe if len(pair) else np.zeros(len(probe), bool)
            start, doc = start[hit], doc[hit]
            if not len(start):
                continue
            a = range_hash(h, start, start + min_words, WORD_BASE)
            b = (range_hash(h, start, start + min_words, WORD_BASE_2) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((start, a, doc))
            doc, a, b, start = doc[order], a[order], b[order], (start - words[doc])[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            take = pa.array(doc[first])
            starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()),
                                              pa.array(start.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [_long(a[first]), pa.array(b[first].astype(np.uint32).view(np.int32)),
                 part.column("id").take(take), part.column("tag").take(take), starts],
                ["a", "b", "id", "tag", "starts"])

    return src.mapInArrow(run, f"a long, b int, id {kind}, tag int, starts array<int>")


def _contexts(src: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Occurrences of the document's shared suffixes (column keys): position, the window
    starts that select it (lo to hi), and the words before (read backwards) and after its
    head, 8 bytes each, zeros beyond the text."""
    head = max(min_words - WINDOW + 1, GRAM)
    rest = min_words - head

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            h, words = _hashes(part.column("text"))
            start, at = select_positions(h, words, min_words)
            if not len(start):
                continue
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
            at = at[first]
            doc = np.searchsorted(words, at, side="right") - 1
            key = range_hash(h, at, at + head, WORD_BASE)
            wanted = part.column("keys")
            pair = np.sort(_pairs(np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy())),
                                  wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
            probe = _pairs(doc, key)
            place = np.minimum(np.searchsorted(pair, probe), max(len(pair) - 1, 0))
            hit = np.flatnonzero(pair[place] == probe) if len(pair) else np.zeros(0, np.int64)
            # a text may hold very many suffixes: a bounded number of rows at a time
            for some in (hit[i:i + ROWS] for i in range(0, len(hit), ROWS)):
                p, d = at[some], doc[some]
                sides = []
                for places, inside in ((p[:, None] - 1 - np.arange(rest), lambda x: x >= words[d][:, None]),
                                       (p[:, None] + head + np.arange(rest), lambda x: x < words[d + 1][:, None])):
                    side = np.where(inside(places), h[np.clip(places, 0, len(h) - 1)], np.uint64(0))
                    raw = side.astype(">u8").tobytes()
                    sides.append(pa.array([raw[i * rest * 8:(i + 1) * rest * 8] for i in range(len(some))], pa.binary()))
                take, base = pa.array(d), words[d]
                yield pa.RecordBatch.from_arrays(
                    [_long(key[some]), part.column("id").take(take), part.column("tag").take(take),
                     *(pa.array((x - base).astype(np.int32)) for x in (p, lo[some], hi[some])), *sides],
                    ["key", "id", "tag", "at", "lo", "hi", "before", "after"])

    return src.mapInArrow(run, f"key long, id {kind}, tag int, at int, lo int, hi int, before binary, after binary")


def _common(order: np.ndarray, key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Common words of every row with the one before it in ``order``; -1 at a new key."""
    a, b = order[:-1], order[1:]
    same = np.logical_and.accumulate(side[a] == side[b], axis=1).sum(1) if side.shape[1] else np.zeros(len(a), int)
    return np.concatenate(([-1], np.where(key[a] == key[b], same, -1)))


def extend(rows: pa.Table, min_words: int) -> pa.Table:
    """Repeated places among occurrences of whole heads: (id, tag, starts, first, keep)."""
    rest = min_words - max(min_words - WINDOW + 1, GRAM)
    key, at, lo, hi = (rows.column(c).to_numpy() for c in ("key", "at", "lo", "hi"))
    before, after = (np.frombuffer(b"".join(rows.column(c).to_pylist()), ">u8").reshape(len(key), rest).astype(np.uint64)
                     for c in ("before", "after"))
    # documents by their order: id, then tag
    ids, tags = (rows.column(c).to_numpy() for c in ("id", "tag"))
    number = np.unique(ids, return_inverse=True)[1]
    _, one, doc = np.unique(number * (1 << 32) + tags, return_index=True, return_inverse=True)
    ends = []
    for side in (before, after):
        order = np.lexsort((*side.T[::-1], key))          # suffix order within the head
        ends.append((order, _common(order, key, side)))
    parts = []
    for left in range(rest + 1):
        group = np.empty((2, len(key)), np.int64)
        for row, (order, common), words in zip(group, ends, (left, rest - left), strict=True):
            row[order] = np.cumsum(common < words)
        here = np.flatnonzero((lo <= at - left) & (at - left <= hi))
        if len(here) < 2:
            continue
        place = group[0, here] * (len(key) + 1) + group[1, here]
        order = np.lexsort((doc[here], place))
        here, place = here[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        least = doc[here[first]]
        many = least != doc[here[last]]
        size = np.diff(np.append(first, len(place)))
        rows_ = np.repeat(many, size)
        parts.append((here[rows_], (at[here] - left)[rows_], np.repeat(least, size)[rows_]))
    if not parts:
        return pa.table({})
    which, start, least = (np.concatenate(c) for c in zip(*parts, strict=True))
    mine = doc[which]
    order = np.lexsort((start, least, mine))
    mine, least, start = mine[order], least[order], start[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(mine)), bool), (mine[1:] != mine[:-1]) | (least[1:] != least[:-1]))))
    kind = rows.column("id").type
    return pa.table({
        "id": pa.array(ids[one[mine[new]]], kind), "tag": pa.array(tags[one[mine[new]]], pa.int32()),
        "starts": pa.ListArray.from_arrays(pa.array(np.append(new, len(mine)), pa.int32()), pa.array(start.astype(np.int32))),
        "first": pa.array(ids[one[least[new]]], kind), "keep": pa.array(mine[new] == least[new])})


def _extended(contexts: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Repeated places from the occurrences, head by head, many heads at a time."""
    names = ["id", "tag", "starts", "first", "keep"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = extend(table.combine_chunks(), min_words) if table.num_rows else table
            if table.num_rows and "id" in out.column_names:
                yield from out.select(names).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))           # the last head may go on
                yield from give(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from give(pa.Table.from_batches(held))

    return (contexts.repartition("key").sortWithinPartitions("key", "after")
            .mapInArrow(run, f"id {kind}, tag int, starts array<int>, first {kind}, keep boolean"))


def _pairs(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One 64-bit value per (document of the slice, key)."""
    return key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, copies): windows (id, tag, starts, first, keep) repeated across texts;
    copies (id, tag, n, first, keep), the documents whose whole text occurs again."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"),
                      F.xxhash64(F.lit(1), text).alias("th2")).filter("id IS NOT NULL")
    kind = src.schema["id"].dataType.simpleString()
    found = scratch(_suffixes(src, kind, min_words), "suffixes")
    tag = F.shiftright("th", 32).cast("int").alias("tag")
    every = found.filter("key IS NULL").select("th", "th2", "id", "n")
    groups = (every.filter(F.col("n") >= min_words).groupBy("th", "th2")
              .agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last"))
    copies = (every.join(groups, ["th", "th2"])
              .select("id", tag, "n", "first", (F.col("id") == F.col("first")).alias("keep")).distinct())
    shared = scratch(_shared_suffixes(found.filter("key IS NOT NULL").select("key", "th", "id"), kind),
                     "shared-suffixes")
    hot = shared.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    per_doc = (shared.join(hot, "key", "left").groupBy("id", "th")
               .agg(*(F.collect_list(F.when(F.col("hot").isNull() == cold, F.col("key"))).alias(name)
                      for name, cold in (("keys", True), ("hot", False)))))
    # rows that share doc_id and text are one document
    texts = scratch(src.drop("th2").join(per_doc, ["id", "th"]).withColumn("tag", tag), "shared-texts")
    places = scratch(_extended(_contexts(texts.filter(F.size("keys") > 0).select("id", "tag", "text", "keys"), kind,
                                         min_words), kind, min_words), "places")
    hot_texts = texts.filter(F.size("hot") > 0).select("id", "tag", "text", F.col("hot").alias("keys"))
    windows = scratch(_windows(hot_texts, kind, min_words), "windows")
    firsts = scratch(windows.groupBy("a", "b")
                     .agg(F.min(F.struct("id", "tag")).alias("f"), F.max(F.struct("id", "tag")).alias("l"))
                     .filter("f < l").select("a", "b", F.col("f.id").alias("first"), F.col("f.tag").alias("ftag")),
                     "first-windows")
    by_hash = windows.join(firsts, ["a", "b"]).select(
        "id", "tag", "starts", "first",
        ((F.col("id") == F.col("first")) & (F.col("tag") == F.col("ftag"))).alias("keep"))
    return places.unionByName(by_hash), copies


def _merged(windows: DataFrame, copies: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Maximal passages (id, tag, keep, spans array<start, end>, first): from windows,
    and of whole copied texts."""
    starts = F.array_sort(F.array_distinct(F.flatten("all_starts")))
    spans = F.aggregate(
        starts, F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                     F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                      (s + min_words).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s.alias("start"), (s + min_words).alias("end"))))))
    # the first copy of a text keeps the windows that no earlier text holds
    lost = (windows.filter("NOT keep").groupBy("id", "tag")
            .agg(F.flatten(F.collect_list("starts")).alias("lost")))
    kept = (copies.filter("keep").join(lost, ["id", "tag"], "left")
            .select("id", "tag",
                    F.array_except(F.sequence(F.lit(0), F.col("n") - min_words),
                                   F.coalesce("lost", F.array().cast("array<int>"))).alias("starts"),
                    F.col("id").alias("first"), F.lit(True).alias("keep"))
            .filter(F.size("starts") > 0))
    own = (windows.select("id", "tag", "starts", "first", "keep").unionByName(kept)
           .groupBy("id", "tag", "keep")
           .agg(F.collect_list("starts").alias("all_starts"), F.min("first").alias("first"))
           .select("id", "tag", "keep", spans.alias("spans"), "first"))
    whole = copies.filter("NOT keep").select("id", "tag", "keep", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
                          .cast("array<struct<start:int,end:int>>").alias("spans"), "first")
    return own, whole


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per maximal repeated passage: doc_id, start_word, end_word (exclusive),
    n_words, first_doc_id (an earlier document that holds a part of it, or the document
    itself) and keep (true in the first document, false where the passage is removed)."""
    own, whole = _merged(*repeated_windows(docs, min_words, id_col, text_col), min_words)
    rows = own.unionByName(whole).select("id", "tag", "keep", "first", F.inline("spans"))
    # a copy's own windows are inside its whole text: keep the widest passage of equal starts
    rows = rows.groupBy("id", "tag", "keep", "start").agg(F.max("end").alias("end"), F.min("first").alias("first"))
    return rows.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"),
                       F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"),
                       F.col("first").alias("first_doc_id"), "keep")


def cut_words(texts: pa.Array, spans: pa.Array) -> list[str]:
    """The texts without the word ranges ``spans`` (and the white space after them)."""
    buf, off = utf8(texts)
    _, words, start, _ = word_hashes(buf, off, NOT_SPACE)
    out = []
    for i, cuts in enumerate(spans.to_pylist()):
        lo, hi, text = int(off[i]), int(off[i + 1]), []
        at = lo
        for cut in sorted((c["start"], c["end"]) for c in cuts or []):
            first, last = words[i] + cut[0], words[i] + cut[1]
            to = int(start[last]) if last < words[i + 1] else hi
            text.append(buf[at:max(at, int(start[first]))].tobytes())
            at = max(at, to)
        text.append(buf[at:hi].tobytes())
        out.append(b"".join(text).decode("utf-8", "replace"))
    return out


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                   text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every passage that an earlier document holds cut out of the text.

    Columns, rows and clean texts stay as they are; ``length_col`` becomes the new
    number of characters where a text was cut. A text cut away whole is empty.
    """
    own, whole = _merged(*repeated_windows(docs, min_words, id_col, text_col), min_words)
    # copies of earlier documents go whole; their own windows add nothing
    cuts = (own.filter("NOT keep").select("id", "tag", "spans").unionByName(whole.select("id", "tag", "spans"))
        .groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    cols = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # fixed inner names: input columns of any name ride along without a clash
    src = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)),
                      F.col(f"`{id_col}`").alias("id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tag"))
    joined = src.join(cuts, ["id", "tag"], "left").select(*(f"c{i}" for i in range(len(cols))), "spans")
    where = cols.index(text_col)
    length = cols.index(length_col) if length_col in cols else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column("spans").is_valid()
            arrays = list(batch.columns[:-1])
            rows = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
            if len(rows):
                take = pa.array(rows)
                new = cut_words(arrays[where].take(take), batch.column("spans").take(take))
                arrays[where] = _put(arrays[where], cut, new)
                if length is not None:
                    arrays[length] = _put(arrays[length], cut, [len(t) for t in new])
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    schema = joined.drop("spans").schema
    return joined.mapInArrow(run, schema).toDF(*cols)


def _put(array: pa.Array, mask: pa.Array, values: list) -> pa.Array:
    import pyarrow.compute as pc

    return pc.replace_with_mask(array, mask, pa.array(values, array.type))
