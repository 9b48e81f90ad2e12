"""Encoding, files and counts against the tokenizers library."""
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from riskloom.llm import chunk_bpe, token_counts, token_files
from riskloom.llm.word_bpe import WordEncoder

WORD, BYTE = str(path("word_bpe_49k.json")), str(path("byte_bpe_50k.json"))
ODD = ["", None, " ", "  a  b.\n\n", "hello<|endoftext|>world.  <|startoftext|>", "aaaaaaaaa" * 500, "\x1c a  b",
       "don't we'll.. \n\n x\t\ty ", "e\u0301\u0301  x", "J\u030c \u01f0 \u03a3\u03b1\u03c2, \u0130stanbul",
       "12345 678 a.b, ,", "\u00c0\u00c9. \u0178\u00ff \u00df\u00f7 \u00d7 \u00aa\u00ba\u00b5", "it's, he's. 's",
       "\u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8" * 400, "x\u00a0 y\u3000 z \u2028", "!!!!!!! ??? <|endoftext|>",
       "the cat " * 20_000, "\U0001f600\U0001f600 ok \u200d"]


def texts(spark, n=150):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(n).collect()
    return [r.text for r in rows] + ODD


def frame(spark, values):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(values)] + [(7, values[7]), (7, "again")]
    return (spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS id", "2 AS n_tokens", "'x' AS start", "0 AS first").repartition(5), rows)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def library(tok, rows):
    return [e.ids for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def test_word_encoder_equals_library(spark, word):
    values = texts(spark)
    enc = WordEncoder(WORD)
    want = library(word, [(0, t) for t in values])
    for _ in range(2):  # from the library, then from the memo
        ids, off = enc.encode(pa.array(values, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want


def test_memo_is_bounded(spark, word, monkeypatch):
    monkeypatch.setattr("riskloom.llm.word_bpe.MEMO_ENTRIES", 50)
    enc, values = WordEncoder(WORD), texts(spark, 20)
    for t in values:
        ids, _ = enc.encode(pa.array([t], pa.string()))
        assert ids.tolist() == library(word, [(0, t)])[0]


@pytest.mark.parametrize("bits", [3, 8])
def test_chunk_coder_round_trip(spark, word, bits):
    df, rows = frame(spark, texts(spark, 60))
    want = {}
    for (i, _), ids in zip(rows, library(word, rows), strict=True):
        want.setdefault(i, []).append((ids, word.decode(ids, skip_special_tokens=False)))
    got = {}
    for r in chunk_bpe.encode_texts(df, WORD, bits=bits).collect():
        got.setdefault(r.doc_id, []).append((r.ids, r.decoded))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    digest = {i: sorted((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(t.encode()).hexdigest()) for ids, t in v) for i, v in want.items()}
    seen = {}
    for r in chunk_bpe.encode_digests(df, WORD, bits=bits, carry=("first", "id")).collect():
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
        assert (r["first"], r["id"]) == (0, 1)
    assert {k: sorted(v) for k, v in seen.items()} == digest


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(1)
    body = bytes(rng.integers(97, 123, 5000).astype(np.uint8)).decode()
    parts = []
    for lead in ("", "another start, of its own length "):
        buf = np.frombuffer((lead + body).encode(), np.uint8)
        cut = np.flatnonzero(chunk_bpe.chunk_borders(buf, np.array([0, len(buf)]))) - len(lead)
        parts.append({c for c in cut.tolist() if c > 32})
    assert parts[0] == parts[1] and len(parts[0]) > 8


def test_token_counts(spark):
    df, rows = frame(spark, texts(spark))
    want = sorted((str(i), len((t or "").encode()), len(ids), len(ids) > 1024) for (i, t), ids in
                  zip(rows, library(Tokenizer.from_file(BYTE), rows), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, BYTE).collect())
    assert got == want


def test_leftmost_merging_gives_the_same_counts(spark):
    values = [t or "" for t in texts(spark, 20) if len(t or "") < 5000]
    fast, slow = token_counts.TextCounter(BYTE), token_counts.TextCounter(BYTE)
    assert fast.merger.all_at_once
    slow.merger.all_at_once = False
    assert fast.counts(pa.array(values)).tolist() == slow.counts(pa.array(values)).tolist()


def test_simple8b_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 239, 240, 1023, 1024, 1025, 7000):
        for _ in range(12):
            x = rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
            x *= rng.integers(0, 2, n).astype(np.uint64)
            words, block, at, value = token_files.pack(x)
            assert (token_files.unpack(words, block, n, at, value) == x).all()
    assert len(token_files.pack(np.zeros(2048, np.uint64))[0]) == 10  # 5 words of 240 zeros a block


def test_token_files(spark, word, tmp_path):
    df, rows = frame(spark, texts(spark))
    token_files.write_ids(df, str(tmp_path / "ids"), WORD, end_id=2)
    want, start = [], 0
    data = sorted(zip(rows, library(word, rows), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    groups = {}
    for (i, _), ids in data:
        ids = ids + [2]
        groups.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)))
    got = {}
    whole = token_files.read_ids(spark, str(tmp_path / "ids")).collect()
    for r in sorted(whole, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
        want.append(r.doc_id)
        got.setdefault(r.doc_id, []).append((r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes()), tuple(r.ids)))
    assert want == sorted(want, key=lambda i: (i is not None, i or 0))  # ascending, null first
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in groups.items()}
    digest = token_files.read_ids(spark, str(tmp_path / "ids"), digest=True).collect()
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in digest) == sorted(
        (str(r.doc_id), r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in whole)


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(df, BYTE).count() == 0
    assert chunk_bpe.encode_digests(df, WORD).count() == 0
    token_files.write_ids(df, str(tmp_path / "none"), WORD)
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_free_arrow_memory_is_given_back_after_each_batch(monkeypatch):
    """Idle workers keep what the pool keeps: the next stages' tasks then lack it."""
    from riskloom.llm import common

    given = []
    pool = type("Pool", (), {"release_unused": lambda self: given.append(1)})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_pydict({"text": ["a b", "c"] * 3}) for _ in range(3)]
    assert sum(p.num_rows for p in common.slices(batches, "text", 4)) == 18
    assert len(given) == 3


def test_a_coder_slice_holds_few_ids_at_once():
    """Ids of a slice are Python objects for a while: the slice bounds them, not the batch."""
    from riskloom.llm.common import slices

    text = "word " * 200_000                                  # 1 MB
    batch = pa.RecordBatch.from_pydict({"text": [text] * 12})
    parts = [p.num_rows for p in slices([batch], "text", chunk_bpe.SLICE_BYTES)]
    assert sum(parts) == 12 and max(parts) <= 4
