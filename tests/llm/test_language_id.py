"""Held-out accuracy, a per-letter forward pass and odd inputs of the language profiles."""
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import language_id as L
from riskloom.llm.registry import op12_language_id

SF = "/root/testdata/sf0.01"


def plain_bundle(text, dim=L.DIM):
    """Trigram by trigram, letter by letter."""
    total = np.zeros(dim)
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    for w in filter(None, words):
        padded = [0, *map(ord, w), 0]
        for i in range(len(padded) - 2):
            v = np.ones(dim)
            for j, c in enumerate(padded[i:i + 3]):
                v = v * np.roll(L.letter_vectors(np.array([c]))[0].astype(float), 2 - j)
            total += v
    return total


TEXTS = ["The cat, the hat.", "Élève à l'été", "", None, "12 34", "a", "ab c\nab", "中文字 word", "x" * 50]


def test_bundles_equal_the_letterwise_sum():
    doc, key, parts, letters = L.trigrams(pa.array(TEXTS, pa.string()))
    got = L.bundles(doc, key, parts, len(TEXTS))
    for t, row, n in zip(TEXTS, got, letters):
        assert np.array_equal(row, plain_bundle(t or "")) and n == sum(c.isalpha() for c in t or "")


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(chr(c) for c in rng.integers(0x4E00, 0x4F00, 200)) for _ in range(20)]
    want = L.bundles(*L.trigrams(pa.array(texts))[:3], 20)
    monkeypatch.setattr(L, "VECTORS", 100)
    monkeypatch.setattr(L, "CELLS", 300)
    assert np.array_equal(L.bundles(*L.trigrams(pa.array(texts))[:3], 20), want)


def test_letter_vectors_are_nearly_orthogonal():
    v = L.letter_vectors(np.arange(200)).astype(float)
    off = v @ v.T / L.DIM - np.eye(200)
    assert set(np.unique(v)) == {-1.0, 1.0} and np.abs(off).max() < 0.2 and abs(off.mean()) < 0.01


def test_query_held_out_accuracy(spark):
    got = op12_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) == len(both)
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(both.doc_id, both.held_out, strict=True))
    held = both[both.held_out & (both.text.str.len() > 20)]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = docs.toPandas()
    proto = {}
    for r in rows.itertuples():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            proto[r.lang] = proto.get(r.lang, 0) + plain_bundle(r.text or "")
    got = L.predict(docs, L.train(docs.repartition(3))).toPandas().merge(rows, on="doc_id")
    for r in got.itertuples():
        b = plain_bundle(r.text or "")
        cos = {l: b @ p / max(np.linalg.norm(b) * np.linalg.norm(p), 1e-300) for l, p in proto.items()}
        assert cos[r.lang_pred] >= max(cos.values()) - 1e-9 and abs(r.score - max(cos[r.lang_pred], 0)) < 1e-9


def test_labels_of_held_out_rows_are_never_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 "
                             "THEN 'zz' ELSE lang END AS lang", "source AS held_out", "lang AS i")
    a, b = L.train(docs), L.train(turned.repartition(5))
    assert a.languages == b.languages and np.allclose(a.unit, b.unit, atol=1e-12)


def test_odd_rows_and_tables(spark):
    kind = "doc_id long, text string, lang string, score string, lang_pred string"
    rows = [(0, "the then that", "en", "s", "p"), (0, "the then that", "en", "s", "p"), (7, "der die das", "de", "", ""),
            (8, None, "en", None, None), (10, "", "de", None, None), (None, "the those", None, None, None),
            (11, "123 !?", "fr", None, None), (9, "der " * 200_000, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    m = L.train(docs)
    assert m.languages == ["de", "en"]          # fr has no letter to learn from
    got = Counter(map(tuple, L.predict(docs, m).select("doc_id", "lang_pred").collect()))
    assert got == Counter({(0, "en"): 2, (7, "de"): 1, (8, "und"): 1, (10, "und"): 1, (None, "en"): 1, (11, "und"): 1,
                           (9, "de"): 1})
    empty = spark.createDataFrame([], kind)
    assert L.predict(empty, m).count() == 0
    none = L.train(empty)
    assert {(r.lang_pred, r.score) for r in L.predict(docs, none).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("most, want", [(1, ["en"]), (2, ["de", "en"])])
def test_commonest_languages_are_learned(spark, monkeypatch, most, want):
    monkeypatch.setattr(L, "MAX_LANGUAGES", most)
    rows = [(0, "the", "en"), (7, "then", "en"), (8, "der", "de"), (10, "le", "fr")]
    assert L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == want
