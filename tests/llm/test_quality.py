"""Held-out accuracy, gradient check, determinism and odd inputs of the classifier."""
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import quality as Q

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model(spark):
    return Q.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.scores(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 100
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :]) > 0.98
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(rows.doc_id, rows.held_out, strict=True))


def test_labels_of_held_out_rows_are_never_used(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 "
                               "THEN 1 - quality ELSE quality END AS quality")
    again = Q.train(docs.repartition(7), turned)
    assert all(np.array_equal(model.w[k], again.w[k]) for k in model.w)


def test_passages_follow_the_text_alone():
    texts = ["one two three", "", None, "WORD!! " * 200, "x"]
    x, off = Q.passage_features(pa.array(texts, pa.string()))
    assert np.diff(off).tolist() == [1, 1, 1, 4, 1]
    for i, t in enumerate(texts):
        alone, _ = Q.passage_features(pa.array([t], pa.string()))
        assert np.allclose(alone, x[off[i]:off[i + 1]])
    again, _ = Q.passage_features(pa.array(["a b a a b", "q q"]))
    assert np.isclose(again[0, -4], 3 / 5) and np.isclose(again[0, -5], 1 / 5) and np.isclose(again[1, -5], 1 / 2)


def test_attention_learns_from_bags_where_one_passage_decides():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 600)
    off = np.concatenate(([0], np.cumsum(n)))
    x = rng.normal(size=(off[-1], Q.N_FEATURES)).astype(np.float32)
    y = (rng.random(600) < 0.4).astype(float)
    x[off[:-1][y == 1], 3] += 6
    m = Q.AttentionModel.fit(x[:off[400]], off[:401], y[:400])
    p = m.score(x[off[400]:], off[400:] - off[400])
    assert ((p >= 0.5) == y[400:]).mean() > 0.9


def test_odd_rows_and_tables(spark, model):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (None, "some text", "en", "s", 9),
            (3, "WORD!! " * 3000, "en", "s", 1), (3, "WORD!! " * 3000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "true AS held_out", "2 AS label")
    got = Q.scores(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = Q.keep_good(df, model)
    assert out.columns == df.columns and out.count() == sum(r.predicted for r in got)
    assert Q.scores(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.scores(df, Q.train(df, none)).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.scores(df, Q.train(df, one)).collect()} <= {0.5, 1.0}


def test_long_and_repeated_documents_leave_the_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_PASSAGES", 200)
    seen = {}
    fit = Q.AttentionModel.fit
    monkeypatch.setattr(Q.AttentionModel, "fit", lambda x, off, y: seen.update(n=np.diff(off), y=y) or fit(x, off, y))
    ids = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"Some words of document {i}.") for i in ids]
    rows += [(ids[0], "many words " * 40_000)] + [(ids[1], f"copy {j} " * 100) for j in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").filter("NOT (doc_id = 0 AND length(text) < 100)")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    model = Q.train(docs.repartition(3), labels)
    assert len(seen["n"]) == len(ids) and seen["n"].sum() <= 200 and seen["n"].max() > 100
    assert set(seen["y"]) == {0.0, 1.0} and model.w


def test_bound_per_bag():
    for sizes, total, most in (([1, 2, 3], 6, 6), ([1, 2, 3], 5, 2), ([9, 9, 9], 10, 3), ([1, 1, 50], 12, 10), ([5] * 9, 4, 1), ([], 5, 5)):
        assert Q.per_bag(np.array(sizes, np.int64), total) == most
    assert Q.spread(np.arange(10), 3).tolist() == [0, 3, 6] and Q.spread(np.arange(2), 3).tolist() == [0, 1]
