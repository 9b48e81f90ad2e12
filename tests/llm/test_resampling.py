"""Resampling against a plain version: checksums, gains, noise, cutoff and ranks."""
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import resampling as R
from riskloom.llm.registry import op13_resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OUT = ["doc_id", "n_features", "weight", "score", "rank"]


def plain_buckets(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target):
    docs = [(i, *plain_buckets(t)) for i, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, _, b in docs:
        np.add.at(s, b, 1)
    for text in target:
        np.add.at(t, plain_buckets(text)[1], 1)
    big_s, big_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((y + 1) * (big_s + 10000) / ((x + 1) * (big_t + 10000))))
            for x, y in zip(s.tolist(), t.tolist())]
    rows = []
    for i, n, b in docs:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*OUT).collect()), key=repr)


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op13_resampling(spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert rows_of(got) == plain([tuple(r) for r in docs], bench)


def test_checksums_of_words_and_pairs():
    texts = ["Ab cÄ1 ab", "", None, "x", "É" * 70 + " q" * 3, "-- ,", "a" * 65 + "B"]
    one, two, words = R.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        n, want = plain_buckets(t)
        got = one[words[i]:words[i + 1]].tolist() + [b for b in two[words[i]:words[i + 1]].tolist() if b >= 0]
        assert got == want and words[i + 1] - words[i] == n


def scored(spark, scores):
    return spark.createDataFrame([(i, 0, 0, s, True, i) for i, s in enumerate(scores)],
                                 "doc_id long, n_features long, weight long, score long, able boolean, row long")


@pytest.mark.parametrize("shape", ["spread", "one hot", "all equal", "steps"])
@pytest.mark.parametrize("share", [0.0005, 0.25, 0.9, 1.0])
def test_bracket_holds_the_cutoff(spark, shape, share):
    rng = np.random.default_rng(2)
    n = 4000
    scores = {"spread": rng.integers(-10**6, 10**6, n), "one hot": np.where(rng.random(n) < 0.4, 5, rng.integers(0, 99, n)),
              "all equal": np.full(n, 7), "steps": rng.integers(0, 3, n)}[shape].tolist()
    rows = scored(spark, scores)
    k = int(n * share)
    low, high, above = R.bracket(rows, k, n)
    kth = sorted(scores, reverse=True)[k - 1]
    assert low <= kth <= high and above == sum(s > high for s in scores) < k
    if shape == "spread":
        assert sum(low <= s <= high for s in scores) < 0.02 * n


def test_bad_bracket_widens(spark, monkeypatch):
    rows = scored(spark, list(range(1000)))
    tried = []

    def wrong(col, ends, accuracy):
        tried.append(ends)
        return F.array(F.lit(0).cast("long"), F.lit(3).cast("long")) if len(tried) < 3 else F.array(F.min(col), F.max(col))
    monkeypatch.setattr(R.F, "percentile_approx", wrong)
    low, high, above = R.bracket(rows, 250, 1000)
    assert len(tried) == 3 and low <= 750 <= high and above < 250


def test_positions_split_equal_rows(spark):
    df = scored(spark, [5] * 500 + [9] * 3).repartition(6)
    got = R.positions(df, "t").collect()
    assert sorted(r.position for r in got) == list(range(1, 504))
    assert {r.position for r in got if r.score == 9} == {1, 2, 3}
    assert all(a.doc_id < b.doc_id for a, b in zip(*[iter(sorted(got, key=lambda r: r.position)[3:])] * 2))


def test_odd_rows_and_tables(spark):
    kind = "doc_id long, text string, score string, row string, rank int"
    long_text = "many words here " * 30_000
    texts = [(None, "w " * 25), (1, None), (2, ""), (3, "a b"), (4, long_text), (5, "w " * 25), (5, "w " * 25),
             (5, "w " * 30), (6, "z" * 100_000), *((i, f"word{i} " * 20) for i in range(10, 40))]
    docs = spark.createDataFrame([(*r, "s", "r", 3) for r in texts], kind).repartition(4)
    bench = ["many words here", None, "", "word11 word12"]
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    assert rows_of(R.resample(docs, target)) == plain(texts, bench)
    empty = spark.createDataFrame([], kind)
    assert R.resample(empty, target).count() == 0
    assert rows_of(R.resample(docs, spark.createDataFrame([], "text string"))) == plain(texts, [])
    few = docs.filter("doc_id < 4")
    assert rows_of(R.resample(few, target)) == plain([t for t in texts if t[0] is not None and t[0] < 4], bench)
