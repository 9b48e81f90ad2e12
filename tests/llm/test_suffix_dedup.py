"""Repeated passages against brute force over all windows of 50 words."""
import random

import pandas as pd
import pytest

from riskloom.llm import suffix_dedup as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, n=50):
    """{(id, text): (removed words, kept words)} over all n-word windows."""
    uniq = sorted({(i, t or "") for i, t in docs if i is not None}, key=lambda d: d[0])
    where = {}
    for d in uniq:
        w = d[1].split()
        for s in range(len(w) - n + 1):
            where.setdefault(tuple(w[s:s + n]), []).append((d, s))
    out = {}
    for places in where.values():
        if len({p[0] for p in places}) < 2:
            continue
        first = min(p[0][0] for p in places)
        for d, s in places:
            side = 1 if d[0] == first else 0
            out.setdefault(d, (set(), set()))[side].update(range(s, s + n))
    return out


def found(rows):
    out = {}
    for r in rows:
        side = 1 if r.keep else 0
        out.setdefault(r.doc_id, (set(), set()))[side].update(range(r.start_word, r.end_word))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 57, 80, 130)]
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 150))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        docs.append(t)
    docs += [docs[3], docs[3], docs[5][:-1] + ["x"], ["same"] * 120, ["same"] * 90, [], ["a"]]
    return [(100 + i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed, hot, rows", [(1, 1024, 8192), (2, 1024, 50), (3, 0, 8192), (4, 3, 8192)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, rows):
    """By extension, in small groups, by fingerprints alone, and by both."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "ROWS", rows)
    docs = corpus(seed)
    df = spark.createDataFrame(pd.DataFrame(docs, columns=["doc_id", "text"])).repartition(5)
    want = {d[0]: v for d, v in brute(docs).items()}
    assert found(S.repeated_passages(df).collect()) == want


def test_on_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    assert found(S.repeated_passages(df).collect()) == {d[0]: v for d, v in brute(docs).items()}


def test_removal_keeps_columns_and_clean_texts(spark):
    rng = random.Random(7)
    p = " ".join(f"w{rng.randrange(999)}" for _ in range(60))
    rows = [(1, "head one " + p, "en", "s", 5), (2, "other " + p + " tail", "en", "s", 6),
            (3, "clean text", "en", "s", 10), (4, None, "en", "s", None), (5, "", None, None, 0),
            (None, p, "en", "s", 1), (6, p, "en", "s", 1), (6, p, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS spans", "1 AS tag", "2 AS id")
    out = S.remove_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    want = [(1, "head one " + p, 5), (2, "other tail", 10), (3, "clean text", 10), (4, None, None),
            (5, "", 0), (None, p, 1), (6, "", 0), (6, "", 0)]
    assert got == sorted(want, key=str)


def test_extension_takes_both_sides():
    """Occurrences of one head: places are shared as far as both contexts agree."""
    import numpy as np
    import pyarrow as pa
    head = S.MIN_WORDS - S.WINDOW + 1
    rest = S.MIN_WORDS - head
    rng = np.random.default_rng(0)
    words = lambda: rng.integers(1, 2 ** 62, rest).astype(np.uint64)
    b, a = words(), words()

    def mixed(x, n):
        return np.concatenate((x[:n], words()[n:]))
    # (words shared before, words shared after) with the first document
    share = [(rest, rest), (rest, 3), (4, rest), (20, 20), (20, 20), (2, 2)]
    rows = [(7, 10 + i, 0, 40, 9, 40, mixed(b, x), mixed(a, y)) for i, (x, y) in enumerate(share)]
    rows.append((8, 99, 0, 40, 9, 40, b, a))                          # another head
    cols = list(zip(*rows))
    table = pa.table({"key": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()),
                      **{n: pa.array(c, pa.int32()) for n, c in zip(("tag", "at", "lo", "hi"), cols[2:6])},
                      **{n: pa.array([x.astype(">u8").tobytes() for x in c], pa.binary())
                         for n, c in (("before", cols[6]), ("after", cols[7]))}})
    got = {}
    for r in S.extend(table, S.MIN_WORDS).to_pylist():
        for s in r["starts"]:
            got[r["id"], s] = (r["first"], r["keep"])
    want = {}
    for left in range(rest + 1):
        for i, (_, doc, _, at, _, _, x, y) in enumerate(rows[:6]):
            same = [d for (_, d, _, _, _, _, u, v) in rows[:6]
                    if (u[:left] == x[:left]).all() and (v[:rest - left] == y[:rest - left]).all()]
            if len(same) > 1:
                want[doc, at - left] = (min(same), doc == min(same))
    assert got == want and len(got) > 40


def test_long_texts_and_hot_passages(spark):
    """A text larger than a slice, a passage that most documents hold, repetition inside one text."""
    rng = random.Random(5)
    p = [f"w{rng.randrange(10 ** 6)}" for _ in range(90)]
    long = [f"l{i}" for i in range(300_000)]
    docs = [(1, " ".join(long[:150_000] + p + long[150_000:])), (2, " ".join(long[1000:1200]))]
    docs += [(10 + i, " ".join([f"a{i}", f"b{i}"] + p[i % 7:] + [f"c{i}"])) for i in range(300)]
    docs += [(900, " ".join(["again"] * 400)), (901, " ".join(p + p))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = {d[0]: v for d, v in brute(docs).items()}
    assert found(S.repeated_passages(df).collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert S.repeated_passages(df).count() == 0
    assert S.remove_repeats(df).count() == 0
