"""Benchmark matches against brute force over all item-sized windows."""
import random
import re
from collections import Counter

import numpy as np

from riskloom.llm import decontaminate as D

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def bag(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            if not v or not w:
                continue
            b = bag(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[s:s + len(v)])
                c = sum((a & b).values())
                if 9 * c >= 4 * (sum(a.values()) + sum(b.values())):
                    sim = c / (sum(a.values()) + sum(b.values()) - c)
                    if sim > out.get((i, j), (0, 0))[0]:
                        out[i, j] = (sim, s)
    return out


def result(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [text(n) for n in (3, 4, 5, 6, 14, 20, 33, 59, 20)] + [["a", "b"] * 12, []]
    docs = []
    for i in range(120):
        t = text(rng.randrange(0, 80))
        p = list(rng.choice(items))
        for _ in range(rng.randrange(0, 3)):
            if p:
                p[rng.choice([0, len(p) - 1, rng.randrange(len(p))])] = "changed"
        at = rng.randrange(len(t) + 1)
        docs.append(t[:at] + p + t[at:])
    docs += [items[6][:-2], items[7] * 2, [], ["a", "b"] * 40]
    docs = [(i, " ".join(t).replace("w1 ", "W1, ")) for i, t in enumerate(docs)]
    items = [(50 + j, " ".join(t)) for j, t in enumerate(items)]
    got = result(D.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                           spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert len(want) > 60
    # the radius of the fingerprints covers all but a few pairs at the very threshold
    missed = set(want) - set(got)
    assert all(want[p][0] < 0.85 for p in missed) and len(missed) <= len(want) // 50
    assert {p: want[p] for p in got} == got


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = rng.choice(64, rng.integers(0, D.RADIUS + 1), replace=False)
        per_block = [sum(D._EDGES[b] <= f < D._EDGES[b + 1] for f in flips) for b in range(D.BLOCKS)]
        assert min(per_block) <= D.NEAR


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert want and result(D.matches(docs, items)) == want


def test_stage_and_odd_rows(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x " + item.upper() + " y", "en", "s", 1), (2, "clean text of its own", "en", "s", 1),
            (3, None, None, None, None), (4, "", "en", "s", 0), (None, item, "en", "s", 1), (1, "other", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS item_id", "2 AS bad_id", "3 AS fp")
    bench = spark.createDataFrame([(9, item), (9, item), (8, None), (7, ""), (None, item)], "item_id long, text string")
    assert [tuple(r)[:2] for r in D.matches(docs, bench).collect()] == [(1, 9)]
    out = D.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 3, 4, None]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).count() == 0 and D.drop_contaminated(docs, none).count() == 6
    assert D.matches(docs.limit(0), bench).count() == 0


def test_items_without_id_remove_their_documents(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before " + item), (2, "nothing of it"), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, None), (7, "some other text")], "item_id long, text string")
    assert D.matches(docs, bench).count() == 0
    assert sorted(str(r.doc_id) for r in D.drop_contaminated(docs, bench).collect()) == ["2", "None"]
