"""Exact links, classes and kept documents against all pairs on small tables."""
import random
import re

import numpy as np
import pandas as pd
import pytest

from riskloom.llm import jaccard_join as J
from riskloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                v = todo.pop()
                if v not in comp:
                    comp[v] = i
                    todo += links[v]
    return {i: (comp[i], len(links[i])) for i in ids}


def corpus(seed, group=40):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    docs = [text(rng.randrange(0, 120)) for _ in range(40)]
    base = text(100)
    for _ in range(group):  # near copies of different distance
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        docs.append(t)
    docs += [docs[5], docs[5], docs[7] + ["tail"], [], [], ["one"], ["one"], ["a", "b"]]
    return [(1000 + i, " ".join(t)) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 16)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK", block)
    docs = corpus(seed)
    df = spark.createDataFrame(pd.DataFrame(docs, columns=["doc_id", "text"])).repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.links(df).collect()}
    want = brute(docs)
    missing = sum(want[i][1] - got[i][1] for i in want)
    assert missing <= 0.001 * sum(v[1] for v in want.values())
    if not missing:
        assert got == want


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.links(df).collect()} == brute(docs)


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "s", 1), (2, base + " x", "en", "s", 1), (3, base, None, None, None),
            (4, "quite another text of some words", "en", "s", 1), (5, None, "en", "s", 0), (6, "", "en", "s", 0),
            (None, base, "en", "s", 1), (4, "quite another text of some words", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS class_id", "2 AS c0", "3 AS kept_id")
    out = J.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 4, 5, None]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert J.links(df).count() == 0
    assert J.drop_near_copies(df).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_prefixes_are_shortened_until_the_recall():
    lonely, crowd = np.ones(16, int), np.full(16, 1000)
    mixed = np.where(np.arange(16) < 4, 5, 1000)
    got = J.shorten(np.stack([lonely, crowd, mixed, np.roll(lonely, 0) * 31]), 0.8, 0.999)
    assert got[0].tolist() == [2] * 7 + [0] * 9                      # a few short prefixes
    assert got[1].tolist() == [4] * 14 + [0] * 2                     # a crowd in every tree
    assert got[2].tolist() == [2] * 4 + [7] * 12                     # long prefixes where it is crowded
    assert got[3].tolist() == got[0].tolist()
    for sizes, row in zip((lonely, crowd, mixed), got):
        assert J.gain(0.8, row[row > 0]).sum() >= -np.log(0.001)
    # a node that one more member would crowd is matched, but does not count
    edge = lonely.copy()
    edge[0] = J.CROWD
    assert J.shorten(edge[None], 0.8, 0.999)[0].tolist() == [2] * 8 + [0] * 8
    # lower recall, longer prefixes
    assert J.shorten(crowd[None], 0.8, 0.9)[0, 0] > 4


def test_recall_at_the_threshold_over_seeds(monkeypatch):
    """Pairs of similarity 0.8 to 0.82 without and with a crowd around them: the trees find them."""
    rng = np.random.default_rng(4)
    found = total = 0
    for crowd in (0, 100):
        for _ in range(150):
            base = rng.integers(1, 2 ** 62, 45).astype(np.uint64)
            a, b = base.copy(), base.copy()
            b[:5] = rng.integers(1, 2 ** 62, 5)                       # 40 of 50: similarity 0.8
            others = []
            for _ in range(crowd):
                o = base.copy()
                o[rng.permutation(45)[:4]] = rng.integers(1, 2 ** 62, 4)
                others.append(o)
            sets = [np.unique(s) for s in (a, b, *others)]
            off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            sig = J._min_hashes(np.concatenate(sets), off, J.TREES * J.MAX_DEPTH).reshape(len(sets), J.TREES, J.MAX_DEPTH)
            share = (sig[:2, None] == sig[None, :]).cumprod(-1).sum(-1)       # (2, other, tree) common prefix
            sizes = (share >= J.TOP).sum(1)
            depth = J.shorten(sizes, 0.8, 0.999)
            lcp = share[0, 1]
            found += bool(((depth > 0) & (lcp[None, :] >= depth)).any())
            total += 1
    assert found >= 0.995 * total


def test_depths_follow_the_data(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    base = text(120)
    docs = []
    for i in range(80):                                               # a crowd
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        docs.append(t)
    pair = text(100)
    docs += [pair, pair[:-1] + ["other"], *(text(90) for _ in range(20))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "id long, text string")
    sig = J._signatures(df, "long", 5)
    width = J.MAX_DEPTH * J.SYMBOL
    forest = (sig.selectExpr("explode(sequence(0, 15)) AS tree", "sig", "id")
              .selectExpr("tree", f"substring(sig, tree * {width} + 1, {width}) AS label", "id"))
    rows = J._matched(J._trie_neighbours(forest), 0.8, 0.999).filter("seeks").collect()
    crowd, few = ({r.depth for r in rows if (r.id < 80) == side} for side in (True, False))
    assert max(crowd) > 3 and few == {J.TOP}
    assert {r.id for r in rows} == set(range(82))                     # the others have no node


def test_a_crowd_is_one_node(spark):
    rows = []
    for tree in range(6):                                             # 100 near copies, some missing in each tree
        rows += [(tree, i) for i in range(100) if (i + tree) % 9]
    rows += [(50, i) for i in (98, 99, 200, 201)] + [(51, 300), (51, 301), (52, 0), (52, 1)]
    matched = spark.createDataFrame([(i, t, 2, t.to_bytes(4, "big"), True) for t, i in rows],
                                    "id long, tree int, depth int, label binary, seeks boolean")
    found = {}
    for r in J._nodes(matched).collect():
        found.setdefault(r.node, set()).add(r.id)
        assert r.size > 1
    assert sorted(map(len, found.values())) == [2, 4, 100]            # the pair inside the crowd went
    assert {300, 301} in found.values() and {98, 99, 200, 201} in found.values()


def test_rows_that_share_an_id_are_kept_by_content(spark):
    rows = [(1, f"text number {i} of this id with its own words {i}", "en", "s", i) for i in range(12)]
    kept = [J.drop_near_copies(spark.createDataFrame(rows, DOCS).repartition(n)).collect() for n in (1, 3, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_a_unit_gets_whole_blocks(spark, monkeypatch):
    """A crowd of many blocks: no row per member and block, and the links of all pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK", 8)
    verify = J._verify

    def counted(kind, num, den):
        run, schema = verify(kind, num, den)

        def few(table):
            assert table.num_rows <= 2, "a row for every member of a unit"
            return run(table)

        return few, schema

    monkeypatch.setattr(J, "_verify", counted)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(words)))
    found = J.links(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in found} == {i: n for i, (_, n) in brute(docs).items()}
