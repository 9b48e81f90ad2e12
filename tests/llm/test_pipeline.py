"""The pipeline: stages in order, columns kept, decisions as in the brute-force versions."""
import hashlib

from public_tokenizers import path
from test_decontaminate import brute as brute_leaks
from test_jaccard_join import brute as brute_links
from test_suffix_dedup import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline as P
from riskloom.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup",
                                        "benchmark decontamination", "BPE encoding and decoding"]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.scores(docs, model).collect() if r.predicted}
    want = {i: t for i, t in kept.items() if i in good}
    for n, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n == 1:
            want = {i: t for i, t in want.items() if brute_links(list(want.items()))[i][0] == i} if len(want) < 5 else {
                i: want[i] for i, (c, _) in brute_links(list(want.items())).items() if c == i}
        if n == 2:
            for (i, t), (removed, _) in brute_repeats(list(want.items())).items():
                words = t.split()
                want[i] = [w for k, w in enumerate(words) if k not in removed]
            want = {i: t.split() if isinstance(t, str) else t for i, t in want.items()}
            assert {r.doc_id: r.text.split() for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            want = {r.doc_id: r.text for r in docs.collect()}
        if n == 3:
            bad = {i for i, _ in brute_leaks(list(want.items()), items)}
            want = {i: t for i, t in want.items() if i not in bad}
        assert {r.doc_id for r in docs.collect()} == set(want)
    tok = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    for r in P.STAGES[-1][1](spark, docs, SF).collect():
        ids = tok.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(P.run(spark, SF).collect()) == sorted(docs.collect())
