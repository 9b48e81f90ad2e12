"""Structured Streaming scoring equals batch scoring of the same requests."""
from pyspark.sql import functions as F

from riskloom.operators import rules as RU
from riskloom.operators import validate as VAL
from riskloom.plans import registry as R
from riskloom.sources.requests import requests_from_transactions
from riskloom.sources.transactions import fixture_cities, surrogate_predictions, surrogate_score
from riskloom.streaming.scoring import history

from sf_paths import SF_SMALL


def test_batch_equals_stream(spark):
    sink, quarantine = R.run_stream_scoring(spark, SF_SMALL)
    stream = spark.read.parquet(sink)
    tx = R.txh(spark, SF_SMALL)
    thr = R.serving_threshold(surrogate_predictions(tx))
    req = requests_from_transactions(surrogate_score(tx), keep=("p",))
    checked = VAL.validate(req, fixture_cities(spark, SF_SMALL), merchant_cats=R.FIXTURE_MERCHANTS)
    batch = RU.score(checked.where("valid"), thr)
    cols = ["request_id", "p", "ml_tier", "rule_id", "rule_tier", "risk_score", "tier",
            "risk_score_pct", "ml_probability_pct"]
    a = sorted(tuple(r) for r in stream.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
    rejected = spark.read.parquet(quarantine)
    assert rejected.count() + len(a) == tx.count()
    assert rejected.where(F.size("errors") == 0).count() == 0
    h = history(spark, sink, 10).collect()
    assert len(h) == 10


def test_stream_writes_json_responses(spark):
    import json

    from riskloom.session import shared_path
    from riskloom.streaming import scoring as ST
    tx = R.txh(spark, SF_SMALL)
    src = shared_path(spark, "json-requests")
    requests_from_transactions(tx).write.json(src)
    out = shared_path(spark, "responses")
    queries, sink, _ = ST.start_scoring_stream(
        spark, src, fixture_cities(spark, SF_SMALL), R.surrogate_probability, 0.35,
        merchant_cats=R.FIXTURE_MERCHANTS, responses_dir=out, model_name="surrogate")
    for q in queries:
        q.awaitTermination()
    docs = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(docs) == spark.read.parquet(sink).count() > 0
    d = docs[0]
    assert set(d) >= {"risk_score", "risk_score_pct", "tier", "ml_probability", "decision_trace",
                      "flags", "model", "optimal_threshold"}
    assert d["model"] == "surrogate" and d["decision_trace"]["final_tier"] == d["tier"]


def test_batches_and_request_ids_do_not_fill_the_heap(spark):
    """A micro-batch is read from files, not from cached blocks; request ids are kept in RocksDB."""
    from riskloom.session import shared_path
    from riskloom.streaming import scoring as ST
    src = shared_path(spark, "heap-requests")
    spark.createDataFrame([('{"request_id": "1"}',), ('{"request_id": "2"}',), ('{"request_id": "1"}',)],
                          "value string").write.text(src)
    cities = spark.createDataFrame([("A", "X", 0.0, 0.0)], "city string, country string, lat double, lon double")
    plans = []

    def probability(txn):
        plans.append(txn._jdf.queryExecution().withCachedData().toString())
        return txn.withColumn("p", F.lit(0.5))
    queries, _, bad = ST.start_scoring_stream(spark, src, cities, probability, 0.5, repeat_window="1 hour")
    queries[0].awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(bad).collect()) == ["1", "2"]
    assert plans and not any("InMemoryRelation" in p for p in plans)
    metrics = [m for p in queries[0].recentProgress for s in p["stateOperators"] for m in s["customMetrics"]]
    assert any(m.startswith("rocksdb") for m in metrics)
    assert spark.conf.get(ST._STORE, ST._DEFAULT_STORE) == ST._DEFAULT_STORE
