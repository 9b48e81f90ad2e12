"""Training, selection, artifacts and model scoring on a small configuration."""
import dataclasses

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.operators import explain as XP
from riskloom.operators import models as M
from riskloom.session import shared_path
from riskloom.sources import artifacts as ART
from riskloom.sources.transactions import fixture_transactions

from sf_paths import SF_MID

SMALL = M.TrainConfig(rf_trees=10, rf_depth=5, calibration_folds=2, gbt_iter=5, gbt_depth=3,
                      cv_folds=2, lr_max_iter=50)


def test_train_select_save_load_score(spark):
    tx = fixture_transactions(spark, SF_MID)
    res = M.train_all(tx, SMALL)
    cmp = {r.name: r for r in M.comparison(res).collect()}
    assert set(cmp) == {M.RF, M.GBT, M.LR}
    assert sum(r.is_best for r in cmp.values()) == 1
    rate = 1405 / 15000
    assert all(r.pr_auc > rate for r in cmp.values())          # quality floor
    split = res.frame.groupBy("label").agg(F.avg(F.col("is_test").cast("double")).alias("f")).collect()
    assert all(abs(r.f - 0.2) < 0.001 for r in split)            # stratified split holds
    meta = ART.provenance(res, 15000, rate, 0.35)
    path = shared_path(spark, "artifact")
    ART.save_artifacts(path, res, meta)
    back = ART.load_artifacts(spark, path)
    assert back["best_name"] == res.best_name
    ver = ART.version_view(spark, back).first()
    assert ver.best_model == res.best_name and ver.n_features == 50
    assert ver.optimal_f1_threshold == 0.35 and ver.raw_optimal_f1_threshold == 0.35
    v = back["prep"].transform(tx.limit(200))
    for name, model in res.models.items():
        a = {r.Transaction_ID: r.p for r in M.probability(model, v).collect()}
        b = {r.Transaction_ID: r.p for r in M.probability(back["models"][name], v).collect()}
        assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_missing_artifact_fails_fast(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        ART.load_artifacts(spark, shared_path(spark, "nothing-here"))


def test_linear_attribution_is_additive(spark):
    tx = fixture_transactions(spark, SF_MID)
    cfg = dataclasses.replace(SMALL, models=(M.LR,), cv_folds=0)
    res = M.train_all(tx, cfg)
    lr = res.models[M.LR]
    train = res.frame.where(~F.col("is_test"))
    coef, center, intercept = XP.linear_terms(lr, train)
    test = res.frame.where(F.col("is_test")).limit(300)
    scored = lr.transform(test)
    contrib = XP.contributions(F.col("features"), res.prep.inputs, coef, center)
    base = intercept + sum(c * m for c, m in zip(coef, center)) - sum(
        c * m for c, m in zip(lr.stages[-1].coefficients.toArray(), lr.stages[0].mean.toArray()
                              / lr.stages[0].std.toArray()))
    from pyspark.ml.functions import vector_to_array
    raw = vector_to_array(F.col("rawPrediction"))[1]
    gaps = scored.select(XP.additivity_gap(contrib, F.lit(float(base)), raw).alias("g")).collect()
    assert max(r.g for r in gaps) < 1e-6
    wf = scored.select(XP.waterfall(contrib).alias("w")).first().w
    assert len(wf) == 12 and [x.value for x in wf] == sorted(x.value for x in wf)
    imp = M.importance(lr, res.prep.inputs).collect()
    assert len(imp) == 15


def test_stream_scoring_with_fitted_model_equals_batch(spark):
    from riskloom.plans import registry as R
    from riskloom.sources.requests import read_requests, requests_from_transactions
    from riskloom.sources.transactions import fixture_cities
    from riskloom.streaming import scoring as ST
    tx = fixture_transactions(spark, SF_MID)
    cfg = dataclasses.replace(SMALL, models=(M.LR,), cv_folds=0)
    res = M.train_all(tx, cfg)
    fn = M.model_probability(res.prep, res.models[M.LR])
    small = fixture_transactions(spark, "/root/testdata/sf0.001")
    src = shared_path(spark, "model-requests")
    requests_from_transactions(small).write.json(src)
    cities = fixture_cities(spark, "/root/testdata/sf0.001")
    queries, sink, _ = ST.start_scoring_stream(spark, src, cities, fn, 0.35,
                                               merchant_cats=R.FIXTURE_MERCHANTS)
    for q in queries:
        q.awaitTermination()
    stream = spark.read.parquet(sink)
    batch, _ = ST.scoring_plan(read_requests(spark, src), cities, fn, 0.35,
                               merchant_cats=R.FIXTURE_MERCHANTS)
    cols = ["request_id", "p", "ml_tier", "risk_score", "tier"]
    a = sorted(tuple(r) for r in stream.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
    assert all(0.0 <= r[1] <= 1.0 for r in a)


def test_tree_attribution_explains_every_test_row(spark, monkeypatch):
    from riskloom.operators import train as TR
    from riskloom.operators.encode import label
    from riskloom.plans import registry as R
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(R, "PUBLISHED", M.TrainConfig(rf_trees=2, rf_depth=3, max_rows=200))
    split = TR.split_and_folds(R.tx(spark, sf).select("Transaction_ID", label().alias("label")))
    want = {r.Transaction_ID for r in split.where("is_test").select("Transaction_ID").collect()}
    rows = R.q_tree_attribution(spark, sf).groupBy("Transaction_ID").count().collect()
    assert {r.Transaction_ID for r in rows} == want and len(want) > 200
    assert {r["count"] for r in rows} == {50}


def test_linear_contributions_unpack_the_vector_once(spark):
    """The bars are those of ``contributions``; the vector is not unpacked for every use of an element."""
    names, coef, center = ["a", "b", "c"], [0.5, -2.0, 0.0], [1.0, 0.25, 3.0]
    df = spark.createDataFrame([(1, Vectors.dense([2.0, 1.0, 5.0])), (2, Vectors.dense([-1.0, 0.25, 0.0]))],
                               ["id", "features"])
    rows = XP.with_linear_contributions(df, names, coef, center, lambda v: v + F.lit(0.0))
    bars = rows.select("id", F.posexplode(XP.waterfall(F.col("contrib"), 2)).alias("pos", "w"))
    old = F.transform(XP.contributions(F.col("features"), names, coef, center), lambda x: F.struct(
        x["idx"].alias("idx"), x["feature"].alias("feature"), (x["value"] + F.lit(0.0)).alias("value")))
    plain = df.select("id", F.posexplode(XP.waterfall(old, 2)).alias("pos", "w"))
    assert bars.columns == plain.columns and sorted(map(str, bars.collect())) == sorted(map(str, plain.collect()))
    unpacked = [x._jdf.queryExecution().optimizedPlan().toString().count("UDF(features") for x in (bars, plain)]
    assert unpacked[0] == 1 and unpacked[1] > 1, unpacked
