"""End to end: train an artifact from a CSV table, then score JSON requests with it."""
import datetime as dt
import json
import tempfile

from riskloom import cli
from riskloom.operators import models as M
from riskloom.schema import REQUEST_SCHEMA
from riskloom.session import shared_path
from riskloom.sources.artifacts import load_artifacts
from riskloom.sources.transactions import fixture_transactions

from sf_paths import SF_MID


def test_train_then_score(spark):
    csv = tempfile.mkdtemp(prefix="riskloom-cli-") + "/tx"
    fixture_transactions(spark, SF_MID).write.option("header", True).csv(csv)
    art = shared_path(spark, "cli-artifact")
    cfg = M.TrainConfig(rf_trees=8, rf_depth=4, calibration_folds=2, gbt_iter=4, gbt_depth=3,
                        cv_folds=2, lr_max_iter=30)
    out = cli.train(spark, csv, art, "csv", cfg)
    assert out["best_model"] in (M.RF, M.GBT, M.LR)
    tables = load_artifacts(spark, art)["tables"]
    assert tables["threshold_sweep"].count() == 19 and tables["rates"].count() > 0
    # curves and both matrices of every model
    assert {r.model for r in tables["roc_curve"].select("model").distinct().collect()} == set(cfg.models)
    assert {(r.model, r["at"]) for r in tables["confusion"].collect()} == {
        (m, at) for m in cfg.models for at in ("0.5", "optimal")}
    if out["best_model"] != M.GBT:
        assert tables["global_attribution"].count() == 15
    base = dict(request_id="a", amount=5000.0, balance=100.0, distance=5570.0, tx_time="02:10",
                tx_type="Online", merchant_cat="Jewelry", card_type="Prepaid",
                tx_location="London", home_loc="New York", daily_tx=4, weekly_tx=7,
                avg_amount=300.0, max_24h=900.0, failed=2, prev_fraud=1, is_intl="Yes",
                is_new="Yes", unusual="Yes", as_of=dt.date(2024, 6, 3))
    rows = [base, dict(base, request_id="b", tx_location="Boston", is_intl="No", failed=0,
                       prev_fraud=0, is_new="No", unusual="No", distance=300.0),
            dict(base, request_id="bad", tx_time="25:61")]
    req = shared_path(spark, "cli-requests")
    spark.createDataFrame([tuple(r[f.name] for f in REQUEST_SCHEMA.fields) for r in rows],
                          REQUEST_SCHEMA).write.json(req)
    dest = shared_path(spark, "cli-out")
    cli.score(spark, art, req, dest)
    docs = {d["request_id"]: d for d in
            (json.loads(r.value) for r in spark.read.text(f"{dest}/responses").collect())}
    assert set(docs) == {"a", "b"}
    assert docs["a"]["tier"] == "HIGH" and docs["a"]["rule_override"].startswith("RULE_01")
    assert 0.0 <= docs["b"]["ml_probability"] <= 1.0
    if out["best_model"] != M.GBT:
        bars = [b["value"] for b in docs["a"]["shap_waterfall"]]
        assert len(bars) == 12 and bars == sorted(bars)
    q = spark.read.parquet(f"{dest}/quarantine").collect()
    assert [r.request_id for r in q] == ["bad"]
