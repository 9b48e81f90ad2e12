"""Command line: train an artifact from a transaction table, score request files.

    python -m riskloom.cli train --input tx.csv --output /shared/artifact [--format csv]
    python -m riskloom.cli score --artifact /shared/artifact --requests req/ --output out/

``train`` profiles the table, fits and compares the candidates, evaluates the
best one (sweep, optima, calibration, curves, importance) and writes all of it
as one artifact folder. ``score`` validates JSON request lines, scores the
accepted ones with the artifact's best model and writes JSON responses plus a
quarantine table. Both run on whatever cluster the session points at.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import explain as XP
from riskloom.operators import geo as GEO
from riskloom.operators import models as M
from riskloom.operators import profile as A
from riskloom.operators import rules as RU
from riskloom.schema import THRESHOLD_FLOOR
from riskloom.session import reliable_checkpoint
from riskloom.sources import artifacts as ART
from riskloom.sources.requests import read_requests
from riskloom.sources.transactions import read_transactions
from riskloom.streaming.scoring import scoring_plan


#: Test rows of the global attribution (the published sample size).
EXPLAIN_ROWS = 500


def profile_tables(tx) -> dict:
    """The statistic tables of the profile (A1-A9), one DataFrame each."""
    return {
        "overview": A.overview(tx),
        "rates": A.rates_grouping_sets(tx),
        "rate_by_prev_fraud": A.rate_by_prev_fraud(tx),
        "rate_by_hour": A.rate_by_hour(tx),
        "rate_by_combo": A.rate_by_combo_filled(tx),
        "correlation": A.correlation(tx),
        "amount_histogram": A.amount_histogram(tx),
        "distance_percentiles": A.distance_percentiles(tx),
    }


def train(spark: SparkSession, input_path: str, output: str, fmt: str = "csv",
          cfg: M.TrainConfig = M.TrainConfig()) -> dict:
    tx = read_transactions(spark, input_path, fmt)
    tables = profile_tables(tx)
    result = M.train_all(tx, cfg)
    best = result.predictions.where(F.col("model") == result.best_name)
    sweep = EV.threshold_sweep(best)
    optima = EV.threshold_optima(best, sweep)
    steps = reliable_checkpoint(EV.score_steps(result.predictions))     # every model's curves
    model = result.models[result.best_name]
    inner = model.forests[0] if isinstance(model, M.CalibratedForest) else model
    tables.update({
        "threshold_sweep": sweep, "threshold_optima": optima,
        "calibration": EV.calibration(best), "roc_curve": EV.roc_curve(steps),
        "pr_curve": EV.pr_curve(steps), "comparison": M.comparison(result),
        "confusion": EV.confusions(result.predictions),
        "importance": M.importance(inner, result.prep.inputs),
    })
    explain = XP.explainer(model, result.prep.inputs)
    if explain is not None:
        shown = explain(result.frame.where(F.col("is_test")).orderBy(F.xxhash64("Transaction_ID"), "Transaction_ID")
                        .limit(EXPLAIN_ROWS).select("Transaction_ID", "features"))
        tables["global_attribution"] = XP.global_attribution(XP.explode_contributions(shown, F.col("contrib")))
    opt = optima.first()["optimal_f1_threshold"]
    ov = tables["overview"].first()
    meta = ART.provenance(result, ov["total_transactions"], ov["fraud_rate"] or 0.0, opt)
    ART.save_artifacts(output, result, meta, tables)
    return {"best_model": result.best_name, "optimal_f1_threshold": opt}


def score(spark: SparkSession, artifact: str, requests_path: str, output: str,
          as_of: dt.date | None = None) -> dict:
    art = ART.load_artifacts(spark, artifact)
    name = art["best_name"]
    threshold = max(float(art["metadata"]["optimal_f1_threshold"]), THRESHOLD_FLOOR)
    auc = art["metrics"].where(F.col("name") == name).first()["roc_auc"]
    explain = XP.explainer(art["models"][name], art["prep"].inputs)
    fn = M.model_probability(art["prep"], art["models"][name], explain)
    scored, quarantined = scoring_plan(read_requests(spark, requests_path),
                                       GEO.city_dimension(spark), fn, threshold, as_of=as_of)
    bars = XP.waterfall(F.col("contrib")) if explain is not None else None
    ART.write_json_lines(RU.response(scored, name, auc, waterfall=bars), f"{output}/responses")
    quarantined.write.mode("overwrite").parquet(f"{output}/quarantine")
    return {"model": name, "threshold": threshold}


def main(argv: list[str] | None = None) -> None:
    from riskloom.session import get_session
    p = argparse.ArgumentParser(prog="riskloom")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--format", default="csv")
    t.add_argument("--small", action="store_true", help="small models (smoke runs)")
    s = sub.add_parser("score")
    s.add_argument("--artifact", required=True)
    s.add_argument("--requests", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--as-of", type=dt.date.fromisoformat, help="scoring date (default: today)")
    args = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or get_session()
    if args.cmd == "train":
        cfg = M.TrainConfig()
        if args.small:
            cfg = dataclasses.replace(cfg, rf_trees=10, rf_depth=5, calibration_folds=2,
                                      gbt_iter=5, gbt_depth=3, cv_folds=2, lr_max_iter=50)
        print(train(spark, args.input, args.output, args.format, cfg))
    else:
        print(score(spark, args.artifact, args.requests, args.output, args.as_of))


if __name__ == "__main__":
    main()
