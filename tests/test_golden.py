"""Golden values of FIXTURES.md at sf0.01 (same in Spark and DuckDB)."""
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import profile as A
from riskloom.sources.transactions import fixture_transactions, surrogate_predictions

from sf_paths import SF_MID


def test_fixture_and_surrogate_goldens(spark):
    tx = fixture_transactions(spark, SF_MID)
    assert tx.count() == 15000
    assert tx.where(F.col("Fraud_Label") == "Fraud").count() == 1405
    pr = surrogate_predictions(tx)
    m = EV.rank_metrics(EV.score_steps(pr)).first()
    assert m.roc_auc == 0.8381005158113657
    assert abs(m.average_precision - 0.4378540102536305) < 1e-15
    c = EV.confusion(pr, 0.5).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (490, 522, 915, 13073)
    by_type = {r.Transaction_Type: (r.total, r.fraud) for r in A.rate_by(tx, "Transaction_Type").collect()}
    assert by_type == {"ATM": (3750, 716), "Online": (3750, 172), "POS": (3750, 269),
                       "Wire Transfer": (3750, 248)}


def test_sweep_invariants(spark):
    pr = surrogate_predictions(fixture_transactions(spark, SF_MID))
    rows = EV.threshold_sweep(pr).orderBy("threshold").collect()
    assert len(rows) == 19
    assert all(r.tp + r.fp + r.tn + r.fn == 15000 for r in rows)
    rec = [r.recall for r in rows]
    assert rec == sorted(rec, reverse=True)


def test_histogram_and_correlation_invariants(spark):
    tx = fixture_transactions(spark, SF_MID)
    h = A.amount_histogram(tx).collect()
    for cls in ("fraud", "normal"):
        rows = [r for r in h if r["class"] == cls]
        area = sum(r.density * (100000.0 / 21) for r in rows)
        assert abs(area - 1.0) < 1e-9
    c = {(r.a, r.b): r.corr for r in A.correlation(tx).collect()}
    for (a, b), v in c.items():
        assert v == c[(b, a)]
        if a == b and v is not None:
            assert v == 1.0
