"""Sources and sinks (S1, S6, S7, R11), validation hand cases (V1-V9), row cap (T1), X2."""
import datetime as dt
import json
import math
import tempfile

from pyspark.sql import functions as F

from riskloom.operators import explain as XP
from riskloom.operators import geo as GEO
from riskloom.operators import rules as RU
from riskloom.operators import train as TR
from riskloom.operators import validate as VAL
from riskloom.schema import REQUEST_SCHEMA
from riskloom.sources import artifacts as ART
from riskloom.sources.transactions import fixture_transactions, read_transactions

from sf_paths import SF_SMALL


def test_csv_source_round_trip(spark):
    tx = fixture_transactions(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="riskloom-csv-") + "/tx"
    tx.withColumn("Transaction_Date", F.date_format("Transaction_Date", "yyyy-MM-dd")) \
      .write.option("header", True).csv(path)
    back = read_transactions(spark, path, "csv")
    a = {r.Transaction_ID: r.asDict() for r in tx.collect()}
    b = {r.Transaction_ID: r.asDict() for r in back.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c, u in a[k].items():
            v = b[k][c]
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-12)), (c, u, v)


def _req(**kw):
    base = dict(request_id="r", amount=100.0, balance=50.0, distance=10.0, tx_time="14:30",
                tx_type="POS", merchant_cat="Fuel", card_type="Debit", tx_location="Paris",
                home_loc="Paris", daily_tx=1, weekly_tx=3, avg_amount=90.0, max_24h=120.0,
                failed=0, prev_fraud=0, is_intl="No", is_new="No", unusual="No",
                as_of=dt.date(2024, 5, 6))
    base.update(kw)
    return tuple(base[f.name] for f in REQUEST_SCHEMA.fields)


def test_validation_hand_cases(spark):
    rows = [
        _req(request_id="ok"),
        _req(request_id="padded", tx_type="  POS ", home_loc=" Paris", is_new="No "),
        _req(request_id="time", tx_time="25:00"),
        _req(request_id="city", tx_location="Atlantis"),
        _req(request_id="intl", tx_location="Tokyo", is_intl="No"),
        _req(request_id="neg", amount=-1.0),
        _req(request_id="daily", daily_tx=0),
        _req(request_id="many", amount=-5.0, failed=-1, card_type="Gold", unusual="Maybe"),
    ]
    req = spark.createDataFrame(rows, REQUEST_SCHEMA)
    v = VAL.validate(req, GEO.city_dimension(spark))
    errs = {r.request_id: sorted(e.field for e in r.errors) for r in v.collect()}
    assert errs["ok"] == [] and errs["padded"] == []
    assert errs["time"] == ["tx_time"]
    assert errs["city"] == ["tx_location"]                  # consistency skipped: city unknown
    assert errs["intl"] == ["is_intl"]
    assert errs["neg"] == ["amount"] and errs["daily"] == ["daily_tx"]
    assert errs["many"] == ["amount", "card_type", "failed", "unusual"]
    msg = [e.message for r in v.collect() if r.request_id == "intl" for e in r.errors]
    assert msg == ["is_intl must match selected locations (expected 'Yes')"]
    assert v.where("valid").count() == 2 and v.where("NOT valid").count() == 6


def test_geo_distance_and_border(spark):
    df = spark.createDataFrame([("New York", "London"), ("Paris", "Paris"), ("Paris", "Atlantis")],
                               "home string, loc string")
    out = {(r.home, r.loc): r for r in GEO.with_geo(df, GEO.city_dimension(spark), "home", "loc").collect()}
    assert abs(out[("New York", "London")].distance_km - 5570) <= 1
    assert out[("New York", "London")].cross_border is True
    assert out[("Paris", "Paris")].distance_km == 0 and out[("Paris", "Paris")].cross_border is False
    assert out[("Paris", "Atlantis")].distance_km is None and out[("Paris", "Atlantis")].cross_border is None


def test_response_json_and_sanitize(spark):
    req = spark.createDataFrame([_req(request_id="a", is_intl="Yes", tx_location="Tokyo")],
                                REQUEST_SCHEMA).withColumn("p", F.lit(0.42))
    resp = RU.response(RU.score(req, 0.35), "Logistic Regression", 0.93456)
    doc = json.loads(ART.to_json_lines(resp).first()["value"])
    assert doc["tier"] in ("LOW", "MEDIUM", "HIGH") and doc["roc_auc"] == 0.9346
    assert doc["decision_trace"]["composite"]["tier_thresholds"] == {"HIGH": 70, "MEDIUM": 35}
    assert [f["code"] for f in doc["flags"]][:2] == ["international", "location_mismatch"]
    bad = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    assert tuple(ART.sanitize(bad).first()) == (None, None, 1.0)


def test_row_cap_is_exact(spark):
    df = spark.range(20000).withColumnRenamed("id", "Transaction_ID")
    kept = [{r[0] for r in TR.cap_rows(d, 5000).collect()} for d in (df, df.repartition(7))]
    assert len(kept[0]) == 5000 and kept[0] == kept[1]
    assert TR.cap_rows(df, None).count() == 20000 == TR.cap_rows(df, 20000).count()
    # rows of one id go together, also where one id holds most rows
    hot = df.withColumn("Transaction_ID", F.when(F.col("Transaction_ID") < 9000, 3).otherwise(F.col("Transaction_ID")))
    counts = TR.cap_rows(hot, 100).groupBy("Transaction_ID").count().collect()
    assert {(r.Transaction_ID == 3) == (r["count"] == 9000) for r in counts} == {True}


def test_split_and_folds_have_exact_quotas(spark):
    df = spark.range(5003).select(F.col("id").alias("Transaction_ID"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    out = TR.split_and_folds(df.repartition(5))
    got = out.groupBy("label", "is_test").count().collect()
    assert {(r.label, r.is_test): r["count"] for r in got} == {(0, True): 900, (0, False): 3602, (1, True): 100,
                                                             (1, False): 401}
    for cols in (["label", "fold"], ["label", "fold", "cal_fold"]):
        n = [r["count"] for r in out.where("NOT is_test").groupBy(*cols).count().collect()]
        assert len(n) == 2 * 5 ** (len(cols) - 1)
        sizes = {}
        for r in out.where("NOT is_test").groupBy(*cols).count().collect():
            sizes.setdefault(tuple(r[c] for c in cols[:-1]), []).append(r["count"])
        assert all(max(v) - min(v) <= 1 for v in sizes.values())
    assert out.where("is_test AND (fold IS NOT NULL OR cal_fold IS NOT NULL)").count() == 0
    assert out.select("Transaction_ID").distinct().count() == 5003
    again = TR.split_and_folds(df)
    assert out.exceptAll(again).count() == 0
    assert TR.split_and_folds(df.limit(0)).count() == 0


def test_global_attribution_top(spark):
    rows = [(i, "f1", float(i % 3)) for i in range(30)] + [(i, "f2", 0.1) for i in range(30)]
    df = spark.createDataFrame(rows, "Transaction_ID long, feature string, contribution double")
    top = XP.global_attribution(df, top=1).collect()
    assert top[0].feature == "f1" and abs(top[0].value - 1.0) < 1e-12
