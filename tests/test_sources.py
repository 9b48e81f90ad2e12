"""CSV scan by name, missing texts, lenient requests, nested sanitising, artifact parts."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import rules as RU
from riskloom.operators import validate as VAL
from riskloom.schema import TRANSACTION_SCHEMA
from riskloom.sources.artifacts import load_artifacts, sanitize
from riskloom.sources.requests import read_requests, requests_to_transactions
from riskloom.sources.transactions import read_transactions

VALUES = {
    "Transaction_ID": "7", "Customer_ID": "3", "Transaction_Amount": "12.5", "Transaction_Time": "09:30",
    "Transaction_Date": "2024-02-29", "Transaction_Type": "ATM", "Merchant_Category": "Fuel",
    "Transaction_Location": "Paris", "Customer_Home_Location": "London", "Distance_From_Home": "3",
    "Card_Type": "Debit", "Account_Balance": "100.25", "Daily_Transaction_Count": "2.0", "Weekly_Transaction_Count": "9",
    "Avg_Transaction_Amount": "11", "Max_Transaction_Last_24h": "20", "Is_International_Transaction": "Yes",
    "Is_New_Merchant": "No", "Failed_Transaction_Count": "0", "Unusual_Time_Transaction": "No",
    "Previous_Fraud_Count": "1", "Fraud_Label": "Fraud"}


def write(folder, columns, rows):
    folder.mkdir()
    (folder / "t.csv").write_text("\n".join([",".join(columns), *(",".join(r) for r in rows)]) + "\n")
    return str(folder)


def test_csv_is_read_by_name(spark, tmp_path):
    names = ["Merchant_ID", *reversed(VALUES), "IP_Address"]
    row = ["77", *(VALUES[c] for c in reversed(VALUES)), "10.0.0.1"]
    bad = list(row)
    for c, v in (("Distance_From_Home", "NaN"), ("Merchant_Category", "N/A"), ("Daily_Transaction_Count", "x"),
                 ("Transaction_Date", "2024-13-01"), ("Account_Balance", "null"), ("Weekly_Transaction_Count", "2.5"),
                 ("Fraud_Label", "")):
        bad[names.index(c)] = v
    df = read_transactions(spark, write(tmp_path / "a", names, [row, bad]))
    assert df.columns == [*TRANSACTION_SCHEMA.fieldNames(), "Merchant_ID", "IP_Address"]
    assert [f.dataType for f in df.schema.fields[:22]] == [f.dataType for f in TRANSACTION_SCHEMA.fields]
    good, damaged = df.collect()
    assert (good.Transaction_Amount, good.Daily_Transaction_Count, good.Fraud_Label, good.Merchant_ID) == (
        12.5, 2, "Fraud", "77")
    assert good.Transaction_Date == dt.date(2024, 2, 29)
    assert [damaged[c] for c in ("Distance_From_Home", "Merchant_Category", "Daily_Transaction_Count", "Transaction_Date",
                                 "Account_Balance", "Weekly_Transaction_Count", "Fraud_Label")] == [None] * 7
    assert damaged.Transaction_Amount == 12.5


def test_missing_column_and_differing_headers_raise(spark, tmp_path):
    names = [c for c in VALUES if c != "Card_Type"]
    path = write(tmp_path / "b", names, [[VALUES[c] for c in names]])
    with pytest.raises(ValueError, match="Card_Type"):
        read_transactions(spark, path)
    unlabelled = [c for c in VALUES if c != "Fraud_Label"]
    path = write(tmp_path / "c", unlabelled, [[VALUES[c] for c in unlabelled]])
    assert read_transactions(spark, path, labelled=False).count() == 1
    with pytest.raises(ValueError, match="Fraud_Label"):
        read_transactions(spark, path)


def test_parquet_nan_is_missing(spark, tmp_path):
    df = spark.createDataFrame([tuple(VALUES.values())], list(VALUES))
    df = df.withColumn("Distance_From_Home", F.lit(float("nan"))).withColumn("Failed_Transaction_Count", F.lit(3.0))
    df.write.parquet(str(tmp_path / "p"))
    row = read_transactions(spark, str(tmp_path / "p"), "parquet").first()
    assert row.Distance_From_Home is None and row.Failed_Transaction_Count == 3


REQUEST = {"request_id": "r", "amount": "12.5", "balance": 10, "distance": 3, "tx_time": "10:00", "tx_type": "\tATM\n",
           "merchant_cat": " Fuel ", "card_type": "Debit", "tx_location": "Paris", "home_loc": "Paris ", "daily_tx": 3.0,
           "weekly_tx": "4", "avg_amount": 1, "max_24h": 2, "failed": 0, "prev_fraud": 0, "is_intl": "No", "is_new": "No",
           "unusual": "\tNo\n"}


def requests(spark, tmp_path, lines):
    (tmp_path / "req").mkdir()
    (tmp_path / "req" / "r.json").write_text("\n".join(lines) + "\n")
    return read_requests(spark, str(tmp_path / "req"))


def test_requests_are_parsed_leniently(spark, tmp_path):
    from riskloom.operators import geo
    bad = {**REQUEST, "request_id": "bad", "amount": "much", "daily_tx": 2.5}
    df = requests(spark, tmp_path, [json.dumps(REQUEST), json.dumps(bad), "{broken"])
    checked = {r.request_id: r for r in VAL.validate(df, geo.city_dimension(spark)).collect()}
    ok = checked["r"]
    assert ok.valid and (ok.amount, ok.daily_tx, ok.tx_type, ok.unusual, ok.home_loc) == (12.5, 3, "ATM", "No", "Paris")
    assert [(e.field, e.message) for e in checked["bad"].errors] == [("amount", VAL.MSG_NUMBER), ("daily_tx", VAL.MSG_NUMBER)]
    assert checked[None]._corrupt_record == "{broken" and not checked[None].valid


def test_scoring_date(spark, tmp_path):
    df = requests(spark, tmp_path, [json.dumps(REQUEST), json.dumps({**REQUEST, "as_of": "2020-01-05"})])
    days = [r.Transaction_Date for r in requests_to_transactions(df).collect()]
    today = spark.sql("SELECT current_date() AS d").first().d
    assert sorted(days) == [dt.date(2020, 1, 5), today]
    assert {r.Transaction_Date for r in requests_to_transactions(df, dt.date(2021, 3, 4)).collect()} == {dt.date(2021, 3, 4)}


def test_sanitize_reaches_nested_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, (inf, [nan, 1.0]), {"a": nan}, [(nan,)], None)],
                               "a double, s struct<x:double,l:array<double>>, m map<string,double>, "
                               "n array<struct<y:double>>, z struct<x:double>")
    r = sanitize(df).first()
    assert (r.a, r.s.x, r.s.l, r.m, r.n[0].y, r.z) == (None, None, [None, 1.0], {"a": None}, None, None)


def test_absent_artifact_and_other_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_artifacts(spark, str(tmp_path / "none"))
    (tmp_path / "odd" / "manifest").mkdir(parents=True)
    (tmp_path / "odd" / "manifest" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        load_artifacts(spark, str(tmp_path / "odd"))
    assert not isinstance(e.value, FileNotFoundError)


def test_checkpoint_folder_is_required_off_local_mode(monkeypatch):
    from riskloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_fixed_rule_values():
    """The published constants, written out: a wrong one must not pass unseen."""
    assert (RU.POINTS_PRIOR_FRAUD, RU.POINTS_FAILED, RU.POINTS_INTERNATIONAL, RU.POINTS_NEW_MERCHANT, RU.POINTS_FAR,
            RU.POINTS_MID, RU.POINTS_UNUSUAL, RU.POINTS_MISMATCH) == (12, 8, 5, 5, 5, 2, 3, 2)
    assert (RU.BONUS_INTL_NEW, RU.BONUS_PRIOR_INTL, RU.BONUS_PRIOR_FAILED) == (5, 5, 5)
    assert (VAL.MSG_NON_NEGATIVE, VAL.MSG_COUNTS, VAL.MSG_YES_NO) == (
        "Must be >= 0", "Transaction counts must be >= 1", "Must be 'Yes' or 'No'")


def test_every_message_and_rule_occurs(spark):
    from riskloom.plans import registry
    rows = registry.q_validation_mutations(spark, "/root/testdata/sf0.001").collect()
    seen = {(r.field, r.message.split(" (")[0].split(":")[0]) for r in rows}
    assert {f for f, _ in seen} == set(registry._MUTATED_REQUEST) - {"Transaction_ID"} | {"balance"}
    assert {m for _, m in seen} >= {VAL.MSG_REQUIRED, VAL.MSG_TIME.split(":")[0], VAL.MSG_LOCATION, VAL.MSG_YES_NO,
                                    VAL.MSG_NON_NEGATIVE, VAL.MSG_COUNTS, "is_intl must match selected locations"}
    rules = {r.rule_id.split(":")[0] for r in registry.q_rule_chain_low_score(spark, "/root/testdata/sf0.01").collect()
             if r.rule_id}
    assert "RULE_04" in rules
