"""Scoring-request sources and the request -> transaction mapping.

Requests arrive as JSON lines (batch ``spark.read`` or ``readStream``) with the
declared 18 fields plus ``request_id`` and ``as_of``. The scoring date is a
parameter (``as_of``), so results are reproducible; without one it is the current
date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import REQUEST_SCHEMA
from riskloom.sources.transactions import normalised

# request field -> training column name
REQUEST_TO_TRANSACTION = {
    "amount": "Transaction_Amount",
    "tx_time": "Transaction_Time",
    "tx_type": "Transaction_Type",
    "merchant_cat": "Merchant_Category",
    "tx_location": "Transaction_Location",
    "home_loc": "Customer_Home_Location",
    "distance": "Distance_From_Home",
    "card_type": "Card_Type",
    "balance": "Account_Balance",
    "daily_tx": "Daily_Transaction_Count",
    "weekly_tx": "Weekly_Transaction_Count",
    "avg_amount": "Avg_Transaction_Amount",
    "max_24h": "Max_Transaction_Last_24h",
    "is_intl": "Is_International_Transaction",
    "is_new": "Is_New_Merchant",
    "failed": "Failed_Transaction_Count",
    "unusual": "Unusual_Time_Transaction",
    "prev_fraud": "Previous_Fraud_Count",
}
REQUEST_FIELDS = list(REQUEST_TO_TRANSACTION)


#: Every field as text: typed reading would turn a number in quotes into NULL.
_TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType(), True) for f in REQUEST_SCHEMA.fields]
                            + [T.StructField("_corrupt_record", T.StringType(), True)])


def parse_requests(lines: DataFrame) -> DataFrame:
    """Typed request fields of JSON lines (column ``value``), parsed leniently.

    Numbers may be quoted and counts may be integral floats. ``bad_fields`` lists the
    fields that hold something else, ``payload`` is the line and ``_corrupt_record``
    is set where it is no JSON object at all. Other columns of ``lines`` are kept.
    """
    r = F.from_json("value", _TEXT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    more = [c for c in lines.columns if c != "value"]
    df = lines.select(F.col("value").alias("payload"), r.alias("r"), *more)
    kinds = {f.name: f.dataType for f in REQUEST_SCHEMA.fields if not isinstance(f.dataType, T.StringType)}
    flat = df.select("payload", F.coalesce("r._corrupt_record", F.when(F.col("r").isNull(), F.col("payload")))
                     .alias("_corrupt_record"), *[F.col(f"r.{f.name}") for f in REQUEST_SCHEMA.fields], *more)
    typed = {n: normalised(n, T.StringType(), t) for n, t in kinds.items()}
    bad = F.array(*[F.when(F.col(n).isNotNull() & typed[n].isNull(), F.lit(n)) for n in kinds])
    return flat.select(
        *[(typed[f.name] if f.name in typed else F.col(f.name)).alias(f.name) for f in REQUEST_SCHEMA.fields],
        F.filter(bad, lambda x: x.isNotNull()).alias("bad_fields"), "payload", "_corrupt_record", *more)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Batch JSON-lines request source."""
    return parse_requests(spark.read.text(path))


def request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, arrival: bool = False):
    """Streaming JSON-lines request source (file source); with ``arrival`` the time of the
    request's file is the column ``arrived_at``."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = r.text(path)
    if arrival:
        lines = lines.select("value", F.col("_metadata.file_modification_time").alias("arrived_at"))
    return parse_requests(lines)


def requests_from_transactions(tx: DataFrame, as_of: dt.date | None = None,
                               keep: tuple[str, ...] = ()) -> DataFrame:
    """Request records derived from a transaction table (fixture and replay)."""
    inv = {v: k for k, v in REQUEST_TO_TRANSACTION.items()}
    as_of_col = (F.lit(as_of).cast("date") if as_of is not None
                 else F.col("Transaction_Date").cast("date"))
    return tx.select(
        F.col("Transaction_ID"),
        F.col("Transaction_ID").cast("string").alias("request_id"),
        *[F.col(c).alias(inv[c]) for c in REQUEST_TO_TRANSACTION.values()],
        as_of_col.alias("as_of"), *keep)


def requests_to_transactions(req: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Training-named columns; Transaction_Date is the scoring date.

    The date is ``as_of`` if given, else the request's own ``as_of``, else the current
    date. Columns that are not request fields (ids, metadata) are carried along.
    """
    own = F.col("as_of") if "as_of" in req.columns else F.lit(None).cast("date")
    date = F.lit(as_of).cast("date") if as_of is not None else F.coalesce(own, F.current_date())
    extras = [c for c in req.columns if c not in REQUEST_TO_TRANSACTION]
    return req.select(*extras, *[F.col(k).alias(v) for k, v in REQUEST_TO_TRANSACTION.items()],
                      date.alias("Transaction_Date"))
