"""Transaction sources.

* ``read_transactions``: the labelled transaction table from CSV (header) or
  Parquet, matched by column name and normalised to the declared types.
* ``fixture_transactions``: the transaction view derived from the driver's
  ``orders``/``customer``/``nation`` tables (FIXTURES.md §5), written with the
  DataFrame API; the DuckDB oracle runs the same definition as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.ordered import keyed_history
from riskloom.schema import TARGET, TRANSACTION_SCHEMA

# FIXED VALUES — texts that count as missing in a transaction table.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def normalised(c: str, source: T.DataType, target: T.DataType) -> "F.Column":
    """Column ``c`` in the declared type: missing texts and NaN are NULL, integral
    floats (``2.0``) are counts, what does not parse is NULL."""
    x = F.col(f"`{c}`")
    if isinstance(source, T.StringType):
        x = F.when(~F.trim(x).isin(MISSING_TEXTS), x)
    if isinstance(target, T.DateType):
        return F.try_to_date(x) if isinstance(source, T.StringType) else x.cast("date")
    if isinstance(target, T.DoubleType):
        x = (F.trim(x) if isinstance(source, T.StringType) else x).try_cast("double")
        return F.when(~F.isnan(x), x)
    if isinstance(target, T.LongType):
        x = F.trim(x) if isinstance(source, T.StringType) else x
        if isinstance(source, (T.StringType, T.DoubleType, T.FloatType, T.DecimalType)):
            d = x.try_cast("double")
            whole = F.when(d == F.floor(d), d).try_cast("bigint")
            return F.coalesce(x.try_cast("bigint"), whole) if isinstance(source, T.StringType) else whole
        return x.try_cast("bigint")
    return x.cast(target)


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", labelled: bool = True) -> DataFrame:
    """Scan a transaction table by column name.

    The declared columns come first, in their declared types and order; extra
    columns follow as they are. CSV is read as text under its header names (files
    whose header differs from the first one raise), so reordered and extra columns
    are safe; a missing declared column raises ``ValueError`` (the label only where
    ``labelled``). Missing texts, NaN and unparsable values become NULL.
    """
    if fmt == "csv":
        df = (spark.read.option("header", True).option("enforceSchema", False)
              .option("mode", "PERMISSIVE").csv(path))
    else:
        df = spark.read.format(fmt).load(path)
    declared = [f for f in TRANSACTION_SCHEMA.fields if labelled or f.name != TARGET or f.name in df.columns]
    absent = [f.name for f in declared if f.name not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {', '.join(absent)}")
    names = [f.name for f in declared]
    return df.select(
        *[normalised(f.name, df.schema[f.name].dataType, f.dataType).alias(f.name) for f in declared],
        *[F.col(f"`{c}`") for c in df.columns if c not in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_transactions(spark: SparkSession, sf_dir: str, history: bool = True) -> DataFrame:
    """Transaction view over the driver tables (22 columns, FIXTURES.md §5).

    Plan: orders ⋈ customer and two lookups into the nation dimension (strategies
    chosen by Catalyst/AQE from their sizes), and for the history columns (average of
    earlier amounts, maximum of the three previous amounts) the range-partitioned
    ``keyed_history``. Those history columns are what a real source supplies; only
    this fixture derives them.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")

    k = F.col("k")
    b = (orders.join(customer, orders.o_custkey == customer.c_custkey)
         .select(
             F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"),
             (F.col("o_totalprice") * F.lit(0.25)).alias("amt"),
             F.col("o_orderdate").alias("d"), "c_acctbal", F.col("c_nationkey").alias("hk"),
             F.when(k % 3 == 0, ((k * 7) % 25).cast("int"))
              .otherwise(F.col("c_nationkey")).alias("lk"),
             ((k * 37) % 1440).cast("int").alias("mi")))

    hn = (nation.select(F.col("n_nationkey").alias("hn_key"),
                                   F.col("n_name").alias("home"),
                                   F.col("n_regionkey").alias("hr")))
    ln = (nation.select(F.col("n_nationkey").alias("ln_key"),
                                   F.col("n_name").alias("loc"),
                                   F.col("n_regionkey").alias("lr")))
    g = (b.join(hn, b.hk == hn.hn_key).join(ln, F.col("lk") == ln.ln_key)
         .drop("hn_key", "ln_key"))

    # History per customer (average of earlier amounts, maximum of the three
    # previous ones): range-partitioned running window, safe for a hot customer.
    # ``history=False`` omits the two columns (and their checkpointed pass) for
    # consumers that do not read them; using them then fails at analysis time.
    if history:
        # quarters of cents are exact decimals: the average does not depend on the order of a sum
        g = keyed_history(g.withColumn("exact", F.col("amt").cast("decimal(18,4)")), "cust", ["d", "k"], "amt",
                          lookback=3, sum_value="exact")
    cust = F.col("cust")
    intl = F.when(F.col("hr") != F.col("lr"), "Yes").otherwise("No")
    newm = F.when(k % 4 == 1, "Yes").otherwise("No")
    unu = F.when((F.col("mi") < 360) | (F.col("mi") >= 1320), "Yes").otherwise("No")
    h = g.select(
        "*",
        intl.alias("intl"), newm.alias("newm"), unu.alias("unu"),
        F.when(k % 11 == 0, k % 4).otherwise(F.lit(0).cast("bigint")).alias("failed"),
        F.when(cust % 9 == 0, 1 + cust % 3).otherwise(F.lit(0).cast("bigint")).alias("pf"),
    )
    if history:
        h = h.select("*", F.when(F.col("prev_count") > 0, F.col("prev_sum").cast("double") / F.col("prev_count"))
                     .alias("av"), F.col("prev_max").alias("mx"))

    mi = F.col("mi")
    hhmm = F.concat(F.lpad(F.floor(mi / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((mi % 60).cast("string"), 2, "0"))
    points = (F.when(F.col("intl") == "Yes", 2).otherwise(0)
              + F.when(F.col("newm") == "Yes", 2).otherwise(0)
              + F.when(F.col("unu") == "Yes", 2).otherwise(0)
              + F.when(F.col("pf") > 0, 3).otherwise(0)
              + F.when(F.col("failed") >= 2, 3).otherwise(0)
              + (k * 31) % 5)
    types = (F.when(k % 4 == 0, "Online").when(k % 4 == 1, "ATM")
             .when(k % 4 == 2, "POS").otherwise("Wire Transfer"))
    cards = F.when(k % 3 == 0, "Debit").when(k % 3 == 1, "Credit").otherwise("Prepaid")
    return h.select(
        k.alias("Transaction_ID"), cust.alias("Customer_ID"),
        F.col("amt").alias("Transaction_Amount"),
        F.when(k % 50 == 7, F.lit(None).cast("string")).when(k % 50 == 8, "bad")
         .otherwise(hhmm).alias("Transaction_Time"),
        F.col("d").cast("date").alias("Transaction_Date"),
        types.alias("Transaction_Type"),
        F.when(k % 40 == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Cat"), (k % 16).cast("string"))).alias("Merchant_Category"),
        F.col("loc").alias("Transaction_Location"), F.col("home").alias("Customer_Home_Location"),
        F.when(k % 60 == 5, F.lit(None).cast("double"))
         .otherwise((F.abs(F.col("lk") - F.col("hk")) * 300).cast("double"))
         .alias("Distance_From_Home"),
        cards.alias("Card_Type"),
        (F.col("c_acctbal") * 10).alias("Account_Balance"),
        (1 + k % 12).alias("Daily_Transaction_Count"),
        (1 + k % 12 + cust % 30).alias("Weekly_Transaction_Count"),
        *([F.col("av").alias("Avg_Transaction_Amount"),
           F.col("mx").alias("Max_Transaction_Last_24h")] if history else []),
        F.col("intl").alias("Is_International_Transaction"),
        F.col("newm").alias("Is_New_Merchant"),
        F.col("failed").alias("Failed_Transaction_Count"),
        F.col("unu").alias("Unusual_Time_Transaction"),
        F.when(k % 45 == 4, F.lit(None).cast("bigint")).otherwise(F.col("pf"))
         .alias("Previous_Fraud_Count"),
        F.when(points >= 8, "Fraud").otherwise("Normal").alias("Fraud_Label"),
    )


def fixture_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City dimension stand-in for driver tables: (city, country, lat, lon).

    city = nation name, country = region name, lat = -60 + 5*key,
    lon = -180 + 14*key (FIXTURES.md §4).
    """
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_name").alias("city"), F.col("r_name").alias("country"),
                    (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"),
                    (F.lit(-180.0) + 14 * F.col("n_nationkey")).alias("lon")))


def surrogate_p() -> "F.Column":
    """Deterministic surrogate score (FIXTURES.md §6): a test input, not a model."""
    tid = F.col("Transaction_ID")
    pts = (F.when(F.col("Is_International_Transaction") == "Yes", 2).otherwise(0)
           + F.when(F.col("Is_New_Merchant") == "Yes", 2).otherwise(0)
           + F.when(F.col("Unusual_Time_Transaction") == "Yes", 2).otherwise(0)
           + F.when(F.coalesce(F.col("Previous_Fraud_Count"), F.lit(0)) > 0, 3).otherwise(0)
           + F.when(F.col("Failed_Transaction_Count") >= 2, 3).otherwise(0)
           + (tid * 17) % 7)
    return (pts * 50 + tid % 50).cast("double") / F.lit(1e3)


def surrogate_predictions(tx: DataFrame, model: str = "surrogate") -> DataFrame:
    """Predictions contract (model, Transaction_ID, label, p) from the surrogate score."""
    return tx.select(
        F.lit(model).alias("model"), F.col("Transaction_ID"),
        F.when(F.col("Fraud_Label") == "Fraud", 1).otherwise(0).alias("label"),
        surrogate_p().alias("p"),
    )


def surrogate_score(tx: DataFrame) -> DataFrame:
    """The transaction table with the surrogate probability ``p`` appended."""
    return tx.withColumn("p", surrogate_p())
