"""Feature projections F1-F44: stateless Catalyst column expressions.

Two layered selects (base ratios and flags, then interactions that reuse
them) keep expression trees small; everything runs inside whole-stage
codegen, nothing leaves the JVM. Missing-value rules come from
``functions.nulls`` (comparison with NULL -> 0, ``!=`` with NULL -> 1,
clip keeps NULL, division never raises).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import clip, flag, mismatch, ratio, yes
from riskloom.schema import NEW_NUMERIC, NUMERIC_FEATURES

TEMPORAL = ["Hour", "DayOfWeek", "Month", "IsWeekend", "IsNight", "Hour_Sin", "Hour_Cos"]
RATIOS = ["Amount_vs_Avg", "Amount_vs_Max24h", "Balance_vs_Amount", "Spend_Ratio",
          "Tx_Velocity_Ratio", "Amount_ZScore", "Max24h_Utilization", "Daily_vs_Expected",
          "Failed_Rate", "Spend_Velocity_Today"]
FLAGS = ["Location_Mismatch", "Risk_Flag_Count", "Amount_Spike_Flag", "Dist_100_500",
         "Dist_500_2000", "Dist_Over_2000", "Balance_Very_Low", "Balance_Low"]
INTERACTIONS = [c for c in NEW_NUMERIC if "_x_" in c]

EPS = 1e-9


def _date(df: DataFrame) -> Column:
    if dict(df.dtypes).get("Transaction_Date") == "string":
        return F.expr("try_to_date(Transaction_Date)")
    return F.col("Transaction_Date").cast("date")


def hour_or_noon(time_col: str = "Transaction_Time") -> Column:
    """Hour of an HH:MM text; unparsable or missing -> 12."""
    return F.coalesce(F.hour(F.try_to_timestamp(F.col(time_col), F.lit("H:m"))),
                      F.lit(12)).cast("int")


def engineer_features(df: DataFrame) -> DataFrame:
    """Append the 44 numeric model inputs (input columns are kept)."""
    amt = F.col("Transaction_Amount")
    avg = F.col("Avg_Transaction_Amount")
    mx = F.col("Max_Transaction_Last_24h")
    bal = F.col("Account_Balance")
    wk = F.col("Weekly_Transaction_Count")
    dy = F.col("Daily_Transaction_Count")
    fail = F.col("Failed_Transaction_Count")
    pf = F.col("Previous_Fraud_Count")
    dist = F.col("Distance_From_Home")
    intl, new, unu = (yes("Is_International_Transaction"), yes("Is_New_Merchant"),
                      yes("Unusual_Time_Transaction"))

    hour = hour_or_noon()
    dow = F.weekday(_date(df))               # Monday = 0
    loc_mismatch = mismatch("Transaction_Location", "Customer_Home_Location")
    amount_vs_avg = ratio(amt, avg + EPS)
    base = df.select(
        "*",
        hour.alias("Hour"),
        dow.alias("DayOfWeek"),
        F.month(_date(df)).alias("Month"),
        flag(dow >= 5).alias("IsWeekend"),
        flag((hour >= 22) | (hour <= 5)).alias("IsNight"),
        F.sin(F.lit(2 * math.pi) * hour / 24).alias("Hour_Sin"),
        F.cos(F.lit(2 * math.pi) * hour / 24).alias("Hour_Cos"),
        amount_vs_avg.alias("Amount_vs_Avg"),
        ratio(amt, mx + EPS).alias("Amount_vs_Max24h"),
        ratio(bal, amt + EPS).alias("Balance_vs_Amount"),
        clip(ratio(amt, bal + EPS), 0, 10).alias("Spend_Ratio"),
        loc_mismatch.alias("Location_Mismatch"),
        clip(ratio(dy, wk / 7 + EPS), 0, 10).alias("Tx_Velocity_Ratio"),
        (intl + new + unu + loc_mismatch + flag(fail > 0) + flag(pf > 0)).alias("Risk_Flag_Count"),
        clip(ratio(amt - avg, avg + 1), -5, 20).alias("Amount_ZScore"),
        flag(amt > avg * 2).alias("Amount_Spike_Flag"),
        clip(ratio(mx, avg + EPS), 0, 20).alias("Max24h_Utilization"),
        clip(dy - wk / 7, -5, 20).alias("Daily_vs_Expected"),
        clip(ratio(fail, dy + 1), 0, 1).alias("Failed_Rate"),
        clip(ratio(amt * dy, avg + EPS), 0, 200).alias("Spend_Velocity_Today"),
        flag((dist >= 100) & (dist < 500)).alias("Dist_100_500"),
        flag((dist >= 500) & (dist < 2000)).alias("Dist_500_2000"),
        flag(dist >= 2000).alias("Dist_Over_2000"),
        flag(bal < amt * 1.5).alias("Balance_Very_Low"),
        flag(bal < amt * 5).alias("Balance_Low"),
        intl.alias("_intl"), new.alias("_new"), flag(pf > 0).alias("_pf_any"),
    )
    dist_k = clip(dist / 1000, 0, 20)
    amt_ratio = clip(F.col("Amount_vs_Avg"), 0, 20)
    night = F.col("IsNight")
    i, n, p = F.col("_intl"), F.col("_new"), F.col("_pf_any")
    out = base.select(
        *[c for c in base.columns if not c.startswith("_")],
        (i * n).alias("Intl_x_NewMerchant"),
        (i * dist_k).alias("Intl_x_Distance"),
        (i * night).alias("Intl_x_Night"),
        (n * F.col("Amount_Spike_Flag")).alias("NewMerchant_x_HighAmt"),
        (p * i).alias("PrevFraud_x_Intl"),
        (p * n).alias("PrevFraud_x_NewMerchant"),
        (pf * amt_ratio).alias("PrevFraud_x_AmtRatio"),
        (fail * i).alias("Failed_x_Intl"),
        (F.col("Risk_Flag_Count") * amt_ratio).alias("Risk_x_AmtRatio"),
        (dist_k * night).alias("Distance_x_Night"),
    )
    return out


def feature_frame(df: DataFrame, keep: list[str] = ("Transaction_ID",)) -> DataFrame:
    """Only the key columns and the 44 features, in model order."""
    return engineer_features(df).select(*keep, *NUMERIC_FEATURES)


DOUBLE_FEATURES = {"Hour_Sin", "Hour_Cos", *RATIOS, "Intl_x_Distance", "PrevFraud_x_AmtRatio",
                   "Risk_x_AmtRatio", "Distance_x_Night"}
