"""Scoring and rule engine (R2-R11) as one narrow projection.

``score`` takes any frame with the request columns and a probability column
and appends tier, rule, points, composite score, trace and flags. It is pure
Column arithmetic, so the same function serves batch and Structured
Streaming frames. Comparisons with missing values count as false; ``!=``
with a missing value counts as a mismatch.

Rounding: the published numbers round the binary value half-to-even
(``round(x, k)`` of a float); ``functions.numbers.py_round`` reproduces that
(Spark's ``round``/``bround`` round the shortest decimal text instead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import truth
from riskloom.functions.numbers import py_round
from riskloom.schema import (ML_COMPONENT_MAX, RULE_COMPONENT_MAX, TIER_HIGH_SCORE,
                             TIER_MEDIUM_SCORE)

# ─────────────────────────────────────────────────────────────────────────────
# FIXED VALUES — rule texts, rule points, flag texts.
# ─────────────────────────────────────────────────────────────────────────────
RULE_01_TEXT = "RULE_01: prior fraud + card-testing (≥2 failed) + international"
RULE_02_FORMAT = "RULE_02: extreme displacement (%s km) + international + new merchant"
RULE_03_FORMAT = "RULE_03: %d/6 critical risk signals simultaneously active"
RULE_04_FORMAT = "RULE_04: %d/6 critical risk signals — elevated for review"

POINTS_PRIOR_FRAUD = 12.0
POINTS_FAILED = 8.0
POINTS_INTERNATIONAL = 5.0
POINTS_NEW_MERCHANT = 5.0
POINTS_FAR = 5.0          # distance > 2000
POINTS_MID = 2.0          # distance > 500
POINTS_UNUSUAL = 3.0
POINTS_MISMATCH = 2.0
BONUS_INTL_NEW = 5.0
BONUS_PRIOR_INTL = 5.0
BONUS_PRIOR_FAILED = 5.0

FLAG_INTERNATIONAL = "International transaction"
FLAG_NEW_MERCHANT = "New merchant — no prior history"
FLAG_UNUSUAL = "Unusual transaction time"
FLAG_MISMATCH_FORMAT = "Location mismatch: %s vs home %s"
FLAG_DISTANCE_FORMAT = "%s km from home"
FLAG_FAILED_FORMAT = "%d failed transaction(s) in session"
FLAG_PRIOR_FORMAT = "Prior fraud history: %d incident(s)"
FLAG_SPIKE_FORMAT = "Amount spike: $%s vs avg $%s (%s×)"

def tier_rank(t: Column) -> Column:
    return F.when(t == "HIGH", 2).when(t == "MEDIUM", 1).otherwise(0)


def rank_tier(r: Column) -> Column:
    return F.when(r >= 2, "HIGH").when(r == 1, "MEDIUM").otherwise("LOW")


def _thousands(x: Column) -> Column:
    """Integer text with thousands separators, e.g. 5,570."""
    return F.format_string("%,d", x.cast("long"))


def score(df: DataFrame, threshold: float, prob_col: str = "p") -> DataFrame:
    """Append the scoring columns to a frame of requests with probability ``prob_col``.

    ``threshold`` is the serving threshold (already floored at 0.05).
    """
    t = float(threshold)
    medium_t = round(t * 0.5, 4)
    p = F.col(prob_col)
    amount, avg_amount = F.col("amount"), F.col("avg_amount")
    distance, failed, prev = F.col("distance"), F.col("failed"), F.col("prev_fraud")
    intl, new, unusual = (truth(F.col("is_intl") == "Yes"), truth(F.col("is_new") == "Yes"),
                          truth(F.col("unusual") == "Yes"))
    prior, card_test = truth(prev > 0), truth(failed >= 2)
    far, mid = truth(distance > 2000), truth(distance > 500)
    moved = F.coalesce(F.col("tx_location") != F.col("home_loc"), F.lit(True))

    ml_tier = (F.when(p >= F.lit(t), "HIGH").when(p >= F.lit(medium_t), "MEDIUM")
               .otherwise("LOW"))
    critical = (prior.cast("int") + card_test.cast("int") + intl.cast("int") + new.cast("int")
                + far.cast("int") + unusual.cast("int"))

    r01 = prior & card_test & intl
    r02 = truth(distance > 5000) & intl & new
    r03 = critical >= 5
    r04 = (critical >= 4) & (ml_tier == "LOW")
    rule_id = (F.when(r01, F.lit(RULE_01_TEXT))
               .when(r02, F.format_string(RULE_02_FORMAT, _thousands(distance)))
               .when(r03, F.format_string(RULE_03_FORMAT, critical))
               .when(r04, F.format_string(RULE_04_FORMAT, critical)))
    override = F.when(r01 | r02 | r03, 2).when(r04, 1).otherwise(0)
    rule_tier = rank_tier(F.greatest(tier_rank(ml_tier), override))

    points = (F.when(prior, POINTS_PRIOR_FRAUD).otherwise(0.0)
              + F.when(card_test, POINTS_FAILED).otherwise(0.0)
              + F.when(intl, POINTS_INTERNATIONAL).otherwise(0.0)
              + F.when(new, POINTS_NEW_MERCHANT).otherwise(0.0)
              + F.when(far, POINTS_FAR).when(mid, POINTS_MID).otherwise(0.0)
              + F.when(unusual, POINTS_UNUSUAL).otherwise(0.0)
              + F.when(moved, POINTS_MISMATCH).otherwise(0.0)
              + F.when(intl & new, BONUS_INTL_NEW).otherwise(0.0)
              + F.when(prior & intl, BONUS_PRIOR_INTL).otherwise(0.0)
              + F.when(prior & card_test, BONUS_PRIOR_FAILED).otherwise(0.0))

    ml_component = F.least(F.lit(ML_COMPONENT_MAX),
                           (p / F.lit(max(t, 1e-9))) * F.lit(ML_COMPONENT_MAX))
    staged = df.select(
        "*", ml_tier.alias("ml_tier"), critical.alias("critical_flags"),
        rule_id.alias("rule_id"), rule_tier.alias("rule_tier"),
        points.alias("rule_points"), ml_component.alias("ml_component"))

    rule_component = F.least(F.lit(RULE_COMPONENT_MAX), F.col("rule_points"))
    risk = py_round(F.col("ml_component") + rule_component, 1)
    staged = staged.select("*", rule_component.alias("rule_component"), risk.alias("risk_score"))
    score_tier = (F.when(F.col("risk_score") >= TIER_HIGH_SCORE, "HIGH")
                  .when(F.col("risk_score") >= TIER_MEDIUM_SCORE, "MEDIUM").otherwise("LOW"))
    final = rank_tier(F.greatest(tier_rank(score_tier), tier_rank(F.col("rule_tier"))))
    return staged.select(
        "*", score_tier.alias("score_tier"), final.alias("tier"),
        F.format_string("%.1f%%", F.col("risk_score")).alias("risk_score_pct"),
        F.format_string("%.1f%%", py_round(p * 100, 1)).alias("ml_probability_pct"),
        F.lit(t).alias("optimal_threshold"), F.lit(medium_t).alias("medium_threshold"))


def decision_trace(scored: DataFrame, prob_col: str = "p") -> Column:
    """The nested decision trace of a scored frame."""
    return F.struct(
        py_round(F.col(prob_col), 6).alias("ml_probability"),
        F.col("ml_tier"),
        F.col("optimal_threshold").alias("optimal_f1_threshold"),
        F.col("medium_threshold"),
        F.struct(F.col("rule_id").isNotNull().alias("fired"), F.col("rule_id"),
                 F.col("rule_tier").alias("tier_override"),
                 F.col("critical_flags").alias("critical_flags_active")).alias("rule_engine"),
        F.struct(py_round(F.col("ml_component"), 2).alias("ml_component"),
                 py_round(F.col("rule_component"), 2).alias("rule_component"),
                 F.col("risk_score").alias("total"),
                 F.struct(F.lit(int(TIER_HIGH_SCORE)).alias("HIGH"),
                          F.lit(int(TIER_MEDIUM_SCORE)).alias("MEDIUM")).alias("tier_thresholds")
                 ).alias("composite"),
        F.col("tier").alias("final_tier"),
    )


def flags(df: DataFrame | None = None) -> Column:
    """Ordered array<struct<code, text>> of the display flags that hold."""
    amount, avg_amount = F.col("amount"), F.col("avg_amount")
    distance = F.col("distance")

    def item(cond, code, text):
        return F.when(truth(cond), F.struct(F.lit(code).alias("code"), text.alias("text")))
    spike_ratio = py_round(amount / avg_amount, 1)
    items = F.array(
        item(F.col("is_intl") == "Yes", "international", F.lit(FLAG_INTERNATIONAL)),
        item(F.col("is_new") == "Yes", "new_merchant", F.lit(FLAG_NEW_MERCHANT)),
        item(F.col("unusual") == "Yes", "unusual_time", F.lit(FLAG_UNUSUAL)),
        item(F.coalesce(F.col("tx_location") != F.col("home_loc"), F.lit(True)), "location_mismatch",
             F.format_string(FLAG_MISMATCH_FORMAT, F.col("tx_location"), F.col("home_loc"))),
        item(distance > 400, "distance", F.format_string(FLAG_DISTANCE_FORMAT, _thousands(distance))),
        item(F.col("failed") > 0, "failed", F.format_string(FLAG_FAILED_FORMAT, F.col("failed"))),
        item(F.col("prev_fraud") > 0, "prior_fraud",
             F.format_string(FLAG_PRIOR_FORMAT, F.col("prev_fraud"))),
        item((avg_amount > 0) & (amount > avg_amount * 2), "amount_spike",
             F.format_string(FLAG_SPIKE_FORMAT, _thousands(F.rint(amount)),
                             _thousands(F.rint(avg_amount)),
                             F.format_string("%.1f", spike_ratio))),
    )
    return F.filter(items, lambda x: x.isNotNull())


def response(scored: DataFrame, model_name: str, roc_auc: float | None,
             prob_col: str = "p", waterfall: Column | None = None) -> DataFrame:
    """The response record per request (nested, JSON-ready)."""
    return scored.select(
        *[c for c in ("request_id", "Transaction_ID") if c in scored.columns],
        F.col("risk_score"), F.col("risk_score_pct"), F.col("tier"),
        py_round(F.col(prob_col), 6).alias("ml_probability"),
        F.col("ml_probability_pct"), F.col("ml_tier"),
        decision_trace(scored, prob_col).alias("decision_trace"),
        F.col("rule_id").alias("rule_override"),
        flags().alias("flags"),
        (waterfall if waterfall is not None else F.array().cast(
            "array<struct<feature:string,value:double>>")).alias("shap_waterfall"),
        F.lit(model_name).alias("model"),
        F.lit(None if roc_auc is None else round(roc_auc, 4)).cast("double").alias("roc_auc"),
        F.col("optimal_threshold"),
    )
