"""Business impact (B1-B5) over the threshold sweep (<= 19 rows per model).

Costs are parameters: missed-fraud cost (default: mean fraud amount shown
with one decimal), false-alert cost, monthly volume; counts are scaled from
the test size to the monthly volume. Window functions here run over the
19-row sweep of one model.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.schema import IMPACT_COST_FN_FALLBACK, IMPACT_COST_FP, IMPACT_MONTHLY_VOLUME


def default_cost_fn(avg_fraud_amount: float | None,
                    fallback: float = IMPACT_COST_FN_FALLBACK) -> float:
    """The mean fraud amount as the form shows it (one decimal, half-up)."""
    if avg_fraud_amount is None:
        return fallback
    return float(Decimal(avg_fraud_amount).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def impact_sweep(sweep: DataFrame, cost_fn: float, cost_fp: float = IMPACT_COST_FP,
                 monthly: float = IMPACT_MONTHLY_VOLUME, test_size: int | None = None) -> DataFrame:
    """Costs per threshold, baseline and savings.

    (model, threshold, tp, fp, fn, total, fn_cost, fp_cost, caught, net, baseline, savings)
    """
    size = F.lit(float(test_size)) if test_size else (F.col("tp") + F.col("fp") + F.col("tn")
                                                        + F.col("fn")).cast("double")
    scale = F.lit(float(monthly)) / size
    cfn, cfp = F.lit(float(cost_fn)), F.lit(float(cost_fp))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sweep.select(
        "model", "threshold", "tp", "fp", "fn",
        ((fn * cfn + fp * cfp) * scale).alias("total"),
        (fn * cfn * scale).alias("fn_cost"),
        (fp * cfp * scale).alias("fp_cost"),
        (tp * cfn * scale).alias("caught"),
        ((tp * cfn - fp * cfp) * scale).alias("net"),
        ((tp + fn) * cfn * scale).alias("baseline"),
    ).withColumn("savings", F.col("baseline") - F.col("total"))


def cheapest_thresholds(sweep: DataFrame, scenarios: DataFrame, test_size: int) -> DataFrame:
    """B1, B3 for many cost and volume assumptions at once: the cheapest threshold of every
    scenario (last on ties) with its costs, and the saving against alerting nobody.

    ``scenarios`` has (scenario, cost_fn, cost_fp, monthly), any number of rows; each model's
    19 sweep rows travel as one array, so a scenario meets each model once. A null cost or
    volume gives null costs and the last threshold.
    """
    steps = sweep.groupBy("model").agg(F.sort_array(F.collect_list(F.struct(
        "threshold", "tp", "fp", "fn"))).alias("steps"))
    models = [r["model"] for r in steps.select("model").collect()]
    each = scenarios.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))) if models else \
        scenarios.withColumn("model", F.lit(None).cast("string"))
    scale = F.col("monthly") / F.lit(float(test_size))

    def total(s):
        return (s["fn"] * F.col("cost_fn") + s["fp"] * F.col("cost_fp")) * scale
    costs = F.transform("steps", lambda s: F.struct(
        (-F.coalesce(total(s), F.lit(0.0))).alias("rank"), s["threshold"].alias("threshold"), s.alias("s"),
        total(s).alias("total")))
    best = each.join(steps, "model").withColumn("b", F.array_max(costs))
    caught = (F.col("b.s.tp") + F.col("b.s.fn")) * F.col("cost_fn") * scale
    return best.select("scenario", "model", F.col("b.threshold").alias("threshold"), F.col("b.total").alias("total"),
                       (F.col("b.s.fn") * F.col("cost_fn") * scale).alias("missed"),
                       (F.col("b.s.fp") * F.col("cost_fp") * scale).alias("false_alerts"),
                       (caught - F.col("b.total")).alias("savings"))


def impact_kpis(rows: DataFrame, test_size: int,
                monthly: float = IMPACT_MONTHLY_VOLUME) -> DataFrame:
    """KPIs at the cheapest threshold (last on ties) and the best saving."""
    opt = F.max_by(F.struct("*"), F.struct(-F.col("total"), F.col("threshold")))
    best = F.max_by(F.col("savings"), F.struct(F.col("savings"), F.col("threshold")))
    agg = rows.groupBy("model").agg(opt.alias("o"), best.alias("best_saving"))

    def o(c):
        return F.col(f"o.{c}")

    def monthly_count(x):
        return F.floor(x / F.lit(float(test_size)) * F.lit(float(monthly)) + 0.5).cast("long")

    def pct(a, b):
        return F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))
    tp, fp, fn = o("tp"), o("fp"), o("fn")
    return agg.select(
        "model", o("threshold").alias("opt_threshold"),
        o("caught").alias("caught"), o("fn_cost").alias("missed"),
        o("fp_cost").alias("fp_cost"), o("net").alias("net"),
        (F.col("best_saving") * 12).alias("annual_saving"),
        (o("total") * 12).alias("annual_cost"),
        monthly_count(tp).alias("monthly_caught"),
        monthly_count(tp + fp).alias("monthly_alerts"),
        pct(tp.cast("double"), tp + fp).alias("precision_pct"),
        pct(tp.cast("double"), tp + fn).alias("capture_pct"),
        pct(fn.cast("double"), tp + fn).alias("miss_pct"),
        pct(o("baseline") - o("total"), o("baseline")).alias("cost_reduction_pct"))
