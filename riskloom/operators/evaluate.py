"""Evaluation operators over a predictions table (model, label, p).

Threshold-grid statistics (confusion, sweep, calibration) are one global
aggregate with conditional counts: partial aggregation per task, one tiny
final merge, no sort. Rank statistics (ROC-AUC, average precision, ROC and
PR curves) need running totals over all distinct scores in descending order;
they use ``ordered_scan`` (range partitions + offsets) instead of a
single-task window. Integer counts stay integers (decimal(38,0) where products
can exceed 64 bits) so AUC is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import zero_guarded
from riskloom.functions.ordered import ordered_scan
from riskloom.session import reliable_checkpoint
from riskloom.schema import (CALIBRATION_BINS, COST_FN_WEIGHT, COST_FP_WEIGHT, CURVE_POINTS,
                             THRESHOLD_FLOOR, THRESHOLD_GRID)

# FIXED VALUES: the per-model optimum scans the unrounded grid 0.05 + i*0.05
# (floating values such as 0.15000000000000002), unlike the rounded sweep grid.
RAW_GRID = [float(t) for t in np.arange(0.05, 0.96, 0.05)]
CALIBRATION_EDGES = [i * (1.0 / CALIBRATION_BINS) for i in range(1, CALIBRATION_BINS)]

DEC = "decimal(38,0)"


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return zero_guarded(2 * tp, 2 * tp + fp + fn)


# ── M1, M2 ───────────────────────────────────────────────────────────────────

def confusion(preds: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """(model, tp, fp, fn, tn) at p >= threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col("p") >= t
    pos = F.col("label") == 1
    return preds.groupBy("model").agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


def confusions(preds: DataFrame) -> DataFrame:
    """(model, at, threshold, tp, fp, fn, tn) at 0.5 and at each model's optimal threshold.

    Both come from one scan: the counts of every grid value, a few rows per model.
    """
    counts = reliable_checkpoint(grid_counts(preds, sorted({0.5, *THRESHOLD_GRID, *RAW_GRID})))
    cols = ["tp", "fp", "fn", "tn"]
    half = counts.where(F.col("threshold") == 0.5).select("model", F.lit("0.5").alias("at"), "threshold", *cols)
    best = F.broadcast(threshold_optima(preds, counts=counts).select("model", "opt_thresh_raw", "opt_thresh"))
    optimal = (counts.join(best, "model").where(F.col("threshold") == F.col("opt_thresh_raw"))
               .select("model", F.lit("optimal").alias("at"), F.col("opt_thresh").alias("threshold"), *cols))
    return half.unionByName(optimal)


def class_report(conf: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted avg.

    Zero divisions give 0. (model, class, precision, recall, f1, support).
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1, f1 = zero_guarded(tp, tp + fp), zero_guarded(tp, tp + fn), _f1(tp, fp, fn)
    p0, r0, f0 = zero_guarded(tn, tn + fn), zero_guarded(tn, tn + fp), _f1(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    acc = zero_guarded(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))
    w0, w1 = zero_guarded(s0, n), zero_guarded(s1, n)
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n))
    out = conf.select("model", F.explode(rows).alias("r")).select("model", "r.*")
    return out.select("model", "class", *[F.round(c, 6).alias(c)
                                          for c in ("precision", "recall", "f1")], "support")


# ── M3-M7: rank statistics ───────────────────────────────────────────────────

def score_steps(preds: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """One row per (model, distinct p), descending, with running totals.

    Columns: model, p, pos, neg, cum_pos (tps), cum_neg (fps), cum_one (1-based
    rank), next_pos, next_neg (counts at the next lower score).
    """
    steps = preds.groupBy("model", "p").agg(
        F.sum("label").cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("neg"),
        F.lit(1).cast("long").alias("one"))
    return ordered_scan(steps, ["model"], "p", True, ["pos", "neg", "one"], ["pos", "neg"],
                        num_partitions=num_partitions)


def rank_metrics(steps: DataFrame) -> DataFrame:
    """(model, roc_auc, average_precision) from ``score_steps``.

    AUC counts tied pairs as one half: with X = sum pos*(2*fps - neg),
    AUC = (2NP - X) / 2NP, exact in decimal(38,0). AP is the step sum
    sum (R_n - R_{n-1}) P_n over distinct thresholds.
    """
    pos, neg = F.col("pos").cast(DEC), F.col("neg").cast(DEC)
    x = pos * (2 * F.col("cum_neg").cast(DEC) - neg)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = steps.groupBy("model").agg(
        F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"), F.sum(x).alias("x_sum"),
        F.sum(F.col("pos") * prec).alias("ap_num"))
    two_np = 2 * F.col("n_neg") * F.col("n_pos")
    return agg.select(
        "model",
        F.when(two_np > 0, (two_np - F.col("x_sum")).cast("double") / two_np.cast("double"))
         .alias("roc_auc"),
        F.when(F.col("n_pos") > 0, F.col("ap_num") / F.col("n_pos").cast("double"))
         .alias("average_precision"))


def brier(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model").agg(
        F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 4).alias("brier"))


def _targets(lengths: DataFrame, k: int) -> DataFrame:
    """(model, idx): round-half-even(linspace(0, n-1, min(k, n))) per model; <= k rows each."""
    num = F.least(F.col("n"), F.lit(k))
    step = F.when(num > 1, (F.col("n") - 1).cast("double") / (num - 1)).otherwise(F.lit(0.0))
    i = F.explode(F.sequence(F.lit(0).cast("long"), (num - 1).cast("long"))).alias("i")
    picked = lengths.select("model", step.alias("step"), i)
    return picked.select("model", F.bround(F.col("i") * F.col("step"), 0).cast("long")
                         .alias("idx")).distinct()


def downsample(curve: DataFrame, lengths: DataFrame, k: int = CURVE_POINTS) -> DataFrame:
    """M8: keep <= k evenly spaced points (both ends) of each model's curve."""
    # at most k rows per model
    return curve.join(F.broadcast(_targets(lengths, k)), ["model", "idx"], "left_semi")


def roc_curve(steps: DataFrame, k: int | None = CURVE_POINTS) -> DataFrame:
    """(model, idx, fpr, tpr, threshold); collinear points dropped, (0,0) first.

    ``k`` downsamples to at most k points; None keeps the full curve.
    """
    steps = reliable_checkpoint(steps)
    keep = ((F.col("cum_one") == 1) | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    kept = steps.where(keep).select("model", "p", "pos", "neg", "cum_pos", "cum_neg",
                                    F.lit(1).cast("long").alias("k1"))
    ranked = ordered_scan(kept, ["model"], "p", True, ["k1"])
    totals = steps.groupBy("model").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pts = ranked.join(F.broadcast(totals), "model").select(
        "model", F.col("cum_k1").alias("idx"),
        F.round(F.try_divide(F.col("cum_neg").cast("double"), F.col("n_neg")), 6).alias("fpr"),
        F.round(F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos")), 6).alias("tpr"),
        F.col("p").alias("threshold"))
    origin = totals.select("model", F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("fpr"),
                           F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    curve = pts.unionByName(origin)
    if k is None:
        return curve
    lengths = kept.groupBy("model").agg((F.count(F.lit(1)) + 1).alias("n"))
    return downsample(curve, lengths, k)


def pr_curve(steps: DataFrame, k: int | None = CURVE_POINTS) -> DataFrame:
    """(model, idx, precision, recall, threshold), ascending threshold, then (1, 0)."""
    steps = reliable_checkpoint(steps)
    totals = steps.groupBy("model").agg(F.sum("pos").alias("n_pos"),
                                        F.count(F.lit(1)).alias("m"))
    recall = F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(
        F.col("cum_pos").cast("double") / F.col("n_pos"))
    pts = steps.join(F.broadcast(totals), "model").select(
        "model", (F.col("m") - F.col("cum_one")).alias("idx"),
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(recall, 6).alias("recall"), F.col("p").alias("threshold"))
    end = totals.select("model", F.col("m").alias("idx"), F.lit(1.0).alias("precision"),
                        F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold"))
    curve = pts.unionByName(end)
    if k is None:
        return curve
    lengths = totals.select("model", (F.col("m") + 1).alias("n"))
    return downsample(curve, lengths, k)


# ── M9-M12, M14, M15: threshold grid ─────────────────────────────────────────

def grid_counts(preds: DataFrame, grid: list[float] = THRESHOLD_GRID) -> DataFrame:
    """(model, threshold, tp, fp, tn, fn) for every grid value, p >= t.

    One aggregate with two conditional counts per grid value.
    """
    pos = F.col("label") == 1
    aggs = [F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg")]
    for i, t in enumerate(grid):
        hit = F.col("p") >= F.lit(float(t))
        aggs += [F.count_if(hit & pos).alias(f"tp{i}"), F.count_if(hit & ~pos).alias(f"fp{i}")]
    one = preds.groupBy("model").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"fp{i}").alias("fp")) for i, t in enumerate(grid)])
    long = one.select("model", "n_pos", "n_neg", F.explode(rows).alias("r"))
    return long.select("model", "r.threshold", "r.tp", "r.fp",
                       (F.col("n_neg") - F.col("r.fp")).alias("tn"),
                       (F.col("n_pos") - F.col("r.tp")).alias("fn"))


def threshold_sweep(preds: DataFrame) -> DataFrame:
    """M9: 19 rows per model, metrics rounded to 4."""
    return _sweep_metrics(grid_counts(preds))


def _sweep_metrics(g: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("model", "threshold", "tp", "fp", "tn", "fn",
                    F.round(zero_guarded(tp, tp + fp), 4).alias("precision"),
                    F.round(zero_guarded(tp, tp + fn), 4).alias("recall"),
                    F.round(_f1(tp, fp, fn), 4).alias("f1"))


def threshold_optima(preds: DataFrame, sweep: DataFrame | None = None,
                     counts: DataFrame | None = None) -> DataFrame:
    """M10 + M11 per model.

    optimal_f1_threshold: max rounded F1 on the sweep, lowest threshold on ties;
    optimal_cost_threshold: min 5*fn + 0.1*fp, lowest on ties;
    opt_thresh_raw: max unrounded F1 on the unrounded grid (first on ties),
    opt_thresh its 2-decimal display value.
    """
    both = counts if counts is not None else grid_counts(
        preds, sorted(set(THRESHOLD_GRID) | set(RAW_GRID)))   # one scan
    if sweep is None:
        sweep = _sweep_metrics(both.where(F.col("threshold").isin(*THRESHOLD_GRID)))
    cost = F.lit(COST_FN_WEIGHT) * F.col("fn") + F.lit(COST_FP_WEIGHT) * F.col("fp")
    a = sweep.groupBy("model").agg(
        F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("optimal_f1_threshold"),
        F.min_by("threshold", F.struct(cost, F.col("threshold"))).alias("optimal_cost_threshold"))
    raw = both.where(F.col("threshold").isin(*RAW_GRID))
    f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    b = raw.groupBy("model").agg(
        F.min_by("threshold", F.struct(-f1, F.col("threshold"))).alias("opt_thresh_raw"))
    return a.join(b, "model").select(
        "model", "optimal_f1_threshold", "optimal_cost_threshold", "opt_thresh_raw",
        F.round("opt_thresh_raw", 2).alias("opt_thresh"))


def floored(t: Column) -> Column:
    """The serving threshold is never below 0.05."""
    return F.greatest(t, F.lit(THRESHOLD_FLOOR))


def nearest_threshold(sweep: DataFrame, t: float) -> DataFrame:
    """The sweep row closest to t (first, i.e. lowest threshold, on ties)."""
    key = F.struct(F.abs(F.col("threshold") - F.lit(float(t))), F.col("threshold"))
    cols = [c for c in sweep.columns if c != "model"]
    row = F.min_by(F.struct(*cols), key).alias("r")
    return sweep.groupBy("model").agg(row).select("model", "r.*")


def calibration(preds: DataFrame, edges: list[float] = CALIBRATION_EDGES) -> DataFrame:
    """Uniform bins, right-closed; empty bins omitted.

    (model, bin, count, prob_pred, prob_true).
    """
    b = sum((F.col("p") > F.lit(e)).cast("int") for e in edges)
    return (preds.select("model", "p", "label", b.alias("bin"))
            .groupBy("model", "bin")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.round(F.avg("p"), 6).alias("prob_pred"),
                 F.round(F.avg(F.col("label").cast("double")), 6).alias("prob_true")))
