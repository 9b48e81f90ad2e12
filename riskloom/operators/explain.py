"""Explanations (X2, X3a, X4): additive contributions as Column expressions.

A linear model's contribution of input j on one row is
coef_j * (x_j - center_j) in log-odds, where x is the model input and center
the background mean. For a standard-scaled logistic regression the effective
coefficient on the raw input is coef_j / std_j (the scaler's mean cancels
against the background mean). Contributions are one array per row built from
literal coefficient arrays: no UDF, no shuffle. The global view (X2) is one
aggregation of |contribution| per feature; the waterfall (X4) sorts each row's
own array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_terms(model: PipelineModel, background: DataFrame,
                 features_col: str = "features") -> tuple[list[float], list[float], float]:
    """(effective coefficients on raw inputs, background means, intercept) of a
    StandardScaler + LogisticRegression pipeline."""
    scaler, lr = model.stages[0], model.stages[-1]
    std = scaler.std.toArray().tolist()
    coef = [c / s if s else 0.0 for c, s in zip(lr.coefficients.toArray().tolist(), std)]
    mean = background.select(Summarizer.mean(F.col(features_col)).alias("m")).first()["m"]
    return coef, mean.toArray().tolist(), float(lr.intercept)


def contributions(features: Column, names: list[str], coef: list[float],
                  center: list[float]) -> Column:
    """array<struct<idx:int, feature:string, value:double>> per row."""
    x = vector_to_array(features)
    return F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(n).alias("feature"),
                 (F.lit(float(c)) * (x[i] - F.lit(float(m)))).alias("value"))
        for i, (n, c, m) in enumerate(zip(names, coef, center))])


def with_linear_contributions(df: DataFrame, names: list[str], coef: list[float], center: list[float],
                              value: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """``contrib`` (as ``contributions``, ``value`` applied to each) for a frame with ``features``.

    The vector is unpacked and the array made in projections of their own: written into a
    higher-order function they would be computed again for every use of an element.
    """
    x = df.withColumn("_x", vector_to_array(F.col("features")))
    terms = F.array(*[F.lit(float(c)) * (F.col("_x")[i] - F.lit(float(m)))
                      for i, (c, m) in enumerate(zip(coef, center))])
    raw = x.withColumn("_raw", terms).drop("_x")
    labels = F.array(*[F.lit(n) for n in names])
    return raw.withColumn("contrib", F.transform("_raw", lambda v, i: F.struct(
        i.alias("idx"), labels[i].alias("feature"), value(v).alias("value")))).drop("_raw")


def explainer(model, names: list[str]):
    """Function that adds ``contrib`` (array<struct<idx, feature, value>>) to a frame with
    ``features``: log-odds terms of the logistic candidate, Shapley values of the boosted
    trees (in log-odds) or of the first calibration fold's forest (in probability)."""
    from riskloom.operators import treeshap as TS
    from riskloom.operators.models import CalibratedForest
    if isinstance(model, PipelineModel):
        scaler, lr = model.stages[0], model.stages[-1]
        std = scaler.std.toArray().tolist()
        coef = [c / s if s else 0.0 for c, s in zip(lr.coefficients.toArray().tolist(), std)]
        center = scaler.mean.toArray().tolist()      # the training rows are the background
        return lambda df: with_linear_contributions(df, names, coef, center)
    trees = model.forests[0] if isinstance(model, CalibratedForest) else model
    return lambda df: TS.with_contributions(df, trees, names)


def explode_contributions(df: DataFrame, contrib: Column, key: str = "Transaction_ID") -> DataFrame:
    """(key, feature, contribution) rows."""
    return (df.select(key, F.explode(contrib).alias("c"))
            .select(key, F.col("c.feature").alias("feature"), F.col("c.value").alias("contribution")))


def global_attribution(rows: DataFrame, top: int = 15) -> DataFrame:
    """Mean |contribution| per feature over all rows, top n."""
    return (rows.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("value"))
            .orderBy(F.desc("value"), F.asc("feature")).limit(top))


def waterfall(contrib: Column, k: int = 6) -> Column:
    """The k largest and k smallest contributions of one row, ascending by value.

    Ties follow the first-occurrence rule on both ends and in the order.
    """
    small = F.slice(F.sort_array(F.transform(contrib, lambda c: F.struct(
        c["value"].alias("v"), c["idx"].alias("i"), c["feature"].alias("f")))), 1, k)
    large = F.slice(F.sort_array(F.transform(contrib, lambda c: F.struct(
        c["value"].alias("v"), (-c["idx"]).alias("i"), c["feature"].alias("f")))), -k, k)
    large = F.transform(large, lambda s: F.struct(s["v"].alias("v"), (-s["i"]).alias("i"), s["f"].alias("f")))
    both = F.sort_array(F.concat(small, large))
    return F.transform(both, lambda s: F.struct(s["f"].alias("feature"), s["v"].alias("value")))


def additivity_gap(contrib: Column, base: Column, raw: Column) -> Column:
    """|sum(contributions) + base - raw| per row: 0 for an exact explanation."""
    total = F.aggregate(contrib, F.lit(0.0), lambda acc, c: acc + c["value"])
    return F.abs(total + base - raw)
