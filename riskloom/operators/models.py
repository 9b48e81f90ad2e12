"""Model fitting, selection and scoring.

Flow: features -> fitted category codes and exact training medians ->
imputed, assembled ``features`` vector -> stratified train/test split and
CV folds with exact quotas -> class weights -> candidates -> predictions table
(model, Transaction_ID, label, p) -> metrics -> best model by (CV average precision,
test average precision).

The prepared frame is written once as Parquet and read by every fit. The forests and
boosting chains of all folds grow in one job over one binned sample (``growth``), their
isotonic calibrators are fitted in one set of jobs (``functions.isotonic``); the logistic
fits run beside them on MLlib. Fitted trees are stored as Spark's own models and loaded
when they are used.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import math
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, RandomForestClassificationModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.isotonic import isotonic_apply, isotonic_curves, isotonic_fit
from riskloom.operators import encode as EN
from riskloom.operators import evaluate as EV
from riskloom.operators import features as FT
from riskloom.operators import forest as FO
from riskloom.operators import growth as G
from riskloom.operators import train as TR
from riskloom.schema import CATEGORICAL_FEATURES, MODEL_INPUTS, NUMERIC_FEATURES
from riskloom.session import reliable_checkpoint, shared_path

RF, GBT, LR = "Random Forest", "Gradient Boosting", "Logistic Regression"


@dataclasses.dataclass
class TrainConfig:
    """Defaults are the published settings, the bound on the rows of a fit included (T1); tests
    pass smaller ones. ``max_rows`` also bounds what a task holds of the sample."""
    rf_trees: int = 300
    rf_depth: int = 12
    rf_min_leaf: int = 4
    calibration_folds: int = 5          # 0 disables isotonic calibration
    gbt_iter: int = 300
    gbt_step: float = 0.02
    gbt_depth: int = 6
    lr_c: float = 0.1
    lr_max_iter: int = 2000
    cv_folds: int = 5
    test_fraction: float = 0.2
    seed: int = 42
    max_rows: int = 200_000
    models: tuple[str, ...] = (RF, GBT, LR)
    parallelism: int = 8                 # concurrent fits (full fits and CV folds), as CrossValidator


@dataclasses.dataclass
class Prep:
    """Fitted preprocessing state: code table (column, value, code), medians, input order."""
    codes: DataFrame
    medians: dict[str, float]
    inputs: list[str]

    def transform(self, df: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """Raw transactions -> ``keep`` columns (default: all) plus the ``features`` vector.

        Codes and medians are applied inside the assembler inputs, so the
        original columns stay untouched; inputs absent from ``df`` are 0 (E4).
        """
        coded = [c for c in CATEGORICAL_FEATURES if c in self.inputs and c in df.columns]
        fe = EN.apply_category_codes(FT.engineer_features(df), self.codes, coded, "_code")
        tmp = [f"_in{i}" for i in range(len(self.inputs))]
        exprs = []
        for name, t in zip(self.inputs, tmp):
            if name in coded:
                e = F.col(name + "_code").cast("double")
            elif name in fe.columns:
                x = F.col(name).cast("double")
                x = F.when(~F.isnan(x), x)
                m = self.medians.get(name)
                e = F.coalesce(x, F.lit(float(m))) if m is not None else x
            else:
                e = F.lit(0.0)
            exprs.append(e.alias(t))
        base = list(keep) if keep is not None else list(df.columns)
        staged = fe.select(*base, *exprs)
        out = VectorAssembler(inputCols=tmp, outputCol="features",
                              handleInvalid="keep").transform(staged)
        return out.drop(*tmp)

    def to_json(self) -> str:
        """Medians and input order; the code table is stored as a table."""
        return json.dumps({"medians": self.medians, "inputs": self.inputs})

    @staticmethod
    def from_json(text: str, codes: DataFrame) -> "Prep":
        return Prep(codes, **json.loads(text))


def fit_prep(tx: DataFrame) -> Prep:
    """E1 + E3 on the full labelled table (the published order: before the split)."""
    fe = FT.feature_frame(tx, keep=())
    codes = EN.stored_codes(EN.fit_category_codes(tx))
    medians = EN.collect_medians(EN.fit_medians(fe, NUMERIC_FEATURES))
    return Prep(codes, medians, list(MODEL_INPUTS))


def prepare(tx: DataFrame, cfg: TrainConfig, capped: bool = True) -> tuple[Prep, DataFrame]:
    """(prep, frame) with Transaction_ID, label, features, is_test, fold, cal_fold, weight.

    The frame lies in Parquet files, which every candidate and fold reads. Without
    ``capped`` it holds the whole table.
    """
    prep = fit_prep(tx)
    base = tx.select("*", EN.label().alias("label"))
    if capped:
        base = TR.cap_rows(base, cfg.max_rows, seed=cfg.seed)
    vec = prep.transform(base, keep=("Transaction_ID", "label"))
    frame = TR.split_and_folds(vec, "label", cfg.test_fraction, cfg.cv_folds, cfg.calibration_folds, seed=cfg.seed)
    return prep, TR.with_weights(frame, TR.class_weights(frame.where(~F.col("is_test"))))


# ── candidates ───────────────────────────────────────────────────────────────

def _logistic(cfg: TrainConfig, weight_sum: float) -> Pipeline:
    # C scales the summed loss in the published model; Spark averages it: regParam = 1 / (C * sum(w)).
    reg = 1.0 / (cfg.lr_c * max(weight_sum, 1.0))
    return Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight",
                           regParam=reg, elasticNetParam=0.0, maxIter=cfg.lr_max_iter,
                           standardization=False),
    ])


def probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Fraud probability column from any fitted candidate (input columns kept)."""
    if isinstance(model, CalibratedForest):
        return model.transform(df, out)
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(*extra)


def model_probability(prep: "Prep", model, explain=None):
    """A ``ProbabilityFn`` for scoring: transaction frame -> same frame plus ``p``, and
    ``contrib`` if an explainer (frame with features -> frame with contrib) is given."""
    def fn(txn: DataFrame) -> DataFrame:
        out = probability(model, prep.transform(txn))
        return (explain(out) if explain is not None else out).drop("features")
    return fn


class CalibratedForest:
    """T5: k forests, each calibrated by isotonic regression on its held-out fold;
    the probability is the mean of the k calibrated probabilities. The parts lie in
    ``path`` and are loaded when they are used."""

    def __init__(self, path: str, folds: int):
        self.path, self.folds = path, folds

    @functools.cached_property
    def forests(self) -> list[RandomForestClassificationModel]:
        return [RandomForestClassificationModel.load(f"{self.path}/forest_{i}") for i in range(self.folds)]

    @functools.cached_property
    def calibrators(self) -> list[IsotonicRegressionModel]:
        return [IsotonicRegressionModel.load(f"{self.path}/isotonic_{i}") for i in range(self.folds)]

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        cur = df
        parts = []
        for i, (rf, iso) in enumerate(zip(self.forests, self.calibrators)):
            s = rf.transform(cur).withColumn("raw_p", vector_to_array(F.col("probability"))[1])
            s = s.drop("rawPrediction", "probability", "prediction")
            iso_in = s.withColumnRenamed("raw_p", "_raw")
            cur = iso.setFeaturesCol("_raw").setPredictionCol(f"_cal{i}").transform(iso_in).drop("_raw")
            parts.append(F.col(f"_cal{i}"))
        mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
        return cur.withColumn(out, mean).drop(*[f"_cal{i}" for i in range(len(parts))])

    @property
    def featureImportances(self):
        return self.forests[0].featureImportances

    def save(self, path: str) -> None:
        for i, (rf, iso) in enumerate(zip(self.forests, self.calibrators)):
            rf.write().overwrite().save(f"{path}/forest_{i}")
            iso.write().overwrite().save(f"{path}/isotonic_{i}")

    @staticmethod
    def load(path: str, k: int) -> "CalibratedForest":
        return CalibratedForest(path, k)


class StoredModels(Mapping):
    """Fitted models by candidate, loaded at their first use."""

    def __init__(self, loaders: dict[str, Callable]):
        self._loaders, self._loaded = loaders, {}

    def __getitem__(self, name: str):
        if name not in self._loaded:
            self._loaded[name] = self._loaders[name]()
        return self._loaded[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)


def _fit_logistic(train: DataFrame, cfg: TrainConfig) -> PipelineModel:
    wsum = train.agg(F.sum("weight")).first()[0] or 1.0
    return _logistic(cfg, wsum).fit(train)


def sample_of(frame: DataFrame, inputs: int) -> G.Sample:
    """The binned sample of a prepared frame of bounded size."""
    w = {int(r["label"]): float(r["weight"]) for r in TR.class_weights(frame.where(~F.col("is_test"))).collect()}
    return G.binned_sample(frame, (w.get(0, 1.0), w.get(1, 1.0)), inputs)


def grow_ensembles(frame: DataFrame, cfg: TrainConfig, inputs: int) -> DataFrame:
    """Forests and chains of the training part and of all CV folds, in one job."""
    folds = [G.FULL, *range(cfg.cv_folds if cfg.cv_folds > 1 else 0)]
    units = [G.Unit(k, G.CHAIN, 0, cfg.gbt_iter) for k in folds] if GBT in cfg.models else []
    if RF in cfg.models:
        units += G.forest_units(folds, cfg.calibration_folds, cfg.rf_trees)
    return G.grow(frame.sparkSession, sample_of(frame, inputs), units, cfg)


def ensemble_predictions(grown: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, dict]:
    """(model, k, Transaction_ID, label, p) of the rows that each fold holds back, and the
    calibration curves per (k, cal)."""
    scores = reliable_checkpoint(G.unseen_scores(grown))
    chain = scores.where(F.col("cal") == G.CHAIN).select(
        F.lit(GBT).alias("model"), "k", "id", "label", (1 / (1 + F.exp(-F.col("p")))).alias("p"))
    forest = scores.where(F.col("cal") != G.CHAIN).withColumn("p", F.col("p") / F.lit(float(cfg.rf_trees)))
    keys = ["k", "cal"]
    curves = isotonic_curves(isotonic_fit(forest.where("calibrates"), keys), keys)
    held = isotonic_apply(forest.where("NOT calibrates"), keys, curves)
    forest = (held.groupBy("k", "id", "label").agg(F.avg(F.coalesce("cal_p", "p")).alias("p"))
              .select(F.lit(RF).alias("model"), "k", "id", "label", "p"))
    return chain.unionByName(forest).withColumnRenamed("id", "Transaction_ID"), curves


def store_ensembles(grown: DataFrame, curves: dict, cfg: TrainConfig, inputs: int) -> dict[str, Callable]:
    """Write the final models in Spark's layout; returns a loader per candidate."""
    spark = grown.sparkSession
    path = shared_path(spark, "models")
    loaders: dict[str, Callable] = {}
    if GBT in cfg.models:
        G.write_boosted(grown, G.FULL, cfg.gbt_iter, cfg.gbt_step, inputs, f"{path}/boosted")
        loaders[GBT] = lambda: GBTClassificationModel.load(f"{path}/boosted")
    if RF in cfg.models and cfg.calibration_folds > 1:
        for i in range(cfg.calibration_folds):
            G.write_forest(grown, G.FULL, i, cfg.rf_trees, inputs, f"{path}/forest_{i}")
            G.write_isotonic(spark, curves.get((G.FULL, i)), f"{path}/isotonic_{i}")
        loaders[RF] = lambda: CalibratedForest(path, cfg.calibration_folds)
    elif RF in cfg.models:
        G.write_forest(grown, G.FULL, -1, cfg.rf_trees, inputs, f"{path}/forest")
        loaders[RF] = lambda: RandomForestClassificationModel.load(f"{path}/forest")
    return loaders


def explained_models(tx: DataFrame, cfg: TrainConfig, names: tuple[str, ...] = (RF,), all_rows: bool = True):
    """(prep, frame, {name: model}): the tree models that explain the candidates, fitted alone:
    the calibrated candidate's first forest, and the boosted trees.

    With ``all_rows`` the frame holds the whole table, split before the bound, so that
    every test row stays; ``max_rows`` bounds the training rows of the fit in either case.
    """
    spark = tx.sparkSession
    prep, frame = prepare(tx, cfg, capped=not all_rows)
    train = frame.where(~F.col("is_test"))
    if all_rows:
        train = TR.cap_rows(train, cfg.max_rows, seed=cfg.seed)
    inputs = len(prep.inputs)
    units = [G.Unit(G.FULL, G.CHAIN, 0, cfg.gbt_iter)] if GBT in names else []
    forests = [u for u in G.forest_units([G.FULL], cfg.calibration_folds, cfg.rf_trees) if u.cal <= 0]
    grown = G.grow(spark, sample_of(train, inputs), units + (forests if RF in names else []), cfg)
    models, path = {}, shared_path(spark, "explained")
    if RF in names:
        G.write_forest(grown, G.FULL, forests[0].cal, cfg.rf_trees, inputs, f"{path}/forest")
        models[RF] = RandomForestClassificationModel.load(f"{path}/forest")
    if GBT in names:
        G.write_boosted(grown, G.FULL, cfg.gbt_iter, cfg.gbt_step, inputs, f"{path}/boosted")
        models[GBT] = GBTClassificationModel.load(f"{path}/boosted")
    return prep, frame, models


def whole_forest(tx: DataFrame, cfg: TrainConfig):
    """(prep, frame, model): the calibrated candidate's first forest, fitted on all of its training
    rows; the frame holds the whole table."""
    prep, frame = prepare(tx, cfg, capped=False)
    train = frame.where(~F.col("is_test"))
    w = {int(r["label"]): float(r["weight"]) for r in TR.class_weights(train).collect()}
    edges = FO.split_values(train, len(prep.inputs))
    if cfg.calibration_folds > 1:
        train = train.where(F.col("cal_fold") != 0)
    grown = FO.grow_forest(train, (w.get(0, 1.0), w.get(1, 1.0)), edges, cfg.rf_trees, cfg)
    path = shared_path(tx.sparkSession, "explained")
    G.write_forest(grown, G.FULL, 0, cfg.rf_trees, len(prep.inputs), f"{path}/forest")
    return prep, frame, RandomForestClassificationModel.load(f"{path}/forest")


# ── T8-T10 ───────────────────────────────────────────────────────────────────

@dataclasses.dataclass
class TrainResult:
    prep: Prep
    models: Mapping
    predictions: DataFrame       # model, Transaction_ID, label, p (test part)
    metrics: DataFrame           # one row per model
    best_name: str
    frame: DataFrame


def _predict(name, model, df) -> DataFrame:
    return probability(model, df).select(F.lit(name).alias("model"), "Transaction_ID",
                                         F.col("label").cast("int").alias("label"), "p")


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _mean_std(scores: list[float]) -> tuple[float, float]:
    mean = sum(scores) / len(scores)
    return mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))


def fold_scores(preds: DataFrame, names, folds: int) -> dict[str, tuple[float, float]]:
    """Mean and population std of average precision over the CV folds, per candidate.

    ``preds`` has (model, k, label, p) of the rows of fold k, scored without it; all folds
    are ranked in one pass.
    """
    if folds < 2:
        return {n: (0.0, 0.0) for n in names}
    one = preds.withColumn("model", F.concat_ws("/", "model", F.col("k").cast("string")))
    found = {r["model"]: r["average_precision"] for r in EV.rank_metrics(EV.score_steps(one)).collect()}
    return {n: _mean_std([float(found.get(f"{n}/{k}") or 0.0) for k in range(folds)]) for n in names}


def train_all(tx: DataFrame, cfg: TrainConfig = TrainConfig()) -> TrainResult:
    """Fit every candidate on the training part and on its CV folds; score the test part.

    One job grows all trees; the logistic fits are submitted beside it from a pool
    (``cfg.parallelism``), like ``CrossValidator(parallelism=...)``.
    """
    prep, frame = prepare(tx, cfg)
    inputs = len(prep.inputs)
    train, test = frame.where(~F.col("is_test")), frame.where(F.col("is_test"))
    cv = cfg.cv_folds if cfg.cv_folds > 1 else 0
    trees = any(n in (RF, GBT) for n in cfg.models)
    with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as pool:
        grown = pool.submit(grow_ensembles, frame, cfg, inputs) if trees else None
        linear = {k: pool.submit(_fit_logistic, train if k == G.FULL else train.where(F.col("fold") != k), cfg)
                  for k in [G.FULL, *range(cv)]} if LR in cfg.models else {}
        linear = {k: f.result() for k, f in linear.items()}
        grown = grown.result() if trees else None
    parts, loaders = [], {}
    if trees:
        scored, curves = ensemble_predictions(grown, cfg)
        parts.append(scored.where(F.col("model").isin(*cfg.models)).withColumn("label", F.col("label").cast("int")))
        loaders |= store_ensembles(grown, curves, cfg, inputs)
    for k, m in linear.items():
        rows = test if k == G.FULL else train.where(F.col("fold") == k)
        parts.append(_predict(LR, m, rows).withColumn("k", F.lit(k)))
    if LR in cfg.models:
        loaders[LR] = lambda: linear[G.FULL]
    scored = reliable_checkpoint(_union(parts))
    allp = scored.where(F.col("k") == G.FULL).select("model", "Transaction_ID", "label", "p")
    metrics = model_metrics(allp, fold_scores(scored.where(F.col("k") != G.FULL), cfg.models, cv))
    best = metrics.orderBy(F.desc("cv_mean_raw"), F.desc("pr_auc")).first()["name"]
    return TrainResult(prep, StoredModels({n: loaders[n] for n in cfg.models}), allp, metrics, best, frame)


def model_metrics(preds: DataFrame, cv: dict[str, tuple[float, float]]) -> DataFrame:
    """M13 inputs: AUC, AP, Brier, CV mean/std and the class report at 0.5 per model."""
    spark = preds.sparkSession
    rank = EV.rank_metrics(EV.score_steps(preds))
    br = preds.groupBy("model").agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))
    rep = EV.class_report(EV.confusion(preds, 0.5))
    cls = rep.groupBy("model").agg(
        *[F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{m}{sfx}")
          for c, sfx in (("1", ""), ("0", "_normal")) for m in ("precision", "recall", "f1")])
    cvdf = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in cv.items()],
                                 "model string, cv_mean_raw double, cv_std_raw double")
    return (rank.join(br, "model").join(cls, "model").join(cvdf, "model")
            .select(F.col("model").alias("name"), F.col("roc_auc"),
                    F.col("average_precision").alias("pr_auc"), "cv_mean_raw", "cv_std_raw",
                    F.round("cv_mean_raw", 4).alias("cv_mean"), F.round("cv_std_raw", 4).alias("cv_std"),
                    F.round("brier", 4).alias("brier"), "precision", "recall", "f1",
                    "precision_normal", "recall_normal", "f1_normal"))


def comparison(result: TrainResult) -> DataFrame:
    """The model comparison table with ``is_best``."""
    m = result.metrics
    return m.select("name", *[F.round(c, 4).alias(c) for c in
                              ("roc_auc", "pr_auc", "cv_mean", "cv_std", "brier", "precision",
                               "recall", "f1", "precision_normal", "recall_normal", "f1_normal")],
                    (F.col("name") == F.lit(result.best_name)).alias("is_best"))


def importance(model, inputs: list[str], top: int = 15) -> DataFrame:
    """Tree importances or |coefficients|, sorted, top n. Raises if unavailable."""
    spark = SparkSession.getActiveSession()
    inner = model
    if isinstance(model, PipelineModel):
        inner = model.stages[-1]
    if hasattr(inner, "featureImportances"):
        values = inner.featureImportances.toArray().tolist()
    elif hasattr(inner, "coefficients"):
        values = [abs(v) for v in inner.coefficients.toArray().tolist()]
    else:
        raise TypeError(f"no importance available for {type(inner).__name__}")
    rows = list(zip(inputs, [float(v) for v in values]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
