"""Artifact sink and source (S2, S3, S8) plus JSON response sink.

An artifact is a folder on shared storage: a log of versions. Each save writes its parts
(an MLlib model directory per candidate, the fitted preprocessing state, Parquet result
tables) to a fresh sub-folder and then appends one small file to the manifest, which
names the parts and their number. Nothing is ever replaced, so a reader sees whole
versions only: the newest one whose parts are all named, or an older one by number.
A save that fails leaves the versions before it as they are. Loading fails fast when the
folder, the version or a part is missing.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel,
                                       RandomForestClassificationModel)
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.nulls import nan_to_null
from riskloom.operators import evaluate as EV
from riskloom.operators import models as M

PIPELINE_VERSION = "riskloom-1"


def _slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def _kind(model) -> tuple[str, int]:
    if isinstance(model, M.CalibratedForest):
        return "calibrated_forest", len(model.forests)
    if isinstance(model, PipelineModel):
        return "pipeline", 0
    if isinstance(model, GBTClassificationModel):
        return "gbt", 0
    if isinstance(model, RandomForestClassificationModel):
        return "forest", 0
    raise TypeError(type(model).__name__)


def provenance(result: M.TrainResult, n_rows: int, fraud_rate: float,
               optimal_f1_threshold: float) -> DataFrame:
    """One-row training provenance record."""
    spark = result.predictions.sparkSession
    test_size = result.predictions.where(F.col("model") == result.best_name).count()
    row = (dt.datetime.now(dt.timezone.utc).isoformat(), PIPELINE_VERSION, pyspark.__version__,
           int(n_rows), len(result.prep.inputs), round(float(fraud_rate), 6), result.best_name,
           int(test_size), float(optimal_f1_threshold), "cv_pr_auc")
    return spark.createDataFrame([row], (
        "trained_at string, pipeline_version string, spark_version string, n_rows long, "
        "n_features int, fraud_rate double, best_model string, test_set_size long, "
        "optimal_f1_threshold double, model_selection_metric string"))


_MANIFEST = ("version long, run string, saved_at string, parts int, part string, name string, slug string, "
             "kind string, folds int")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per version: version, run, saved_at, parts, complete, newest.

    Two saves at the same moment may take the same number; the later run id is the newer.
    """
    rows = (_manifest(spark, path).groupBy("version", "run", "saved_at", "parts")
            .agg((F.count(F.lit(1)) == F.col("parts")).alias("complete")))
    last = rows.where("complete").agg(F.max(F.struct("version", "run")).alias("m")).first()["m"]
    return rows.withColumn("newest", F.col("run") == F.lit(last["run"] if last else ""))


def write_version(spark: SparkSession, path: str, tables: dict[str, DataFrame], models: dict | None = None,
                  prep: M.Prep | None = None) -> int:
    """Write one version (tables, models, preprocessing state); returns its number."""
    path = path.rstrip("/")
    run = f"run-{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    root = f"{path}/{run}"
    parts = []
    for name, model in (models or {}).items():
        kind, k = _kind(model)
        sub = f"{root}/models/{_slug(name)}"
        if kind == "calibrated_forest":
            model.save(sub)
        else:
            model.write().overwrite().save(sub)
        parts.append(("model", name, _slug(name), kind, k))
    if prep is not None:
        spark.createDataFrame([(prep.to_json(),)], "value string").write.text(f"{root}/prep")
        prep.codes.write.parquet(f"{root}/codes")
        parts.append(("prep", "prep", "prep", "json", 0))
    for name, df in tables.items():
        df.write.parquet(f"{root}/tables/{_slug(name)}")
        parts.append(("table", name, _slug(name), "parquet", 0))
    try:
        version = (_manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException as e:
        if not _missing(e):
            raise
        version = 1
    saved = dt.datetime.now(dt.timezone.utc).isoformat()
    rows = [(version, run, saved, len(parts), *p) for p in parts]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load_version(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """S3: the newest complete version, or the one asked for: version, run, tables, models (loaded
    at their first use) and prep. Raises FileNotFoundError when it or a table is absent; other
    failures (permissions, damaged files) are raised as they are."""
    path = path.rstrip("/")
    try:
        known = versions(spark, path).where("complete")
        known = known.where("newest") if version is None else known.where(F.col("version") == version)
        found = known.orderBy(F.desc("run")).first()
        if found is None:
            raise FileNotFoundError(f"{path} holds no complete version" + (f" {version}" if version else ""))
        root = f"{path}/{found['run']}"
        rows = _manifest(spark, path).where(F.col("run") == found["run"]).collect()      # a row per part
        tables = {r["name"]: spark.read.parquet(f"{root}/tables/{r['slug']}") for r in rows if r["part"] == "table"}
        prep = None
        if any(r["part"] == "prep" for r in rows):
            prep = M.Prep.from_json(spark.read.text(f"{root}/prep").first()["value"],
                                    spark.read.parquet(f"{root}/codes"))
    except AnalysisException as e:
        if not _missing(e):
            raise
        raise FileNotFoundError(f"artifact at {path} is missing or incomplete: {e}") from e
    load = {"pipeline": PipelineModel.load, "gbt": GBTClassificationModel.load,
            "forest": RandomForestClassificationModel.load}

    def loader(r):
        sub = f"{root}/models/{r['slug']}"
        if r["kind"] == "calibrated_forest":
            return lambda: M.CalibratedForest.load(sub, r["folds"])
        return lambda: load[r["kind"]](sub)
    models = M.StoredModels({r["name"]: loader(r) for r in rows if r["part"] == "model"})
    return {"version": found["version"], "run": found["run"], "tables": tables, "models": models, "prep": prep}


#: Tables of every trained artifact.
CORE_TABLES = ("metadata", "predictions", "metrics")


def save_artifacts(path: str, result: M.TrainResult, meta: DataFrame,
                   tables: dict[str, DataFrame] | None = None) -> int:
    """A training result as the next version of the artifact; returns its number."""
    core = dict(zip(CORE_TABLES, (meta, result.predictions, result.metrics)))
    return write_version(result.predictions.sparkSession, path, {**(tables or {}), **core}, result.models, result.prep)


def load_artifacts(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """S3: a training result read back: the newest complete version, or an older one."""
    found = load_version(spark, path, version)
    tables = dict(found["tables"])
    absent = [t for t in CORE_TABLES if t not in tables] + ([] if found["prep"] else ["prep"])
    if absent:
        raise FileNotFoundError(f"artifact at {path} lacks {', '.join(absent)}")
    meta = tables.pop("metadata").first()
    return {"version": found["version"], "metadata": meta.asDict(), "prep": found["prep"], "models": found["models"],
            "best_name": meta["best_model"], "predictions": tables.pop("predictions"),
            "metrics": tables.pop("metrics"), "tables": tables}


def version_view(spark: SparkSession, artifact: dict) -> DataFrame:
    """S8 view: provenance of a loaded artifact with the serving (floored) threshold."""
    meta = dict(artifact["metadata"])
    raw = float(meta.pop("optimal_f1_threshold"))
    row = spark.createDataFrame([{**meta, "raw_optimal_f1_threshold": raw}])
    return row.withColumn("optimal_f1_threshold", EV.floored(F.lit(raw)))


def _clean(x: Column, kind: T.DataType) -> Column:
    """``x`` with every NaN and infinity inside it as NULL."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(x)
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_clean(x[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(x.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _clean(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _clean(v, kind.valueType))
    return x


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and +/-Inf become NULL at every level of every column."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_lines(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON document per row (``value``), optionally keyed."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    cols = [F.col(key)] if key else []
    return df.select(*cols, body.alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    to_json_lines(sanitize(df)).select("value").write.mode("overwrite").text(path)
