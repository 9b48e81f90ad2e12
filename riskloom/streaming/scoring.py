"""Live scoring as Structured Streaming (R12) and the scored history.

JSON request files -> validation (stream-static joins to the small
city table) -> request -> transaction mapping with the request's as-of date ->
probability -> the same ``rules.score`` columns as batch -> one folder per
micro-batch. Rejected requests go to a quarantine sink with their messages. Checkpoints and
sinks live in the shared checkpoint folder, so a restarted query resumes
exactly where it stopped.

Stateless unless ``repeat_window`` is given. Then the query keeps the request ids it has
seen (with the arrival time of their file as event time, so the state is bounded by the
window) and scores a repeated request once, across restarts too. Requests whose file is
older than the newest one by more than the window may be dropped as late;
``unscored_requests`` finds them.

Each batch folder has a row of time bounds beside it, with the latest time of all batches
up to it. ``history`` walks from the newest batch backwards and stops where that mark
shows that no earlier batch can hold one of the newest rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import rules as RU
from riskloom.operators.explain import waterfall
from riskloom.operators import validate as VAL
from riskloom.sources.requests import (REQUEST_TO_TRANSACTION, parse_requests, read_requests, request_stream,
                                       requests_to_transactions)
from riskloom.session import remove, shared_path
from riskloom.sources.artifacts import sanitize, to_json_lines

ProbabilityFn = Callable[[DataFrame], DataFrame]


def scoring_plan(requests: DataFrame, cities: DataFrame, probability: ProbabilityFn,
                 threshold: float, merchant_cats: list[str] | None = None,
                 as_of: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, quarantined) for a batch or streaming request frame.

    ``as_of`` is the scoring date; without it a request's own date or the current date.

    ``probability`` maps a transaction-named frame to the same frame plus ``p``. Validated
    batch requests are written once: both results read them, and the optimiser does not
    carry the parsing and validation into every feature (which took minutes of planning).
    """
    kw = {"merchant_cats": merchant_cats} if merchant_cats else {}
    checked = VAL.validate(requests, cities, **kw)
    if not requests.isStreaming:
        path = shared_path(requests.sparkSession, "validated")
        checked.write.parquet(path)
        checked = requests.sparkSession.read.schema(checked.schema).parquet(path)
    return split_checked(checked, probability, threshold, as_of)


def split_checked(checked: DataFrame, probability: ProbabilityFn, threshold: float,
                  as_of: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, quarantined) of validated requests."""
    accepted = checked.where("valid").drop("errors", "valid", "home_country", "tx_country", "bad_fields",
                                           "payload", "_corrupt_record")
    quarantined = checked.where("NOT valid").select(
        *[c for c in ("request_id", "Transaction_ID", "payload", "_corrupt_record") if c in checked.columns],
        "errors")
    scored_in = probability_on_requests(accepted, probability, as_of)
    scored = RU.score(scored_in, threshold).withColumn("scored_at", F.current_timestamp())
    return scored, quarantined


def probability_on_requests(requests: DataFrame, probability: ProbabilityFn,
                            as_of: dt.date | None = None) -> DataFrame:
    """Request columns plus ``p`` (the mapping to training names is internal)."""
    txn = requests_to_transactions(requests, as_of)
    with_p = probability(txn)
    extras = [c for c in requests.columns if c not in REQUEST_TO_TRANSACTION]
    return with_p.select(*extras, *[F.col(v).alias(k) for k, v in REQUEST_TO_TRANSACTION.items()],
                         "p", *[c for c in ("contrib",) if c in with_p.columns])


def start_scoring_stream(spark: SparkSession, source_dir: str, cities: DataFrame,
                         probability: ProbabilityFn, threshold: float,
                         sink_dir: str | None = None, quarantine_dir: str | None = None,
                         merchant_cats: list[str] | None = None,
                         available_now: bool = True, max_files_per_trigger: int | None = None,
                         responses_dir: str | None = None, model_name: str = "model",
                         roc_auc: float | None = None, as_of: dt.date | None = None,
                         repeat_window: str | None = None):
    """Start the scoring query; returns ([query], sink, quarantine).

    The source is read and validated once: each micro-batch of validated requests is
    kept as files until it is written to all sinks (scored, quarantined and, with ``responses_dir``, one
    JSON response document per accepted request). Every sink has one folder
    ``batch=<id>`` per micro-batch, which a repeated batch overwrites, so the sinks
    agree and hold every request once after a failure.
    """
    sink_dir = sink_dir or shared_path(spark, "scored")
    quarantine_dir = quarantine_dir or shared_path(spark, "quarantine")
    kw = {"merchant_cats": merchant_cats} if merchant_cats else {}
    requests = request_stream(spark, source_dir, max_files_per_trigger, arrival=repeat_window is not None)
    if repeat_window:
        # only the line is exchanged by its key, not its fields beside it: they are parsed again from it
        requests = parse_requests(requests.select(F.col("payload").alias("value"), "arrived_at",
                                                  request_key().alias("_seen"))
                                  .withWatermark("arrived_at", repeat_window).dropDuplicatesWithinWatermark(["_seen"])
                                  .select("value"))
    checked = VAL.validate(requests, cities, **kw)

    def write(batch: DataFrame, batch_id: int) -> None:
        # files, not the executors' memory: a batch may be the whole backlog
        path = shared_path(batch.sparkSession, "validated")
        batch.write.parquet(path)
        try:
            kept = batch.sparkSession.read.schema(batch.schema).parquet(path)
            scored, quarantined = split_checked(kept, probability, threshold, as_of)
            if responses_dir:
                bars = waterfall(F.col("contrib")) if "contrib" in scored.columns else None
                docs = to_json_lines(sanitize(RU.response(scored, model_name, roc_auc, waterfall=bars)))
                docs.select("value").write.mode("overwrite").text(f"{responses_dir}/batch={batch_id}")
                scored = scored.drop("contrib")
            write_scored(scored, sink_dir, batch_id)
            quarantined.write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")
        finally:
            remove(batch.sparkSession, path)

    w = checked.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink_dir}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return [_start(spark, w)], sink_dir, quarantine_dir


_STORE = "spark.sql.streaming.stateStore.providerClass"
_DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def _start(spark: SparkSession, writer):
    """Start with the request ids in RocksDB, on the executors' disks: the default store holds all of
    them in the executors' heap. A query keeps the settings of its start; another choice of the session
    is left as it is, and so is a checkpoint's."""
    before = spark.conf.get(_STORE, None)
    if before not in (None, _DEFAULT_STORE):
        return writer.start()
    spark.conf.set(_STORE, _DEFAULT_STORE.replace("HDFSBackedStateStoreProvider", "RocksDBStateStoreProvider"))
    try:
        return writer.start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def request_key() -> "F.Column":
    """What makes a request the same: its id, or its text where it has none."""
    return F.coalesce(F.concat(F.lit("id:"), F.col("request_id")), F.concat(F.lit("text:"), F.md5("payload")))


def unscored_requests(spark: SparkSession, source_dir: str, sink_dir: str, quarantine_dir: str) -> DataFrame:
    """Requests of the source that neither sink holds by id: the late ones, once the query has
    caught up. A batch anti-join; requests without an id are left out."""
    done = (spark.read.parquet(sink_dir).select("request_id")
            .unionByName(spark.read.parquet(quarantine_dir).select("request_id")))
    return read_requests(spark, source_dir).where("request_id IS NOT NULL").join(done, "request_id", "left_anti")


_BOUNDS = "batch long, rows long, lo timestamp, hi timestamp, mark timestamp"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The batch ids under ``folder``, newest first (a directory listing, no file is read)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted((int(n[6:]) for n in names if n.startswith("batch=")), reverse=True)


def _bounds(spark: SparkSession, sink_dir: str, ids: list[int]) -> list:
    return (spark.read.schema(_BOUNDS).parquet(*[f"{sink_dir}/_bounds/batch={i}" for i in ids])
            .orderBy(F.desc("batch")).collect() if ids else [])


def write_scored(scored: DataFrame, sink_dir: str, batch_id: int) -> None:
    """One micro-batch as a folder, then its time bounds; a repeated batch overwrites both."""
    spark = scored.sparkSession
    scored.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")
    own = spark.read.schema(scored.schema).parquet(f"{sink_dir}/batch={batch_id}").agg(
        F.count(F.lit(1)).alias("rows"), F.min("scored_at").alias("lo"), F.max("scored_at").alias("hi")).first()
    before = [i for i in _batches(spark, f"{sink_dir}/_bounds") if i < batch_id][:1]
    marks = [t for t in (own["hi"], *(b["mark"] for b in _bounds(spark, sink_dir, before))) if t is not None]
    row = (batch_id, own["rows"], own["lo"], own["hi"], max(marks, default=None))
    (spark.createDataFrame([row], _BOUNDS).coalesce(1).write.mode("overwrite")
     .parquet(f"{sink_dir}/_bounds/batch={batch_id}"))


def history(spark: SparkSession, sink_dir: str, n: int = 50) -> DataFrame:
    """The newest n scored requests (the limit is the feature: a recent-history view).

    Reads the folders of the newest batches only, however many the sink holds.
    """
    ids = _batches(spark, f"{sink_dir}/_bounds")
    if not ids:
        raise FileNotFoundError(f"no scored batch in {sink_dir}")
    take = 1
    while True:
        seen = _bounds(spark, sink_dir, ids[:take + 1])
        inside, older = seen[:take], seen[take:]
        # the n-th newest row of the batches inside is not older than ``least``
        total, least = 0, None
        for b in sorted((b for b in inside if b["rows"]), key=lambda b: b["lo"], reverse=True):
            total, least = total + b["rows"], b["lo"]
            if total >= n:
                break
        if not older or (total >= n and (older[0]["mark"] is None or older[0]["mark"] < least)):
            break
        take *= 2
    needed = [b["batch"] for b in inside if b["rows"] and (total < n or b["hi"] >= least)] or [inside[0]["batch"]]
    rows = spark.read.option("basePath", sink_dir).parquet(*[f"{sink_dir}/batch={i}" for i in needed])
    return rows.orderBy(F.desc("scored_at"), F.desc("request_id")).limit(n)
