"""Queries over what a deployment keeps: artifact versions, scored streams and their
history, fitted-model scores, cost scenarios and the city table. Registered like those of
``registry``, which imports this module at its end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import geo as GEO
from riskloom.operators import impact as IM
from riskloom.operators import models as M
from riskloom.operators import rules as RU
from riskloom.plans import fixture_sql as S
from riskloom.plans import registry as R
from riskloom.schema import CITIES, IMPACT_COST_FP
from riskloom.session import shared_path
from riskloom.sources import artifacts as ART
from riskloom.sources.requests import read_requests, requests_from_transactions
from riskloom.sources.transactions import fixture_cities, surrogate_predictions, surrogate_score
from riskloom.streaming import scoring as ST

# ── S2, S3, S8: two versions of an artifact ──────────────────────────────────

_VERSION_SQL = """SELECT {v}::BIGINT AS version, {newest} AS newest, threshold,
  count_if(label = 1 AND p >= threshold) AS tp, count_if(label = 0 AND p >= threshold) AS fp,
  count_if(label = 0 AND p < threshold) AS tn, count_if(label = 1 AND p < threshold) AS fn
FROM {src}, grid GROUP BY threshold"""


@R.register("artifact_roundtrip", R._ev_sql(
    _VERSION_SQL.format(v=1, newest="FALSE", src="pr") + " UNION ALL "
    + _VERSION_SQL.format(v=2, newest="TRUE", src="(SELECT * FROM pr WHERE Transaction_ID IN "
                          "(SELECT Transaction_ID FROM tx WHERE Is_International_Transaction = 'Yes')) i"), R._GRID))
def q_artifact_roundtrip(spark, sf_dir):
    """Threshold sweeps saved as two versions: the newest is what a reader gets, the first stays."""
    t = R.tx(spark, sf_dir)
    path = shared_path(spark, "artifact")
    for rows in (t, t.where(F.col("Is_International_Transaction") == "Yes")):
        ART.write_version(spark, path, {"threshold sweep": EV.threshold_sweep(surrogate_predictions(rows))})
    first, newest = ART.load_version(spark, path, 1), ART.load_version(spark, path)
    log = ART.versions(spark, path).select("version", "newest")
    parts = [v["tables"]["threshold sweep"].select(F.lit(v["version"]).cast("long").alias("version"), "threshold", "tp",
                                                   "fp", "tn", "fn") for v in (first, newest)]
    return parts[0].unionByName(parts[1]).join(F.broadcast(log), "version")      # a row per version


# ── R13: the newest scored requests ──────────────────────────────────────────

@R.register("scored_history", R._ev_sql(
    """SELECT Transaction_ID, p, risk_score, tier FROM scored s
JOIN (SELECT Transaction_ID AS i, CAST(Transaction_Date AS TIMESTAMP)
        + to_minutes(CAST((Transaction_ID * 37) % 1440 AS INTEGER)) AS scored_at FROM tx) d ON d.i = Transaction_ID
ORDER BY scored_at DESC, CAST(Transaction_ID AS VARCHAR) DESC LIMIT 50""", *R._SCORE_CTES))
def q_scored_history(spark, sf_dir):
    """The last 50 of the scored requests, kept as one batch a year (the scoring time is that
    of the transaction, a test input)."""
    t = R.txh(spark, sf_dir)
    thr = R.serving_threshold(surrogate_predictions(R.tx(spark, sf_dir)))
    at = F.col("Transaction_Date").cast("timestamp") + F.make_dt_interval(
        mins=((F.col("Transaction_ID") * 37) % 1440).cast("int"))
    scored = RU.score(requests_from_transactions(surrogate_score(t).withColumn("scored_at", at),
                                                 keep=("p", "scored_at")), thr)
    scored = R.reliable_checkpoint(scored.select("Transaction_ID", "request_id", "p", "risk_score", "tier", "scored_at"))
    year = F.year("scored_at")
    first, last = scored.agg(F.min(year), F.max(year)).first()
    sink = shared_path(spark, "history")
    for i, y in enumerate(range(first, last + 1) if first else []):
        ST.write_scored(scored.where(year == y), sink, i)
    return ST.history(spark, sink, 50).select("Transaction_ID", "p", "risk_score", "tier")


# ── R12: repeated requests ───────────────────────────────────────────────────

_REJECTED_SQL = f"SELECT Transaction_ID FROM ({R._validation_sql()}) e"


@R.register("stream_repeats", S.with_ctes("SELECT Transaction_ID, 1::BIGINT AS times, "
                                          "Transaction_ID NOT IN (SELECT Transaction_ID FROM bad) AS accepted FROM tx",
                                          ("bad", f"SELECT * FROM ({_REJECTED_SQL}) b")))
def q_stream_repeats(spark, sf_dir):
    """All requests sent, the stream restarted, and all sent again: each is scored or rejected once."""
    cities = fixture_cities(spark, sf_dir)
    thr = R.serving_threshold(surrogate_predictions(R.tx(spark, sf_dir)))
    src, sink, bad = (shared_path(spark, n) for n in ("repeats", "repeats-scored", "repeats-bad"))
    requests = requests_from_transactions(R.txh(spark, sf_dir)).drop("Transaction_ID")
    for again in (False, True):
        if again:
            # the same lines once more, not the transactions' history
            spark.read.text(src).write.mode("append").option("compression", "gzip").text(src)
        else:
            requests.write.option("compression", "gzip").json(src)
        queries, _, _ = ST.start_scoring_stream(
            spark, src, cities, R.surrogate_probability, thr, sink_dir=sink, quarantine_dir=bad,
            merchant_cats=R.FIXTURE_MERCHANTS, repeat_window="1 hour")
        for q in queries:
            q.awaitTermination()
    both = (spark.read.parquet(sink).select("request_id", F.lit(True).alias("accepted"))
            .unionByName(spark.read.parquet(bad).select("request_id", F.lit(False).alias("accepted"))))
    return (both.groupBy(F.col("request_id").cast("long").alias("Transaction_ID"), "accepted")
            .agg(F.count(F.lit(1)).alias("times")))


# ── R1: a fitted model's scores ──────────────────────────────────────────────

@R.register("model_scores", S.with_ctes(
    "SELECT Transaction_ID, TRUE AS p_in_range, TRUE AS stream_equals_batch FROM tx "
    "WHERE Transaction_ID NOT IN (SELECT Transaction_ID FROM bad)", ("bad", f"SELECT * FROM ({_REJECTED_SQL}) b")))
def q_model_scores(spark, sf_dir):
    """The published logistic candidate, fitted and then serving every accepted request, as a
    batch and as a stream."""
    t = R.txh_stored(spark, sf_dir)
    fitted = M.train_all(t, M.TrainConfig(models=(M.LR,), cv_folds=0))
    fn = M.model_probability(fitted.prep, fitted.models[M.LR])
    cities = fixture_cities(spark, sf_dir)
    src = shared_path(spark, "model-requests")
    requests_from_transactions(t).drop("Transaction_ID").write.json(src)
    queries, sink, _ = ST.start_scoring_stream(spark, src, cities, fn, 0.35, merchant_cats=R.FIXTURE_MERCHANTS)
    batch, _ = ST.scoring_plan(read_requests(spark, src), cities, fn, 0.35, merchant_cats=R.FIXTURE_MERCHANTS)
    batch = batch.select("request_id", "p", "risk_score", "tier")
    for q in queries:
        q.awaitTermination()
    stream = spark.read.parquet(sink).select("request_id", F.struct("p", "risk_score", "tier").alias("s"))
    return batch.join(stream, "request_id", "full").select(
        F.col("request_id").cast("long").alias("Transaction_ID"),
        F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("p_in_range"),
        F.struct("p", "risk_score", "tier").eqNullSafe(F.col("s")).alias("stream_equals_batch"))


# ── G1-G3 on the 59 cities ───────────────────────────────────────────────────

_NAMES = [c[0] for c in CITIES] + ["Atlantis"]
_NAMES_SQL = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in _NAMES) + "]"
_CITY_VALUES = ", ".join("('{}', '{}', {!r}::DOUBLE, {!r}::DOUBLE)".format(
    c.replace("'", "''"), k.replace("'", "''"), float(a), float(b)) for c, k, a, b in CITIES)


@R.register("city_table_distance", S.with_ctes(f"""
SELECT Transaction_ID, home, loc, home_country, tx_country,
  CAST(floor(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) + 0.5) AS BIGINT) AS distance_km,
  home_country <> tx_country AS cross_border
FROM (SELECT Transaction_ID, home, loc, h.country AS home_country, l.country AS tx_country,
        pow(sin((l.lat - h.lat) * (pi() / 180) / 2), 2)
        + cos(h.lat * (pi() / 180)) * cos(l.lat * (pi() / 180)) * pow(sin((l.lon - h.lon) * (pi() / 180) / 2), 2) AS a
      FROM (SELECT Transaction_ID, {_NAMES_SQL}[1 + (Customer_ID * 7) % {len(_NAMES)}] AS home,
              {_NAMES_SQL}[1 + (Transaction_ID * 13) % {len(_NAMES)}] AS loc FROM tx) t
      LEFT JOIN c59 h ON home = h.city LEFT JOIN c59 l ON loc = l.city) x""",
    ("c59", f"SELECT * FROM (VALUES {_CITY_VALUES}) v(city, country, lat, lon)")))
def q_city_table_distance(spark, sf_dir):
    """Distances and border crossings between the supported cities; every transaction is moved to
    a pair of them by its ids (a test input), one of the names being unknown."""
    names = F.array(*[F.lit(n) for n in _NAMES])

    def pick(c, k):
        return F.element_at(names, (1 + (F.col(c) * k) % len(_NAMES)).cast("int"))
    t = R.tx(spark, sf_dir).select("Transaction_ID", pick("Customer_ID", 7).alias("home"),
                                   pick("Transaction_ID", 13).alias("loc"))
    return GEO.with_geo(t, GEO.city_dimension(spark), "home", "loc")


# ── B1, B3: cost scenarios ───────────────────────────────────────────────────

_SCENARIO_COSTS = ("total", "missed", "false_alerts", "savings")


@R.register("impact_scenarios", R._ev_sql(
    "SELECT scenario, model, threshold, " + ", ".join(f"round({c}, 4) AS {c}" for c in _SCENARIO_COSTS)
    + " FROM best", *R._SWEEP_CTES,
    ("scen", f"""SELECT Customer_Home_Location AS scenario, avg(CASE WHEN {R._FRAUD} THEN Transaction_Amount END) AS cfn,
        {IMPACT_COST_FP!r}::DOUBLE AS cfp, CAST(count(*) AS DOUBLE) AS monthly FROM tx GROUP BY 1"""),
    ("cost", """SELECT scenario, model, threshold, (fn * cfn + fp * cfp) * f AS total, fn * cfn * f AS missed,
        fp * cfp * f AS false_alerts, (tp + fn) * cfn * f - (fn * cfn + fp * cfp) * f AS savings
      FROM sweep, (SELECT *, monthly / (SELECT count(*) FROM pr) AS f FROM scen) s"""),
    ("best", "SELECT DISTINCT ON (scenario, model) * FROM cost ORDER BY scenario, model, coalesce(total, 0) ,"
             " threshold DESC")))
def q_impact_scenarios(spark, sf_dir):
    """The cheapest threshold under each home location's own mean fraud amount and volume."""
    t = R.tx(spark, sf_dir)
    pr = surrogate_predictions(t)
    scenarios = t.groupBy(F.col("Customer_Home_Location").alias("scenario")).agg(
        F.avg(F.when(F.col("Fraud_Label") == "Fraud", F.col("Transaction_Amount"))).alias("cost_fn"),
        F.lit(IMPACT_COST_FP).alias("cost_fp"), F.count(F.lit(1)).cast("double").alias("monthly"))
    best = IM.cheapest_thresholds(EV.threshold_sweep(pr), scenarios, pr.count())
    return best.select("scenario", "model", "threshold", *[F.round(c, 4).alias(c) for c in _SCENARIO_COSTS])
