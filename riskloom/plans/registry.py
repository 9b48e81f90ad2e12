"""Query registry: every named query as a Spark plan plus its DuckDB oracle.

Each Spark query takes (spark, sf_dir) and returns a DataFrame over the driver
tables; building it may run jobs (reliable checkpoints, fits, small aggregates).
The oracle is ANSI SQL over the same tables. Queries that have no SQL equivalent
(model fitting, tree explanations) have no oracle entry and are checked by row
count and by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import profile as A
from riskloom.plans import fixture_sql as S
from riskloom.session import reliable_checkpoint, shared_path
from riskloom.sources.transactions import fixture_transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's count_if is bigint: cast each call."""
    out, i, token = [], 0, "count_if("
    while (j := sql.find(token, i)) >= 0:
        depth, k = 0, j + len(token) - 1
        while True:                                   # the matching close parenthesis
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(f"{sql[i:j]}CAST({sql[j:k + 1]} AS BIGINT)")
        i = k + 1
    return "".join(out) + sql[i:]


def _positive_zero_round(sql: str) -> str:
    """DuckDB's round keeps the sign of a tiny negative (-0.0); Spark's round gives
    +0.0: add 0.0 to each round() result (only -0.0 changes)."""
    out, i, token = [], 0, "round("
    while (j := sql.find(token, i)) >= 0:
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(token)])
            i = j + len(token)
            continue
        depth, k = 0, j + len(token) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(f"{sql[i:j]}({sql[j:k + 1]} + 0.0)")
        i = k + 1
    return "".join(out) + sql[i:]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _positive_zero_round(_bigint_count_if(sql))
        return fn
    return deco


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction view without the two per-customer history columns."""
    return fixture_transactions(spark, sf_dir, history=False)


def txh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction view with Avg_Transaction_Amount and Max_Transaction_Last_24h."""
    return fixture_transactions(spark, sf_dir, history=True)


def txh_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txh`` as Parquet in the shared folder, for queries that read it in several passes
    (the history columns of the test view take an exchange of all rows)."""
    path = shared_path(spark, "transactions")
    txh(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


_FRAUD = "Fraud_Label = 'Fraud'"
_RATE_COLS = (f"count(Fraud_Label) AS total, count_if({_FRAUD}) AS fraud, "
              f"round(CAST(count_if({_FRAUD}) AS DOUBLE) / count(Fraud_Label), 6) AS fraud_rate")


def _rate_sql(key_expr: str, name: str, cols: str = "*", src: str = "mf") -> str:
    inner = (f"SELECT {key_expr} AS {name}, {_RATE_COLS} FROM {src} "
             f"WHERE {key_expr} IS NOT NULL GROUP BY 1")
    return S.with_ctes(f"SELECT {cols} FROM ({inner}) r", ("mf", S.MF_SQL))


# ── profiling ────────────────────────────────────────────────────────────────

@register("overview", S.with_ctes(f"""
SELECT count(*) AS total_transactions, count_if({_FRAUD}) AS total_fraud,
  round(avg(CASE WHEN {_FRAUD} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fraud_rate,
  round(sum(Transaction_Amount), 2) AS total_amount,
  round(avg(CASE WHEN {_FRAUD} THEN Transaction_Amount END), 4) AS avg_fraud_amount
FROM tx"""))
def q_overview(spark, sf_dir):
    return A.overview(tx(spark, sf_dir))


for _name, _col in A.RATE_KEYS.items():
    def _make(col):
        def q(spark, sf_dir):
            return A.rate_by_filled(tx(spark, sf_dir), col)
        return q
    register(f"rate_by_{_name}", _rate_sql(_col, _col))(_make(_col))


@register("rate_by_prev_fraud",
          _rate_sql("CAST(coalesce(Previous_Fraud_Count, 0) AS INTEGER)", "Previous_Fraud_Count"))
def q_rate_by_prev_fraud(spark, sf_dir):
    return A.rate_by_prev_fraud(tx(spark, sf_dir))   # the fill touches categoricals only


_HOUR_SQL = "CAST(hour(try_strptime(Transaction_Time, '%H:%M')) AS INTEGER)"


@register("rate_by_hour", _rate_sql(_HOUR_SQL, "Hour", "Hour, fraud_rate"))
def q_rate_by_hour(spark, sf_dir):
    return A.rate_by_hour(tx(spark, sf_dir))


_COMBO_SQL = "concat(Is_International_Transaction, ' Intl / ', Is_New_Merchant, ' New')"


@register("rate_by_combo", _rate_sql(_COMBO_SQL, "Combo", "Combo, fraud_rate"))
def q_rate_by_combo(spark, sf_dir):
    return A.rate_by_combo_filled(tx(spark, sf_dir))


@register("rates_grouping_sets", S.with_ctes(" UNION ALL ".join(
    f"SELECT '{n}' AS dimension, CAST({c} AS VARCHAR) AS value, {_RATE_COLS} "
    f"FROM mf WHERE {c} IS NOT NULL GROUP BY {c}" for n, c in A.RATE_KEYS.items()),
    ("mf", S.MF_SQL)))
def q_rates_grouping_sets(spark, sf_dir):
    return A.rates_grouping_sets(tx(spark, sf_dir))


@register("mode_fill", S.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing, "
    f"CASE WHEN count_if({c} IS NULL) > 0 THEN {S.mode_sql(c)} END AS fill_value FROM tx"
    for c in S.PROFILE_CATEGORICALS)))
def q_mode_fill(spark, sf_dir):
    return A.mode_fill_table(tx(spark, sf_dir))


def _corr_sql() -> str:
    from riskloom.schema import CORRELATION_COLUMNS as cols
    rows = []
    for a in cols:
        for b in cols:
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            rows.append(
                f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({x}, {y}) / nullif("
                f"stddev_pop(CASE WHEN {both} THEN {x} END) * "
                f"stddev_pop(CASE WHEN {both} THEN {y} END), 0), 3) AS corr FROM tx")
    return S.with_ctes(" UNION ALL ".join(rows))


@register("correlation", _corr_sql())
def q_correlation(spark, sf_dir):
    return A.correlation(tx(spark, sf_dir))


_W = "(100000.0::DOUBLE / 21)"
_X = "least(greatest(Transaction_Amount, 0.0::DOUBLE), 100000.0::DOUBLE)"
_HIST_SQL = S.with_ctes(f"""
SELECT g.class, g.bin, (g.lo + g.hi) / 2 AS bin_center, coalesce(c.cnt, 0) AS count,
       CAST(coalesce(c.cnt, 0) AS DOUBLE) / (g.hi - g.lo) / n.n AS density
FROM g JOIN n ON g.class = n.class
LEFT JOIN (SELECT class, bin, count(*) AS cnt FROM b2 GROUP BY ALL) c
  ON g.class = c.class AND g.bin = c.bin""",
    ("b0", f"""SELECT CASE WHEN {_FRAUD} THEN 'fraud' ELSE 'normal' END AS class, {_X} AS x,
                CAST(least(floor({_X} / {_W}), 20) AS INTEGER) AS b FROM tx
                WHERE Transaction_Amount IS NOT NULL"""),
    ("b1", f"SELECT class, x, CASE WHEN b * {_W} > x THEN b - 1 ELSE b END AS b FROM b0"),
    ("b2", f"""SELECT class, CASE WHEN b < 20 AND (b + 1) * {_W} <= x THEN b + 1 ELSE b END AS bin
               FROM b1"""),
    ("n", "SELECT class, count(*) AS n FROM b2 GROUP BY class"),
    ("g", f"""SELECT class, CAST(i AS INTEGER) AS bin, i * {_W} AS lo,
                CASE WHEN i = 20 THEN 100000.0::DOUBLE ELSE (i + 1) * {_W} END AS hi
              FROM n, range(21) t(i)"""))


@register("amount_histogram", _HIST_SQL)
def q_amount_histogram(spark, sf_dir):
    return A.amount_histogram(tx(spark, sf_dir))


_DIST_SQL = S.with_ctes("""
SELECT CASE WHEN Fraud_Label = 'Fraud' THEN 'fraud' ELSE 'normal' END AS class,
  round(quantile_cont(Distance_From_Home, 0.5), 6) AS median_distance,
  round(quantile_cont(Distance_From_Home, 0.75), 6) AS p75_distance
FROM tx GROUP BY 1""")


def _distance_percentiles(spark, sf_dir):
    q = A.distance_percentiles(tx(spark, sf_dir))
    return q.select("class", F.round("median_distance", 6).alias("median_distance"),
                    F.round("p75_distance", 6).alias("p75_distance"))


register("distance_percentiles", _DIST_SQL)(_distance_percentiles)


@register("top_combo", _rate_sql(_COMBO_SQL, "Combo", "Combo, fraud_rate")
          + " ORDER BY fraud_rate DESC, Combo LIMIT 1")
def q_top_combo(spark, sf_dir):
    return A.top_combo(A.rate_by_combo_filled(tx(spark, sf_dir)))


_HOURS = f"""SELECT {_HOUR_SQL} AS Hour,
  round(CAST(count_if({_FRAUD}) AS DOUBLE) / count(Fraud_Label), 6) AS fraud_rate
  FROM mf WHERE {_HOUR_SQL} IS NOT NULL GROUP BY 1"""


@register("hour_insight", S.with_ctes("""
SELECT p.Hour AS peak_hour, p.fraud_rate AS peak_rate, round(a.night_avg, 6) AS night_avg,
  round(a.day_avg, 6) AS day_avg,
  round(CASE WHEN a.day_avg > 0 THEN (a.night_avg / a.day_avg - 1) * 100 ELSE 0.0 END, 4)
    AS night_premium_pct
FROM (SELECT * FROM hr ORDER BY fraud_rate DESC, Hour LIMIT 1) p,
 (SELECT coalesce(avg(CASE WHEN Hour >= 22 OR Hour <= 5 THEN fraud_rate END), 0.0) AS night_avg,
         coalesce(avg(CASE WHEN Hour BETWEEN 6 AND 21 THEN fraud_rate END), 0.0) AS day_avg
  FROM hr) a""", ("mf", S.MF_SQL), ("hr", _HOURS)))
def q_hour_insight(spark, sf_dir):
    return A.hour_insight(A.rate_by_hour(tx(spark, sf_dir)))


@register("distance_gap", S.with_ctes("""
SELECT f.m AS fraud_median, nm.m AS normal_median,
  CASE WHEN nm.m > 0 THEN round(f.m / nm.m, 6) END AS ratio
FROM (SELECT quantile_cont(Distance_From_Home, 0.5) AS m FROM tx WHERE Fraud_Label = 'Fraud') f,
     (SELECT quantile_cont(Distance_From_Home, 0.5) AS m FROM tx
      WHERE Fraud_Label IS DISTINCT FROM 'Fraud') nm"""))
def q_distance_gap(spark, sf_dir):
    return A.distance_gap(A.distance_percentiles(tx(spark, sf_dir)))


@register("top_locations", _rate_sql("Transaction_Location", "Transaction_Location")
          + " ORDER BY fraud_rate DESC, Transaction_Location DESC LIMIT 15")
def q_top_locations(spark, sf_dir):
    return A.top_locations(A.rate_by_filled(tx(spark, sf_dir), "Transaction_Location"))


# ── features, encoding, imputation ───────────────────────────────────────────

from riskloom.operators import encode as EN  # noqa: E402
from riskloom.operators import features as FT  # noqa: E402
from riskloom.operators import train as TR  # noqa: E402
from riskloom.plans.features_sql import FEATURE_CTES  # noqa: E402
from riskloom.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES  # noqa: E402


def _r6(c: str, doubles=FT.DOUBLE_FEATURES):
    return F.round(F.col(c), 6).alias(c) if c in doubles else F.col(c)


def _r6_sql(c: str, doubles=FT.DOUBLE_FEATURES) -> str:
    return f"round({c}, 6) AS {c}" if c in doubles else c


def _feature_query(cols):
    def q(spark, sf_dir):
        fe = FT.engineer_features(txh(spark, sf_dir))
        return fe.select("Transaction_ID", *[_r6(c) for c in cols])
    return q


for _name, _cols in (("features_temporal", FT.TEMPORAL), ("features_ratio", FT.RATIOS),
                     ("features_flags", FT.FLAGS), ("features_interaction", FT.INTERACTIONS)):
    register(_name, S.with_ctes(
        f"SELECT Transaction_ID, {', '.join(_r6_sql(c) for c in _cols)} FROM fe",
        *FEATURE_CTES))(_feature_query(_cols))


_CODES_SQL = ("SELECT \"column\", value, CAST(row_number() OVER (PARTITION BY \"column\" "
              "ORDER BY value) - 1 AS INTEGER) AS code FROM (" + " UNION ".join(
                  f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'Unknown') AS value "
                  f"FROM tx UNION SELECT '{c}', 'Unknown'" for c in CATEGORICAL_FEATURES) + ") u")


@register("category_codes", S.with_ctes(_CODES_SQL))
def q_category_codes(spark, sf_dir):
    return EN.fit_category_codes(tx(spark, sf_dir))


@register("encoded_categories", S.with_ctes(
    "SELECT Transaction_ID, " + ", ".join(
        f"(SELECT code FROM codes WHERE \"column\" = '{c}' AND value = "
        f"coalesce(CAST(tx.{c} AS VARCHAR), 'Unknown')) AS {c}" for c in CATEGORICAL_FEATURES)
    + " FROM tx", ("codes", _CODES_SQL)))
def q_encoded_categories(spark, sf_dir):
    t = tx(spark, sf_dir)
    codes = EN.stored_codes(EN.fit_category_codes(t))
    return EN.apply_category_codes(t.select("Transaction_ID", *CATEGORICAL_FEATURES), codes, CATEGORICAL_FEATURES)


@register("imputed_medians", S.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM fe"
    for c in NUMERIC_FEATURES), *FEATURE_CTES))
def q_imputed_medians(spark, sf_dir):
    m = EN.fit_medians(FT.feature_frame(txh(spark, sf_dir)), NUMERIC_FEATURES)
    return m.select("feature", F.round("median", 6).alias("median"))


@register("class_weights", S.with_ctes("""
SELECT label, count(*) AS n,
  round(CAST(sum(count(*)) OVER () AS DOUBLE) / (2 * count(*)), 6) AS weight
FROM (SELECT CASE WHEN Fraud_Label = 'Fraud' THEN 1 ELSE 0 END AS label FROM tx) t
GROUP BY label"""))
def q_class_weights(spark, sf_dir):
    w = TR.class_weights(tx(spark, sf_dir).select(EN.label().alias("label")))
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


# ── evaluation on the surrogate score ────────────────────────────────────────

from riskloom.operators import evaluate as EV  # noqa: E402
from riskloom.schema import THRESHOLD_GRID  # noqa: E402
from riskloom.sources.transactions import surrogate_predictions  # noqa: E402


def preds(spark, sf_dir):
    return surrogate_predictions(tx(spark, sf_dir))


_PR = ("pr", "SELECT 'surrogate' AS model, Transaction_ID, label, p FROM sc")
_SC = ("sc", S.SC_SQL)


def _ev_sql(body: str, *ctes) -> str:
    return S.with_ctes(body, _SC, _PR, *ctes)


_GRID_VALUES = ", ".join(f"({t!r}::DOUBLE)" for t in THRESHOLD_GRID)
_RAW_VALUES = ", ".join(f"({t!r}::DOUBLE)" for t in EV.RAW_GRID)
_GRID = ("grid", f"SELECT * FROM (VALUES {_GRID_VALUES}) v(threshold)")
_COUNTS_SQL = """SELECT model, threshold, count_if(label = 1 AND p >= threshold) AS tp,
   count_if(label = 0 AND p >= threshold) AS fp, count_if(label = 0 AND p < threshold) AS tn,
   count_if(label = 1 AND p < threshold) AS fn FROM pr, {g} GROUP BY model, threshold"""
_F1_SQL = "CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END"
_SWEEP_SQL = f"""SELECT model, threshold, tp, fp, tn, fn,
   round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 4) AS precision,
   round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 4) AS recall,
   round({_F1_SQL}, 4) AS f1 FROM counts"""
_SWEEP_CTES = (_GRID, ("counts", _COUNTS_SQL.format(g="grid")), ("sweep", _SWEEP_SQL))
_OPT_SQL = f"""SELECT a.model, a.optimal_f1_threshold, c.optimal_cost_threshold, r.opt_thresh_raw,
   round(r.opt_thresh_raw, 2) AS opt_thresh
 FROM (SELECT DISTINCT ON (model) model, threshold AS optimal_f1_threshold FROM sweep
       ORDER BY model, f1 DESC, threshold) a
 JOIN (SELECT DISTINCT ON (model) model, threshold AS optimal_cost_threshold FROM sweep
       ORDER BY model, 5.0::DOUBLE * fn + 0.1::DOUBLE * fp, threshold) c USING (model)
 JOIN (SELECT DISTINCT ON (model) model, threshold AS opt_thresh_raw FROM rawcounts
       ORDER BY model, {_F1_SQL} DESC, threshold) r USING (model)"""
_OPT_CTES = (*_SWEEP_CTES, ("rawgrid", f"SELECT * FROM (VALUES {_RAW_VALUES}) v(threshold)"),
             ("rawcounts", _COUNTS_SQL.format(g="rawgrid")), ("optima", _OPT_SQL))


@register("confusion", _ev_sql("""
SELECT model, '0.5' AS at, 0.5::DOUBLE AS threshold,
  count_if(label = 1 AND p >= 0.5) AS tp, count_if(label = 0 AND p >= 0.5) AS fp,
  count_if(label = 1 AND p < 0.5) AS fn, count_if(label = 0 AND p < 0.5) AS tn
FROM pr GROUP BY model
UNION ALL
SELECT pr.model, 'optimal', o.opt_thresh,
  count_if(label = 1 AND p >= o.opt_thresh_raw), count_if(label = 0 AND p >= o.opt_thresh_raw),
  count_if(label = 1 AND p < o.opt_thresh_raw), count_if(label = 0 AND p < o.opt_thresh_raw)
FROM pr JOIN optima o USING (model) GROUP BY pr.model, o.opt_thresh""", *_OPT_CTES))
def q_confusion(spark, sf_dir):
    return EV.confusions(preds(spark, sf_dir))


def _z(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


_P0, _R0, _F0 = _z("tn", "tn + fn"), _z("tn", "tn + fp"), _z("2 * tn", "2 * tn + fn + fp")
_P1, _R1, _F1 = _z("tp", "tp + fp"), _z("tp", "tp + fn"), _z("2 * tp", "2 * tp + fp + fn")
_W0, _W1 = _z("tn + fp", "n"), _z("tp + fn", "n")
_REPORT_SQL = _ev_sql(f"""
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM (
 SELECT model, '0' AS class, {_P0} AS precision, {_R0} AS recall, {_F0} AS f1, tn + fp AS support FROM c
 UNION ALL SELECT model, '1', {_P1}, {_R1}, {_F1}, tp + fn FROM c
 UNION ALL SELECT model, 'accuracy', NULL, NULL, {_z("tp + tn", "n")}, n FROM c
 UNION ALL SELECT model, 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2, n FROM c
 UNION ALL SELECT model, 'weighted avg', {_P0} * {_W0} + {_P1} * {_W1}, {_R0} * {_W0} + {_R1} * {_W1},
        {_F0} * {_W0} + {_F1} * {_W1}, n FROM c) r""", ("c", """SELECT model, count_if(label = 1 AND p >= 0.5) AS tp,
  count_if(label = 0 AND p >= 0.5) AS fp, count_if(label = 1 AND p < 0.5) AS fn,
  count_if(label = 0 AND p < 0.5) AS tn, count(*) AS n FROM pr GROUP BY model"""))


@register("class_report", _REPORT_SQL)
def q_class_report(spark, sf_dir):
    return EV.class_report(EV.confusion(preds(spark, sf_dir), 0.5))


_STEPS = ("steps", """SELECT model, p, sum(label) AS pos, count(*) - sum(label) AS neg,
  sum(sum(label)) OVER w AS cum_pos, sum(count(*) - sum(label)) OVER w AS cum_neg,
  row_number() OVER w AS cum_one,
  lead(sum(label)) OVER w AS next_pos, lead(count(*) - sum(label)) OVER w AS next_neg
  FROM pr GROUP BY model, p
  WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_RANK_SQL = _ev_sql("""SELECT model,
  CAST(2 * sum(neg) * sum(pos) - sum(pos * (2 * cum_neg - neg)) AS DOUBLE)
    / CAST(2 * sum(neg) * sum(pos) AS DOUBLE) AS roc_auc,
  sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / CAST(sum(pos) AS DOUBLE) AS average_precision
FROM steps GROUP BY model""", _STEPS)


@register("roc_auc", f"SELECT model, round(roc_auc, 10) AS roc_auc FROM ({_RANK_SQL})")
def q_roc_auc(spark, sf_dir):
    m = EV.rank_metrics(EV.score_steps(preds(spark, sf_dir)))
    return m.select("model", F.round("roc_auc", 10).alias("roc_auc"))


@register("average_precision",
          f"SELECT model, round(average_precision, 10) AS average_precision FROM ({_RANK_SQL})")
def q_average_precision(spark, sf_dir):
    m = EV.rank_metrics(EV.score_steps(preds(spark, sf_dir)))
    return m.select("model", F.round("average_precision", 10).alias("average_precision"))


@register("brier", _ev_sql(
    "SELECT model, round(avg(power(p - label, 2)), 4) AS brier FROM pr GROUP BY model"))
def q_brier(spark, sf_dir):
    return EV.brier(preds(spark, sf_dir))


def _targets_sql(src: str) -> str:
    return (f"SELECT DISTINCT model, CAST(round_even(i * CASE WHEN least(n, 200) > 1 THEN "
            f"CAST(n - 1 AS DOUBLE) / (least(n, 200) - 1) ELSE 0.0 END, 0) AS BIGINT) AS idx "
            f"FROM {src}, range(200) r(i) WHERE i < least(n, 200)")


_ROC_SQL = _ev_sql(
    "SELECT curve.* FROM curve JOIN tg USING (model, idx)", _STEPS,
    ("kept", "SELECT * FROM steps WHERE cum_one = 1 OR next_pos IS NULL OR next_pos <> pos "
             "OR next_neg <> neg"),
    ("tot", "SELECT model, sum(pos) AS n_pos, sum(neg) AS n_neg FROM steps GROUP BY model"),
    ("curve", """SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY p DESC) AS BIGINT) AS idx,
        round(CAST(cum_neg AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(cum_pos AS DOUBLE) / n_pos, 6) AS tpr,
        p AS threshold FROM kept JOIN tot USING (model)
      UNION ALL SELECT model, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM tot"""),
    ("lens", "SELECT model, count(*) AS n FROM curve GROUP BY model"),
    ("tg", _targets_sql("lens")))


@register("roc_curve", _ROC_SQL)
def q_roc_curve(spark, sf_dir):
    return EV.roc_curve(EV.score_steps(preds(spark, sf_dir)))


_PRC_SQL = _ev_sql(
    "SELECT curve.* FROM curve JOIN tg USING (model, idx)", _STEPS,
    ("tot", "SELECT model, sum(pos) AS n_pos, count(*) AS m FROM steps GROUP BY model"),
    ("curve", """SELECT model, CAST(m - cum_one AS BIGINT) AS idx,
        round(CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg), 6) AS precision,
        round(CASE WHEN n_pos = 0 THEN 1.0 ELSE CAST(cum_pos AS DOUBLE) / n_pos END, 6) AS recall,
        p AS threshold FROM steps JOIN tot USING (model)
      UNION ALL SELECT model, CAST(m AS BIGINT), 1.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM tot"""),
    ("lens", "SELECT model, m + 1 AS n FROM tot"),
    ("tg", _targets_sql("lens")))


@register("pr_curve", _PRC_SQL)
def q_pr_curve(spark, sf_dir):
    return EV.pr_curve(EV.score_steps(preds(spark, sf_dir)))


@register("threshold_sweep", _ev_sql("SELECT * FROM sweep", *_SWEEP_CTES))
def q_threshold_sweep(spark, sf_dir):
    return EV.threshold_sweep(preds(spark, sf_dir))


@register("threshold_optima", _ev_sql("SELECT * FROM optima", *_OPT_CTES))
def q_threshold_optima(spark, sf_dir):
    return EV.threshold_optima(preds(spark, sf_dir))


@register("nearest_threshold", _ev_sql(
    "SELECT DISTINCT ON (model) * FROM sweep ORDER BY model, abs(threshold - 0.4::DOUBLE), threshold",
    *_SWEEP_CTES))
def q_nearest_threshold(spark, sf_dir):
    return EV.nearest_threshold(EV.threshold_sweep(preds(spark, sf_dir)), 0.40)


_CAL_BIN = " + ".join(f"CAST(p > {e!r}::DOUBLE AS INTEGER)" for e in EV.CALIBRATION_EDGES)


@register("calibration", _ev_sql(f"""
SELECT model, {_CAL_BIN} AS bin, count(*) AS count, round(avg(p), 6) AS prob_pred,
  round(avg(CAST(label AS DOUBLE)), 6) AS prob_true FROM pr GROUP BY ALL"""))
def q_calibration(spark, sf_dir):
    return EV.calibration(preds(spark, sf_dir))


# ── scoring and rule engine on the surrogate score ───────────────────────────

from riskloom.functions.numbers import py_round, py_round_sql  # noqa: E402
from riskloom.operators import rules as RU  # noqa: E402
from riskloom.sources.requests import requests_from_transactions  # noqa: E402
from riskloom.sources.transactions import surrogate_score  # noqa: E402


def serving_threshold(pr: DataFrame) -> float:
    """Floored F1-optimal threshold of the (single-model) predictions."""
    return EV.threshold_optima(pr).select(EV.floored(F.col("optimal_f1_threshold")).alias("t")).first()["t"]


def scored(spark, sf_dir):
    t = txh(spark, sf_dir)
    thr = serving_threshold(surrogate_predictions(tx(spark, sf_dir)))   # needs no history
    return RU.score(requests_from_transactions(surrogate_score(t), keep=("p",)), thr)


_REQ_SQL = """SELECT tx.Transaction_ID, Transaction_Amount AS amount, Account_Balance AS balance,
  Distance_From_Home AS distance, Transaction_Time AS tx_time, Transaction_Type AS tx_type,
  Merchant_Category AS merchant_cat, Card_Type AS card_type, Transaction_Location AS tx_location,
  Customer_Home_Location AS home_loc, Daily_Transaction_Count AS daily_tx,
  Weekly_Transaction_Count AS weekly_tx, Avg_Transaction_Amount AS avg_amount,
  Max_Transaction_Last_24h AS max_24h, Failed_Transaction_Count AS failed,
  Previous_Fraud_Count AS prev_fraud, Is_International_Transaction AS is_intl,
  Is_New_Merchant AS is_new, Unusual_Time_Transaction AS unusual"""
_RANK = "(CASE {x} WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END)"
_UNRANK = "(CASE WHEN {x} >= 2 THEN 'HIGH' WHEN {x} = 1 THEN 'MEDIUM' ELSE 'LOW' END)"


def _b(cond: str, default: str = "false") -> str:
    return f"coalesce({cond}, {default})"


_POINTS = " + ".join(f"(CASE WHEN {c} THEN {v!r}::DOUBLE ELSE 0.0::DOUBLE END)" for c, v in (
    ("prior", RU.POINTS_PRIOR_FRAUD), ("card_test", RU.POINTS_FAILED),
    ("intl", RU.POINTS_INTERNATIONAL), ("new_m", RU.POINTS_NEW_MERCHANT)))
_POINTS += (f" + (CASE WHEN far THEN {RU.POINTS_FAR!r}::DOUBLE WHEN mid THEN {RU.POINTS_MID!r}::DOUBLE "
            f"ELSE 0.0::DOUBLE END) + " + " + ".join(
                f"(CASE WHEN {c} THEN {v!r}::DOUBLE ELSE 0.0::DOUBLE END)" for c, v in (
                    ("unu", RU.POINTS_UNUSUAL), ("moved", RU.POINTS_MISMATCH),
                    ("intl AND new_m", RU.BONUS_INTL_NEW), ("prior AND intl", RU.BONUS_PRIOR_INTL),
                    ("prior AND card_test", RU.BONUS_PRIOR_FAILED))))
_DIST_TXT = "printf('%,d', CAST(trunc(distance) AS BIGINT))"
_SCORE_CTES = (
    *_OPT_CTES,
    ("thr", "SELECT greatest(optimal_f1_threshold, 0.05::DOUBLE) AS t FROM optima"),
    ("req", _REQ_SQL + ", sc.p FROM tx JOIN sc USING (Transaction_ID)"),
    ("s0", f"""SELECT req.*, thr.t, {py_round_sql('thr.t * 0.5', 4)} AS mt,
        {_b('prev_fraud > 0')} AS prior, {_b('failed >= 2')} AS card_test,
        {_b("is_intl = 'Yes'")} AS intl, {_b("is_new = 'Yes'")} AS new_m,
        {_b("unusual = 'Yes'")} AS unu, {_b('distance > 2000')} AS far,
        {_b('distance > 500')} AS mid, {_b('distance > 5000')} AS very_far,
        {_b('tx_location <> home_loc', 'true')} AS moved FROM req, thr"""),
    ("s1", f"""SELECT *, CASE WHEN p >= t THEN 'HIGH' WHEN p >= mt THEN 'MEDIUM' ELSE 'LOW' END AS ml_tier,
        CAST(prior AS INTEGER) + CAST(card_test AS INTEGER) + CAST(intl AS INTEGER)
          + CAST(new_m AS INTEGER) + CAST(far AS INTEGER) + CAST(unu AS INTEGER) AS critical_flags,
        {_POINTS} AS rule_points,
        least(60.0::DOUBLE, (p / greatest(t, 1e-9::DOUBLE)) * 60.0::DOUBLE) AS ml_component FROM s0"""),
    ("s2", f"""SELECT *,
        CASE WHEN prior AND card_test AND intl THEN '{RU.RULE_01_TEXT}'
             WHEN very_far AND intl AND new_m THEN 'RULE_02: extreme displacement (' || {_DIST_TXT}
                  || ' km) + international + new merchant'
             WHEN critical_flags >= 5 THEN 'RULE_03: ' || critical_flags || '/6 critical risk signals simultaneously active'
             WHEN critical_flags >= 4 AND ml_tier = 'LOW' THEN 'RULE_04: ' || critical_flags
                  || '/6 critical risk signals — elevated for review' END AS rule_id,
        CASE WHEN (prior AND card_test AND intl) OR (very_far AND intl AND new_m) OR critical_flags >= 5 THEN 2
             WHEN critical_flags >= 4 AND ml_tier = 'LOW' THEN 1 ELSE 0 END AS override,
        least(40.0::DOUBLE, rule_points) AS rule_component FROM s1"""),
    ("s3", f"""SELECT *, {_UNRANK.format(x=f"greatest({_RANK.format(x='ml_tier')}, override)")} AS rule_tier,
        {py_round_sql('ml_component + rule_component', 1)} AS risk_score FROM s2"""),
    ("s4", """SELECT *, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MEDIUM'
        ELSE 'LOW' END AS score_tier FROM s3"""),
    ("scored", f"""SELECT *, {_UNRANK.format(x=f"greatest({_RANK.format(x='score_tier')}, {_RANK.format(x='rule_tier')})")} AS tier,
        printf('%.1f%%', risk_score) AS risk_score_pct,
        printf('%.1f%%', {py_round_sql('p * 100', 1)}) AS ml_probability_pct FROM s4"""),
)


def _score_sql(cols: str) -> str:
    return _ev_sql(f"SELECT {cols} FROM scored", *_SCORE_CTES)


@register("model_tier", _score_sql("Transaction_ID, p, ml_tier"))
def q_model_tier(spark, sf_dir):
    return scored(spark, sf_dir).select("Transaction_ID", "p", "ml_tier")


@register("rule_chain", _score_sql("Transaction_ID, critical_flags, rule_id, rule_tier"))
def q_rule_chain(spark, sf_dir):
    return scored(spark, sf_dir).select("Transaction_ID", "critical_flags", "rule_id", "rule_tier")


@register("rule_points", _score_sql("Transaction_ID, rule_points, rule_component"))
def q_rule_points(spark, sf_dir):
    return scored(spark, sf_dir).select("Transaction_ID", "rule_points", "rule_component")


@register("risk_score", _score_sql(
    f"Transaction_ID, {py_round_sql('ml_component', 6)} AS ml_component, risk_score, score_tier, "
    "tier, risk_score_pct, ml_probability_pct"))
def q_risk_score(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("Transaction_ID", py_round(F.col("ml_component"), 6).alias("ml_component"),
                    "risk_score", "score_tier", "tier", "risk_score_pct", "ml_probability_pct")


@register("decision_trace", _score_sql(
    f"Transaction_ID, {py_round_sql('p', 6)} AS ml_probability, ml_tier, t AS optimal_f1_threshold, "
    "mt AS medium_threshold, rule_id IS NOT NULL AS fired, rule_id, rule_tier AS tier_override, "
    f"critical_flags AS critical_flags_active, {py_round_sql('ml_component', 2)} AS ml_component, "
    f"{py_round_sql('rule_component', 2)} AS rule_component, risk_score AS total, tier AS final_tier"))
def q_decision_trace(spark, sf_dir):
    s = scored(spark, sf_dir)
    tr = s.select("Transaction_ID", RU.decision_trace(s).alias("t"))
    return tr.select("Transaction_ID", "t.ml_probability", "t.ml_tier", "t.optimal_f1_threshold",
                     "t.medium_threshold", "t.rule_engine.fired", "t.rule_engine.rule_id",
                     "t.rule_engine.tier_override", "t.rule_engine.critical_flags_active",
                     "t.composite.ml_component", "t.composite.rule_component", "t.composite.total",
                     "t.final_tier")


_FLAG_ROWS = [
    ("intl", "international", f"'{RU.FLAG_INTERNATIONAL}'"),
    ("new_m", "new_merchant", f"'{RU.FLAG_NEW_MERCHANT}'"),
    ("unu", "unusual_time", f"'{RU.FLAG_UNUSUAL}'"),
    ("moved", "location_mismatch", "printf('Location mismatch: %s vs home %s', tx_location, home_loc)"),
    (_b("distance > 400"), "distance", f"{_DIST_TXT} || ' km from home'"),
    (_b("failed > 0"), "failed", "printf('%d failed transaction(s) in session', failed)"),
    (_b("prev_fraud > 0"), "prior_fraud", "printf('Prior fraud history: %d incident(s)', prev_fraud)"),
    (_b("avg_amount > 0 AND amount > avg_amount * 2"), "amount_spike",
     "'Amount spike: $' || printf('%,d', CAST(round_even(amount, 0) AS BIGINT)) || ' vs avg $' || "
     "printf('%,d', CAST(round_even(avg_amount, 0) AS BIGINT)) || ' (' || "
     f"printf('%.1f', {py_round_sql('amount / avg_amount', 1)}) || '×)'"),
]
_FLAGS_SQL = _ev_sql(
    "SELECT Transaction_ID, CAST(row_number() OVER (PARTITION BY Transaction_ID ORDER BY o) - 1 "
    "AS INTEGER) AS pos, code, text FROM (" + " UNION ALL ".join(
        f"SELECT Transaction_ID, {i} AS o, '{code}' AS code, {text} AS text FROM scored WHERE {cond}"
        for i, (cond, code, text) in enumerate(_FLAG_ROWS)) + ") f", *_SCORE_CTES)


@register("flags", _FLAGS_SQL)
def q_flags(spark, sf_dir):
    s = scored(spark, sf_dir)
    return (s.select("Transaction_ID", F.posexplode(RU.flags()).alias("pos", "f"))
            .select("Transaction_ID", "pos", "f.code", "f.text"))


# ── geography, validation ────────────────────────────────────────────────────

from riskloom.operators import geo as GEO  # noqa: E402
from riskloom.operators import validate as VAL  # noqa: E402
from riskloom.sources.transactions import fixture_cities  # noqa: E402

_GEO_SQL = S.with_ctes("""
SELECT Transaction_ID, home, loc, home_country, tx_country,
  CAST(floor(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) + 0.5) AS BIGINT) AS distance_km,
  home_country <> tx_country AS cross_border
FROM (SELECT Transaction_ID, Customer_Home_Location AS home, Transaction_Location AS loc,
        h.country AS home_country, l.country AS tx_country,
        pow(sin((l.lat - h.lat) * (pi() / 180) / 2), 2)
        + cos(h.lat * (pi() / 180)) * cos(l.lat * (pi() / 180))
          * pow(sin((l.lon - h.lon) * (pi() / 180) / 2), 2) AS a
      FROM tx LEFT JOIN cities h ON Customer_Home_Location = h.city
              LEFT JOIN cities l ON Transaction_Location = l.city) x""", ("cities", S.CITY_SQL))


def _geo(spark, sf_dir):
    t = tx(spark, sf_dir).select("Transaction_ID", "Customer_Home_Location", "Transaction_Location")
    return GEO.with_geo(t, fixture_cities(spark, sf_dir), "Customer_Home_Location",
                        "Transaction_Location")


@register("city_distance", f"SELECT Transaction_ID, home, loc, distance_km FROM ({_GEO_SQL})")
def q_city_distance(spark, sf_dir):
    return _geo(spark, sf_dir).select(
        "Transaction_ID", F.col("Customer_Home_Location").alias("home"),
        F.col("Transaction_Location").alias("loc"), "distance_km")


@register("cross_border",
          f"SELECT Transaction_ID, home_country, tx_country, cross_border FROM ({_GEO_SQL})")
def q_cross_border(spark, sf_dir):
    return _geo(spark, sf_dir).select("Transaction_ID", "home_country", "tx_country", "cross_border")


FIXTURE_MERCHANTS = [f"Cat{i}" for i in range(16)]


def _validation_sql(requests: str = _REQ_SQL + " FROM tx") -> str:
    from riskloom.schema import VALID_CARD_TYPES, VALID_TX_TYPES, YES_NO
    rows = []

    def add(field, cond, msg_sql):
        rows.append(f"SELECT Transaction_ID, '{field}' AS field, {msg_sql} AS message "
                    f"FROM v WHERE {cond}")

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    req = lambda f: add(f, f"{f} IS NULL", lit(VAL.MSG_REQUIRED))
    req("tx_time")
    add("tx_time", "tx_time IS NOT NULL AND try_strptime(tx_time, '%H:%M') IS NULL", lit(VAL.MSG_TIME))
    for f, dom in (("tx_type", VALID_TX_TYPES), ("merchant_cat", FIXTURE_MERCHANTS),
                   ("card_type", VALID_CARD_TYPES)):
        req(f)
        inlist = ", ".join(lit(d) for d in dom)
        add(f, f"{f} IS NOT NULL AND {f} NOT IN ({inlist})", lit(VAL._domain_msg(f, dom)))
    for f, country in (("tx_location", "tx_country"), ("home_loc", "home_country")):
        req(f)
        add(f, f"{f} IS NOT NULL AND {country} IS NULL", lit(VAL.MSG_LOCATION))
    yn = ", ".join(lit(d) for d in YES_NO)
    for f in ("is_new", "unusual", "is_intl"):
        req(f)
        add(f, f"{f} IS NOT NULL AND {f} NOT IN ({yn})", lit(VAL.MSG_YES_NO))
    exp = "(CASE WHEN home_country <> tx_country THEN 'Yes' ELSE 'No' END)"
    add("is_intl", f"is_intl IN ({yn}) AND home_country IS NOT NULL AND tx_country IS NOT NULL "
                   f"AND is_intl <> {exp}", f"printf({lit(VAL.MSG_INTL_FORMAT)}, {exp})")
    for f in ("amount", "balance", "avg_amount", "max_24h", "distance"):
        req(f)
        add(f, f"{f} < 0", lit(VAL.MSG_NON_NEGATIVE))
    for f in ("daily_tx", "weekly_tx"):
        req(f)
        add(f, f"{f} < 1", lit(VAL.MSG_COUNTS))
    for f in ("failed", "prev_fraud"):
        req(f)
        add(f, f"{f} < 0", lit(VAL.MSG_NON_NEGATIVE))
    trimmed = ("tx_type", "merchant_cat", "card_type", "tx_location", "home_loc",
               "is_intl", "is_new", "unusual")
    body = " UNION ALL ".join(rows)
    strip = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g') AS {c}"
    rq = f"SELECT * REPLACE ({', '.join(strip.format(c=c) for c in trimmed)}) FROM ({requests}) r0"
    v = ("SELECT r.*, h.country AS home_country, l.country AS tx_country FROM rq r "
         "LEFT JOIN cities h ON r.home_loc = h.city LEFT JOIN cities l ON r.tx_location = l.city")
    return S.with_ctes(body, ("cities", S.CITY_SQL), ("rq", rq), ("v", v))


@register("validation_errors", _validation_sql())
def q_validation_errors(spark, sf_dir):
    req = requests_from_transactions(txh(spark, sf_dir))
    v = VAL.validate(req, fixture_cities(spark, sf_dir), merchant_cats=FIXTURE_MERCHANTS)
    return VAL.error_rows(v)


# ── sources: written and read back ───────────────────────────────────────────

from riskloom.functions.ordered import exact_quantiles_full  # noqa: E402
from riskloom.sources import artifacts as ART  # noqa: E402
from riskloom.sources.requests import read_requests, requests_to_transactions  # noqa: E402
from riskloom.sources.transactions import read_transactions  # noqa: E402
from riskloom.schema import TRANSACTION_SCHEMA  # noqa: E402

_ROUNDED = ("Transaction_Amount", "Avg_Transaction_Amount", "Max_Transaction_Last_24h", "Account_Balance")
_VIEW_SQL = S.with_ctes("SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in _ROUNDED) + ") FROM tx")


def _rounded_view(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in _ROUNDED else F.col(c)
                       for c in TRANSACTION_SCHEMA.fieldNames()])


@register("csv_scan", _VIEW_SQL)
def q_csv_scan(spark, sf_dir):
    """The view as CSV with columns in another order, three extra ones, missing texts and
    counts as floats, read back by name."""
    t = txh(spark, sf_dir)
    missing = {"StringType()": "NA", "DoubleType()": "NaN", "LongType()": "null"}
    texts = {}
    for f in t.schema.fields:
        x = F.col(f.name).cast("string")
        if f.name.endswith("_Count"):
            x = F.concat(x, F.lit(".0"))
        texts[f.name] = F.coalesce(x, F.lit(missing.get(str(f.dataType), "")))
    extra = [F.lit("77").alias("Merchant_ID"), F.lit("10.0.0.1").alias("IP_Address"), F.lit("2.0").alias("Device_ID")]
    path = shared_path(spark, "csv-scan")
    t.select(extra[0], *[texts[c].alias(c) for c in reversed(t.columns)], *extra[1:]).write.option(
        "header", True).csv(path)
    return _rounded_view(read_transactions(spark, path))


@register("quantiles_full", S.with_ctes(" UNION ALL ".join(
    f"SELECT Fraud_Label, {q}::DOUBLE AS q, round(quantile_cont(Transaction_Amount, {q}), 6) AS quantile "
    "FROM tx GROUP BY Fraud_Label" for q in (0.1, 0.5, 0.75))))
def q_quantiles_full(spark, sf_dir):
    """The full ranking, which every approximate bracket falls back to."""
    out = exact_quantiles_full(tx(spark, sf_dir), ["Fraud_Label"], "Transaction_Amount", [0.1, 0.5, 0.75])
    return out.select("Fraud_Label", "q", F.round("quantile", 6).alias("quantile"))


@register("request_scan", S.with_ctes(
    "SELECT Transaction_ID, Transaction_Date, " + ", ".join(
        f"round({c}, 9) AS {c}" for c in ("Transaction_Amount", "Account_Balance", "Avg_Transaction_Amount"))
    + ", Transaction_Time, Merchant_Category, Distance_From_Home, Daily_Transaction_Count, "
      "Previous_Fraud_Count, Is_New_Merchant FROM tx"))
def q_request_scan(spark, sf_dir):
    """Requests as JSON lines with quoted numbers and counts as floats, read back and renamed."""
    r = requests_from_transactions(txh(spark, sf_dir)).drop("Transaction_ID")
    texts = [F.concat(F.col(f.name).cast("string"), F.lit(".0")).alias(f.name) if f.dataType.simpleString() == "bigint"
             else F.col(f.name).cast("string").alias(f.name) for f in r.schema.fields]
    path = shared_path(spark, "request-scan")
    r.select(F.to_json(F.struct(*texts)).alias("value")).write.text(path)
    out = requests_to_transactions(read_requests(spark, path))
    return out.select(F.col("request_id").cast("bigint").alias("Transaction_ID"), "Transaction_Date",
                      *[F.round(c, 9).alias(c) for c in ("Transaction_Amount", "Account_Balance",
                                                         "Avg_Transaction_Amount")],
                      "Transaction_Time", "Merchant_Category", "Distance_From_Home", "Daily_Transaction_Count",
                      "Previous_Fraud_Count", "Is_New_Merchant")


@register("response_json", _score_sql("Transaction_ID, risk_score, tier, ml_tier, rule_id, rule_tier, ml_probability_pct"))
def q_response_json(spark, sf_dir):
    """Response documents written as JSON lines, read back and flattened."""
    path = shared_path(spark, "responses")
    docs = RU.response(scored(spark, sf_dir), "surrogate", None)
    ART.write_json_lines(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    return back.select("Transaction_ID", "risk_score", "tier", "ml_tier", "decision_trace.rule_engine.rule_id",
                       F.col("decision_trace.rule_engine.tier_override").alias("rule_tier"), "ml_probability_pct")


#: Deterministic damage to a request by its id, so that every message occurs (a test input).
_MUTATIONS = [
    (1, "tx_type", "'Cheque'"), (2, "merchant_cat", "'Nowhere'"), (3, "card_type", "'Paper'"),
    (4, "tx_location", "'Atlantis'"), (5, "home_loc", "'Atlantis'"), (6, "is_new", "'maybe'"),
    (7, "unusual", "'?'"), (8, "is_intl", "'no'"), (9, "is_intl", "CASE is_intl WHEN 'Yes' THEN 'No' ELSE 'Yes' END"),
    (10, "amount", "-1.0"), (11, "avg_amount", "-0.5"), (12, "max_24h", "-2.0"), (13, "distance", "-3.0"),
    (14, "daily_tx", "0"), (15, "weekly_tx", "-1"), (16, "failed", "-1"), (17, "prev_fraud", "-2"),
    (18, "tx_time", "'25:61'"),
]
_PADDED = "(chr(9) || ' ' || {c} || chr(10))"


def _mutated(columns: list[str]) -> list[str]:
    """SQL expressions, the same text for both engines."""
    out = []
    for c in columns:
        x = c
        for k, field, value in _MUTATIONS:
            if field == c:
                x = f"CASE WHEN Transaction_ID % 23 = {k} THEN {value} ELSE {x} END"
        if c in VAL.TRIMMED:
            x = f"CASE WHEN Transaction_ID % 23 = 19 THEN {_PADDED.format(c=c)} ELSE {x} END"
        out.append(f"{x} AS {c}")
    return out


_MUTATED_REQUEST = ["Transaction_ID", "amount", "balance", "distance", "tx_time", "tx_type", "merchant_cat", "card_type",
                    "tx_location", "home_loc", "daily_tx", "weekly_tx", "avg_amount", "max_24h", "failed", "prev_fraud",
                    "is_intl", "is_new", "unusual"]


@register("validation_mutations", _validation_sql(
    "SELECT " + ", ".join(_mutated(_MUTATED_REQUEST)) + " FROM (" + _REQ_SQL + " FROM tx) r00"))
def q_validation_mutations(spark, sf_dir):
    req = requests_from_transactions(txh(spark, sf_dir)).selectExpr(*_mutated(_MUTATED_REQUEST))
    v = VAL.validate(req, fixture_cities(spark, sf_dir), merchant_cats=FIXTURE_MERCHANTS)
    return VAL.error_rows(v)


_LOW_CTES = tuple((n, q.replace(", sc.p FROM tx", ", sc.p * 0.1::DOUBLE AS p FROM tx")) if n == "req" else (n, q)
                  for n, q in _SCORE_CTES)


@register("rule_chain_low_score", _ev_sql(
    "SELECT Transaction_ID, critical_flags, rule_id, rule_tier FROM scored", *_LOW_CTES))
def q_rule_chain_low_score(spark, sf_dir):
    """The rules on scores a tenth as high, where the model alone says LOW."""
    thr = serving_threshold(surrogate_predictions(tx(spark, sf_dir)))
    t = surrogate_score(txh(spark, sf_dir)).withColumn("p", F.col("p") * F.lit(0.1))
    return RU.score(requests_from_transactions(t, keep=("p",)), thr).select(
        "Transaction_ID", "critical_flags", "rule_id", "rule_tier")


# ── business impact ──────────────────────────────────────────────────────────

from riskloom.operators import impact as IM  # noqa: E402

_COST_FN_SQL = ("(SELECT CAST(round(CAST(round(avg(Transaction_Amount), 4) AS DECIMAL(20,4)), 1) "
                "AS DOUBLE) FROM tx WHERE Fraud_Label = 'Fraud')")
_IMPACT_CTES = (*_SWEEP_CTES,
                ("par", f"SELECT {_COST_FN_SQL} AS cfn, 15.0::DOUBLE AS cfp, "
                        "50000.0::DOUBLE / (SELECT count(*) FROM pr) AS scale"),
                ("imp", """SELECT model, threshold, tp, fp, fn,
                    (fn * cfn + fp * cfp) * scale AS total, fn * cfn * scale AS fn_cost,
                    fp * cfp * scale AS fp_cost, tp * cfn * scale AS caught,
                    (tp * cfn - fp * cfp) * scale AS net, (tp + fn) * cfn * scale AS baseline,
                    (tp + fn) * cfn * scale - (fn * cfn + fp * cfp) * scale AS savings
                  FROM sweep, par"""))
_IMPACT_DOUBLES = ("total", "fn_cost", "fp_cost", "caught", "net", "baseline", "savings")


def _impact_rows(spark, sf_dir):
    t = tx(spark, sf_dir)
    pr = surrogate_predictions(t)
    mean = t.where(F.col("Fraud_Label") == "Fraud").agg(
        F.round(F.avg("Transaction_Amount"), 4).cast("decimal(20,4)").alias("c")).first()["c"]
    ov = IM.default_cost_fn(mean)
    sweep = reliable_checkpoint(EV.threshold_sweep(pr))      # 19 rows per model
    one = sweep.first()
    n = one.tp + one.fp + one.tn + one.fn                    # every row is in each sweep row
    return IM.impact_sweep(sweep, cost_fn=ov, test_size=n), n


@register("impact_sweep", _ev_sql(
    "SELECT model, threshold, tp, fp, fn, " + ", ".join(f"round({c}, 4) AS {c}" for c in _IMPACT_DOUBLES)
    + " FROM imp", *_IMPACT_CTES))
def q_impact_sweep(spark, sf_dir):
    rows, _ = _impact_rows(spark, sf_dir)
    return rows.select("model", "threshold", "tp", "fp", "fn",
                       *[F.round(c, 4).alias(c) for c in _IMPACT_DOUBLES])


_KPI_COLS = ("caught", "missed", "fp_cost", "net", "annual_saving", "annual_cost",
             "precision_pct", "capture_pct", "miss_pct", "cost_reduction_pct")


@register("impact_kpis", _ev_sql(
    "SELECT model, opt_threshold, monthly_caught, monthly_alerts, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in _KPI_COLS) + " FROM kpi", *_IMPACT_CTES,
    ("o", "SELECT DISTINCT ON (model) * FROM imp ORDER BY model, total, threshold DESC"),
    ("b", "SELECT DISTINCT ON (model) model, savings AS best FROM imp ORDER BY model, savings DESC, threshold DESC"),
    ("kpi", """SELECT o.model, o.threshold AS opt_threshold, o.caught, o.fn_cost AS missed,
        o.fp_cost, o.net, b.best * 12 AS annual_saving, o.total * 12 AS annual_cost,
        CAST(floor(o.tp / CAST((SELECT count(*) FROM pr) AS DOUBLE) * 50000.0 + 0.5) AS BIGINT) AS monthly_caught,
        CAST(floor((o.tp + o.fp) / CAST((SELECT count(*) FROM pr) AS DOUBLE) * 50000.0 + 0.5) AS BIGINT) AS monthly_alerts,
        CASE WHEN o.tp + o.fp > 0 THEN CAST(o.tp AS DOUBLE) / (o.tp + o.fp) * 100 ELSE 0.0 END AS precision_pct,
        CASE WHEN o.tp + o.fn > 0 THEN CAST(o.tp AS DOUBLE) / (o.tp + o.fn) * 100 ELSE 0.0 END AS capture_pct,
        CASE WHEN o.tp + o.fn > 0 THEN CAST(o.fn AS DOUBLE) / (o.tp + o.fn) * 100 ELSE 0.0 END AS miss_pct,
        CASE WHEN o.baseline > 0 THEN (o.baseline - o.total) / o.baseline * 100 ELSE 0.0 END AS cost_reduction_pct
      FROM o JOIN b USING (model)""")))
def q_impact_kpis(spark, sf_dir):
    rows, n = _impact_rows(spark, sf_dir)
    k = IM.impact_kpis(rows, test_size=n)
    return k.select("model", "opt_threshold", "monthly_caught", "monthly_alerts",
                    *[F.round(c, 4).alias(c) for c in _KPI_COLS])


# ── explanations and models ──────────────────────────────────────────────────

from riskloom.operators import explain as XP  # noqa: E402
from riskloom.operators import models as M  # noqa: E402
from riskloom.schema import MODEL_INPUTS  # noqa: E402

# Fixture coefficients for the linear-attribution check (a test input, like the
# surrogate score): coef_i = ((i mod 7) - 3) / 4, center_i = (i mod 5) / 2.
FIXTURE_COEF = [((i % 7) - 3) / 4.0 for i in range(len(MODEL_INPUTS))]
FIXTURE_CENTER = [(i % 5) / 2.0 for i in range(len(MODEL_INPUTS))]


def _linear_attribution_sql() -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC_FEATURES)
    xs = []
    for c in MODEL_INPUTS:
        if c in CATEGORICAL_FEATURES:
            xs.append(f"CAST((SELECT code FROM codes WHERE \"column\" = '{c}' AND value = "
                      f"coalesce(CAST(fe.{c} AS VARCHAR), 'Unknown')) AS DOUBLE) AS {c}")
        else:
            xs.append(f"coalesce(CAST(fe.{c} AS DOUBLE), med.{c}) AS {c}")
    body = " UNION ALL ".join(
        f"SELECT Transaction_ID, '{c}' AS feature, {w!r}::DOUBLE * ({c} - {m!r}::DOUBLE) AS raw FROM x"
        for c, w, m in zip(MODEL_INPUTS, FIXTURE_COEF, FIXTURE_CENTER))
    body = f"SELECT Transaction_ID, feature, {py_round_sql('raw', 6)} + 0.0 AS contribution FROM ({body}) l"
    return S.with_ctes(body, *FEATURE_CTES, ("codes", _CODES_SQL), ("med", f"SELECT {med} FROM fe"),
                       ("x", f"SELECT fe.Transaction_ID, {', '.join(xs)} FROM fe, med"))


@register("linear_attribution", _linear_attribution_sql())
def q_linear_attribution(spark, sf_dir):
    t = txh_stored(spark, sf_dir)
    prep = M.fit_prep(t)
    v = prep.transform(t, keep=("Transaction_ID",))
    rows = XP.explode_contributions(
        v, XP.contributions(F.col("features"), prep.inputs, FIXTURE_COEF, FIXTURE_CENTER))
    # + 0.0 turns -0.0 (zero coefficient times a negative offset) into 0.0
    return rows.select("Transaction_ID", "feature",
                       (py_round(F.col("contribution"), 6) + F.lit(0.0)).alias("contribution"))


_LINEAR_SQL = _linear_attribution_sql()


@register("global_attribution", f"""SELECT feature, round(avg(abs(contribution)), 4) AS value
FROM ({_LINEAR_SQL}) l GROUP BY feature""")
def q_global_attribution(spark, sf_dir):
    rows = q_linear_attribution(spark, sf_dir)
    return XP.global_attribution(rows, top=len(MODEL_INPUTS)).select("feature", F.round("value", 4).alias("value"))


@register("waterfall", f"""SELECT Transaction_ID, CAST(row_number() OVER (PARTITION BY Transaction_ID
  ORDER BY contribution, ord) - 1 AS INTEGER) AS pos, feature, contribution FROM (
  SELECT *, row_number() OVER (PARTITION BY Transaction_ID ORDER BY contribution, ord) AS up,
    row_number() OVER (PARTITION BY Transaction_ID ORDER BY contribution DESC, ord) AS down
  FROM (SELECT l.*, list_position([{", ".join(f"'{c}'" for c in MODEL_INPUTS)}], feature) AS ord
        FROM ({_LINEAR_SQL}) l) o) r WHERE up <= 6 OR down <= 6""")
def q_waterfall(spark, sf_dir):
    t = txh_stored(spark, sf_dir)
    prep = M.fit_prep(t)
    v = prep.transform(t, keep=("Transaction_ID",))
    v = XP.with_linear_contributions(v, prep.inputs, FIXTURE_COEF, FIXTURE_CENTER,
                                     lambda x: py_round(x, 6) + F.lit(0.0))
    return (v.select("Transaction_ID", F.posexplode(XP.waterfall(F.col("contrib"))).alias("pos", "w"))
            .select("Transaction_ID", "pos", "w.feature", F.col("w.value").alias("contribution")))


# Rows-only (no SQL): model fitting at the published sizes. Only the labelled rows of a fit
# are bounded (T1, hash-selected); the bound is a column of the results. The library's default is the
# published bound of 200,000 rows.
PUBLISHED = M.TrainConfig(max_rows=20_000)


def _bounded(df: DataFrame) -> DataFrame:
    return df.withColumn("max_labelled_rows", F.lit(PUBLISHED.max_rows))


@register("train_compare")
def q_train_compare(spark, sf_dir):
    return _bounded(M.comparison(M.train_all(txh_stored(spark, sf_dir), PUBLISHED)))


@register("forest_importance")
def q_forest_importance(spark, sf_dir):
    prep, _, models = M.explained_models(txh_stored(spark, sf_dir), PUBLISHED, all_rows=False)
    return _bounded(M.importance(models[M.RF], prep.inputs))


@register("split_fold", S.with_ctes("""
SELECT Transaction_ID, label, rk <= n_test AS is_test,
  CAST(CASE WHEN rk > n_test THEN (rk - n_test - 1) % 5 END AS INTEGER) AS fold,
  CAST(CASE WHEN rk > n_test THEN floor((rk - n_test - 1) / 5.0) % 5 END AS INTEGER) AS cal_fold
FROM (SELECT *, CAST(floor(n * 0.2::DOUBLE + 0.5) AS BIGINT) AS n_test FROM (
  SELECT Transaction_ID, label, row_number() OVER (PARTITION BY label
      ORDER BY md5('42:split:' || Transaction_ID), Transaction_ID) AS rk,
    count(*) OVER (PARTITION BY label) AS n
  FROM (SELECT Transaction_ID, CASE WHEN Fraud_Label = 'Fraud' THEN 1 ELSE 0 END AS label FROM tx) l) r) s"""))
def q_split_fold(spark, sf_dir):
    """The split, CV folds and calibration folds of every labelled row."""
    return TR.split_and_folds(tx(spark, sf_dir).select("Transaction_ID", EN.label().alias("label")))


@register("row_cap", S.with_ctes("""
SELECT Transaction_ID, Fraud_Label FROM tx
ORDER BY md5('42:cap:' || Transaction_ID), Transaction_ID LIMIT 1000"""))
def q_row_cap(spark, sf_dir):
    """Exactly 1,000 hash-selected rows (the cap is the feature)."""
    return TR.cap_rows(tx(spark, sf_dir).select("Transaction_ID", "Fraud_Label"), 1000)


# ── streaming scoring (stream = batch is asserted in the tests) ──

from riskloom.sources.transactions import surrogate_p  # noqa: E402
from riskloom.streaming import scoring as ST  # noqa: E402


def surrogate_probability(txn: DataFrame) -> DataFrame:
    """Surrogate score on request-derived rows (the request id is the transaction id)."""
    if "Transaction_ID" not in txn.columns:
        txn = txn.withColumn("Transaction_ID", F.col("request_id").cast("long"))
    return txn.withColumn("p", surrogate_p())


def run_stream_scoring(spark, sf_dir):
    """Write requests derived from the tables as JSON files, score them with the
    streaming plan (availableNow) and return (scored sink, quarantine sink) paths."""
    t = txh(spark, sf_dir)
    thr = serving_threshold(surrogate_predictions(tx(spark, sf_dir)))
    src = shared_path(spark, "requests")
    requests_from_transactions(t).write.mode("overwrite").json(src)
    queries, sink, quarantine = ST.start_scoring_stream(
        spark, src, fixture_cities(spark, sf_dir), surrogate_probability, thr,
        merchant_cats=FIXTURE_MERCHANTS, max_files_per_trigger=4)
    for q in queries:
        q.awaitTermination()
    return sink, quarantine


@register("stream_score", "SELECT * FROM (" + _score_sql(
    "Transaction_ID, p, ml_tier, rule_id, risk_score, tier")
    + f") s WHERE Transaction_ID NOT IN (SELECT Transaction_ID FROM ({_validation_sql()}) e)")
def q_stream_score(spark, sf_dir):
    sink, _ = run_stream_scoring(spark, sf_dir)
    return spark.read.parquet(sink).select(
        F.col("request_id").cast("long").alias("Transaction_ID"), "p", "ml_tier", "rule_id",
        "risk_score", "tier")


def _dealt(df: DataFrame) -> DataFrame:
    """Few bytes and much work per row: dealt to all cores whatever the frame's files, in as few
    parts as keep them busy (a task tables every tree once for each block of its rows)."""
    from riskloom.operators.treeshap import BLOCK_ROWS
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (4 * BLOCK_ROWS)))
    return df.repartition(parts, "Transaction_ID")


@register("tree_attribution")
def q_tree_attribution(spark, sf_dir):
    """X3b on every test row: the first calibration fold's forest, fitted on all of its training rows."""
    from riskloom.operators import treeshap as TS
    prep, frame, model = M.whole_forest(txh_stored(spark, sf_dir), PUBLISHED)
    contrib = TS.tree_contributions(_dealt(frame.where(F.col("is_test"))), model, prep.inputs)
    # no bound on the labelled rows
    return TS.explode_tree_contributions(contrib, prep.inputs).withColumn("max_labelled_rows", F.lit(None).cast("int"))


_SPLIT_SQL = """SELECT Transaction_ID, label, rk <= floor(n * 0.2::DOUBLE + 0.5) AS is_test FROM (
  SELECT Transaction_ID, label, row_number() OVER (PARTITION BY label
      ORDER BY md5('42:split:' || Transaction_ID), Transaction_ID) AS rk,
    count(*) OVER (PARTITION BY label) AS n
  FROM (SELECT Transaction_ID, CASE WHEN Fraud_Label = 'Fraud' THEN 1 ELSE 0 END AS label FROM tx) l) r"""


@register("tree_additivity", S.with_ctes(f"""
SELECT m.model, Transaction_ID, 0.0::DOUBLE AS gap FROM ({_SPLIT_SQL}) s,
  (VALUES ('{M.RF}'), ('{M.GBT}')) m(model) WHERE is_test"""))
def q_tree_additivity(spark, sf_dir):
    """X3b on every test row and both tree models: contributions plus base against the model's
    own output (the forest's probability, the boosted trees' log-odds)."""
    from pyspark.ml.functions import vector_to_array

    from riskloom.operators import treeshap as TS
    prep, frame, models = M.explained_models(txh_stored(spark, sf_dir), PUBLISHED, names=(M.RF, M.GBT))
    test = _dealt(frame.where(F.col("is_test")).select("Transaction_ID", "features"))
    parts = []
    for name, raw in ((M.RF, vector_to_array("probability")[1]), (M.GBT, vector_to_array("rawPrediction")[1] * 2)):
        total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c) + F.col("base")
        out = models[name].transform(test).select("Transaction_ID", raw.alias("raw"))
        both = TS.tree_contributions(test, models[name], prep.inputs).join(out, "Transaction_ID")
        parts.append(both.select(F.lit(name).alias("model"), "Transaction_ID",
                                 F.round(F.abs(total - F.col("raw")), 9).alias("gap")))
    return parts[0].unionByName(parts[1])


from riskloom.plans import lifecycle  # noqa: E402,F401
