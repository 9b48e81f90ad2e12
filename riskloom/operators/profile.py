"""Exploratory aggregations over a transaction table.

Each operator is DataFrame -> small DataFrame; one scan per statistic at
most, partial (map-side) aggregation everywhere, no row data collected. The
only driver round trips are category modes (one value per column), the same
pattern MLlib's Imputer uses for its surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import ratio
from riskloom.functions.selection import select_quantiles
from riskloom.session import reliable_checkpoint
from riskloom.schema import (CORRELATION_COLUMNS, FRAUD_VALUE, HIST_BINS, HIST_MAX,
                             PROFILE_CATEGORICALS, TARGET)

RATE_KEYS = {
    "type": "Transaction_Type",
    "merchant": "Merchant_Category",
    "location": "Transaction_Location",
    "international": "Is_International_Transaction",
    "new_merchant": "Is_New_Merchant",
}


def is_fraud() -> Column:
    return F.coalesce(F.col(TARGET) == F.lit(FRAUD_VALUE), F.lit(False))


def _rate_aggs() -> list[Column]:
    return [F.count(TARGET).alias("total"),
            F.count_if(F.col(TARGET) == F.lit(FRAUD_VALUE)).alias("fraud")]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("fraud_rate", F.round(ratio(F.col("fraud"), F.col("total")), 6))


# ── A2: mode fill ────────────────────────────────────────────────────────────

def value_counts(df: DataFrame, cols: list[str] = PROFILE_CATEGORICALS) -> DataFrame:
    """(column, value, n): one unpivot and one partial-aggregating group-by for all
    columns; the result has one row per distinct value (NULL included)."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def mode_fill_table(df: DataFrame, cols: list[str] = PROFILE_CATEGORICALS) -> DataFrame:
    """(column, missing, fill_value): the fill chosen for each categorical column.

    The mode is the most frequent non-null value, lowest on ties; it is only a
    fill when the column has gaps.
    """
    vc = value_counts(df, cols)
    agg = vc.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.min_by(F.when(F.col("value").isNotNull(), F.col("value")),
                 F.struct(F.col("value").isNull(), -F.col("n"), F.col("value"))).alias("_mode"))
    return agg.select("column", F.col("missing").cast("long").alias("missing"),
                      F.when(F.col("missing") > 0, F.col("_mode")).alias("fill_value"))


def category_modes(df: DataFrame, cols: list[str] = PROFILE_CATEGORICALS) -> dict:
    """Most frequent value (lowest on ties) of each column that has gaps."""
    return {r["column"]: r["fill_value"] for r in mode_fill_table(df, cols).collect()
            if r["fill_value"] is not None}


def mode_fill(df: DataFrame, cols: list[str] = PROFILE_CATEGORICALS) -> DataFrame:
    """Fill gaps of categorical columns with their mode; the input is not changed."""
    modes = category_modes(df, cols)
    return df.select(*[F.coalesce(F.col(c), F.lit(modes[c])).alias(c) if c in modes
                       else F.col(c) for c in df.columns])


# ── A1, A3-A6 ────────────────────────────────────────────────────────────────

def overview(df: DataFrame) -> DataFrame:
    amt = F.col("Transaction_Amount")
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(is_fraud()).alias("total_fraud"),
        F.round(F.avg(is_fraud().cast("double")), 6).alias("fraud_rate"),
        F.round(F.sum(amt), 2).alias("total_amount"),
        F.round(F.avg(F.when(is_fraud(), amt)), 4).alias("avg_fraud_amount"),
    )


def rate_by(df: DataFrame, key: str | Column, name: str | None = None) -> DataFrame:
    """(key, total, fraud, fraud_rate); missing keys are dropped."""
    kc = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    return _with_rate(df.where(kc.isNotNull()).groupBy(kc.alias(name)).agg(*_rate_aggs()))


def rate_by_prev_fraud(df: DataFrame) -> DataFrame:
    return rate_by(df, F.coalesce(F.col("Previous_Fraud_Count"), F.lit(0)).cast("int"),
                   "Previous_Fraud_Count")


def parsed_hour(time_col: str = "Transaction_Time") -> Column:
    return F.hour(F.try_to_timestamp(F.col(time_col), F.lit("H:m")))


def rate_by_hour(df: DataFrame) -> DataFrame:
    """(Hour, fraud_rate); unparsable times are dropped (not set to 12)."""
    return rate_by(df, parsed_hour(), "Hour").select("Hour", "fraud_rate")


def combo() -> Column:
    return F.concat(F.col("Is_International_Transaction"), F.lit(" Intl / "),
                    F.col("Is_New_Merchant"), F.lit(" New"))


def rate_by_combo(df: DataFrame) -> DataFrame:
    return rate_by(df, combo(), "Combo").select("Combo", "fraud_rate")


def _count_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), *_rate_aggs()]


def _modes(counts: DataFrame, dim: str, key: str, weight: str = "n_rows") -> dict:
    """{dimension: most frequent non-null key (lowest on ties)} from a small aggregate.

    A partial-aggregating ``min_by`` per dimension (no window); the result has one
    value per dimension and is collected.
    """
    best = F.min_by(F.col(key), F.struct(-F.col(weight), F.col(key)))
    rows = counts.where(F.col(key).isNotNull()).groupBy(dim).agg(best.alias("_mode")).collect()
    return {r[dim]: r["_mode"] for r in rows}


def _fill_and_merge(counts: DataFrame, dim: str, key: str) -> DataFrame:
    """Merge each dimension's NULL-key group into its mode group (the mode fill).

    ``counts`` is the per-value aggregate; it is written once as a small reliable
    checkpoint so the data is scanned once for both the modes and the result.
    """
    counts = reliable_checkpoint(counts)
    modes = _modes(counts, dim, key)
    mode = F.lit(None).cast("string")
    for d, m in modes.items():
        mode = F.when(F.col(dim) == F.lit(d), F.lit(m)).otherwise(mode)
    filled = F.coalesce(F.col(key).cast("string"), mode)
    return (counts.where(filled.isNotNull())
            .groupBy(dim, filled.alias(key))
            .agg(F.sum("total").alias("total"), F.sum("fraud").alias("fraud")))


def rate_by_filled(df: DataFrame, key: str) -> DataFrame:
    """A3 with the A2 mode fill in one scan: (key, total, fraud, fraud_rate)."""
    counts = df.groupBy(F.lit(key).alias("_dim"), F.col(key)).agg(*_count_aggs())
    return _with_rate(_fill_and_merge(counts, "_dim", key).select(key, "total", "fraud"))


def rate_by_combo_filled(df: DataFrame) -> DataFrame:
    """A6 with both flags mode-filled, one scan: (Combo, fraud_rate)."""
    i, n = "Is_International_Transaction", "Is_New_Merchant"
    counts = reliable_checkpoint(df.groupBy(F.col(i), F.col(n)).agg(*_count_aggs()))
    per_i = counts.groupBy(F.lit("c").alias("_d"), i).agg(F.sum("n_rows").alias("n_rows"))
    per_n = counts.groupBy(F.lit("c").alias("_d"), n).agg(F.sum("n_rows").alias("n_rows"))
    mi, mn = _modes(per_i, "_d", i).get("c"), _modes(per_n, "_d", n).get("c")
    fi = F.coalesce(F.col(i), F.lit(mi).cast("string"))
    fn = F.coalesce(F.col(n), F.lit(mn).cast("string"))
    key = F.concat(fi, F.lit(" Intl / "), fn, F.lit(" New"))
    merged = (counts.where(key.isNotNull()).groupBy(key.alias("Combo"))
              .agg(F.sum("total").alias("total"), F.sum("fraud").alias("fraud")))
    return _with_rate(merged).select("Combo", "fraud_rate")


def rates_grouping_sets(df: DataFrame, keys: dict[str, str] = RATE_KEYS) -> DataFrame:
    """All key rates in one scan: (dimension, value, total, fraud, fraud_rate).

    One GROUPING SETS aggregate (Expand: rows x keys, narrow, in codegen, then
    one partial aggregation) keeps NULL keys as their own group; the mode fill
    then merges each NULL group into its mode, on the small aggregate.
    """
    names = list(keys)
    cols = [keys[n] for n in names]
    gid = F.col("_gid")
    # grouping_id bit for column i (from the left) is 2^(k-1-i); a single-column
    # set leaves every bit set except its own.
    full = (1 << len(cols)) - 1
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for i, (n, c) in enumerate(zip(names, cols)):
        own = full ^ (1 << (len(cols) - 1 - i))
        dim = F.when(gid == own, F.lit(n)).otherwise(dim)
        val = F.when(gid == own, F.col(c).cast("string")).otherwise(val)
    agg = df.groupingSets([[F.col(c)] for c in cols], *cols).agg(
        *_count_aggs(), F.grouping_id(*cols).alias("_gid"))
    counts = agg.select(dim.alias("dimension"), val.alias("value"), "n_rows", "total", "fraud")
    return _with_rate(_fill_and_merge(counts, "dimension", "value"))


# ── A7: correlation ──────────────────────────────────────────────────────────

def correlation(df: DataFrame, cols: list[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Pearson matrix on pairwise-complete rows, rounded to 3: (a, b, corr).

    One aggregate with covar_pop / (stddev_pop * stddev_pop) per pair; NULL on a
    constant column (plain ``corr`` raises under ANSI mode there).
    """
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            r = F.try_divide(F.covar_pop(x, y),
                             F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
            aggs.append(F.round(r, 3).alias(f"{i}_{cols.index(b)}"))
    one = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            src = f"{min(i, j)}_{max(i, j)}"
            pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                  F.col(src).alias("corr")))
    return one.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


# ── A8: amount histogram ─────────────────────────────────────────────────────

def _hist_bin(x: Column) -> Column:
    """Bin of x in [0, 100000] on edges i*(100000/21), last bin closed."""
    w = F.lit(HIST_MAX / HIST_BINS)
    last = HIST_BINS - 1
    b0 = F.least(F.floor(x / w), F.lit(last)).cast("int")
    b1 = F.when(b0 * w > x, b0 - 1).otherwise(b0)
    return F.when((b1 < last) & ((b1 + 1) * w <= x), b1 + 1).otherwise(b1)


def amount_histogram(df: DataFrame) -> DataFrame:
    """Density histogram of clipped amounts per class, empty bins included.

    One pass: per class, one conditional count per bin; no join for empty bins.
    (class, bin, bin_center, count, density); density = count / width / n.
    """
    x = F.least(F.greatest(F.col("Transaction_Amount"), F.lit(0.0)), F.lit(HIST_MAX))
    binned = df.select(F.when(is_fraud(), "fraud").otherwise("normal").alias("class"),
                       _hist_bin(x).alias("bin")).where(F.col("bin").isNotNull())
    per = binned.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("bin") == i).alias(f"c{i}") for i in range(HIST_BINS)])
    w = HIST_MAX / HIST_BINS
    rows = []
    for i in range(HIST_BINS):
        lo = i * w
        hi = HIST_MAX if i == HIST_BINS - 1 else (i + 1) * w
        rows.append(F.struct(
            F.lit(i).alias("bin"), F.lit((lo + hi) / 2).alias("bin_center"),
            F.col(f"c{i}").alias("count"),
            F.try_divide(F.col(f"c{i}") / F.lit(hi - lo), F.col("n")).alias("density")))
    return per.select("class", F.explode(F.array(*rows)).alias("r")).select("class", "r.*")


# ── A9: distance percentiles ─────────────────────────────────────────────────

def distance_percentiles(df: DataFrame) -> DataFrame:
    """Exact median and p75 of distance per class (linear interpolation); two classes at most."""
    cls = F.when(is_fraud(), "fraud").otherwise("normal")
    q = select_quantiles(df, ["Distance_From_Home"], [0.5, 0.75], cls)
    rows = [(g, *(float(q[(g, "Distance_From_Home", p)]) for p in (0.5, 0.75))) for g in sorted({k[0] for k in q})]
    return df.sparkSession.createDataFrame(rows, "class string, median_distance double, p75_distance double")


# ── A10-A13: insights ────────────────────────────────────────────────────────

def top_combo(combo_rates: DataFrame) -> DataFrame:
    """Combination with the highest rate (ties: first in key order)."""
    return combo_rates.orderBy(F.desc("fraud_rate"), F.asc("Combo")).limit(1)


def hour_insight(hour_rates: DataFrame) -> DataFrame:
    """Peak hour and the night-over-day premium (unweighted means over hours)."""
    night = (F.col("Hour") >= 22) | (F.col("Hour") <= 5)
    day = (F.col("Hour") >= 6) & (F.col("Hour") <= 21)
    peak = F.min_by(F.struct("Hour", "fraud_rate"), F.struct(-F.col("fraud_rate"), F.col("Hour")))
    agg = hour_rates.agg(
        peak.alias("peak"),
        F.coalesce(F.avg(F.when(night, F.col("fraud_rate"))), F.lit(0.0)).alias("night_avg"),
        F.coalesce(F.avg(F.when(day, F.col("fraud_rate"))), F.lit(0.0)).alias("day_avg"))
    premium = F.when(F.col("day_avg") > 0,
                     (F.col("night_avg") / F.col("day_avg") - 1) * 100).otherwise(F.lit(0.0))
    return agg.select(F.col("peak.Hour").alias("peak_hour"),
                      F.col("peak.fraud_rate").alias("peak_rate"),
                      F.round("night_avg", 6).alias("night_avg"),
                      F.round("day_avg", 6).alias("day_avg"),
                      F.round(premium, 4).alias("night_premium_pct"))


def distance_gap(percentiles: DataFrame) -> DataFrame:
    """Fraud-over-normal median distance ratio (NULL when the normal median is 0)."""
    agg = percentiles.agg(
        F.max(F.when(F.col("class") == "fraud", F.col("median_distance"))).alias("fraud_median"),
        F.max(F.when(F.col("class") == "normal", F.col("median_distance"))).alias("normal_median"))
    return agg.select("fraud_median", "normal_median",
                      F.when(F.col("normal_median") > 0,
                             F.round(F.col("fraud_median") / F.col("normal_median"), 6))
                      .alias("ratio"))


def top_locations(location_rates: DataFrame, n: int = 15) -> DataFrame:
    """Top-n locations by rate (ascending display sort, last n kept)."""
    return (location_rates.orderBy(F.desc("fraud_rate"), F.desc("Transaction_Location"))
            .limit(n))
