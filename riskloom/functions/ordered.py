"""Global running totals over an ordered key without a single-task window.

``Window.orderBy`` without ``partitionBy`` pulls every row into one task, and
``Window.partitionBy(g)`` puts a hot group into one task. Instead:

1. range-partition the (pre-aggregated, unique-keyed) rows on (group, order),
   tag each row with its partition and write a reliable checkpoint so the tag
   survives recomputation after executor loss;
2. running sums inside each (partition, group) slice with a bounded window;
3. per-(partition, group) totals and first-row values of the groups on each
   partition's edges (at most 2 rows per partition) give, by a tiny window, the
   exclusive offset of every slice and the first row of the following slice;
   they are broadcast back (the bound is the partition count).

The result is exact and every task holds one range partition only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import reliable_checkpoint


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the keys of ``left`` are kept."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def ordered_scan(df: DataFrame, group_cols: list[str], order_col: str, descending: bool,
                 sum_cols: list[str], lead_cols: list[str] = (),
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum) for ``sum_cols`` and ``next_<c>``
    (value on the next row of the same group, NULL on the last) for ``lead_cols``.

    Rows must be unique on ``group_cols + [order_col]`` (aggregate first).
    """
    order: Column = F.col(order_col).desc() if descending else F.col(order_col).asc()
    keys = [F.col(g) for g in group_cols]
    tagged = reliable_checkpoint(
        df.repartitionByRange(_parts(df, num_partitions), *keys, order)
          .withColumn("_part", F.spark_partition_id()))

    slice_w = Window.partitionBy("_part", *group_cols).orderBy(order)
    running = slice_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.select(
        "*",
        *[F.sum(c).over(running).alias(f"_loc_{c}") for c in sum_cols],
        *[F.lead(c).over(slice_w).alias(f"_lead_{c}") for c in lead_cols],
    )

    first_key = F.struct(F.col(order_col)) if not descending else F.struct(-F.col(order_col))
    # only a partition's first and last group can continue across its edges: the
    # offset table has <= 2 rows per partition, a bound fixed by the partition count
    gkey = F.struct(*keys)
    bounds = F.broadcast(tagged.groupBy("_part").agg(F.min(gkey).alias("_gmin"),
                                                     F.max(gkey).alias("_gmax")))
    edge = (tagged.join(bounds, "_part")
            .where(gkey.eqNullSafe(F.col("_gmin")) | gkey.eqNullSafe(F.col("_gmax"))))
    slices = edge.groupBy("_part", *group_cols).agg(
        *[F.sum(c).alias(f"_tot_{c}") for c in sum_cols],
        *[F.min_by(F.col(c), first_key).alias(f"_first_{c}") for c in lead_cols],
    )
    across = Window.partitionBy(*group_cols).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "_part", *group_cols,
        *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}")
          for c in sum_cols],
        *[F.lead(f"_first_{c}").over(across).alias(f"_nextfirst_{c}") for c in lead_cols],
    )
    joined = join_null_safe(local, F.broadcast(offsets), ["_part", *group_cols], "left")
    out = joined.select(
        *[F.col(c) for c in df.columns], "_part",
        *[(F.col(f"_loc_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0))).alias(f"cum_{c}")
          for c in sum_cols],
        *[F.coalesce(F.col(f"_lead_{c}"), F.col(f"_nextfirst_{c}")).alias(f"next_{c}")
          for c in lead_cols],
    )
    return out


def _pick(ranked: DataFrame, targets: DataFrame, join_on: list[str], keys: list[str], value_col: str,
          offset_col: str | None = None) -> DataFrame:
    """Interpolate between the order statistics at ranks _lo and _hi (0-based).

    ``ranked`` has cum__n (inclusive running count within ``join_on``) and _n; the
    targets have one row per ``keys``, q among them; ``offset_col`` (on targets)
    shifts ranks by the rows below the ranked range.
    """
    shift = F.col(offset_col) if offset_col else F.lit(0)
    first_rank = F.col("cum__n") - F.col("_n") + shift
    last_rank = F.col("cum__n") + shift
    hit_lo = (first_rank <= F.col("_lo")) & (F.col("_lo") < last_rank)
    hit_hi = (first_rank <= F.col("_hi")) & (F.col("_hi") < last_rank)
    ranked = ranked.select(*join_on, value_col, "_n", "cum__n")
    picks = (join_null_safe(ranked, targets, join_on)
             .where(hit_lo | hit_hi)
             .groupBy(*keys, "_pos", "_lo")
             .agg(F.max(F.when(hit_lo, F.col(value_col))).alias("_vlo"),
                  F.max(F.when(hit_hi, F.col(value_col))).alias("_vhi")))
    frac = F.col("_pos") - F.col("_lo")
    vlo, vhi = F.col("_vlo").cast("double"), F.col("_vhi").cast("double")
    return picks.select(*keys, (vlo + (vhi - vlo) * frac).alias("quantile"))


def _targets(totals: DataFrame, group_cols: list[str], probs: list[float]) -> DataFrame:
    qs = F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q")
    t = totals.select(*group_cols, "_total", qs)
    pos = F.col("q") * (F.col("_total") - 1)
    return t.select(*group_cols, "q", "_total", pos.alias("_pos"),
                    F.floor(pos).cast("long").alias("_lo"), F.ceil(pos).cast("long").alias("_hi"))


def _present(df: DataFrame, value_col: str) -> DataFrame:
    """Rows that have a value, as double; NaN counts as missing."""
    v = F.col(value_col).cast("double")
    return df.withColumn(value_col, F.when(~F.isnan(v), v)).where(F.col(value_col).isNotNull())


def exact_quantiles_full(df: DataFrame, group_cols: list[str], value_col: str,
                         probs: list[float], num_partitions: int | None = None) -> DataFrame:
    """Exact quantiles by ranking every distinct (group, value) pair."""
    counts = (_present(df, value_col)
                .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))
    ranked = ordered_scan(counts, group_cols, value_col, False, ["_n"],
                          num_partitions=num_partitions)
    # totals from the checkpoint-backed ranks, not from the upstream aggregate
    totals = ranked.groupBy(*group_cols).agg(F.max("cum__n").alias("_total"))
    targets = _targets(totals, group_cols, probs).drop("_total")
    return _pick(ranked, targets, group_cols, [*group_cols, "q"], value_col)


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                    probs: list[float], num_partitions: int | None = None,
                    accuracy: int = 10000) -> DataFrame:
    """Exact linearly interpolated quantiles per group, NULLs and NaNs skipped.

    Returns one row per (group, q) with ``quantile``. Two passes over the data
    instead of a shuffle of every distinct value: (1) ``percentile_approx``
    (bounded-memory sketches, rank error <= N/accuracy) brackets each target
    rank by the approximate quantiles at q -/+ 3/accuracy; (2) one aggregation
    counts the rows below each bracket and the distinct values inside it; only
    those are ranked exactly, by ``ordered_scan``. Each result is verified
    (the target ranks fall inside the bracket); if any bracket missed, the
    full ranking is used instead.
    """
    data = _present(df, value_col).select(*group_cols, F.col(value_col).alias("_v"))
    # Candidate half-widths of the bracket; per group the narrowest one of at
    # least max(3/accuracy, 4/N) is used (small groups get a wide bracket: the
    # interpolation ranks follow q*(N-1), the sketch ranks q*N).
    margins = sorted({3.0 / accuracy, 1e-3, 3e-3, 1e-2, 3e-2, 0.1, 0.3, 1.0})
    margins = [m for m in margins if m >= 3.0 / accuracy]
    edge_of = {(q, m, side): min(1.0, max(0.0, q + side * m))
               for q in probs for m in margins for side in (-1, 1)}
    edges = sorted(set(edge_of.values()))
    sk = data.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_total"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("_sk"))
    targets = _targets(sk, group_cols, probs)
    idx = {e: i for i, e in enumerate(edges)}
    need = F.greatest(F.lit(3.0 / accuracy), F.lit(4.0) / F.col("_total"))
    lo_expr = F.lit(None).cast("double")
    hi_expr = F.lit(None).cast("double")
    for q in probs:
        for m in reversed(margins):          # the last match wins: narrowest sufficient margin
            pick = (F.col("q") == q) & ((F.lit(m) >= need) | F.lit(m == margins[-1]))
            lo_expr = F.when(pick, F.col("_sk")[idx[edge_of[(q, m, -1)]]]).otherwise(lo_expr)
            hi_expr = F.when(pick, F.col("_sk")[idx[edge_of[(q, m, 1)]]]).otherwise(hi_expr)
    brackets = join_null_safe(targets, sk.select(*group_cols, "_sk"), group_cols).select(
        *group_cols, "q", "_pos", "_lo", "_hi", lo_expr.alias("_blo"), hi_expr.alias("_bhi"))
    brackets = reliable_checkpoint(brackets)            # groups x probs rows
    keys = [*group_cols, "q"]
    inside = F.col("_v") >= F.col("_blo")
    counted = (join_null_safe(data, brackets.select(*keys, "_blo", "_bhi"), group_cols)
               .where(F.col("_v") <= F.col("_bhi"))
               .groupBy(*keys, F.when(inside, F.col("_v")).alias(value_col))
               .agg(F.count(F.lit(1)).alias("_n")))
    counted = reliable_checkpoint(counted)              # below-counts + bracket values only
    below = (counted.where(F.col(value_col).isNull())
             .select(*keys, F.col("_n").alias("_below")))
    inner = counted.where(F.col(value_col).isNotNull())
    ranked = ordered_scan(inner, keys, value_col, False, ["_n"], num_partitions=num_partitions)
    span = ranked.groupBy(*keys).agg(F.max("cum__n").alias("_inside"))
    tg = (join_null_safe(join_null_safe(brackets, below, keys, "left"), span, keys, "left")
          .select(*keys, "_pos", "_lo", "_hi", F.coalesce("_below", F.lit(0)).alias("_below"),
                  F.coalesce("_inside", F.lit(0)).alias("_inside")))
    ok = (F.col("_below") <= F.col("_lo")) & (F.col("_hi") < F.col("_below") + F.col("_inside"))
    if tg.where(~ok).limit(1).count() > 0:
        return exact_quantiles_full(df, group_cols, value_col, probs, num_partitions)
    return _pick(ranked, tg.select(*keys, "_pos", "_lo", "_hi", "_below"), keys, keys, value_col,
                 offset_col="_below")


def keyed_history(df: DataFrame, key: str, order_cols: list[str], value: str, lookback: int = 3,
                  num_partitions: int | None = None, sum_value: str | None = None) -> DataFrame:
    """Per-key history of ``value`` over earlier rows, safe for a hot key.

    Adds ``prev_sum``/``prev_count`` (sum and count of non-null values on all
    earlier rows of the key, in ``order_cols`` order) and ``prev_max`` (maximum
    over the ``lookback`` immediately preceding rows). ``sum_value`` is another column to
    add up; a decimal one gives exact sums, whatever the partitions. Equivalent to
    ``Window.partitionBy(key).orderBy(order)`` frames, but the rows are range
    partitioned on (key, order) so a key holding a third of the data is spread
    over many tasks. Only the first and last key of each partition can continue
    across a partition edge; their corrections come from tables of at most
    2 (offsets) and 2 * lookback (edge rows) rows per partition, a bound fixed by
    the partition count, so they are broadcast without a count.
    Rows must be unique on (key, order_cols); NULL keys are one key and NULL order
    values sort first, as in the window.
    """
    n = _parts(df, num_partitions)
    order = [F.col(c) for c in order_cols]
    tagged = reliable_checkpoint(
        df.repartitionByRange(n, F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    v, add = F.col(value), F.col(sum_value or value)
    w = Window.partitionBy("_part", key).orderBy(*order)

    # <= 1 row per partition: its first and last key (a NULL key sorts first)
    k = F.struct(F.col(key))
    bounds = F.broadcast(tagged.groupBy("_part").agg(F.min(k).alias("_kmin"), F.max(k).alias("_kmax")))
    edge = (tagged.join(bounds, "_part")
            .where(k.eqNullSafe(F.col("_kmin")) | k.eqNullSafe(F.col("_kmax"))))
    # <= 2 rows per partition: sums of the edge slices, then exclusive offsets
    slices = edge.groupBy("_part", key).agg(F.sum(add).alias("_ts"), F.count(add).alias("_tc"))
    prior = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_part", key,
                            F.coalesce(F.sum("_ts").over(prior), F.lit(0)).alias("_os"),
                            F.coalesce(F.sum("_tc").over(prior), F.lit(0)).alias("_oc"))
    # <= 2 * lookback rows per partition: first rows of the first key, last rows of the last key
    up = F.row_number().over(w)
    down = F.row_number().over(Window.partitionBy("_part", key).orderBy(*[c.desc() for c in order]))
    ranked = edge.select(key, *order_cols, value, "_kmin", "_kmax", up.alias("_up"), down.alias("_dn"))
    head = k.eqNullSafe(F.col("_kmin")) & (F.col("_up") <= lookback)
    tail = k.eqNullSafe(F.col("_kmax")) & (F.col("_dn") <= lookback)
    ends = ranked.where(head | tail).select(key, *order_cols, value, head.alias("_head"))
    across = Window.partitionBy(key).orderBy(*order).rowsBetween(-lookback, -1)
    fixes = (ends.select(key, *order_cols, "_head", F.max(v).over(across).alias("_fm"))
             .where("_head").select(key, *order_cols, "_fm", F.lit(True).alias("_fixed")))

    local = tagged.select(
        "*",
        F.coalesce(F.sum(add).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         .alias("_ls"),
        F.count(add).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_lc"),
        F.max(v).over(w.rowsBetween(-lookback, -1)).alias("_lm"))
    out = join_null_safe(local, F.broadcast(offsets), ["_part", key], "left")
    out = join_null_safe(out, F.broadcast(fixes), [key, *order_cols], "left")
    return out.select(
        *df.columns,
        (F.col("_ls") + F.coalesce(F.col("_os"), F.lit(0))).alias("prev_sum"),
        (F.col("_lc") + F.coalesce(F.col("_oc"), F.lit(0))).alias("prev_count"),
        F.when(F.col("_fixed"), F.col("_fm")).otherwise(F.col("_lm")).alias("prev_max"))
