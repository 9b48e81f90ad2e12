"""Distributed running totals equal a brute-force single-machine scan."""
import numpy as np
import pandas as pd


from riskloom.functions.ordered import ordered_scan
from riskloom.operators import evaluate as EV


def _brute_auc_ap(y, p):
    df = pd.DataFrame({"y": y, "p": p}).groupby("p", sort=True)["y"].agg(["sum", "count"])
    df = df.iloc[::-1]
    pos, neg = df["sum"].to_numpy(), (df["count"] - df["sum"]).to_numpy()
    tps, fps = np.cumsum(pos), np.cumsum(neg)
    P, N = tps[-1], fps[-1]
    auc = (pos * (N - fps + neg / 2.0)).sum() / (P * N)
    ap = (pos / P * tps / (tps + fps)).sum()
    return auc, ap


def test_ordered_scan_multi_model_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in ("a", "b", "c"):
        n = 3000 if m != "c" else 50
        p = np.round(rng.random(n), 2)                 # many ties
        y = (rng.random(n) < p * 0.5).astype(int)
        rows += [(m, int(i), int(yy), float(pp)) for i, (yy, pp) in enumerate(zip(y, p))]
    preds = spark.createDataFrame(rows, "model string, Transaction_ID long, label int, p double")
    got = {r.model: (r.roc_auc, r.average_precision)
           for r in EV.rank_metrics(EV.score_steps(preds, num_partitions=5)).collect()}
    for m in ("a", "b", "c"):
        sub = [(r[2], r[3]) for r in rows if r[0] == m]
        auc, ap = _brute_auc_ap([s[0] for s in sub], [s[1] for s in sub])
        assert abs(got[m][0] - auc) < 1e-12 and abs(got[m][1] - ap) < 1e-12


def test_ordered_scan_lead_across_partitions(spark):
    rows = [("g", float(i), i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, o double, v long")
    out = {r.o: (r.cum_v, r.next_v) for r in
           ordered_scan(df, ["g"], "o", False, ["v"], ["v"], num_partitions=9).collect()}
    cum = 0
    for i in range(100):
        cum += i % 3
        assert out[float(i)][0] == cum
        assert out[float(i)][1] == ((i + 1) % 3 if i < 99 else None)


def test_keyed_history_matches_plain_window_with_hot_key(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskloom.functions.ordered import keyed_history
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        cust = 0 if i % 3 == 0 else int(rng.integers(1, 40))      # one key holds a third
        amt = None if i % 17 == 0 else float(rng.integers(1, 1000)) / 4
        rows.append((cust, int(rng.integers(0, 50)), i, amt))
    df = spark.createDataFrame(rows, "cust long, d long, k long, amt double")
    got = keyed_history(df, "cust", ["d", "k"], "amt", lookback=3, num_partitions=13)
    w = Window.partitionBy("cust").orderBy("d", "k")
    ref = df.select("k", F.sum("amt").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("s"),
                    F.count("amt").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"),
                    F.max("amt").over(w.rowsBetween(-3, -1)).alias("m"))
    a = {r.k: (r.prev_sum, r.prev_count, r.prev_max) for r in got.collect()}
    b = {r.k: (r.s or 0.0, r.c, r.m) for r in ref.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1] and a[k][2] == b[k][2]
        assert abs(a[k][0] - b[k][0]) <= 1e-9 * max(1.0, abs(b[k][0]))


def test_evaluation_edge_cases_do_not_raise(spark):
    """One class only, one distinct score: NULL rank metrics, zero-guarded ratios."""
    rows = [("neg", i, 0, 0.3) for i in range(50)] + [("pos", i, 1, 0.7) for i in range(5)]
    preds = spark.createDataFrame(rows, "model string, Transaction_ID long, label int, p double")
    steps = EV.score_steps(preds, num_partitions=3)
    m = {r.model: r for r in EV.rank_metrics(steps).collect()}
    assert m["neg"].roc_auc is None and m["neg"].average_precision is None
    assert m["pos"].roc_auc is None and m["pos"].average_precision == 1.0
    pr = {(r.model, r.idx): r for r in EV.pr_curve(steps).collect()}
    assert pr[("neg", 0)].recall == 1.0 and pr[("neg", 1)].precision == 1.0
    roc = EV.roc_curve(steps).collect()
    assert {r.model for r in roc} == {"neg", "pos"}
    sweep = EV.threshold_sweep(preds).collect()
    assert all(r.precision >= 0 and r.f1 >= 0 for r in sweep)
    assert EV.class_report(EV.confusion(preds, 0.5)).count() == 10
    assert EV.threshold_optima(preds).count() == 2


def test_rank_metrics_property_random_partitions(spark):
    """Random score tables, heavy ties, random partition counts: exact AUC/AP."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    cases = []

    @settings(max_examples=12, deadline=None)
    @given(st.integers(min_value=1, max_value=23), st.integers(min_value=0, max_value=10_000),
           st.integers(min_value=2, max_value=40))
    def collect(parts, seed, levels):
        cases.append((parts, seed, levels))
    collect()
    for parts, seed, levels in cases:
        rng = np.random.default_rng(seed)
        rows = []
        for m in ("x", "y"):
            n = int(rng.integers(20, 400))
            p = rng.integers(0, levels, n) / levels
            y = (rng.random(n) < 0.3).astype(int)
            y[0], y[1] = 0, 1                              # both classes present
            rows += [(m, int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
        preds = spark.createDataFrame(rows, "model string, Transaction_ID long, label int, p double")
        got = {r.model: (r.roc_auc, r.average_precision)
               for r in EV.rank_metrics(EV.score_steps(preds, num_partitions=parts)).collect()}
        for m in ("x", "y"):
            sub = [(r[2], r[3]) for r in rows if r[0] == m]
            auc, ap = _brute_auc_ap([s[0] for s in sub], [s[1] for s in sub])
            assert abs(got[m][0] - auc) < 1e-12 and abs(got[m][1] - ap) < 1e-12, (parts, seed)


def test_keyed_history_property(spark):
    """Random lookback, partition count and key skew: equals the plain per-key window."""
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskloom.functions.ordered import keyed_history
    cases = []

    @settings(max_examples=6, deadline=None)
    @given(st.integers(1, 19), st.integers(1, 5), st.integers(0, 10_000), st.integers(1, 30))
    def collect(parts, lookback, seed, keys):
        cases.append((parts, lookback, seed, keys))
    collect()
    for parts, lookback, seed, keys in cases:
        rng = np.random.default_rng(seed)
        rows = [(0 if i % 2 == 0 else int(rng.integers(1, keys + 1)), int(rng.integers(0, 9)), i,
                 None if i % 13 == 0 else float(rng.integers(-500, 500)))
                for i in range(600)]
        df = spark.createDataFrame(rows, "cust long, d long, k long, amt double")
        got = keyed_history(df, "cust", ["d", "k"], "amt", lookback=lookback, num_partitions=parts)
        w = Window.partitionBy("cust").orderBy("d", "k")
        ref = df.select("k", F.sum("amt").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("s"),
                        F.count("amt").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"),
                        F.max("amt").over(w.rowsBetween(-lookback, -1)).alias("m"))
        a = {r.k: (r.prev_sum, r.prev_count, r.prev_max) for r in got.collect()}
        b = {r.k: (r.s or 0.0, r.c, r.m) for r in ref.collect()}
        for k in b:
            assert a[k][1:] == b[k][1:] and abs(a[k][0] - b[k][0]) < 1e-6, (parts, lookback, seed, k)


def _quantiles(rows):
    want = {}
    for g in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == g and r[1] is not None and not np.isnan(r[1])]
        for q in (0.25, 0.5, 0.9):
            if v:
                want[g, q] = float(np.quantile(v, q))
    return want


def test_quantiles_with_nan_null_groups_and_the_full_ranking(spark):
    from riskloom.functions.ordered import exact_quantiles, exact_quantiles_full
    rng = np.random.default_rng(5)
    rows = [(g, None if i % 9 == 0 else float("nan") if i % 5 == 0 else float(rng.integers(0, 50)))
            for g in ("a", "b", None) for i in range(800)] + [("small", 1.0), ("small", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for fn in (exact_quantiles, exact_quantiles_full):
        got = {(r.g, r.q): r.quantile for r in fn(df, ["g"], "v", [0.25, 0.5, 0.9], num_partitions=5).collect()}
        want = _quantiles(rows)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_missed_bracket_falls_back_to_the_full_ranking(spark, monkeypatch):
    from pyspark.sql import functions as F

    from riskloom.functions import ordered
    called = []
    full = ordered.exact_quantiles_full
    monkeypatch.setattr(ordered, "exact_quantiles_full", lambda *a, **k: called.append(1) or full(*a, **k))
    # a sketch that brackets nothing: every percentile is the smallest value
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda c, p, a: F.transform(p, lambda _: F.lit(0.0)))
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "g string, v double")
    got = {r.q: r.quantile for r in ordered.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert called and got == {0.5: 49.5}


def test_keyed_history_with_null_keys_and_order_values(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskloom.functions.ordered import keyed_history
    rows = [(None if i % 3 == 0 else i % 4, None if i % 5 == 0 else i // 7, i, float(i % 11)) for i in range(240)]
    df = spark.createDataFrame(rows, "cust long, d long, k long, amt double")
    w = Window.partitionBy("cust").orderBy("d", "k")
    want = {r.k: (r.s, r.n, r.m) for r in df.select(
        "k", F.coalesce(F.sum("amt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("s"),
        F.count("amt").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("n"),
        F.max("amt").over(w.rowsBetween(-3, -1)).alias("m")).collect()}
    got = {r.k: (r.prev_sum, r.prev_count, r.prev_max) for r in
           keyed_history(df, "cust", ["d", "k"], "amt", 3, num_partitions=7).collect()}
    assert got == want
