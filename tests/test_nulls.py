"""Hand cases for the null and number rules."""
import math

import numpy as np
from pyspark.sql import functions as F

from riskloom.functions.nulls import clip, flag, mismatch, ratio
from riskloom.functions.numbers import py_round
from riskloom.functions.ordered import exact_quantiles
from riskloom.operators.features import hour_or_noon
from riskloom.operators.profile import category_modes


def test_flag_and_mismatch_with_nulls(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("a", "a"), ("a", "b")], "x string, y string")
    r = df.select(flag(F.col("x") == "a").alias("f"), mismatch("x", "y").alias("m")).collect()
    assert [x.f for x in r] == [0, 1, 1, 1]
    assert [x.m for x in r] == [1, 1, 0, 1]          # != with a missing value counts


def test_clip_keeps_null_and_ratio_never_raises(spark):
    df = spark.createDataFrame([(None, 1.0), (50.0, 0.0), (-3.0, 2.0)], "a double, b double")
    r = df.select(clip(F.col("a"), 0, 10).alias("c"), ratio(F.col("a"), F.col("b")).alias("q")).collect()
    assert [x.c for x in r] == [None, 10.0, 0.0]
    assert [x.q for x in r] == [None, None, -1.5]


def test_hour_parse_and_weekday(spark):
    df = spark.createDataFrame([("9:5",), ("25:00",), ("x",), (None,), ("23:59",)], "t string")
    assert [r.h for r in df.select(hour_or_noon("t").alias("h")).collect()] == [9, 12, 12, 12, 23]
    d = spark.sql("select weekday(date'2024-01-01') a, weekday(date'2024-01-07') b").first()
    assert (d.a, d.b) == (0, 6)                        # Monday = 0


def test_exact_median_interpolates(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)] + [("h", 7.0)],
                               "g string, v double")
    q = {(r.g, r.q): r.quantile for r in exact_quantiles(df, ["g"], "v", [0.5, 0.75]).collect()}
    assert q[("g", 0.5)] == 2.5 and q[("g", 0.75)] == 3.25 and q[("h", 0.5)] == 7.0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(0, 50, 2000))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.q): r.quantile for r in
           exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.75, 0.99], num_partitions=7).collect()}
    for g in ("a", "b"):
        vals = np.array([v for k, v in rows if k == g])
        for q in (0.1, 0.5, 0.75, 0.99):
            assert math.isclose(got[(g, q)], float(np.percentile(vals, q * 100)), rel_tol=1e-12)


def test_mode_ties_take_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert category_modes(df, ["c"]) == {"c": "a"}


def test_python_rounding(spark):
    vals = [12.35, 2.675, 2.25, 0.125, -2.5, 70.05, 34.95]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (1, 2):
        got = [r[0] for r in df.select(py_round(F.col("x"), d)).collect()]
        assert got == [round(v, d) for v in vals]


def test_bracketed_quantiles_exact_without_fallback(spark, monkeypatch):
    from riskloom.functions import ordered as O

    def no_fallback(*a, **k):
        raise AssertionError("bracket missed: full ranking used")
    monkeypatch.setattr(O, "exact_quantiles_full", no_fallback)
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(0 if i % 3 == 0 else rng.integers(0, 1000)))
            for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.q): r.quantile for r in O.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99]).collect()}
    for g in "ab":
        vals = np.array([v for k, v in rows if k == g])
        for q in (0.1, 0.5, 0.99):
            assert got[(g, q)] == float(np.percentile(vals, q * 100))


def test_python_rounding_property(spark):
    """py_round equals Python's round() on random doubles and near-tie decimals."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    values = []

    @settings(max_examples=400, deadline=None)
    @given(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False),
           st.integers(min_value=0, max_value=1000))
    def collect(x, k):
        values.append(x)
        values.append(round(x, 2) + (k % 10) * 0.005)        # near-tie decimals
    collect()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for d in (1, 2, 4, 6):
        got = [r[0] for r in df.select(py_round(F.col("x"), d)).collect()]
        assert got == [round(v, d) for v in values]


def test_bracketed_quantiles_property(spark, monkeypatch):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from riskloom.functions import ordered as O

    def no_fallback(*a, **k):
        raise AssertionError("bracket missed")
    monkeypatch.setattr(O, "exact_quantiles_full", no_fallback)
    cases = []

    @settings(max_examples=6, deadline=None)
    @given(st.integers(0, 10_000), st.sampled_from(["normal", "ties", "tiny"]),
           st.lists(st.sampled_from([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]), min_size=1,
                    max_size=3, unique=True))
    def collect(seed, kind, probs):
        cases.append((seed, kind, sorted(probs)))
    collect()
    for seed, kind, probs in cases:
        rng = np.random.default_rng(seed)
        n = {"normal": 5000, "ties": 5000, "tiny": 3}[kind]
        vals = (rng.normal(0, 100, n) if kind != "ties" else rng.integers(0, 7, n).astype(float))
        rows = [("g", float(v)) for v in vals] + [("h", float(v) * 2) for v in vals[: max(1, n // 3)]]
        df = spark.createDataFrame(rows, "g string, v double")
        got = {(r.g, r.q): r.quantile for r in O.exact_quantiles(df, ["g"], "v", probs).collect()}
        for g, arr in (("g", vals), ("h", vals[: max(1, n // 3)] * 2)):
            for q in probs:
                want = float(np.percentile(arr, q * 100))
                assert math.isclose(got[(g, q)], want, rel_tol=1e-12, abs_tol=1e-12), (seed, kind, g, q)
