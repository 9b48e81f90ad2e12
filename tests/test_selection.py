"""Radix selection against numpy: ties, signs, infinities, groups and hot values."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.functions import selection as SEL

PROBS = [0.0, 0.1, 0.5, 0.75, 1.0]


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 1e-310, 1.0, 1.0 + 2 ** -52, 7e200, np.inf])
    keys = SEL.ordered_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [SEL.key_value(int(k)) for k in keys] == x.tolist()
    assert SEL.ordered_keys(np.array([-0.0]))[0] == SEL.ordered_keys(np.array([0.0]))[0]


def test_equals_numpy(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    data = {"u": rng.random(n), "ties": rng.integers(0, 3, n).astype(float), "hot": np.where(rng.random(n) < 0.6, 4.0, 9.5),
            "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n)),
            "none": np.full(n, np.nan), "count": rng.integers(-5, 10 ** 9, n)}
    pdf = pd.DataFrame(data)
    df = spark.createDataFrame(pdf).repartition(6)
    got = SEL.select_quantiles(df, list(data), PROBS)
    for c, v in data.items():
        for p in PROBS:
            if c == "none":
                assert ("", c, p) not in got
            else:
                assert np.isclose(got[("", c, p)], np.nanquantile(v, p), rtol=1e-12, atol=0)
    few = SEL.select_quantiles(df.limit(0), ["u"], PROBS)
    assert few == {}
    one = SEL.select_quantiles(spark.createDataFrame([(3.5,), (None,)], "x double"), ["x"], [0.5])
    assert one == {("", "x", 0.5): 3.5}


def test_groups_are_separate(spark):
    rng = np.random.default_rng(1)
    rows = [(("a", "b", None)[i % 3], float(rng.normal() * (1 + i % 3)), i) for i in range(3000)] + [("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long").repartition(4)
    got = SEL.select_quantiles(df, ["v", "w"], [0.25, 0.5], F.col("g"))
    for g in ("a", "b"):
        v, w = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2))
        for p in (0.25, 0.5):
            assert np.isclose(got[(g, "v", p)], np.quantile(v, p)) and got[(g, "w", p)] == np.quantile(w, p)
    assert got[("c", "w", 0.5)] == 1.0 and ("c", "v", 0.5) not in got and not any(k[0] is None for k in got)
