import numpy as np
import pandas as pd

from orrery.operators import anomaly
from orrery.operators.quantiles import exact_quantiles


def test_equal_numpy(spark):
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"a": rng.normal(size=30_011), "b": rng.integers(0, 5, 30_011), "c": np.r_[np.zeros(29_000), rng.exponential(size=1011)]})
    got = {(r["position"], r["k"]): r["value"] for r in exact_quantiles(spark.createDataFrame(df), list(df.columns)).collect()}
    want = {(i, k): df[c].quantile(p) for i, c in enumerate(df.columns) for k, p in enumerate((0.25, 0.75))}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    one = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert {(r["position"], r["k"]): r["value"] for r in exact_quantiles(one, ["a", "b"]).collect()} == {(0, 0): 1.75, (0, 1): 3.25}
    assert exact_quantiles(one.limit(0), ["a", "b"]).count() == 0


def test_outliers(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(20)] + [(500.0, 1), (float("nan"), 1)], "v double, same int")
    assert [(r["column"], r["quantity"]) for r in anomaly.iqr_outliers(df).collect()] == [("v", 1)]
    assert anomaly.iqr_outliers(df.limit(7)).count() == 0
