"""States of parts, merged, against the findings of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import anomaly, quantiles, states


def table(spark, seed, n):
    rng = random.Random(seed)
    rows = [(
        i, rng.choice([1.0, 2.0, float("nan"), None, 1e6 if rng.random() < 0.02 else 3.0]), 7, rng.choice([-1, 1, 2]), None if i % 3 else "x", str(1990 + i % 30), str(i % 14), [1, 2], rng.gauss(0, 1),
    ) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, v double, same int, neg int, few string, ano string, mes string, list array<int>, g double")


def told(df):
    return sorted(tuple(r) for r in df.select("kind", "column", F.coalesce("quantity", F.lit(0)), F.coalesce("pct", F.lit(0.0)), F.coalesce("detail", F.lit(""))).collect())


@pytest.mark.parametrize("n", [0, 5, 3000])
def test_merged_states_equal_a_full_run(spark, n):
    df, keys = table(spark, n, n), ["ano", "mes", "neg"]
    part = F.concat(F.lit("p"), (F.col("row_id") % 4).cast("string"))
    old = states.table_state(df.where("row_id % 4 < 3"), part), states.key_state(df.where("row_id % 4 < 3"), keys, part)
    new = states.table_state(df.where("row_id % 4 = 3"), "p3"), states.key_state(df.where("row_id % 4 = 3"), keys, "p3")
    got = states.findings_of(old[0].unionByName(new[0]), old[1].unionByName(new[1]), df, keys)
    assert told(got) == told(anomaly.detect(df, keys))


def test_a_bracket_that_misses_is_made_anew(spark):
    df = spark.createDataFrame([(float(i if i < 990 else i * 100),) for i in range(1000)], "x double")
    wrong = quantiles.Bracket(1000, 0.0, 99900.0, [(0.0, 1.0), (2.0, 3.0)])
    assert told(anomaly.iqr_by_brackets(df, {"x": wrong})) == told(anomaly.iqr_outliers(df)) != []


def test_columns_within_the_fences_are_not_read(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    kept = states.table_state(df, F.col("y"))
    monkeypatch.setattr(anomaly, "exact_quantiles", lambda *a, **k: pytest.fail("read"))
    assert told(states.findings_of(kept, None, df)) == []
