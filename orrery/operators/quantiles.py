"""Exact quantiles of several columns, for any number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000
_BUCKETS = 4096
_MARGIN = 0.005


@dataclass(frozen=True)
class Bracket:
    """Of one column: number of values, least, greatest, and two values that hold each quantile between them."""

    n: int
    least: float | None
    greatest: float | None
    around: list[tuple[float, float]]


def brackets(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.75)) -> list[Bracket]:
    """A bracket for each column, from one pass with a sketch. Nulls are left out and NaN must not occur."""
    if not columns:
        return []
    wide = [max(0.0, min(1.0, p + d * _MARGIN)) for p in probabilities for d in (-1, 1)]
    n = len(columns)
    cells = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    told = cells.agg(*(F.percentile_approx(f"x{i}", wide, _ACCURACY) for i in range(n)), *(f(f"x{i}") for f in (F.count, F.min, F.max) for i in range(n))).first()
    out = []
    for i in range(n):
        count, least, greatest = told[n + i], told[2 * n + i], told[3 * n + i]
        # of few values the bracket could miss a neighbour, so it is all of them
        ends = told[i] if count >= 10 / _MARGIN else [least, greatest] * len(probabilities)
        out.append(Bracket(count, least, greatest, list(zip(ends[::2], ends[1::2], strict=True))))
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.75), told: list[Bracket] | None = None) -> DataFrame:
    """position (of the column), k (of the probability), n (values), value: quantiles interpolated linearly.

    Nulls are left out and NaN must not occur. A sketch first brackets every quantile within half a percent of the
    rows; it is taken at once, as merged sketches may differ from run to run and all that follows must see the
    same brackets. The values in a bracket fall into 4096 equal buckets, whose counts tell which one or two hold the
    wanted ranks, and only those are sorted. So the largest sort is of some millionths of the rows, and ties are counted
    first, where the built-in exact percentile keeps all distinct values in one task. told: brackets made before.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "position int, k int, n long, value double")
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    cells = df.select(*(v.alias(f"x{i}") for i, v in enumerate(x)))
    told = brackets(df, columns, probabilities) if told is None else told
    pairs = [(i, k) for i, t in enumerate(told) if t.n for k in range(len(probabilities))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "position int, k int, n long, value double")
    low, high = (lambda i, k: F.lit(told[i].around[k][0])), (lambda i, k: F.lit(told[i].around[k][1]))
    counts = [F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))]
    below = [F.count_if(F.col(f"x{i}") < low(i, k)).alias(f"b{i}_{k}") for i, k in pairs]
    row = cells.agg(*counts, *below)
    wanted = row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(k).alias("k"), F.col(f"n{i}").alias("n"), F.col(f"b{i}_{k}").alias("below"), ((F.col(f"n{i}") - 1) * probabilities[k]).alias("at")) for i, k in pairs))).alias("w")).select("w.*").where("n > 0")
    inside = F.array_compact(
        F.array(
            *(
                F.when(
                    F.col(f"x{i}").between(low(i, k), high(i, k)),
                    F.struct(F.lit(i).alias("position"), F.lit(k).alias("k"), F.col(f"x{i}").alias("v"), _bucket(F.col(f"x{i}"), low(i, k), high(i, k)).alias("bucket")),
                )
                for i, k in pairs
            )
        )
    )
    values = cells.select(F.explode(inside).alias("r")).select("r.*").groupBy("position", "k", "bucket", "v").agg(F.count(F.lit(1)).alias("m"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    by_bucket = Window.partitionBy("position", "k").orderBy("bucket").rowsBetween(*so_far)
    sizes = values.groupBy("position", "k", "bucket").agg(F.sum("m").alias("size")).withColumn("before", F.sum("size").over(by_bucket) - F.col("size"))
    first, last = F.floor("at") - F.col("below"), F.ceil("at") - F.col("below")
    touched = sizes.join(F.broadcast(wanted), ["position", "k"]).where((F.col("before") <= last) & (F.col("before") + F.col("size") > first))
    by_value = Window.partitionBy("position", "k", "bucket").orderBy("v").rowsBetween(*so_far)
    near = values.join(F.broadcast(touched), ["position", "k", "bucket"]).withColumn("upto", F.col("before") + F.sum("m").over(by_value))
    has = lambda rank: (F.col("upto") - F.col("m") <= rank) & (F.col("upto") > rank)
    ends = near.groupBy("position", "k", "n", "at").agg(F.max(F.when(has(first), F.col("v"))).alias("a"), F.max(F.when(has(last), F.col("v"))).alias("b"))
    return ends.select("position", "k", "n", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))


def _bucket(v, low, high):
    place = F.nanvl((v - low) / F.when(high > low, high - low) * _BUCKETS, F.lit(0.0))
    return F.coalesce(F.least(place, F.lit(_BUCKETS - 1.0)).cast("int"), F.lit(0))
