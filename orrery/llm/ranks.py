"""Exact ranks inside groups of any size, without one task ever holding a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(df: DataFrame, group: str, coarse: str, fine: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's rank from 1 among the rows of equal ``group``, ordered by (coarse, fine, *order).

    Rows are ranked inside small leaves (group, coarse, fine); the leaves' sizes are prefix-summed on two
    levels, so the largest window holds one leaf, the fine values of one coarse value, or the coarse values of
    one group. None of the three keys may be null.
    """
    leaf = [group, coarse, fine]
    ranked = df.withColumn("__in_leaf", F.row_number().over(Window.partitionBy(*leaf).orderBy(*order)))
    sizes = df.groupBy(*leaf).agg(F.count(F.lit(1)).alias("__n"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    by_fine = Window.partitionBy(group, coarse).orderBy(fine).rowsBetween(*so_far)
    by_coarse = Window.partitionBy(group).orderBy(coarse).rowsBetween(*so_far)
    fines = sizes.withColumn("__before_fine", F.sum("__n").over(by_fine) - F.col("__n"))
    coarses = sizes.groupBy(group, coarse).agg(F.sum("__n").alias("__m"))
    coarses = coarses.select(group, coarse, (F.sum("__m").over(by_coarse) - F.col("__m")).alias("__before_coarse"))
    base = fines.join(coarses, [group, coarse]).select(*leaf, (F.col("__before_fine") + F.col("__before_coarse")).alias("__base"))
    return ranked.join(base, leaf).withColumn(out, F.col("__base") + F.col("__in_leaf")).drop("__base", "__in_leaf")
