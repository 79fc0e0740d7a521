"""States of a table's parts that merge: what the findings need of each part, kept so that new parts don't rescan old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalised, numeric_columns, percent
from .anomaly import FINDING, iqr_by_brackets, year_and_month
from .quantiles import Bracket

#: Size of the sketches of quantiles, and how far from a quantile its bracket reaches, in shares of the rows. The sketch is
#: off by under half a percent nearly always; where a bracket turns out not to hold its quantile, the table is asked.
SKETCH, MARGIN = 1024, 0.02


def table_state(df: DataFrame, part: Column | str) -> DataFrame:
    """part, position, column and the column's state for each column of each part of a table: one pass, one shuffle of a row
    a task and part. ``part``: what rows belong to, or one label for all of them."""
    plain = normalised(df)
    label = F.lit(part) if isinstance(part, str) else part
    numbers = set(numeric_columns(plain))
    ranges = year_and_month(df.columns)
    n, states = F.count(F.lit(1)), []
    for i, f in enumerate(plain.schema.fields):
        x = F.col(f"`{f.name}`")
        ordered = f.dataType.typeName() not in ("map", "variant")
        whole = x.cast("string").try_cast("double").try_cast("long")
        _, low, high = ranges.get(f.name, (None, None, None))
        cells = {
            "n": n,
            "nulls": F.count_if(x.isNull()),
            "held": F.count(x),
            "same": F.min(x).eqNullSafe(F.max(x)) if ordered else F.lit(False),
            "value": F.to_json(F.struct(F.min(x).alias("v"))) if ordered else F.lit(None).cast("string"),
            "shown": F.min(x).cast("string") if ordered else F.lit(None).cast("string"),
            "below": F.count_if(x < 0) if f.name in numbers else F.lit(0).cast("long"),
            "outside": F.count_if(~whole.between(low, high)) if low is not None else F.lit(0).cast("long"),
            "least": F.min(x.cast("double")) if f.name in numbers else F.lit(None).cast("double"),
            "greatest": F.max(x.cast("double")) if f.name in numbers else F.lit(None).cast("double"),
            "sketch": F.kll_sketch_agg_double(x.cast("double"), SKETCH) if f.name in numbers else F.lit(None).cast("binary"),
        }
        states.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), *(c.alias(k) for k, c in cells.items())))
    aggregated = plain.groupBy(label.alias("part")).agg(F.array(*states).alias("states"))
    return aggregated.select("part", F.explode("states").alias("s")).select("part", "s.*")


def key_state(df: DataFrame, keys: list[str], part: Column | str) -> DataFrame:
    """part, key1, key2 (128 bits of the combination of ``keys``), whole (no key is null) and rows of each combination and part."""
    label = F.lit(part) if isinstance(part, str) else part
    columns = [F.col(f"`{k}`") for k in keys]
    named = [*columns, *(c.isNull() for c in columns)]  # hashes pass over nulls
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    rows = normalised(df).select(label.alias("part"), F.xxhash64(F.lit(1), *named).alias("key1"), F.xxhash64(F.lit(2), *named).alias("key2"), whole.alias("whole"))
    return rows.groupBy("part", "key1", "key2", "whole").agg(F.count(F.lit(1)).alias("rows"))


def merged(states: DataFrame) -> DataFrame:
    """One state a column of the states of all parts, or of some."""
    full = F.col("held") > 0
    return states.groupBy("position", "column").agg(
        *(F.sum(c).alias(c) for c in ("n", "nulls", "held", "below", "outside")),
        (F.coalesce(F.bool_and(F.when(full, F.col("same"))), F.lit(False)) & F.min(F.when(full, F.col("value"))).eqNullSafe(F.max(F.when(full, F.col("value"))))).alias("same"),
        F.min(F.when(full, F.col("shown"))).alias("shown"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def _brackets(state: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.75)) -> dict[str, Bracket]:
    """Of each numeric column what its merged sketch says of its quantiles: a row a column comes to the driver."""
    ranks = F.array(*(F.lit(min(1.0, max(0.0, p + d * MARGIN))) for p in probabilities for d in (-1, 1)))
    rows = state.where("least IS NOT NULL").orderBy("position").select("column", "held", "least", "greatest", F.kll_sketch_get_quantile_double("sketch", ranks).alias("ends"))
    out = {}
    for r in rows.collect():
        ends = list(r["ends"]) if r["held"] >= 1000 else [r["least"], r["greatest"]] * len(probabilities)
        out[r["column"]] = Bracket(r["held"], r["least"], r["greatest"], list(zip(ends[::2], ends[1::2], strict=True)))
    return out


def findings_of(states: DataFrame, keys: DataFrame | None, table: DataFrame, key_names: list[str] | None = None, least_pct: float = 50.0) -> DataFrame:
    """The findings that ``anomaly.detect`` has for the whole table, from the states of its parts.

    Only columns whose merged extremes lie beyond the fences that their merged sketch allows are read in ``table``, for exact
    quartiles. keys: the states of the combination of ``key_names``.
    """
    state = merged(states)
    ranges = year_and_month(table.columns)
    kind_of = F.create_map(*(F.lit(x) for c, (kind, _, _) in ranges.items() for x in (c, kind))) if ranges else F.create_map(F.lit(""), F.lit(""))
    null = {t: F.lit(None).cast(t) for t in ("long", "double", "string")}
    finding = lambda kind, quantity, pct, detail: F.struct(kind.alias("kind"), F.col("column"), quantity.cast("long").alias("quantity"), pct.alias("pct"), detail.alias("detail"))
    share = percent(F.col("nulls"), F.col("n"))
    told = F.array(
        F.when((F.col("n") > 0) & (share >= least_pct), finding(F.lit("muitos_nulos"), F.col("nulls"), share, null["string"])),
        F.when(F.col("same") & (F.col("held") > 0), finding(F.lit("coluna_constante"), null["long"], null["double"], F.col("shown"))),
        F.when(F.col("below") > 0, finding(F.lit("valores_negativos"), F.col("below"), null["double"], null["string"])),
        F.when(F.col("outside") > 0, finding(kind_of[F.col("column")], F.col("outside"), null["double"], null["string"])),
    )
    plain = state.select(F.explode(F.array_compact(told)).alias("f")).select("f.*")
    out = plain.unionByName(iqr_by_brackets(table, _brackets(state)))
    if keys is not None:
        twice = keys.groupBy("key1", "key2", "whole").agg(F.sum("rows").alias("rows")).where("rows > 1")
        row = twice.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("quantity"), F.count_if("whole").cast("string").alias("detail")).where("quantity > 0")
        out = out.unionByName(row.select(F.lit("duplicidade_combinacao").alias("kind"), F.lit(", ".join(key_names or [])).alias("column"), "quantity", null["double"].alias("pct"), "detail"))
    return out.select(*(c.split()[0] for c in FINDING.split(", ")))
