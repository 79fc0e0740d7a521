"""Column profiles of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, missing, normalised, numeric_columns, percent, unpivot

# A column whose name holds one of these is taken for a date.
DATE_HINTS = ("data", "dt_", "_dt", "date", "ano", "mes", "exercicio", "vigencia", "periodo", "prazo")
# Fixed value: what a text that is a date looks like.
DATE_PATTERN = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"
_FORMATS = ("y-M-d H:m:s", "y-M-d H:m", "y-M-d", "d-M-y", "d-M-yy")


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, pct_nulls (of all rows, two places), most nulls first, then by name. NaN is a null.

    One aggregate over the table. A table without rows has no profile.
    """
    cells = [F.count_if(missing(df, c)).alias(f"{i}_nulls") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *cells).where("n > 0")
    both = row.withColumns({f"{i}_pct_nulls": percent(F.col(f"{i}_nulls"), F.col("n")) for i in range(len(df.columns))})
    return unpivot(both, df.columns, ["nulls", "pct_nulls"], ["long", "double"]).drop("position").orderBy(F.desc("nulls"), "column")


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, distinct (non-null values), pct_distinct (of all rows; 0 without rows), in column order.

    Exact counts of several columns are one pass with the values dealt by column and value; ``approximate``
    keeps a sketch for each column instead, which needs no shuffle of values.
    """
    df = normalised(df)
    count = F.approx_count_distinct if approximate else F.count_distinct
    cells = [count(_groupable(F.col(f"`{f.name}`"), f.dataType)).alias(f"{i}_distinct") for i, f in enumerate(df.schema.fields)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *cells)
    both = row.withColumns({f"{i}_pct_distinct": percent(F.col(f"{i}_distinct"), F.col("n")) for i in range(len(df.columns))})
    return unpivot(both, df.columns, ["distinct", "pct_distinct"], ["long", "double"]).orderBy("position").drop("position")


def _groupable(column: Column, kind: T.DataType) -> Column:
    return F.to_json(column) if isinstance(kind, T.MapType) else column


def column_duplicates(df: DataFrame) -> DataFrame:
    """column, duplicated_rows, pct_duplicated: rows whose value occurs twice or more, nulls being equal.

    Every occurrence counts. Columns of nulls only are left out. All columns are counted in one shuffle of
    (column, value) pairs, added up before it.
    """
    df = normalised(df)
    values = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), _text(F.col(f"`{f.name}`"), f.dataType).alias("value")) for i, f in enumerate(df.schema.fields)]
    counts = df.select(F.explode(F.array(*values)).alias("r")).groupBy("r.position", "r.column", "r.value").agg(F.count(F.lit(1)).alias("n"))
    by_column = counts.groupBy("position", "column").agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated_rows"), F.sum("n").alias("rows"), F.count("value").alias("values")
    )
    shares = by_column.where("values > 0").withColumn("pct_duplicated", percent(F.col("duplicated_rows"), F.col("rows")))
    return shares.orderBy("position").select("column", "duplicated_rows", "pct_duplicated")


def _text(column: Column, kind: T.DataType) -> Column:
    return F.to_json(column) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else column.cast("string")


def looks_like_date(name: str | None) -> bool:
    """Whether a column's name hints at a date."""
    return any(hint in (name or "").strip().lower() for hint in DATE_HINTS)


def to_date(text: Column) -> Column:
    """A text as a timestamp, null if none of the formats fits. Year first, else day first."""
    plain = F.replace(F.replace(text, F.lit("/"), F.lit("-")), F.lit("T"), F.lit(" "))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in _FORMATS))


def date_text_columns(df: DataFrame, sample: int = 20) -> list[str]:
    """Text columns whose name and first values look like dates: of at most ``sample`` non-null values at least
    half, and at least three, are dates. One small read for each column with such a name."""
    named = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and looks_like_date(f.name)]
    out = []
    for name in named:
        value = F.col(f"`{name}`")
        first = df.where(value.isNotNull()).select(value.alias("v")).limit(sample)
        n, dates = first.agg(F.count(F.lit(1)), F.count_if(F.col("v").rlike(DATE_PATTERN))).first()
        if n and dates >= max(3, n // 2):
            out.append(name)
    return out


def date_ranges(df: DataFrame) -> DataFrame:
    """column, first, last (as text yyyy-MM-dd HH:mm:ss) of true date columns and of texts that look like dates."""
    true = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    texts = set(date_text_columns(df))
    columns = [c for c in df.columns if c in true or c in texts]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, first string, last string")
    value = lambda c: to_date(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`").cast("timestamp_ntz")
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    cells = [a for i, c in enumerate(columns) for a in (shown(F.min(value(c))).alias(f"{i}_first"), shown(F.max(value(c))).alias(f"{i}_last"))]
    ranges = unpivot(df.agg(*cells), columns, ["first", "last"], ["string", "string"])
    return ranges.where(F.col("first").isNotNull()).orderBy("position").drop("position")


def column_types(df: DataFrame) -> DataFrame:
    """column, type, in column order."""
    return df.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(df.dtypes)], "position int, column string, type string").orderBy("position").drop("position")


def numeric_stats(df: DataFrame) -> DataFrame:
    """column, count, mean, std (of a sample), min, max of each numeric column, in column order."""
    df = normalised(df)
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, max double")
    cells = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        cells += [F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"), F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max")]
    return unpivot(df.agg(*cells), columns, ["count", "mean", "std", "min", "max"], ["long", *["double"] * 4]).orderBy("position").drop("position")


def sample_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in this order, cells as text of at most 120 characters, null as ``NULL``."""
    top = df.orderBy(*order).limit(n)
    return top.select(*(F.coalesce(as_text(F.col(f"`{f.name}`"), f.dataType), F.lit("NULL")).alias(f.name) for f in df.schema.fields))


def profile(df: DataFrame, order: list[str] | None = None) -> dict[str, DataFrame]:
    """All of the above by name, and ``shape``: rows, columns."""
    shape = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    return {
        "shape": shape,
        "types": column_types(df),
        "nulls": null_profile(df),
        "cardinality": cardinality(df),
        "duplicates": column_duplicates(df),
        "dates": date_ranges(df),
        "numeric": numeric_stats(df),
        "sample": sample_rows(df, order or df.columns[:1]),
    }
