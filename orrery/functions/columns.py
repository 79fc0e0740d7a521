"""Column helpers: nulls, casts and text as the engine's operators see them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a line of text besides CR LF.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CELL = 120


def missing(df: DataFrame, name: str) -> Column:
    """True for null, and for NaN in floating columns."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def normalised(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating columns, so that every aggregate ignores it."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in floating}) if floating else df


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers; booleans are not."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def as_text(column: Column, kind: T.DataType) -> Column:
    """A cell as text of at most 120 characters; nested values as JSON."""
    text = F.to_json(column) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else column.cast("string")
    return F.substring(text, 1, CELL)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent to two places; 0 if there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, 2))


def unpivot(row: DataFrame, columns: list[str], fields: list[str], kinds: list[str]) -> DataFrame:
    """One row for each of ``columns`` from the single row of an aggregate whose cells are named ``<place>_<field>``.

    Returns position, column and the fields, cast to ``kinds``.
    """
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *(F.col(f"{i}_{f}").cast(k).alias(f) for f, k in zip(fields, kinds, strict=True)))
        for i, c in enumerate(columns)
    ]
    kind = "array<struct<position:int,column:string," + ",".join(f"{f}:{k}" for f, k in zip(fields, kinds, strict=True)) + ">>"
    return row.select(F.explode(F.array(*cells).cast(kind)).alias("r")).select("r.*")


def make_valid_text(content: Column) -> Column:
    """Bytes as UTF-8 text without the bytes that aren't."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def exploded(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` and each element of ``array``. Of an outer explode no filter on the array is inferred, which would
    compute it again; what an empty or null array leaves is dropped afterwards."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def text_lines(text: Column) -> Column:
    """The lines of a text; a last line end makes no further line, and an empty text has none."""
    ended = F.regexp_replace(text, rf"(?:{LINE_ENDS})\z", "")  # so that the text is split once only
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(ended, LINE_ENDS, -1))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a Java pattern, in order; no match gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def found_once(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches in order of their first place."""
    return F.array_distinct(found(text, pattern, group))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it, also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def last_entries(entries: Column) -> Column:
    """A map of (k, v) structs; of repeated keys the last counts."""
    return let(entries, lambda rows: F.map_from_entries(F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda y: y["k"] == x["k"]))))


def first_by(rows: Column, key: Callable[[Column], Column]) -> Column:
    """The first of the elements that share a key, in order."""
    return let(rows, lambda r: let(F.transform(r, key), lambda keys: F.filter(r, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def sorted_set(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def kept(*conditions: tuple[Column, str]) -> Column:
    """The labels of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(label)) for c, label in conditions)))
