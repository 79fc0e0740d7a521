"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import checkpointed, shared_folder, stored  # noqa: F401  the operators take them from here

#: One word: a run of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, even where others differ from them in case only or hold dots."""
    at = {df.columns.index(name): name for name in names}
    return df.toDF(*(at.get(k, f"x{k}") for k in range(len(df.columns)))).select(*(F.col(f"`{name}`") for name in names))


def shielded(df: DataFrame, read: Sequence[str], made: Sequence[str] = (), keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with columns under names that an operator's own can't clash with, and the columns that it passes on.

    Those of exactly the names in ``read`` keep them, the others are called x0, x1, and so on. Passed on are the columns
    in ``keep`` (default: all), but those that are named as one of ``made``, whatever the case: the second list has their
    names here, the third what they are to be called again.
    """
    at = {df.columns.index(name): name for name in read}
    inner = [at.get(k, f"x{k}") for k in range(len(df.columns))]
    replaced = {name.lower() for name in made}
    passed = [k for k, c in enumerate(df.columns) if c.lower() not in replaced] if keep is None else [df.columns.index(c) for c in keep if c.lower() not in replaced]
    return df.toDF(*inner), [inner[k] for k in passed], [df.columns[k] for k in passed]


def schema(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with further columns of these kinds; a type, as names of nested fields needn't parse."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in more.items())])


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def hex_bits(text: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of md5(text), as a long: a hash that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")
