"""Thin layer over collected results: Markdown tables, partitioned files, keys of payloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anomaly import FINDING, judged, ranking


def _cell(value) -> str:
    if isinstance(value, list | tuple):
        return ", ".join(_cell(v) for v in value)
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A titled Markdown table of the first ``most`` rows; nothing beyond them comes to the driver."""
    rows = df.limit(most).collect()
    head = f"## {title}\n\n"
    if not rows:
        return head + "Nothing found.\n"
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return head + "\n".join(lines + ["| " + " | ".join(_cell(v) for v in r) + " |" for r in rows]) + "\n"


def document(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    return f"# {title}\n\n" + "\n".join(markdown(df, name, most) for name, df in sections.items())


def radar_report(tables: Mapping[str, DataFrame], most: int = 20, each: int = 10) -> str:
    """The ranking of all tables, and of the first ``most`` with a score the first ``each`` findings. Each table is judged once."""
    spark, told = SparkSession.active(), judged(tables)
    parts = [markdown(ranking(spark, told), "Tables")]
    parts += [markdown(spark.createDataFrame(found, FINDING), name, each).replace("## ", "### ", 1) for name, found, _ in told[:most] if found]
    return "# Radar\n\n" + "\n".join(parts)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as Parquet, a folder for each severity."""
    findings.write.mode("overwrite").partitionBy("severity").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def payload_key(*columns: str | Column) -> Column:
    """SHA-256 of the columns as JSON: the key under which an outside analysis of them can be kept."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def analysis_input(records: DataFrame) -> DataFrame:
    """path, method, names: called classes and methods, then tables, then procedures with ``PROC:`` in front; distinct,
    in this order."""
    called = F.transform("calls", lambda c: F.concat_ws("::", F.nullif(c["class"], F.lit("")), c["method"]))
    procedures = F.transform("procedures", lambda p: F.concat(F.lit("PROC:"), p))
    return records.select("path", "method", F.array_distinct(F.concat(called, F.col("tables"), procedures)).alias("names"))
