"""The line rules over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import make_valid_text
from ..operators.rules import RULES, Rule, apply_rules


def arriving_files(spark: SparkSession, path: str, glob: str = "*.php", per_batch: int = 1000) -> DataFrame:
    """A stream of path, text: files are read once, when they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return raw.select("path", make_valid_text(F.col("content")).alias("text"))


def stream_findings(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every arriving file: no state is kept, as a file is a row of its own."""
    return apply_rules(files, rules)
