"""What calls and includes reach over any number of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded
from ..shared import checkpointed
from .code import classes, includes, resolve_includes, resolved_calls


def reach(edges: DataFrame, starts: DataFrame | None = None, most_levels: int | None = None) -> DataFrame:
    """start, node, level: every node that a start reaches over one edge or more, and over how few.

    edges: source, target. starts: one column ``start``; by default all sources. most_levels stops there.
    Semi-naive: a round joins only the pairs that the last one found with the edges, drops those known, and
    checkpoints the rest, so cycles end and lineage doesn't grow; the number of rounds is the greatest level. Null ends are no
    edges, repeated ones count once, and a node on a cycle reaches itself. No edges give no rows. Pairs are as many as the
    answer has: name ``starts`` where the edges are many.
    """
    edges = checkpointed(edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct())
    new = edges.select(F.col("source").alias("start"), F.col("target").alias("node"))
    if starts is not None:
        new = new.join(starts.select("start").distinct(), "start", "left_semi")
    new = checkpointed(new.withColumn("level", F.lit(1)))
    known, level = new, 1
    while (most_levels is None or level < most_levels) and not new.isEmpty():
        level += 1
        next_ = new.join(edges, new["node"] == edges["source"]).select("start", F.col("target").alias("node")).distinct()
        new = checkpointed(next_.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("level", F.lit(level)))
        known = known.unionByName(new)
    return known


def call_edges(found_methods: DataFrame, files: DataFrame) -> DataFrame:
    """source, target: ``path::method`` of a caller and of the method that it calls on an object of a known class.

    A call whose class or method is in none of the files has no edge. Of methods of one name in a file the first counts.
    """
    index = classes(files).select(F.col("name").alias("class"), F.col("path").alias("class_path"))
    made = exploded(found_methods, resolved_calls(F.col("body")), "c", "path", "method").where("c.class <> ''")
    calls = made.select(F.concat_ws("::", "path", "method").alias("source"), F.col("c.class").alias("class"), F.concat(F.lit("::"), F.col("c.method")).alias("called"))
    there = found_methods.select(F.concat_ws("::", "path", "method").alias("target")).distinct()
    return calls.join(index, "class").select("source", F.concat("class_path", "called").alias("target")).join(there, "target", "left_semi").select("source", "target").distinct()


def call_closure(found_methods: DataFrame, files: DataFrame, starts: DataFrame | None = None, most_levels: int | None = None) -> DataFrame:
    """start, node, level over calls; both are ``path::method``."""
    return reach(call_edges(found_methods, files), starts, most_levels)


def include_edges(files: DataFrame, root: str = "") -> DataFrame:
    """source, target: paths of a file and of those that it includes; includes that aren't found have no edge."""
    asked = exploded(files, includes(F.col("text")), "include", "path")
    return resolve_includes(asked, files, root).where("found").select(F.col("path").alias("source"), "target").distinct()


def include_closure(files: DataFrame, starts: DataFrame | None = None, most_levels: int | None = None, root: str = "") -> DataFrame:
    """start, node, level over include and require statements; both are paths."""
    return reach(include_edges(files, root), starts, most_levels)


def included_parts(files: DataFrame, parts: DataFrame, starts: DataFrame | None = None, most_levels: int | None = None, root: str = "") -> DataFrame:
    """start, path, level and the columns of ``parts`` (path, ...) of every file that a start is or includes.

    So the actions, endpoints or tables of a page are found however deep its includes go; level 0 is the start itself.
    """
    own = (files.select("path") if starts is None else starts.select(F.col("start").alias("path"))).distinct()
    nodes = include_closure(files, starts, most_levels, root).select("start", F.col("node").alias("path"), "level")
    itself = own.select(F.col("path").alias("start"), "path", F.lit(0).alias("level"))
    nodes = nodes.where(F.col("start") != F.col("path")).unionByName(itself)
    return nodes.join(parts, "path").select("start", "path", "level", *(c for c in parts.columns if c != "path"))
