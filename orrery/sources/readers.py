"""Readers: tables, SQL, files of text, graphs and maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import make_valid_text
from ..operators.catalog import parse_columns
from .embedded import EDGE, NODE, node_label

# Folders that hold no program text of one's own, and names of map files in order of preference.
IGNORED = (".git", "vendor", "node_modules", "__pycache__", ".idea", ".vscode")
MAP_NAMES = ("domain_map.json", "domain_map_refined.json", "map.json", "domain.json")
DEFAULT_ROWS = 200


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table or ``(query) alias`` over JDBC; filters, columns and limits are pushed to the database by Spark.

    key: a column of numbers, dates or times by whose range the rows are read in ``partitions`` parts at once; a first query asks
    for its least and greatest value. Null keys are in the first part. Without a key, or with nothing in it, the table is one
    part. A key whose values bunch makes uneven parts: choose one that numbers the rows.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("dbtable", table).load()
    quoted = '"' + key.replace('"', '""') + '"'
    first = reader.option("dbtable", f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}) bounds").load().first()
    whole = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table)
    if first[0] is None or first[0] == first[1]:
        return whole.load()
    upper = first[1] if not isinstance(first[1], int) else first[1] + 1  # the last part is as wide as the others
    return whole.option("partitionColumn", quoted).option("lowerBound", str(first[0])).option("upperBound", str(upper)).option("numPartitions", partitions).load()


def clean_query(query: str | None) -> str | None:
    """A query without closing semicolons, one pair of outer quotes and blank lines at its ends."""
    if not query:
        return query
    q = re.sub(r";+\s*$", "", query.strip())
    if len(q) > 1 and q[0] == q[-1] and q[0] in "'\"":
        q = q[1:-1].strip()
    q = re.sub(r";+\s*$", "", q)
    return "\n".join(line.rstrip() for line in q.splitlines()).strip()


def rewrite_top(query: str) -> str:
    """``SELECT TOP n ...`` as ``SELECT ... LIMIT n``."""
    m = re.match(r"(?is)^\s*select\s+top\s*\(?\s*(\d+)\s*\)?\s+(.*)$", query)
    return f"SELECT {m[2].rstrip()} LIMIT {m[1]}" if m else query


def load(spark: SparkSession, table: str | None = None, query: str | None = None, limit: int | None = DEFAULT_ROWS, order: list[str] | None = None) -> DataFrame:
    """A query's result, or a table's first ``limit`` rows in ``order`` (all rows if None). The query wins over the table.

    Only queries are run: text that begins with another verb than SELECT, WITH, VALUES, FROM or TABLE is refused.
    """
    if query:
        text = rewrite_top(clean_query(query) or "")
        if not re.match(r"(?i)\s*\(*\s*(select|with|values|from|table)\b", text):
            raise ValueError("only queries can be run")
        return spark.sql(text)
    if not table:
        raise ValueError("a table or a query is needed")
    df = spark.table(table)
    return df if limit is None else (df.orderBy(*(order or df.columns[:1])).limit(limit))


def list_tables(spark: SparkSession, schemas: list[str] | None = None, views: bool = True) -> DataFrame:
    """schema, name, kind of the catalog's tables, by schema and name."""
    rows = []
    for db in schemas or [d.name for d in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(db):
            view = t.tableType in ("VIEW", "TEMPORARY")
            if views or not view:
                rows.append((".".join(t.namespace or []), t.name, "view" if view else "table"))
    return spark.createDataFrame(sorted(set(rows)), "schema string, name string, kind string").orderBy("schema", "name")


def connection_info(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.current_catalog().alias("catalog"), F.current_database().alias("database"), F.current_user().alias("user"), F.version().alias("version"))


def files(spark: SparkSession, path: str, glob: str = "*.php", ignore: tuple[str, ...] = IGNORED) -> DataFrame:
    """path, length, modified, text of all files below a path; bytes that aren't UTF-8 are dropped.

    Files in an ignored folder are left out before their content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    if ignore:
        raw = raw.where(~F.col("path").rlike("/(" + "|".join(map(re.escape, ignore)) + ")/"))
    return raw.select("path", "length", F.col("modificationTime").alias("modified"), make_valid_text(F.col("content")).alias("text"))


def all_program_files(spark: SparkSession, path: str) -> DataFrame:
    """Program files of three endings, with no folder ignored."""
    return files(spark, path, "*.{php,inc,phtml}", ())


def graphml(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """entities (id, name, columns) and edges (id, source_id, target_id) of a GraphML file with yWorks labels.

    strict: nodes without id or name are left out, names and types of columns are normalised, an edge without id is
    ``edge<its place from 0>``; otherwise all stay as they are.
    """
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    entities = nodes.select(F.col("_id").alias("id"), F.trim(node_label(F.col("data"), "name")).alias("name"), parse_columns(node_label(F.col("data"), "attributes"), strict).alias("columns"))
    if strict:
        entities = entities.where("id IS NOT NULL AND name IS NOT NULL AND name <> ''")
    edge = spark.read.format("xml").option("rowTag", "edge").schema(EDGE).load(path)
    # an edge without id is numbered by its place in the file; only those without are looked at again
    spread = edge.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = spread.withColumn("part", part).join(F.broadcast(offsets), "part")
    place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    number = F.concat(F.lit("edge"), place.cast("string")) if strict else F.lit(None)
    named = placed.select(F.coalesce("_id", number).alias("id"), F.col("_source").alias("source_id"), F.col("_target").alias("target_id"))
    return entities, named


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object: of the folder's files the preferred names first, then any domain map, then the first."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(*(F.when(name == n, F.lit(i)) for i, n in enumerate(MAP_NAMES)), F.when(name.contains("domain_map"), F.lit(len(MAP_NAMES))), F.lit(len(MAP_NAMES) + 1))
    best = listed.orderBy(rank, "path").limit(1).first()
    if best is None:
        raise FileNotFoundError(path)
    return spark.read.option("multiLine", "true").json(best[0])


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """domain (folder), name of all JSON files below a path, sorted."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    parts = F.split("path", "/")
    return listed.select(F.element_at(parts, -2).alias("domain"), F.element_at(parts, -1).alias("name")).orderBy("domain", "name")
