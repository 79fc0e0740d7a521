"""Table structures from catalog rows, and graphs of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of types in graphs and what they are called here.
GRAPH_TYPES = {"int": "int4", "integer": "int4", "smallint": "int2", "bigint": "int8", "bit": "bpchar(1)", "datetime": "timestamp", "float": "numeric(15, 3)"}
_SIZED = ("varchar", "char", "nvarchar", "nchar", "binary", "varbinary")


def split_name(name: Column, default_schema: str = "_dbo") -> Column:
    """schema, name of ``[schema].[name]``; without a schema the default."""
    bare = F.regexp_replace(F.trim(name), r"[\[\]]", "")
    dotted = bare.contains(".")
    return F.struct(F.when(dotted, F.substring_index(bare, ".", 1)).otherwise(default_schema).alias("schema"), F.when(dotted, F.regexp_replace(bare, r"^[^.]*\.", "")).otherwise(bare).alias("name"))


def format_type(kind: Column, length: Column, precision: Column, scale: Column, bytes_: bool = False) -> Column:
    """A column's type as SQL writes it: length -1 is max. bytes_: lengths of national types are in bytes, two a letter."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    letters = F.when(k.isin("nvarchar", "nchar"), F.floor(length / 2)).otherwise(length) if bytes_ else length
    both = precision.isNotNull() & scale.isNotNull()
    return (
        F.when(k.isin(*_SIZED) & (length == -1), F.concat(k, F.lit("(max)")))
        .when(k.isin(*_SIZED) & length.isNotNull(), F.concat(k, F.lit("("), letters.cast("string"), F.lit(")")))
        .when(k.isin("decimal", "numeric") & both, F.concat(k, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(k.isin("float", "real") & precision.isNotNull() & F.lit(not bytes_), F.concat(k, F.lit("("), precision.cast("string"), F.lit(")")))
        .when(k.isin("datetime2", "time", "datetimeoffset") & scale.isNotNull() & F.lit(bytes_), F.concat(k, F.lit("("), scale.cast("string"), F.lit(")")))
        .otherwise(k)
    )


def structure(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Catalog rows of columns with their formatted type and whether they are part of the primary key.

    columns: TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE, CHARACTER_MAXIMUM_LENGTH,
    NUMERIC_PRECISION, NUMERIC_SCALE, IS_NULLABLE; keys: TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME.
    """
    on = ["TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME"]
    flagged = columns.join(keys.select(*on).distinct().withColumn("__pk", F.lit(True)), on, "left")
    kind = format_type(F.col("DATA_TYPE"), F.col("CHARACTER_MAXIMUM_LENGTH"), F.col("NUMERIC_PRECISION"), F.col("NUMERIC_SCALE"))
    return flagged.select(*on, "ORDINAL_POSITION", kind.alias("type"), (F.col("IS_NULLABLE") == "YES").alias("nullable"), F.col("__pk").isNotNull().alias("is_pk"))


def structure_report(columns: DataFrame, keys: DataFrame, foreign: DataFrame, indexes: DataFrame) -> DataFrame:
    """A row for each table: counts and nested lists of columns, key columns, foreign keys and indexes."""
    t = ["TABLE_SCHEMA", "TABLE_NAME"]
    cols = structure(columns, keys).groupBy(*t).agg(F.sort_array(F.collect_list(F.struct("ORDINAL_POSITION", "COLUMN_NAME", "type", "nullable", "is_pk"))).alias("columns"))
    fks = foreign.groupBy(F.col("PARENT_SCHEMA").alias(t[0]), F.col("PARENT_TABLE").alias(t[1])).agg(F.sort_array(F.collect_list(F.struct("FK_NAME", "PARENT_COLUMN", "REFERENCED_SCHEMA", "REFERENCED_TABLE", "REFERENCED_COLUMN"))).alias("foreign_keys"))
    named = indexes.where(F.col("INDEX_NAME").isNotNull())
    idx = named.groupBy(*t).agg(F.sort_array(F.collect_list(F.struct("INDEX_NAME", "KEY_ORDINAL", "COLUMN_NAME", "IS_UNIQUE", "INDEX_TYPE"))).alias("indexes"))
    out = cols.join(fks, t, "left").join(idx, t, "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) if c != "columns" else F.size(c)
    return out.select(*t, F.size("columns").alias("n_columns"), F.size(F.filter("columns", lambda x: x["is_pk"])).alias("n_pk"), F.greatest(size("foreign_keys"), F.lit(0)).alias("n_fk"), F.size(F.array_distinct(F.coalesce(F.transform("indexes", lambda x: x["INDEX_NAME"]), F.array().cast("array<string>")))).alias("n_indexes"), "columns", "foreign_keys", "indexes")


def graph_type(name: Column) -> Column:
    """A type in a graph by its name here; none is unknown."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(n == "", "unknown").otherwise(F.coalesce(F.create_map(*(F.lit(x) for kv in GRAPH_TYPES.items() for x in kv))[n], n))


def parse_columns(text: Column, strict: bool = True) -> Column:
    """Lines ``name: type`` as an array of name, type; split at the first colon. strict: types get their names
    here; otherwise they stay as they are, and none is null."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lit(not strict) | ~x.rlike("^(<|y:)")))
    name = lambda x: F.lower(F.regexp_replace(x, "[ /]", "_")) if strict else x
    return F.transform(lines, lambda x: F.struct(name(F.trim(F.substring_index(x, ":", 1))).alias("name"), (graph_type if strict else F.trim)(F.when(x.contains(":"), F.regexp_replace(x, "^[^:]*:", ""))).alias("type")))


def resolve_edges(edges: DataFrame, entities: DataFrame, strict: bool = True) -> DataFrame:
    """Edges (id, source_id, target_id) with the names of their ends; a missing id is ``edge<n>``.

    strict: both ends must be known; otherwise unknown ones have no name.
    """
    how = "inner" if strict else "left"
    a = entities.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    b = entities.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return edges.join(a, "source_id", how).join(b, "target_id", how).select("id", "source_id", "source_name", "target_id", "target_name")


def foreign_key_coverage(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """rows, matched, orphans, pct_matched of a foreign key (nulls left out), by one semi-join flag."""
    keys = parent.select(F.col(parent_key).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__hit", F.lit(1))
    rows = child.select(F.col(child_key).alias("__k")).where("__k IS NOT NULL").groupBy("__k").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.join(keys, "__k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("__hit") == 1, F.col("n"))), F.lit(0)).alias("matched"))
    return counted.select("rows", "matched", (F.col("rows") - F.col("matched")).alias("orphans"), F.when(F.col("rows") == 0, 0.0).otherwise(F.round(F.col("matched") / F.col("rows") * 100, 2)).alias("pct_matched"))
