"""Catalogs of databases over JDBC, by dialect, as rows that ``operators.catalog`` takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = "SELECT s.name AS [schema], o.name AS name, o.type AS kind FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id WHERE o.is_ms_shipped = 0 AND o.type IN ('U', 'V')"
_COLUMNS = """SELECT TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE, CHARACTER_MAXIMUM_LENGTH, NUMERIC_PRECISION,
NUMERIC_SCALE, IS_NULLABLE, COLUMN_DEFAULT, COLUMNPROPERTY(OBJECT_ID(QUOTENAME(TABLE_SCHEMA) + '.' + QUOTENAME(TABLE_NAME)), COLUMN_NAME, 'IsIdentity') AS IS_IDENTITY
FROM INFORMATION_SCHEMA.COLUMNS"""
_KEYS = """SELECT k.TABLE_SCHEMA, k.TABLE_NAME, k.CONSTRAINT_NAME, k.COLUMN_NAME, k.ORDINAL_POSITION FROM INFORMATION_SCHEMA.KEY_COLUMN_USAGE k
JOIN INFORMATION_SCHEMA.TABLE_CONSTRAINTS c ON c.CONSTRAINT_SCHEMA = k.CONSTRAINT_SCHEMA AND c.CONSTRAINT_NAME = k.CONSTRAINT_NAME WHERE c.CONSTRAINT_TYPE = 'PRIMARY KEY'"""
_FOREIGN = """SELECT f.name AS FK_NAME, OBJECT_SCHEMA_NAME(f.parent_object_id) AS PARENT_SCHEMA, OBJECT_NAME(f.parent_object_id) AS PARENT_TABLE,
COL_NAME(c.parent_object_id, c.parent_column_id) AS PARENT_COLUMN, OBJECT_SCHEMA_NAME(f.referenced_object_id) AS REFERENCED_SCHEMA,
OBJECT_NAME(f.referenced_object_id) AS REFERENCED_TABLE, COL_NAME(c.referenced_object_id, c.referenced_column_id) AS REFERENCED_COLUMN
FROM sys.foreign_keys f JOIN sys.foreign_key_columns c ON c.constraint_object_id = f.object_id"""
_INDEXES = """SELECT OBJECT_SCHEMA_NAME(i.object_id) AS TABLE_SCHEMA, OBJECT_NAME(i.object_id) AS TABLE_NAME, i.name AS INDEX_NAME, i.is_unique AS IS_UNIQUE,
i.type_desc AS INDEX_TYPE, COL_NAME(c.object_id, c.column_id) AS COLUMN_NAME, c.key_ordinal AS KEY_ORDINAL
FROM sys.indexes i JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id WHERE i.name IS NOT NULL"""
_PROCEDURES = """SELECT s.name AS [schema], p.name AS name, p.create_date AS created, p.modify_date AS modified, m.definition AS definition
FROM sys.procedures p JOIN sys.schemas s ON s.schema_id = p.schema_id LEFT JOIN sys.sql_modules m ON m.object_id = p.object_id"""
_PARAMETERS = """SELECT OBJECT_SCHEMA_NAME(r.object_id) AS [schema], OBJECT_NAME(r.object_id) AS [procedure], r.parameter_id AS position, r.name AS name,
TYPE_NAME(r.user_type_id) AS type, r.max_length, r.precision, r.scale, r.is_output FROM sys.parameters r JOIN sys.procedures p ON p.object_id = r.object_id"""
_DEPENDENCIES = """SELECT DISTINCT OBJECT_SCHEMA_NAME(d.referencing_id) AS [schema], OBJECT_NAME(d.referencing_id) AS [procedure],
COALESCE(OBJECT_SCHEMA_NAME(d.referenced_id), d.referenced_schema_name) AS referenced_schema, COALESCE(OBJECT_NAME(d.referenced_id), d.referenced_entity_name) AS referenced
FROM sys.sql_expression_dependencies d"""

# Derby: types, defaults and the columns of an index come as text and are taken apart by Spark.
_DERBY_OF = "JOIN SYS.SYSTABLES t ON t.TABLEID = {} JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID"
_DERBY_TABLES = "SELECT s.SCHEMANAME AS \"schema\", t.TABLENAME AS \"name\", CASE t.TABLETYPE WHEN 'T' THEN 'U' ELSE 'V' END AS \"kind\" FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID WHERE t.TABLETYPE IN ('T', 'V')"
_DERBY_COLUMNS = f"""SELECT s.SCHEMANAME, t.TABLENAME, c.COLUMNNAME, c.COLUMNNUMBER, CAST(c.COLUMNDATATYPE AS VARCHAR(128)) AS KIND, CAST(c.COLUMNDEFAULT AS VARCHAR(128)) AS PRESET,
CASE WHEN c.AUTOINCREMENTINC IS NULL THEN 0 ELSE 1 END AS IDENTITY_ FROM SYS.SYSCOLUMNS c {_DERBY_OF.format("c.REFERENCEID")} WHERE t.TABLETYPE IN ('T', 'V')"""
_DERBY_KEYS = f"""SELECT s.SCHEMANAME, t.TABLENAME, k.CONSTRAINTNAME AS NAME, CAST(g.DESCRIPTOR AS VARCHAR(128)) AS PLACES FROM SYS.SYSCONSTRAINTS k {_DERBY_OF.format("k.TABLEID")}
JOIN SYS.SYSKEYS y ON y.CONSTRAINTID = k.CONSTRAINTID JOIN SYS.SYSCONGLOMERATES g ON g.CONGLOMERATEID = y.CONGLOMERATEID WHERE k.TYPE = 'P'"""
_DERBY_FOREIGN = f"""SELECT s.SCHEMANAME, t.TABLENAME, k.CONSTRAINTNAME AS NAME, CAST(g.DESCRIPTOR AS VARCHAR(128)) AS PLACES, s2.SCHEMANAME AS SCHEMA2, t2.TABLENAME AS TABLE2, CAST(g2.DESCRIPTOR AS VARCHAR(128)) AS PLACES2
FROM SYS.SYSCONSTRAINTS k {_DERBY_OF.format("k.TABLEID")} JOIN SYS.SYSFOREIGNKEYS f ON f.CONSTRAINTID = k.CONSTRAINTID JOIN SYS.SYSCONGLOMERATES g ON g.CONGLOMERATEID = f.CONGLOMERATEID
JOIN SYS.SYSCONSTRAINTS k2 ON k2.CONSTRAINTID = f.KEYCONSTRAINTID JOIN SYS.SYSKEYS y2 ON y2.CONSTRAINTID = k2.CONSTRAINTID JOIN SYS.SYSCONGLOMERATES g2 ON g2.CONGLOMERATEID = y2.CONGLOMERATEID
JOIN SYS.SYSTABLES t2 ON t2.TABLEID = k2.TABLEID JOIN SYS.SYSSCHEMAS s2 ON s2.SCHEMAID = t2.SCHEMAID"""
_DERBY_INDEXES = f"""SELECT s.SCHEMANAME, t.TABLENAME, g.CONGLOMERATENAME AS NAME, CAST(g.DESCRIPTOR AS VARCHAR(128)) AS PLACES FROM SYS.SYSCONGLOMERATES g {_DERBY_OF.format("g.TABLEID")}
WHERE g.ISINDEX AND t.TABLETYPE = 'T'"""

QUERIES = {
    "sqlserver": {"tables": _TABLES, "columns": _COLUMNS, "keys": _KEYS, "foreign_keys": _FOREIGN, "indexes": _INDEXES, "procedures": _PROCEDURES, "parameters": _PARAMETERS, "dependencies": _DEPENDENCIES},
    "derby": {"tables": _DERBY_TABLES, "columns": _DERBY_COLUMNS, "keys": _DERBY_KEYS, "foreign_keys": _DERBY_FOREIGN, "indexes": _DERBY_INDEXES},
}


def dialect_of(url: str) -> str:
    """The dialect that a JDBC address names."""
    name = url.split(":")[1]
    if name not in QUERIES:
        raise ValueError(f"no catalog queries for {name}")
    return name


def catalog(spark: SparkSession, url: str, what: str, **options: str) -> DataFrame:
    """Rows of one kind of ``QUERIES[dialect]``: the same columns whatever the dialect. A catalog has a row a column, key
    or index, so it is read in one partition; filters on its columns are pushed into the database where it makes them itself."""
    dialect = dialect_of(url)

    def read(name: str) -> DataFrame:
        return spark.read.format("jdbc").option("url", url).option("dbtable", f"({QUERIES[dialect][name]}) q").options(**options).load()

    return _from_derby(what, read) if dialect == "derby" else read(what)


def _from_derby(what: str, read: Callable[[str], DataFrame]) -> DataFrame:
    if what == "tables":
        return read(what)
    columns = read("columns")
    if what == "columns":
        kind = F.col("KIND")
        base = F.lower(F.trim(F.regexp_extract(kind, r"^([A-Z ]+?)\s*(?:\(|NOT NULL|$)", 1)))
        number = lambda k: F.nullif(F.regexp_extract(kind, r"\((\d+)(?:,\s*(\d+))?\)", k), F.lit("")).try_cast("int")
        texts, exact = base.contains("char"), base.isin("decimal", "numeric")
        return columns.select(
            F.col("SCHEMANAME").alias("TABLE_SCHEMA"), F.col("TABLENAME").alias("TABLE_NAME"), F.col("COLUMNNAME").alias("COLUMN_NAME"), F.col("COLUMNNUMBER").alias("ORDINAL_POSITION"),
            base.alias("DATA_TYPE"), F.when(texts, number(1)).alias("CHARACTER_MAXIMUM_LENGTH"), F.when(exact, number(1)).alias("NUMERIC_PRECISION"), F.when(exact, F.coalesce(number(2), F.lit(0))).alias("NUMERIC_SCALE"),
            F.when(kind.contains("NOT NULL"), F.lit("NO")).otherwise(F.lit("YES")).alias("IS_NULLABLE"), F.when(F.col("IDENTITY_") == 0, F.col("PRESET")).alias("COLUMN_DEFAULT"), F.col("IDENTITY_").alias("IS_IDENTITY"),
        )
    rows = read(what)
    listed = lambda c: F.transform(F.split(F.regexp_extract(c, r"\(([^)]*)\)", 1), r",\s*"), lambda x: x.try_cast("int"))
    named = columns.select("SCHEMANAME", "TABLENAME", F.col("COLUMNNUMBER").alias("place"), "COLUMNNAME")
    own = F.posexplode(listed("PLACES")).alias("pos", "place")
    if what == "foreign_keys":
        there = named.select(F.col("SCHEMANAME").alias("SCHEMA2"), F.col("TABLENAME").alias("TABLE2"), F.col("place").alias("place2"), F.col("COLUMNNAME").alias("COLUMN2"))
        pairs = rows.select("NAME", "SCHEMANAME", "TABLENAME", "SCHEMA2", "TABLE2", listed("PLACES2").alias("places2"), own).withColumn("place2", F.get("places2", F.col("pos")))
        joined = pairs.join(named, ["SCHEMANAME", "TABLENAME", "place"]).join(there, ["SCHEMA2", "TABLE2", "place2"])
        names = ("NAME", "FK_NAME"), ("SCHEMANAME", "PARENT_SCHEMA"), ("TABLENAME", "PARENT_TABLE"), ("COLUMNNAME", "PARENT_COLUMN"), ("SCHEMA2", "REFERENCED_SCHEMA"), ("TABLE2", "REFERENCED_TABLE"), ("COLUMN2", "REFERENCED_COLUMN")
        return joined.select(*(F.col(a).alias(b) for a, b in names))
    joined = rows.select("NAME", "SCHEMANAME", "TABLENAME", "PLACES", own).join(named, ["SCHEMANAME", "TABLENAME", "place"])
    place = (F.col("pos") + 1).alias
    if what == "keys":
        return joined.select(F.col("SCHEMANAME").alias("TABLE_SCHEMA"), F.col("TABLENAME").alias("TABLE_NAME"), F.col("NAME").alias("CONSTRAINT_NAME"), F.col("COLUMNNAME").alias("COLUMN_NAME"), place("ORDINAL_POSITION"))
    unique = F.col("PLACES").startswith("UNIQUE")
    return joined.select(F.col("SCHEMANAME").alias("TABLE_SCHEMA"), F.col("TABLENAME").alias("TABLE_NAME"), F.col("NAME").alias("INDEX_NAME"), unique.alias("IS_UNIQUE"), F.lit("NONCLUSTERED").alias("INDEX_TYPE"), F.col("COLUMNNAME").alias("COLUMN_NAME"), place("KEY_ORDINAL"))


def pick_procedure(procedures: DataFrame, name: str, default_schema: str = "_dbo") -> DataFrame:
    """The procedure of this name (``schema.name`` or ``name``); without a schema the default one's first, then by schema."""
    bare = name.replace("[", "").replace("]", "").strip()
    schema, _, own = bare.rpartition(".")
    found = procedures.where(F.lower("name") == own.lower())
    if schema:
        found = found.where(F.lower("schema") == schema.lower())
    return found.orderBy(F.col("schema") != default_schema, "schema").limit(1)
