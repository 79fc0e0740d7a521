"""Readers over JDBC, against the database that comes with Spark, in memory."""

import uuid

import pytest
from pyspark.sql import functions as F

from orrery.operators import catalog as structures
from orrery.sources import catalog_sql, readers

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = spark.range(1000).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("DAY"))
    rows = rows.unionByName(spark.createDataFrame([(None, "none", None)], "ID int, NAME string, DAY date"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "ROWS_").options(**DRIVER).save()
    run = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    run.execute("CREATE TABLE A (ID INT NOT NULL GENERATED ALWAYS AS IDENTITY, X VARCHAR(10) DEFAULT 'q', D DECIMAL(9,2), B BIGINT NOT NULL, CONSTRAINT PKA PRIMARY KEY (B, ID))")
    run.execute("CREATE TABLE C (ID INT NOT NULL, AB BIGINT, AID INT, CONSTRAINT FKA FOREIGN KEY (AB, AID) REFERENCES A (B, ID))")
    run.execute("CREATE UNIQUE INDEX IX ON C (AID, ID)")
    run.execute("CREATE VIEW V AS SELECT ID FROM C")
    return url


def test_tables_are_read_in_parts(spark, database):
    for key in ("ID", "DAY"):
        df = readers.jdbc_table(spark, database, "ROWS_", key, 8, **DRIVER)
        assert df.rdd.getNumPartitions() == 8 and df.count() == 1001
        sizes = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 200
        assert sorted(r["NAME"] for r in df.collect()) == sorted([f"n{i}" for i in range(1000)] + ["none"])
    assert readers.jdbc_table(spark, database, "ROWS_", **DRIVER).count() == 1001
    none = readers.jdbc_table(spark, database, "(SELECT * FROM ROWS_ WHERE ID < 0) q", "ID", **DRIVER)
    assert none.count() == 0 and none.rdd.getNumPartitions() == 1
    one = readers.jdbc_table(spark, database, "ROWS_", "ID", 4, **DRIVER).where("ID = 7").select("NAME")
    assert [r[0] for r in one.collect()] == ["n7"] and "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,7)]" in one._jdf.queryExecution().executedPlan().toString()


def test_catalog(spark, database):
    read = lambda what: catalog_sql.catalog(spark, database, what, **DRIVER)
    assert sorted(map(tuple, read("tables").where("schema = 'APP'").collect())) == [("APP", "A", "U"), ("APP", "C", "U"), ("APP", "ROWS_", "U"), ("APP", "V", "V")]
    columns = read("columns").where("TABLE_NAME = 'A'").orderBy("ORDINAL_POSITION")
    assert [tuple(r)[2:] for r in columns.collect()] == [
        ("ID", 1, "integer", None, None, None, "NO", None, 1),
        ("X", 2, "varchar", 10, None, None, "YES", "'q'", 0),
        ("D", 3, "decimal", None, 9, 2, "YES", None, 0),
        ("B", 4, "bigint", None, None, None, "NO", None, 0),
    ]
    assert sorted(map(tuple, read("keys").collect())) == [("APP", "A", "PKA", "B", 1), ("APP", "A", "PKA", "ID", 2)]
    assert sorted(map(tuple, read("foreign_keys").collect())) == [("FKA", "APP", "C", "AB", "APP", "A", "B"), ("FKA", "APP", "C", "AID", "APP", "A", "ID")]
    assert sorted(tuple(r)[2:] for r in read("indexes").where("INDEX_NAME = 'IX'").collect()) == [("IX", True, "NONCLUSTERED", "AID", 1), ("IX", True, "NONCLUSTERED", "ID", 2)]
    whole = structures.structure_report(*map(read, ("columns", "keys", "foreign_keys", "indexes"))).where("TABLE_NAME IN ('A', 'C')").orderBy("TABLE_NAME")
    assert [(r["TABLE_NAME"], r["n_columns"], r["n_pk"], r["n_fk"]) for r in whole.collect()] == [("A", 4, 2, 0), ("C", 3, 0, 2)]
    with pytest.raises(ValueError):
        catalog_sql.dialect_of("jdbc:other:x")
