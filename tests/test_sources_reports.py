import pytest
from pyspark.sql import functions as F

from orrery.operators import code, reports, rules
from orrery.plans import ORACLE_SQL, QUERIES
from orrery.sources import catalog_sql, readers
from orrery.streaming.scan import arriving_files, stream_findings

GRAPH = """<?xml version="1.0"?>
<graphml xmlns:y="http://www.yworks.com/xml/graphml"><graph>
<node id="n0"><data key="d"><y:GenericNode><y:NodeLabel configuration="x.name">Acao</y:NodeLabel><y:NodeLabel configuration="x.attributes">id: int
valor: float</y:NodeLabel></y:GenericNode></data></node>
<node id="n1"><data key="d"><y:GenericNode><y:NodeLabel configuration="x.name">Meta</y:NodeLabel></y:GenericNode></data></node>
<node id="n2"/>
<edge id="e0" source="n0" target="n1"/><edge id="e1" source="n0" target="n9"/>
</graph></graphml>"""


def test_queries_are_cleaned_and_checked(spark):
    assert readers.clean_query(' "select 1 ;"; ') == "select 1"
    assert readers.rewrite_top("SELECT TOP 5 * FROM t") == "SELECT * FROM t LIMIT 5"
    assert readers.load(spark, query="select 1 as a;").first()["a"] == 1
    with pytest.raises(ValueError):
        readers.load(spark, query="DROP TABLE t")
    with pytest.raises(ValueError):
        readers.load(spark)
    spark.range(10).createOrReplaceTempView("tens")
    assert [r[0] for r in readers.load(spark, "tens", limit=3, order=["id"]).collect()] == [0, 1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "a.php").write_bytes(b"a\xffb\nvar_dump(1);")
    (tmp_path / "b.inc").write_text("x")
    (tmp_path / "vendor" / "c.php").write_text("var_dump(1);")
    found = readers.files(spark, str(tmp_path)).collect()
    assert [r["text"] for r in found] == ["ab\nvar_dump(1);"]
    assert readers.all_program_files(spark, str(tmp_path)).count() == 3
    stream = stream_findings(arriving_files(spark, str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("found").where("rule_id = 'debug_var_dump'").count() == 2


def test_graph_and_json(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    entities, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["name"]: [c["type"] for c in r["columns"]] for r in entities.collect()} == {"Acao": ["int4", "numeric(15, 3)"], "Meta": []}
    assert edges.count() == 2 and readers.graphml(spark, str(tmp_path / "g.graphml"), strict=False)[0].count() == 3
    folder = tmp_path / "dom"
    folder.mkdir()
    (folder / "z.json").write_text('{"a": 1}')
    (folder / "my_domain_map.json").write_text('{"a": 2}')
    assert readers.json_map(spark, str(folder)).first()["a"] == 2
    assert [r["name"] for r in readers.json_files(spark, str(tmp_path)).collect()] == ["my_domain_map.json", "z.json"]


def test_pick_procedure(spark):
    p = spark.createDataFrame([("a", "x"), ("_dbo", "x"), ("b", "y")], "schema string, name string")
    assert catalog_sql.pick_procedure(p, "X").first()["schema"] == "_dbo"
    assert catalog_sql.pick_procedure(p, "[a].[x]").first()["schema"] == "a"


def test_reports(spark, tmp_path):
    files = spark.createDataFrame([("a.php", "<?php\nvar_dump($x);\nfunction f($a) { $o = new T(); $o->g(); }")], "path string, text string")
    found = rules.apply_rules(files)
    assert "| a.php | 2 | debug_var_dump |" in reports.markdown(found, "Findings") and "Nothing" in reports.markdown(found.limit(0), "x")
    reports.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == found.count()
    names = reports.analysis_input(code.method_records(code.methods(files))).first()["names"]
    assert names == ["T::g"]
    assert len(files.select(reports.payload_key("path", F.lit(1)).alias("k")).first()["k"]) == 64


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) > 70


def test_queries_equal_their_sql(spark):
    import duckdb

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("facade_methods", "model_warnings", "clickables", "script_places", "suspect_sql", "domain_inventory", "domain_relations", "table_structure", "graph_columns", "entity_cross"):
        df = QUERIES[name](spark, sf)
        want = db.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect()), name


def test_loose_graph_stays_as_it_is(spark, tmp_path):
    text = GRAPH.replace('<edge id="e1" ', "<edge ").replace("</graph>", '<edge source="n1" target="n0"/></graph>')
    (tmp_path / "g.graphml").write_text(text.replace("valor: float", "Valor: float\nflag"))
    strict, loose = (readers.graphml(spark, str(tmp_path / "g.graphml"), strict=k) for k in (True, False))
    assert sorted(r["id"] for r in strict[1].collect()) == ["e0", "edge1", "edge2"]
    assert sorted(r["id"] or "" for r in loose[1].collect()) == ["", "", "e0"]
    columns = {r["id"]: [tuple(c) for c in r["columns"]] for r in loose[0].collect()}
    assert columns["n0"] == [("id", "int"), ("Valor", "float"), ("flag", None)]


def test_radar_report(spark):
    tables = {f"t{i:02}": spark.createDataFrame([(-1, None)], "a int, b string") for i in range(3)} | {"bad": ValueError("gone")}
    text = reports.radar_report(tables, most=2, each=1)
    assert text.count("### ") == 2 and "### t00" in text and "gone" in text
