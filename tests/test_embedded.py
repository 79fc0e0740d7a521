"""Graphs and maps in text columns, awkward ones too."""

from orrery.sources import embedded, readers
from test_sources_reports import GRAPH


def test_graphs_equal_those_of_files(spark, tmp_path):
    texts = [GRAPH, GRAPH.replace('<edge id="e1" ', "<edge "), None, "", "<graphml><graph>", "<graphml><graph/></graphml>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for strict in (True, False):
        entities, edges = embedded.graphml_texts(rows, "k", "t", strict)
        for k in (0, 1):
            (tmp_path / f"{k}.graphml").write_text(texts[k])
            nodes_, edges_ = readers.graphml(spark, str(tmp_path / f"{k}.graphml"), strict)
            assert sorted(map(repr, entities.where(f"key = {k}").drop("key").collect())) == sorted(map(repr, nodes_.collect()))
            assert sorted(map(repr, edges.where(f"key = {k}").drop("key").collect())) == sorted(map(repr, edges_.collect()))
        assert entities.where("key > 1").count() == 0 and edges.where("key > 1").count() == 0


def test_maps_of_either_form(spark):
    maps = [
        '{"entities": {" A ": {"descricao": "d", "categoria": "c", "aliases": ["x"]}, "b": 1, "": {}}, "relacoes": [{"origem": "A", "destino": "b"}, {"origem": "a ", "destino": "B", "tipo": ""}, {"origem": "a"}, 3], "regras_candidatas": [" r ", "", 5]}',
        '{"entities": ["A", {"name": "B", "categoria": "q"}, {"x": 1}, 7, null, "a", " "], "relacoes": {}, "regras_candidatas": "no"}',
        '{"entities": 5}', "[1]", "no json", None,
    ]
    df = spark.createDataFrame(list(enumerate(maps)), "k int, t string")
    assert sorted(map(tuple, embedded.map_entities(df, "k", "t").collect())) == [(0, "a", "d", "c", ["x"]), (0, "b", None, None, None), (1, "a", None, None, None), (1, "b", None, "q", None)]
    assert list(map(tuple, embedded.map_relations(df, "k", "t").collect())) == [(0, "a", "b", "relaciona_com")]
    assert sorted(map(tuple, embedded.map_rules(df, "k", "t").collect())) == [(0, 0, "r"), (0, 2, "5")]
    assert embedded.map_entities(df.limit(0), "k", "t").count() == 0
