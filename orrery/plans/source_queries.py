"""Queries over graphs, maps and files that are made as text from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded
from ..operators import domain, reports, rules
from ..shared import shared_folder
from ..sources import embedded, readers
from .queries import _RULED, part_keys, program_files, query, table

# A GraphML document a nation: a node for each supplier, of which some lack a label or an id, and an edge to the next, of
# which some lack an id. Both engines build its parts by these expressions.
_NODE = (
    "'<node id=\"n' || k || '\"><data key=\"d\"><y:GenericNode>' || CASE k % 4 WHEN 0 THEN '' ELSE '<y:NodeLabel configuration=\"x.entity.name\"> Sup' || k || ' </y:NodeLabel>' END"
    " || CASE k % 3 WHEN 0 THEN '<y:NodeLabel configuration=\"x.entity.attributes\">id: int' || chr(10) || 'C' || k || ': datetime</y:NodeLabel>' ELSE '' END || '</y:GenericNode></data></node>'"
)
_EDGE = "'<edge' || CASE k % 5 WHEN 0 THEN '' ELSE ' id=\"e' || k || '\"' END || ' source=\"n' || k || '\" target=\"n' || (k + 25) || '\"/>'"
_HEAD, _TAIL = '<?xml version="1.0"?><graphml xmlns:y="http://www.yworks.com/xml/graphml"><graph>', "</graph></graphml>"
_GRAPHS = f"""s AS (SELECT s_nationkey AS nation, s_suppkey AS k FROM supplier),
g AS (SELECT nation, '{_HEAD}' || string_agg({_NODE}, '' ORDER BY k) || string_agg({_EDGE}, '' ORDER BY k) || '{_TAIL}' AS text FROM s GROUP BY nation),
n AS (SELECT nation, unnest(regexp_extract_all(text, '(?s)<node .*?</node>')) AS node FROM g),
e AS (SELECT nation, unnest(regexp_extract_all(text, '<edge[^>]*>')) AS edge, unnest(range(len(regexp_extract_all(text, '<edge[^>]*>')))) AS place FROM g)"""


def graph_texts(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("k"))
    parts = k.select("nation", "k", F.expr(_NODE).alias("node"), F.expr(_EDGE).alias("edge"))
    listed = parts.groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("k", "node", "edge"))).alias("parts"))
    joined = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return listed.select("nation", F.concat(F.lit(_HEAD), joined("node"), joined("edge"), F.lit(_TAIL)).alias("text"))


def _both(of: int, spark, sf_dir) -> DataFrame:
    texts = graph_texts(spark, sf_dir)
    return embedded.graphml_texts(texts, "nation", "text")[of].withColumn("strict", F.lit(True)).unionByName(embedded.graphml_texts(texts, "nation", "text", strict=False)[of].withColumn("strict", F.lit(False)))


@query(f"""WITH {_GRAPHS}, d AS (SELECT nation, regexp_extract(node, 'id="(\\w+)"', 1) AS id, nullif(trim(regexp_extract(node, 'name"> (\\w+) <', 1)), '') AS name, regexp_extract(node, '(C\\d+): datetime', 1) AS c FROM n)
SELECT nation AS key, id, name, CASE WHEN c = '' THEN '' ELSE 'id int4,' || lower(c) || ' timestamp' END AS columns, true AS strict FROM d WHERE name IS NOT NULL
UNION ALL SELECT nation, id, name, CASE WHEN c = '' THEN '' ELSE 'id int,' || c || ' datetime' END, false FROM d""")
def graph_text_entities(spark, sf_dir):
    shown = F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"]))
    return _both(0, spark, sf_dir).select("key", "id", "name", F.array_join(shown, ",").alias("columns"), "strict")


@query(f"""WITH {_GRAPHS}, d AS (SELECT nation, nullif(regexp_extract(edge, ' id="(\\w+)"', 1), '') AS id, place, regexp_extract(edge, 'source="(\\w+)"', 1) AS source_id, regexp_extract(edge, 'target="(\\w+)"', 1) AS target_id FROM e)
SELECT nation AS key, coalesce(id, 'edge' || place) AS id, source_id, target_id, true AS strict FROM d UNION ALL SELECT nation, id, source_id, target_id, false FROM d""")
def graph_text_edges(spark, sf_dir):
    return _both(1, spark, sf_dir)


# A domain map for each part: entities as an object or as a list, relations with and without a kind, or no JSON at all.
_MAP = (
    "CASE k % 5 WHEN 0 THEN '{\"entities\": {\" Meta' || (k % 7) || '\": {\"descricao\": \"d' || k || '\", \"categoria\": \"c' || (k % 3) || '\", \"aliases\": [\"m\", \"x' || k || '\"]}, \"acao\": {}}'"
    " WHEN 1 THEN '{\"entities\": [\"Fonte' || (k % 7) || '\", {\"name\": \"acao\", \"categoria\": \"c' || (k % 3) || '\"}, ' || k || ', {\"categoria\": \"none\"}, \" \"]'"
    " WHEN 2 THEN '{\"dominio\": \"d\"' WHEN 3 THEN '{\"entities\": {\"a\": {}, \"A \": {\"categoria\": \"later\"}}' ELSE 'no json' END"
    " || CASE WHEN k % 5 = 4 THEN '' ELSE ', \"relacoes\": [{\"origem\": \"Acao\", \"destino\": \" meta' || (k % 7) || '\"}, {\"origem\": \"a\", \"destino\": \"acao\", \"tipo\": \"USA\"}, {\"origem\": \"\", \"destino\": \"b\"}, \"x\", {\"origem\": \"A\", \"destino\": \"acao\", \"tipo\": \"usa\"}],"
    " \"regras_candidatas\": ' || CASE WHEN k % 2 = 0 THEN '[\" r' || (k % 3) || ' \", \"\"]' ELSE '\"r\"' END || '}' END"
)
_MAPS = f"""m AS (SELECT k, {_MAP} AS text FROM (SELECT p_partkey AS k FROM part)), j AS (SELECT k, text::JSON AS j FROM m WHERE json_valid(text)),
named AS (SELECT k, unnest(list_sort(json_keys(j, '$.entities'))) AS name, unnest(range(len(json_keys(j, '$.entities')))) AS pos, j FROM j WHERE json_type(j, '$.entities') = 'OBJECT'),
listed AS (SELECT k, unnest(json_extract(j, '$.entities[*]')) AS v, unnest(range(len(json_extract(j, '$.entities[*]')))) AS pos FROM j WHERE json_type(j, '$.entities') = 'ARRAY'),
r AS (SELECT k, unnest(json_extract(j, '$.relacoes[*]')) AS v FROM j),
rel AS (SELECT DISTINCT k, lower(trim(v ->> 'origem')) AS source, lower(trim(v ->> 'destino')) AS target, coalesce(lower(v ->> 'tipo'), 'relaciona_com') AS kind FROM r
        WHERE json_type(v) = 'OBJECT' AND trim(v ->> 'origem') <> '' AND trim(v ->> 'destino') <> '')"""
_ENTITY = """v AS (SELECT k, pos, lower(trim(name)) AS name, j -> 'entities' -> name AS v FROM named
 UNION ALL SELECT k, pos, lower(trim(CASE json_type(v) WHEN 'OBJECT' THEN v ->> 'name' WHEN 'VARCHAR' THEN v ->> '$' END)), v FROM listed),
ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, name ORDER BY pos) AS nth FROM v WHERE name <> '') WHERE nth = 1)"""


def map_texts(spark, sf_dir) -> DataFrame:
    return part_keys(spark, sf_dir).select("k", F.expr(_MAP).alias("text"))


@query(f"""WITH {_MAPS}, {_ENTITY} SELECT k AS key, name, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> 'descricao' END AS descricao, CASE WHEN json_type(v) = 'OBJECT' THEN v ->> 'categoria' END AS categoria,
 CASE WHEN json_type(v -> 'aliases') = 'ARRAY' THEN array_to_string(list_transform(json_extract(v, '$.aliases[*]'), lambda x: x ->> '$'), ',') END AS aliases FROM ent""")
def map_entities(spark, sf_dir):
    return embedded.map_entities(map_texts(spark, sf_dir), "k", "text").withColumn("aliases", F.array_join("aliases", ","))


@query(f"""WITH {_MAPS}, {_ENTITY}, e AS (SELECT DISTINCT name FROM ent), wide AS (SELECT DISTINCT source, target, kind FROM rel),
manual AS (SELECT 'acao' AS source, 'fonte' || (p_partkey % 9) AS target, 'usa' AS kind FROM part)
SELECT DISTINCT source, target, kind FROM (SELECT * FROM wide UNION ALL SELECT * FROM manual) WHERE source IN (SELECT name FROM e) AND target IN (SELECT name FROM e)""")
def merged_relations(spark, sf_dir):
    maps = map_texts(spark, sf_dir)
    entities = embedded.map_entities(maps, "k", "text").select("name").distinct()
    manual = table(spark, sf_dir, "part").select(F.lit("acao").alias("source"), F.expr("'fonte' || (p_partkey % 9)").alias("target"), F.lit("usa").alias("kind"))
    return domain.merge_relations(embedded.map_relations(maps, "k", "text"), manual, entities)


@query(f"""WITH {_MAPS}, u AS (SELECT k, unnest(json_extract(j, '$.regras_candidatas[*]')) AS v, unnest(range(len(json_extract(j, '$.regras_candidatas[*]')))) AS pos FROM j WHERE json_type(j, '$.regras_candidatas') = 'ARRAY')
SELECT k AS key, CAST(pos AS INT) AS pos, trim(v ->> '$') AS rule FROM u WHERE trim(v ->> '$') <> ''""")
def map_rules(spark, sf_dir):
    return embedded.map_rules(map_texts(spark, sf_dir), "k", "text")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH p AS (SELECT page_id % 40 AS part, html FROM pages) SELECT part, CAST(sum(strlen(html) + 1) AS BIGINT) AS bytes, CAST(sum(len(string_split(html, chr(10)))) AS BIGINT) AS lines,
 CAST(sum(length(html) + 1) AS BIGINT) AS letters FROM p WHERE part <> 7 GROUP BY part""")
def files_read(spark, sf_dir):
    folder = _folder(spark, "pages")
    parts = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("part"), "html")
    parts.repartition("part").write.partitionBy("part").text(folder)
    found = readers.files(spark, folder, "*.txt", ("part=7",))
    part = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("long").alias("part")
    return found.groupBy(part).agg(F.sum("length").alias("bytes"), F.sum(F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"), F.sum(F.length("text")).cast("long").alias("letters"))


@query("SELECT n_nationkey, n_name, upper(n_name) AS shown FROM nation ORDER BY n_nationkey LIMIT 12")
def loaded_query(spark, sf_dir):
    view = f"nation_{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").createOrReplaceTempView(view)
    return readers.load(spark, query=f' "SELECT TOP 12 n_nationkey, n_name, upper(n_name) AS shown FROM {view} ORDER BY n_nationkey ;; " ')


@query(f"WITH {_RULED} SELECT severity, rule_id, count(*) AS findings FROM hits GROUP BY severity, rule_id")
def written_findings(spark, sf_dir):
    folder = _folder(spark, "findings")
    reports.write_findings(rules.apply_rules(program_files(spark, sf_dir)), folder)
    return spark.read.parquet(folder).groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("findings"))
