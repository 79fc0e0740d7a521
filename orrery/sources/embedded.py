"""Graphs and domain maps that come as text in a column, with their keys: GraphML by schema, JSON by VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded
from ..operators.catalog import parse_columns

_LABEL = "struct<_VALUE:string,_configuration:string>"
NODE = f"_id string,data array<struct<`y:GenericNode`:struct<`y:NodeLabel`:array<{_LABEL}>>>>"
EDGE = "_id string,_source string,_target string"
_GRAPHML = f"struct<graph:array<struct<node:array<struct<{NODE}>>,edge:array<struct<{EDGE}>>>>>"
#: Fixed value: the kind of a relation that names none.
RELATED = "relaciona_com"


def node_label(data: Column, kind: str) -> Column:
    """The first label of a node whose configuration ends so."""
    labels = F.flatten(F.transform(F.filter(data, lambda d: d["y:GenericNode"]["y:NodeLabel"].isNotNull()), lambda d: d["y:GenericNode"]["y:NodeLabel"]))
    return F.try_element_at(F.filter(labels, lambda x: x["_configuration"].endswith(kind)), F.lit(1))["_VALUE"]


def graphml_texts(rows: DataFrame, key: str, text: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """entities (key, id, name, columns) and edges (key, id, source_id, target_id) of each row's GraphML text.

    As ``readers.graphml`` reads files: strict leaves out nodes without id or name, normalises columns, and names an edge
    without id by its place among its graph's. Text that is null or no GraphML has neither.
    """
    parsed = rows.select(F.col(key).alias("key"), F.from_xml(text, _GRAPHML)["graph"].alias("graphs"))
    nodes = exploded(parsed, F.flatten(F.transform("graphs", lambda g: F.coalesce(g["node"], F.array()))), "n", "key")
    entities = nodes.select("key", F.col("n._id").alias("id"), F.trim(node_label(F.col("n.data"), "name")).alias("name"), parse_columns(node_label(F.col("n.data"), "attributes"), strict).alias("columns"))
    if strict:
        entities = entities.where("id IS NOT NULL AND name IS NOT NULL AND name <> ''")
    edges = parsed.select("key", F.posexplode(F.flatten(F.transform("graphs", lambda g: F.coalesce(g["edge"], F.array())))).alias("at", "e"))
    number = F.concat(F.lit("edge"), F.col("at").cast("string")) if strict else F.lit(None).cast("string")
    edges = edges.select("key", F.coalesce("e._id", number).alias("id"), F.col("e._source").alias("source_id"), F.col("e._target").alias("target_id"))
    return entities, edges


def _parts(maps: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """key, pos, name (of an object's fields), value of what a field of each map holds, be it an object or a list."""
    held = maps.select(F.col(key).alias("map"), F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant").alias("held"))
    each = maps.sparkSession.tvf.variant_explode(F.col("held").outer())
    return held.lateralJoin(each).select(F.col("map").alias("key"), "pos", F.col("key").alias("name"), "value")


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def map_entities(maps: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, descricao, categoria, aliases of the entities of domain maps in JSON text, be they an object by name or a
    list of names and of objects with a name; names trimmed, in lower case, one row each, of equal ones the first (of an
    object's fields, which have no order, that with the least name as written).

    Items of other kinds and blank names are left out; text that is null or no JSON has none.
    """
    parts = _parts(maps, key, text, "entities")
    value = F.col("value")
    # a list's items have no field name
    listed = F.when(_is(value, "OBJECT"), _text(value, "$.name")).when(_is(value, "STRING"), _text(value))
    name = F.lower(F.trim(F.coalesce("name", listed)))
    rows = parts.select("key", "pos", name.alias("name"), *(_text(value, f"$.{f}").alias(f) for f in ("descricao", "categoria")), F.try_variant_get(value, "$.aliases", "array<string>").alias("aliases"))
    first = rows.where("name <> ''").groupBy("key", "name").agg(F.min_by(F.struct("descricao", "categoria", "aliases"), "pos").alias("first"))
    return first.select("key", "name", "first.*")


def map_relations(maps: DataFrame, key: str, text: str) -> DataFrame:
    """key, source, target, kind of the relations of domain maps, trimmed, in lower case, distinct; without both ends they are
    left out, without a kind they are ``relaciona_com``."""
    parts = _parts(maps, key, text, "relacoes").where(_is(F.col("value"), "OBJECT"))
    field = lambda f: F.lower(F.trim(F.coalesce(_text(F.col("value"), f"$.{f}"), F.lit(""))))
    rows = parts.select("key", field("origem").alias("source"), field("destino").alias("target"), F.coalesce(F.nullif(field("tipo"), F.lit("")), F.lit(RELATED)).alias("kind"))
    return rows.where("source <> '' AND target <> ''").distinct()


def map_rules(maps: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, rule: candidate rules of domain maps, trimmed; only a list's."""
    rows = _parts(maps, key, text, "regras_candidatas").where(F.col("name").isNull())
    return rows.select("key", "pos", F.trim(_text(F.col("value"))).alias("rule")).where("rule <> ''")
