"""Queries over catalog rows, graphs, domain maps and dates derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, catalog, domain, profile
from .queries import _ENTITIES, _entities, part_keys, query, table


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d FROM events) SELECT 'data_ref' AS "column", strftime(min(d), '%Y-%m-%d') || ' 00:00:00' AS first, strftime(max(d), '%Y-%m-%d') || ' 00:00:00' AS last FROM d""")
def date_texts(spark, sf_dir):
    shown = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "d/M/yyyy"))
    rows = table(spark, sf_dir, "events").select("event_id", shown.alias("data_ref"), F.col("event_type").alias("data_kind"), shown.alias("other"))
    return profile.date_ranges(rows)


@query("SELECT count(*) AS rows, CAST(6 AS INT) AS columns FROM events")
def profile_shape(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "events"))["shape"]


_TYPES = "CASE k % 8 WHEN 0 THEN 'varchar' WHEN 1 THEN 'NVARCHAR' WHEN 2 THEN 'decimal' WHEN 3 THEN 'float' WHEN 4 THEN 'datetime2' WHEN 5 THEN 'int' WHEN 6 THEN 'varbinary' ELSE 'nchar' END"
_LENGTH = "CASE WHEN k % 3 = 0 THEN -1 WHEN k % 3 = 1 THEN CAST(k % 90 * 2 AS INT) END"
_PRECISION, _SCALE = "CASE WHEN k % 5 <> 0 THEN CAST(k % 30 AS INT) END", "CASE WHEN k % 7 <> 0 THEN CAST(k % 6 AS INT) END"
_COLUMNS = f"c AS (SELECT k, '[s' || (k % 2) || '].[t' || (k % 9) || ']' AS full_name, 's' || (k % 2) AS s, 't' || (k % 9) AS t, 'c' || k AS c, lower({_TYPES}) AS kind, {_LENGTH} AS len, {_PRECISION} AS p, {_SCALE} AS sc FROM (SELECT p_partkey AS k FROM part))"


def _catalog(spark, sf_dir) -> DataFrame:
    rows = part_keys(spark, sf_dir).select("k", F.expr("'[s' || (k % 2) || '].[t' || (k % 9) || ']'").alias("full_name"))
    named = rows.withColumn("n", catalog.split_name(F.col("full_name")))
    return named.select(
        "k", F.col("n.schema").alias("TABLE_SCHEMA"), F.col("n.name").alias("TABLE_NAME"), F.expr("'c' || k").alias("COLUMN_NAME"), F.col("k").cast("int").alias("ORDINAL_POSITION"), F.expr(_TYPES).alias("DATA_TYPE"),
        F.expr(_LENGTH).alias("CHARACTER_MAXIMUM_LENGTH"), F.expr(_PRECISION).alias("NUMERIC_PRECISION"), F.expr(_SCALE).alias("NUMERIC_SCALE"), F.expr("CASE WHEN k % 4 = 0 THEN 'YES' ELSE 'NO' END").alias("IS_NULLABLE"),
    )


_SIZED = "kind IN ('varchar', 'char', 'nvarchar', 'nchar', 'binary', 'varbinary')"


@query(f"""WITH {_COLUMNS} SELECT s AS "TABLE_SCHEMA", t AS "TABLE_NAME", c AS "COLUMN_NAME", CASE WHEN {_SIZED} AND len = -1 THEN kind || '(max)' WHEN {_SIZED} AND len IS NOT NULL THEN kind || '(' || len || ')'
 WHEN kind = 'decimal' AND p IS NOT NULL AND sc IS NOT NULL THEN kind || '(' || p || ',' || sc || ')' WHEN kind = 'float' AND p IS NOT NULL THEN kind || '(' || p || ')' ELSE kind END AS type, k % 4 = 0 AS nullable, k % 5 = 0 AS is_pk FROM c""")
def table_structure(spark, sf_dir):
    rows = _catalog(spark, sf_dir)
    return catalog.structure(rows, rows.where("k % 5 = 0")).drop("ORDINAL_POSITION")


_KEY_NAMES = "CASE k % 8 WHEN 0 THEN 'cliente_ID' WHEN 1 THEN 'valor' WHEN 2 THEN 'Ano' WHEN 3 THEN 'descricao' WHEN 4 THEN 'mes_ref' WHEN 5 THEN 'reg_x' WHEN 6 THEN 'id' ELSE 'exercicio' END || CASE WHEN k % 3 = 0 THEN '' ELSE '_' || k END"


@query(f"""WITH c AS (SELECT 's' || (k % 2) AS "TABLE_SCHEMA", 't' || (k % 9) AS "TABLE_NAME", k AS place, {_KEY_NAMES} AS name FROM (SELECT p_partkey AS k FROM part)),
r AS (SELECT *, row_number() OVER (PARTITION BY "TABLE_SCHEMA", "TABLE_NAME" ORDER BY place) AS nth FROM c WHERE regexp_matches(lower(name), '_id$|ano|mes|exercicio|reg_|pro_|pa_|uno_'))
SELECT "TABLE_SCHEMA", "TABLE_NAME", string_agg(name, ',' ORDER BY place) AS keys FROM r WHERE nth <= 8 GROUP BY ALL""")
def key_suggestions(spark, sf_dir):
    k = part_keys(spark, sf_dir)
    columns = k.select(F.expr("'s' || (k % 2)").alias("TABLE_SCHEMA"), F.expr("'t' || (k % 9)").alias("TABLE_NAME"), F.col("k").alias("ORDINAL_POSITION"), F.expr(_KEY_NAMES).alias("COLUMN_NAME"))
    return anomaly.key_suggestions(columns).withColumn("keys", F.array_join("keys", ","))


@query(f"""WITH {_COLUMNS} SELECT c, CASE WHEN {_SIZED} AND len = -1 THEN kind || '(max)' WHEN kind IN ('nvarchar', 'nchar') AND len IS NOT NULL THEN kind || '(' || (len // 2) || ')' WHEN {_SIZED} AND len IS NOT NULL THEN kind || '(' || len || ')'
 WHEN kind = 'decimal' AND p IS NOT NULL AND sc IS NOT NULL THEN kind || '(' || p || ',' || sc || ')' WHEN kind = 'datetime2' AND sc IS NOT NULL THEN kind || '(' || sc || ')' ELSE kind END AS type FROM c""")
def parameter_types(spark, sf_dir):
    kind = catalog.format_type(*(F.col(c) for c in ("DATA_TYPE", "CHARACTER_MAXIMUM_LENGTH", "NUMERIC_PRECISION", "NUMERIC_SCALE")), bytes_=True)
    return _catalog(spark, sf_dir).select(F.col("COLUMN_NAME").alias("c"), kind.alias("type"))


@query(f"""WITH {_COLUMNS} SELECT s AS "TABLE_SCHEMA", t AS "TABLE_NAME", CAST(count(*) AS INT) AS n_columns, CAST(count(*) FILTER (k % 5 = 0) AS INT) AS n_pk, CAST(count(*) FILTER (k % 11 = 0) AS INT) AS n_fk, CAST(count(DISTINCT k % 13) FILTER (k % 13 < 3 AND k % 2 = 0) AS INT) AS n_indexes FROM c GROUP BY s, t""")
def structure_reports(spark, sf_dir):
    rows = _catalog(spark, sf_dir)
    fk = rows.where("k % 11 = 0").select(F.expr("'fk' || k").alias("FK_NAME"), F.col("TABLE_SCHEMA").alias("PARENT_SCHEMA"), F.col("TABLE_NAME").alias("PARENT_TABLE"), F.col("COLUMN_NAME").alias("PARENT_COLUMN"), F.lit("s").alias("REFERENCED_SCHEMA"), F.lit("r").alias("REFERENCED_TABLE"), F.lit("id").alias("REFERENCED_COLUMN"))
    index = F.expr("CASE WHEN k % 13 < 3 THEN 'ix' || (k % 13) END")
    idx = rows.where("k % 2 = 0").select("TABLE_SCHEMA", "TABLE_NAME", index.alias("INDEX_NAME"), F.lit(True).alias("IS_UNIQUE"), F.lit("NONCLUSTERED").alias("INDEX_TYPE"), "COLUMN_NAME", F.lit(1).alias("KEY_ORDINAL"))
    return catalog.structure_report(rows, rows.where("k % 5 = 0"), fk, idx).select("TABLE_SCHEMA", "TABLE_NAME", "n_columns", "n_pk", "n_fk", "n_indexes")


_ATTRS = "'Id Nation: INT' || chr(10) || '<b>' || chr(10) || 'name/x: ' || CASE k % 4 WHEN 0 THEN 'float' WHEN 1 THEN ' bit' WHEN 2 THEN 'Text' ELSE '' END || chr(10) || 'flag'"


@query(f"""WITH n AS (SELECT k, string_split({_ATTRS}, chr(10)) AS ls FROM (SELECT n_nationkey AS k FROM nation)), l AS (SELECT k, unnest(ls) AS x FROM n),
r AS (SELECT k, lower(regexp_replace(trim(split_part(x, ':', 1)), '[ /]', '_', 'g')) AS name, CASE WHEN contains(x, ':') THEN lower(trim(split_part(x, ':', 2))) ELSE '' END AS raw FROM l WHERE x NOT LIKE '<%')
SELECT k, name, CASE raw WHEN '' THEN 'unknown' WHEN 'int' THEN 'int4' WHEN 'bit' THEN 'bpchar(1)' WHEN 'float' THEN 'numeric(15, 3)' ELSE raw END AS type FROM r""")
def graph_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).select("k", F.explode(catalog.parse_columns(F.expr(_ATTRS))).alias("c"))
    return rows.select("k", "c.name", "c.type")


@query("""SELECT 'strict' AS kind, 'e' || n_nationkey AS id, n_name AS source_name, r_name AS target_name FROM nation JOIN region ON r_regionkey = n_regionkey * 2
UNION ALL SELECT 'loose', 'e' || n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey * 2""")
def graph_edges(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ents = nation.selectExpr("'n' || n_nationkey AS id", "n_name AS name").unionByName(region.selectExpr("'r' || r_regionkey AS id", "r_name AS name"))
    edges = nation.selectExpr("'e' || n_nationkey AS id", "'n' || n_nationkey AS source_id", "'r' || (n_regionkey * 2) AS target_id")
    both = [catalog.resolve_edges(edges, ents, strict).select(F.lit(k).alias("kind"), "id", "source_name", "target_name") for k, strict in (("strict", True), ("loose", False))]
    return both[0].unionByName(both[1])


_CANON = "CASE WHEN name NOT LIKE 'x\\_%' ESCAPE '\\' THEN regexp_replace(name, '_old$', '') END"


@query(f"""WITH {_ENTITIES}, d AS (SELECT DISTINCT {_CANON} AS canonical FROM e WHERE {_CANON} IS NOT NULL) SELECT canonical, CASE WHEN canonical LIKE 'programa%' THEN 'Entidade associada à organização programática do domínio.' WHEN canonical LIKE 'acao%' THEN 'Entidade associada à execução operacional.'
 WHEN canonical LIKE 'meta%' THEN 'Entidade associada a metas físicas, qualitativas ou financeiras.' WHEN canonical LIKE 'fonte%' THEN 'Entidade associada à origem de recursos ou detalhamento financeiro.' WHEN canonical LIKE 'regiao%' THEN 'Entidade associada à regionalização ou recorte territorial.' END AS description FROM d""")
def entity_descriptions(spark, sf_dir):
    d = domain.distinct_entities(_entities(spark, sf_dir))
    return d.select("canonical", domain.description(F.col("canonical")).alias("description"))


_LINKS = "l AS (SELECT a.name AS source_name, CASE WHEN a.position % 7 = 0 THEN 'nobody' ELSE b.name END AS target_name FROM e a JOIN e b ON b.position = a.position + 1)"


def _links(spark, sf_dir) -> DataFrame:
    e = _entities(spark, sf_dir).select("position", "name")
    b = e.select((F.col("position") - 1).alias("position"), F.col("name").alias("other"))
    return e.join(b, "position").select(F.col("name").alias("source_name"), F.when(F.col("position") % 7 == 0, "nobody").otherwise(F.col("other")).alias("target_name"))


@query(f"""WITH {_ENTITIES}, {_LINKS}, d AS (SELECT DISTINCT {_CANON} AS c FROM e WHERE {_CANON} IS NOT NULL), r AS (SELECT {_CANON.replace('name', 'source_name')} AS source, {_CANON.replace('name', 'target_name')} AS target FROM l)
SELECT DISTINCT source, target, CASE WHEN regexp_matches(source, 'meta|fonte') THEN 'detalha' WHEN contains(source, 'indicador') THEN 'mede' WHEN regexp_matches(source, 'regiao|municip') THEN 'regionaliza' WHEN source = 'acao' AND contains(target, 'programa') THEN 'pertence_a' ELSE 'relaciona_com' END AS kind
FROM r WHERE source IN (SELECT c FROM d) AND target IN (SELECT c FROM d)""")
def domain_relations(spark, sf_dir):
    return domain.domain_relations(_links(spark, sf_dir), _entities(spark, sf_dir))


@query(f"""WITH {_ENTITIES}, d AS (SELECT DISTINCT ON (c) c, odd FROM (SELECT {_CANON} AS c, odd, position, CASE WHEN name = {_CANON} THEN 70 ELSE 0 END + 2 - odd AS score FROM e) WHERE c IS NOT NULL ORDER BY c, score DESC, position)
SELECT rule FROM (SELECT unnest(['multi_year', 'financial_detail', 'revision', 'regional', 'program_action_hierarchy', 'objective_goal', 'indicator']) AS rule) WHERE CASE rule WHEN 'multi_year' THEN (SELECT bool_or(odd = 0) FROM d) WHEN 'financial_detail' THEN (SELECT bool_or(odd = 1 OR regexp_matches(c, 'fonte|valor|teto')) FROM d)
 WHEN 'regional' THEN (SELECT bool_or(contains(c, 'regiao')) FROM d) WHEN 'program_action_hierarchy' THEN (SELECT bool_or(contains(c, 'programa')) AND bool_or(contains(c, 'acao')) FROM d) WHEN 'objective_goal' THEN (SELECT bool_or(contains(c, 'objetivo')) AND bool_or(contains(c, 'meta')) FROM d) WHEN 'indicator' THEN (SELECT bool_or(contains(c, 'indicador')) FROM d) ELSE (SELECT bool_or(regexp_matches(c, 'revisao|original|ajuste|reducao')) FROM d) END""")
def candidate_rules(spark, sf_dir):
    return domain.candidate_rules(_entities(spark, sf_dir)).select("rule")


@query("""WITH c AS (SELECT lower(n_name) AS alias, CASE WHEN n_nationkey % 4 = 0 THEN 'group' || n_regionkey ELSE lower(n_name) END AS name, CAST(n_regionkey AS VARCHAR) AS category FROM nation)
SELECT name, coalesce(string_agg(alias, ',' ORDER BY alias) FILTER (alias <> name), '') AS aliases, min(category) AS category FROM c GROUP BY name""")
def refined_entities(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    ents = nation.select(F.concat(F.lit(" "), F.col("n_name")).alias("name"), F.col("n_regionkey").cast("string").alias("category"))
    aliases = nation.where("n_nationkey % 4 = 0").select(F.lower("n_name").alias("alias"), F.expr("'group' || n_regionkey").alias("canonical"))
    return domain.refine(ents, aliases).withColumn("aliases", F.array_join("aliases", ","))


_EXPECTED = "x AS (SELECT DISTINCT 'n' || (k % 40) AS source, 'r' || (k % 7) AS target FROM (SELECT p_partkey AS k FROM part))"


@query(f"""WITH {_EXPECTED}, have AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation), inferred AS (SELECT source, target FROM x WHERE CAST(substr(source, 2) AS INT) % 3 = 0 AND target IN ('r1', 'r2')),
c AS (SELECT x.source, x.target, coalesce(bool_or(h.source IS NOT NULL), false) AS found FROM x LEFT JOIN (SELECT * FROM have UNION SELECT * FROM inferred) h ON x.source = h.source AND x.target = h.target GROUP BY ALL)
SELECT count(*) AS expected, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS missing, round(count(*) FILTER (found) / count(*) * 100, 2) AS pct, (SELECT count(*) FROM inferred) AS inferred FROM c""")
def relation_cross(spark, sf_dir):
    x = table(spark, sf_dir, "part").selectExpr("'n' || (p_partkey % 40) AS source", "'r' || (p_partkey % 7) AS target")
    have = table(spark, sf_dir, "nation").selectExpr("'n' || n_nationkey AS source", "'r' || n_regionkey AS target")
    columns = x.where("CAST(substr(source, 2) AS INT) % 3 = 0").select(F.upper("source").alias("entity"), F.explode(F.array(F.lit("r1_id"), F.lit("COD_R2"), F.lit("r3"))).alias("column"))
    inferred = domain.infer_relations(x, columns)
    return domain.adherence(domain.cross_relations(x, have, inferred)).join(inferred.agg(F.count(F.lit(1)).alias("inferred")))


_RULE = "CASE k % 7 WHEN 0 THEN 'Estrutura programática por 4 anos' WHEN 1 THEN 'Detalhamento financeiro e fontes de recurso' WHEN 2 THEN 'Indicadores' WHEN 3 THEN 'Regionalização territorial' WHEN 4 THEN 'Os objetivos pertencem a programas' WHEN 5 THEN 'Metas detalham os objetivos' ELSE 'Nada' END || ' ' || k"
# Names of entities and relationships that a fifth and a seventh of the suppliers each give.
_NAMES = "CASE k % 9 WHEN 0 THEN ' Programa' WHEN 1 THEN 'programaobjetivo' WHEN 2 THEN 'ACAO' WHEN 3 THEN 'acaofonte' WHEN 4 THEN 'indicador' WHEN 5 THEN 'acaoregiao' ELSE 'other' || k END"
_ENDS = "CASE k % 5 WHEN 0 THEN 'acao' WHEN 1 THEN 'ProgramaObjetivo' WHEN 2 THEN 'acaoregiao' ELSE 'x' END", "CASE k % 5 WHEN 0 THEN 'programa ' WHEN 1 THEN 'programa' WHEN 2 THEN 'acao' ELSE 'y' END"


@query(f"""WITH {_ENTITIES}, r AS (SELECT {_RULE} AS rule FROM (SELECT p_partkey AS k FROM part)),
have AS (SELECT DISTINCT unnest(CASE odd WHEN 0 THEN ['temporal_signals', 'status_signals'] ELSE ['financial_signals'] END) AS name FROM e
 UNION SELECT lower(trim({_NAMES})) FROM (SELECT s_suppkey AS k FROM supplier) UNION SELECT lower(trim({_ENDS[0]})) || ' → ' || lower(trim({_ENDS[1]})) FROM (SELECT s_suppkey AS k FROM supplier)),
told(words, needs) AS (VALUES ('4 anos|quadrien|ano|plurianual', ['temporal_signals']), ('valor|finance|fonte|revis|teto|orc', ['financial_signals']), ('valor|finance|fonte|revis|teto|orc', ['versioning_signals']), ('região|regional|município|territ', ['regional_signals']), ('status|situação|avali', ['status_signals']),
 ('estrutura programática|programas, objetivos e ações', ['programa', 'programaobjetivo', 'acao']), ('estrutura programática|programas, objetivos e ações', ['acao → programa']), ('estrutura programática|programas, objetivos e ações', ['programaobjetivo → programa']),
 ('direcionamento estratégico|diretrizes, programas', ['diretriz', 'diretriz_programa', 'programa']), ('detalhamento financeiro|fontes de recurso', ['acaofonte']), ('detalhamento financeiro|fontes de recurso', ['despesateto']), ('detalhamento financeiro|fontes de recurso', ['tetoorgao']),
 ('metas associadas|monitoramento', ['acaometa']), ('indicadores|medição de desempenho', ['indicador']), ('indicadores|medição de desempenho', ['indicador → programa']), ('regionalização|territorial', ['acaoregiao']), ('regionalização|territorial', ['acaoregiao → acao']),
 ('ação está semanticamente vinculada ao programa', ['acao', 'programa']), ('objetivos pertencem a programas', ['programaobjetivo', 'programa']), ('objetivos pertencem a programas', ['programaobjetivo → programa']), ('metas detalham os objetivos', ['programaobjetivometa', 'programaobjetivo'])),
h AS (SELECT list(name) AS names FROM have), met AS (SELECT words, needs FROM told, h WHERE len(list_filter(needs, lambda x: NOT list_contains(names, x))) = 0),
c AS (SELECT rule, count(needs) AS n FROM r LEFT JOIN met ON regexp_matches(lower(rule), words) GROUP BY rule)
SELECT rule, CAST(n AS INT) AS evidence, CASE WHEN n >= 3 THEN 'alta' WHEN n >= 1 THEN 'média' ELSE 'baixa' END AS confidence FROM c""")
def rule_evidence(spark, sf_dir):
    text = part_keys(spark, sf_dir).select(F.expr(_RULE).alias("rule"))
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    names, links = k.select(F.expr(_NAMES).alias("name")), k.select(F.expr(_ENDS[0]).alias("source"), F.expr(_ENDS[1]).alias("target"))
    return domain.rule_evidence(text, domain.signals(_entities(spark, sf_dir)), names, links).withColumn("evidence", F.size("evidence"))


@query("""WITH d AS (SELECT p_partkey AS k, 'd' || p_partkey AS domain FROM part), x AS (SELECT k, domain, k % 2 = 0 AS s, k % 3 <> 0 AS m, k % 4 <> 0 AS c, k % 5 <> 0 AS i, CASE WHEN k % 4 <> 0 THEN CAST(60 + k % 41 AS DOUBLE) END AS e, CASE WHEN k % 4 <> 0 THEN CAST(40 + k % 61 AS DOUBLE) END AS r, CASE WHEN k % 4 <> 0 THEN k % 3 ELSE 0 END AS n FROM d)
SELECT domain, s AS has_structural, c AS has_cross, CASE WHEN NOT s THEN 'não iniciado' WHEN NOT m THEN 'estrutural' WHEN NOT c THEN 'semântico inicial' WHEN NOT i THEN 'parcial' WHEN e >= 95 AND r >= 90 AND n >= 2 THEN 'maduro' WHEN e >= 70 OR r >= 50 OR n >= 1 THEN 'parcial' ELSE 'raso' END AS maturity FROM x WHERE s OR m OR c OR i""")
def domain_inventory(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "'d' || p_partkey AS domain")
    crosses = d.where("k % 4 <> 0").selectExpr("domain", "CAST(60 + k % 41 AS DOUBLE) AS adherence_entities", "CAST(40 + k % 61 AS DOUBLE) AS adherence_relationships", "k % 3 AS rule_count")
    return domain.inventory(d.where("k % 2 = 0"), d.where("k % 3 <> 0"), crosses, d.where("k % 5 <> 0")).select("domain", "has_structural", "has_cross", "maturity")


@query("""SELECT DISTINCT lower(CASE WHEN n_nationkey % 3 = 0 THEN 'obj' WHEN n_nationkey % 3 = 1 THEN 'list' ELSE 'named' END || n_name) AS name FROM nation""")
def expected_entities(spark, sf_dir):
    n = F.col("n_name")
    forms = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"obj'), n, F.lit('": {"descricao": "d"}}'))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('["list'), n, F.lit(' "]'))).otherwise(F.concat(F.lit('[{"name": "named'), n, F.lit('"}]')))
    return domain.expected_entities(table(spark, sf_dir, "nation").select(forms.alias("entities")))


_URLS = "CASE k % 5 WHEN 0 THEN 'http://h/p.php?action=Conta.abrir&id=' || k || '&id=' || k WHEN 1 THEN 'action=A.x&action=B.y&z=' || k WHEN 2 THEN 'p?action%3DC.d%26n%3D' || k WHEN 3 THEN 'p.php?action=solo&x=1' ELSE 'p.php?x=1&y=' || k END"


@query(f"""WITH u AS (SELECT k, replace(replace({_URLS}, '%3D', '='), '%26', '&') AS d FROM (SELECT p_partkey AS k FROM part)), q AS (SELECT k, CASE WHEN contains(d, 'action=') THEN 'action=' || string_split(d, 'action=')[-1] ELSE regexp_replace(d, '^[^?]*\\?', '') END AS q FROM u),
a AS (SELECT k, q, regexp_extract(q, '^action=([^&]*)', 1) AS action FROM q) SELECT k, action, CASE WHEN contains(action, '.') THEN split_part(action, '.', 1) ELSE '' END AS class, CASE WHEN contains(action, '.') THEN split_part(action, '.', 2) ELSE action END AS method,
 array_to_string(list_sort(list_distinct(list_filter(string_split(q, '&'), lambda x: x NOT LIKE 'action=%'))), '&') AS params FROM a""")
def url_variants(spark, sf_dir):
    from ..operators import web

    u = part_keys(spark, sf_dir).select("k", web.parse_action_url(F.expr(_URLS)).alias("u"))
    params = F.array_sort(F.transform("u.params", lambda p: F.concat(p["key"], F.lit("="), p["value"])))
    return u.select("k", "u.action", "u.class", "u.method", F.array_join(params, "&").alias("params"))
