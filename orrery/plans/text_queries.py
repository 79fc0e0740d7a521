"""Queries over program text, pages and SQL derived from the driver's tables, and SQL that computes the same from the same text.

Each kind of text is one expression that Spark and the oracle's engine both read, so neither side has it written down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded
from ..operators import code, reports, rules, sqltext, web
from .queries import part_keys, query, table

_NL, _Q = " || chr(10) || ", " || chr(39) || "


def lines_of_text(*parts: str) -> str:
    return _NL.join(f"({p})" for p in parts)


PHP = lines_of_text(
    "'<?php'", "'/**'", "' * @author team' || (k % 3)", "' * @tabela tb_' || (k % 7)", "' * @SGBD mssql'", "' */'",
    "'class Fachada' || k || ' {'", "'  /** @var int'", "'   * @campo id_' || (k % 5)", "'   * @primary sim'", "'   */'", "'  private $id;'",
    "'  /** @label L */'", "'  private $nome;'", "''", "''", "'  private $solto;'",
    "'  public function getId($a, $b) {'", "'    $p = new Persistencia' || (k % 4) || '();'", "'    $p->salvar($a);'", "'    $stmt->execute();'",
    "'    $x = Util::fmt($b);' || CASE WHEN k % 3 = 0 THEN ' echo $_GET[\"q\"];' ELSE '' END",
    "'    $sql = \"SELECT x FROM dbo.t' || (k % 6) || ' WHERE id = {$a}\";'", "CASE WHEN k % 2 = 0 THEN '    $sql .= \" AND y = 1\";' ELSE '    // none' END",
    "'    $conn->query($sql);'", "'    include \"inc/modal_' || (k % 3) || '.php\";'", "'    $u = \"?action=Conta.abrir&id=' || k || '\";'",
    "'    $conn->prepare(\"EXEC dbo.pr_' || (k % 2) || '\");'", "'    return \"}\" . $u;'", "'  }'", "'  protected function setNome($v) { $this->nome = $v; }'", "'}'", "''",
)

PAGE = lines_of_text(
    "'<div id=\"modal_' || (k % 4) || '\"></div><button class=\"btn\"> Salvar <b>' || (k % 3) || '</b></button>'",
    f"'<a class=\"btn\" href=\"#\" onclick=\"recuperaConteudoDinamico(this, '{_Q}'x.php?action=Ped.lista&id=' || k{_Q}', '{_Q}'#alvo' || (k % 5){_Q}')\" data-id=\"' || k || '\">Detalhamento ' || k || '</a>'",
    f"'<input type=\"button\" value=\"Ok ' || (k % 2) || '\" onclick=\"show('{_Q}'a,b'{_Q}', f(1, 2))\"/>'",
    "'<span class=\"x\" onclick=\"go(' || k || ')\">Repasse</span>'",
    "'<?php include \"inc/detalhe_' || (k % 3) || '.php\"; include \"other.php\"; ?>'",
    "'<script>'", "'const URL_A = \"a' || k || '.php\"; const N = 1 + ' || (k % 4) || ';'", "'const fd = new FormData();'",
    "'function enviar(x) { if (x) { console.log(x); } }'", "'$.ajax({ url: URL_A, method: \"POST\", data: fd, timeout: ' || (k % 9) || ' }).done(function (r) { Swal.fire({ title: r }); });'",
    "'$(\"#b' || (k % 2) || '\").on(\"click\", \".c\", function (e) { $.get(\"g' || (k % 3) || '.php\"); });'", "'</script>'",
    "CASE WHEN k % 2 = 0 THEN '<p>' ELSE '' END", "'<script src=\"s' || (k % 3) || '.js\"></script>'",
)

SQL = (
    "CASE k % 6 WHEN 0 THEN 'DECLARE @x INT; DECLARE @t' || (k % 4) || ' TABLE (i INT); SELECT a INTO #tmp' || (k % 5) || ' FROM ##g JOIN dbo.fn_' || (k % 3) || '(1) f ON 1 = 1'"
    " WHEN 1 THEN 'BEGIN TRY EXEC sp_executesql @q END TRY BEGIN CATCH ROLLBACK END CATCH'"
    " WHEN 2 THEN 'WITH c AS (SELECT 1 AS a) SELECT a FROM c; UPDATE t SET a = ' || k || chr(10) || 'WHERE b = 1'"
    " WHEN 3 THEN 'SELECT 1 FROM #a, #b, #c, #d, #e' || (k % 4) || '; EXEC p1; EXEC p2; EXEC p3; EXEC p4; EXEC p' || (k % 7)"
    " WHEN 4 THEN 'SELECT a FROM b' || chr(10) || 'select  a from B' || chr(10) || 'DELETE FROM c' || (k % 3)"
    " ELSE '-- SELECT' || chr(10) || 'UPDATE u SET x = 1 WHERE y = ' || k || '; DELETE FROM v' END"
)

_FILES = f"f AS (SELECT k, 'app/' || (k % 10) || '/Fachada' || k || '.php' AS path, {PHP} AS text FROM (SELECT p_partkey AS k FROM part)),\n"
_BODY = _FILES + (
    "l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS n FROM f),\n"
    "e AS (SELECT path, 'getId' AS method, min(n) FILTER (contains(line, 'public function')) AS a, min(n) FILTER (line = '  }') AS b FROM l GROUP BY path"
    " UNION ALL SELECT path, regexp_extract(line, 'function (\\w+)', 1), n, n FROM l WHERE contains(line, 'protected function')),\n"
    "m AS (SELECT f.path, method, k, text, a, b, array_to_string(string_split(text, chr(10))[a:b], chr(10)) AS body FROM f JOIN e USING (path))\n"
)
_PUBLIC = "WHERE contains(body, 'public function')"
_PAGES = f"p AS (SELECT k, {PAGE} AS html FROM (SELECT p_partkey AS k FROM part))\n"
_SQLS = f"s AS (SELECT k AS id, {SQL} AS sql FROM (SELECT o_orderkey AS k FROM orders)),\nt AS (SELECT id, sql, regexp_replace(sql, '--[^\\n]*', ' ', 'g') AS plain FROM s)\n"


def php_files(spark, sf_dir) -> DataFrame:
    k = part_keys(spark, sf_dir)
    return k.select(F.expr("'app/' || (k % 10) || '/Fachada' || k || '.php'").alias("path"), F.expr(PHP).alias("text"))


def ui_pages(spark, sf_dir) -> DataFrame:
    return part_keys(spark, sf_dir).select("k", F.expr(PAGE).alias("html"))


def sqls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("id"), F.expr(SQL).alias("sql"))


def _joined(column, separator: str = ",") -> F.Column:
    return F.array_join(column, separator)


def _all(text: str, pattern: str, group: int = 1) -> str:
    """SQL: the sorted distinct matches, joined."""
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern}', {group}))), ',')"


@query(f"""WITH {_SQLS} SELECT id, {_all('plain', '(##?\\w+)')} AS temp_tables, {_all('plain', '(?i)DECLARE\\s+(@\\w+)\\s+TABLE')} AS table_variables, {_all('plain', '(?i)DECLARE\\s+(@\\w+)')} AS variables,
 {_all('plain', '([a-zA-Z_]\\w*\\.[a-zA-Z_]\\w*)\\s*\\(')} AS function_calls, regexp_matches(plain, '(?i)sp_executesql') AS dynamic_sql, regexp_matches(plain, '(?is)BEGIN\\s+TRY.*BEGIN\\s+CATCH') AS try_catch,
 regexp_matches(plain, '#\\w') AS has_temp, regexp_matches(plain, '(?i)WITH\\s+\\w+\\s+AS\\s*\\(') AS cte,
 regexp_matches(plain, '(?i)\\bUPDATE\\b') AND NOT contains(upper(regexp_extract(plain, '(?is)\\bUPDATE\\b[^;]*')), ' WHERE ') AS update_strict,
 regexp_matches(plain, '(?i)\\bDELETE\\b') AND NOT contains(upper(regexp_extract(plain, '(?is)\\bDELETE\\b[^;]*')), ' WHERE ') AS delete_strict FROM t""")
def sql_details(spark, sf_dir):
    a = sqltext.analyse_sql(sqls(spark, sf_dir), strict=True)
    r = F.col("resources")
    arrays = [_joined(c).alias(c) for c in ("temp_tables", "table_variables", "variables", "function_calls")]
    flags = [r[k].alias(n) for k, n in (("dynamic_sql", "dynamic_sql"), ("try_catch", "try_catch"), ("temp_tables", "has_temp"), ("cte", "cte"))]
    return a.select("id", *arrays, *flags, F.col("update_without_where").alias("update_strict"), F.col("delete_without_where").alias("delete_strict"))


# SQL whose literals, comments and brackets hold what would be SQL elsewhere; ~ stands for a single quote.
QUOTED = (
    "replace(CASE k % 9 WHEN 0 THEN 'SELECT ~a -- b~ AS x FROM dbo.m' || (k % 5) || ' -- tail' || chr(10) || 'WHERE y = ~it~~s DELETE FROM z~'"
    " WHEN 1 THEN 'UPDATE t SET a = ~/* no */~ /* WHERE */; SELECT [delete], ' || k || ' FROM [u v]'"
    " WHEN 2 THEN 'DELETE FROM v' || (k % 3) || chr(10) || 'WHERE a = 1; DELETE FROM w -- WHERE'"
    " WHEN 3 THEN 'INSERT INTO h (a) SELECT b FROM c WHERE d = ~MERGE INTO x~; MERGE INTO g USING f ON 1 = ' || k"
    " WHEN 4 THEN 'WITH c AS (SELECT ' || k || ' AS a) SELECT a FROM c'"
    " WHEN 5 THEN 'SELECT 1 FROM a; select  1  FROM A; SELECT 2 FROM b JOIN c' || (k % 4) || ' ON 1 = 1'"
    " WHEN 6 THEN 'EXEC p ~SELECT 1 FROM x~, \"UPDATE y\"'"
    " WHEN 7 THEN '/* DELETE FROM n -- */ UPDATE q SET s = ~WHERE~ || ' || k"
    " ELSE 'SELECT ~open FROM x' END, '~', chr(39))"
)
_MASKED = f"""q AS (SELECT k AS id, {QUOTED} AS sql FROM (SELECT o_orderkey AS k FROM orders)),
w AS (SELECT id, sql, regexp_extract_all(sql, '(?s)--[^\\r\\n]*|/\\*.*?\\*/|''[^'']*(?:''|$)|"[^"]*"|\\[[^\\]]*\\]|[^''"\\[/-]+|.') AS words FROM q),
v AS (SELECT id, words, array_to_string(list_transform(words, lambda x, i: CASE WHEN x LIKE '--%' OR x LIKE '/*%' THEN ' ' WHEN x LIKE '''%' THEN '''' || (i - 1) || '''' WHEN x LIKE '"%' THEN '"' || (i - 1) || '"' ELSE x END), '') AS plain,
  array_to_string(list_transform(words, lambda x, i: CASE WHEN x LIKE '--%' OR x LIKE '/*%' THEN ' ' WHEN x LIKE '''%' THEN '''' || (i - 1) || '''' WHEN x LIKE '"%' THEN '"' || (i - 1) || '"' WHEN x LIKE '[%' THEN '[' || (i - 1) || ']' ELSE x END), '') AS verbs FROM w)"""
_VERBS = "['DELETE', 'INSERT', 'MERGE', 'SELECT', 'UPDATE']"


def quoted_sqls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("id"), F.expr(QUOTED).alias("sql"))


def _no_where(verb: str) -> str:
    return f"len(list_filter(regexp_extract_all(verbs, '(?is)\\b{verb}\\b[^;]*'), lambda x: NOT regexp_matches(x, '(?i)\\bWHERE\\b'))) > 0"


@query(f"""WITH {_MASKED},
o AS (SELECT *, list_filter({_VERBS}, lambda x: regexp_matches(verbs, '(?i)\\b' || x || CASE x WHEN 'INSERT' THEN '\\s+INTO' ELSE '' END || '\\b')) AS ops FROM v)
SELECT id, array_to_string(ops, ',') AS operations, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(plain, '(?i)\\b(?:FROM|JOIN)\\s+([#@\\[\\]\\w.]+)', 1), lambda x: regexp_replace(x, '[\\[\\]]', '', 'g')))), ',') AS tables_read,
 array_to_string(list_sort(list_distinct(regexp_extract_all(plain, '(?i)\\b(?:INSERT\\s+INTO|UPDATE|DELETE\\s+FROM|MERGE\\s+INTO)\\s+(\\w+)', 1))), ',') AS tables_write,
 {_no_where('UPDATE')} AS update_without_where, {_no_where('DELETE')} AS delete_without_where,
 CASE WHEN len(list_filter(ops, lambda x: x <> 'SELECT')) = 0 THEN 'read' WHEN list_contains(ops, 'SELECT') THEN 'read_write' ELSE 'write' END AS kind FROM o""")
def sql_quoted(spark, sf_dir):
    a = sqltext.analyse_sql(quoted_sqls(spark, sf_dir))
    arrays = [_joined(c).alias(c) for c in ("operations", "tables_read", "tables_write")]
    return a.select("id", *arrays, "update_without_where", "delete_without_where", "kind")


@query(f"""WITH {_MASKED},
p AS (SELECT id, words, unnest(string_split(regexp_replace(verbs, '(?i)\\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\\b', chr(1) || '\\1', 'g'), chr(1))) AS piece FROM v),
r AS (SELECT id, upper(regexp_extract(piece, '^\\w+')) AS verb, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(piece, '''\\d+''|"\\d+"|\\[\\d+\\]|[^''"\\[]+|.'),
  lambda x: CASE WHEN regexp_full_match(x, '[''"\\[]\\d+[''"\\]]') THEN words[CAST(regexp_extract(x, '\\d+') AS INT) + 1] ELSE x END), ''), '[ \\t]+\\n', chr(10), 'g'), ' ' || chr(10)) AS statement FROM p)
SELECT id, verb, min(statement) AS statement, upper(regexp_replace(statement, '\\s+', ' ', 'g')) AS folded FROM r WHERE list_contains({_VERBS}, verb) GROUP BY id, verb, folded""")
def sql_statements(spark, sf_dir):
    rows = exploded(quoted_sqls(spark, sf_dir), sqltext.all_statements(F.col("sql")), "s", "id").select("id", "s.*")
    return rows.withColumn("folded", F.upper(F.regexp_replace("statement", r"\s+", " ")))


@query(f"""WITH {_SQLS}, w AS (SELECT id, list_filter([
 CASE WHEN regexp_matches(plain, '(?i)sp_executesql') THEN 'Uso de SQL dinâmico' END, CASE WHEN regexp_matches(plain, '(?i)\\bROLLBACK\\b') THEN 'Uso de transações' END,
 CASE WHEN len(list_distinct(regexp_extract_all(plain, '##?\\w+'))) >= 5 THEN 'Uso intenso de temp tables' END,
 CASE WHEN regexp_matches(plain, '(?i)\\bDELETE\\b') AND NOT regexp_matches(regexp_extract(plain, '(?is)\\bDELETE\\b[^;]*'), '(?i)\\bWHERE\\b') THEN 'DELETE sem WHERE detectado' END,
 CASE WHEN regexp_matches(plain, '(?i)\\bUPDATE\\b') AND NOT regexp_matches(regexp_extract(plain, '(?is)\\bUPDATE\\b[^;]*'), '(?i)\\bWHERE\\b') THEN 'UPDATE sem WHERE detectado' END,
 CASE WHEN len(list_distinct(regexp_extract_all(plain, '(?i)\\bEXEC\\s+(\\w+)', 1))) >= 5 THEN 'Múltiplas chamadas para outras procedures' END], lambda x: x IS NOT NULL) AS ws FROM t)
SELECT warning, count(*) AS n FROM (SELECT unnest(ws) AS warning FROM w) GROUP BY warning""")
def sql_warnings(spark, sf_dir):
    a = exploded(sqltext.analyse_sql(sqls(spark, sf_dir)), F.col("warnings"), "warning")
    return a.groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FILES.rstrip().rstrip(',')}, h AS (SELECT path, replace(regexp_extract(text, '\\$sql = "([^"]*)"', 1), '{{$a}}', ':var') AS first, trim(regexp_extract(text, '\\$sql \\.= "([^"]*)"', 1)) AS more, regexp_extract(text, 'prepare\\("([^"]*)"', 1) AS direct FROM f)
SELECT path, 'variavel' AS kind, '$sql' AS variable, NULL AS method, first || CASE WHEN more <> '' THEN chr(10) || more ELSE '' END AS sql FROM h
UNION ALL SELECT path, 'variavel_em_chamada', '$sql', 'query', first || CASE WHEN more <> '' THEN chr(10) || more ELSE '' END FROM h UNION ALL SELECT path, 'direto', NULL, 'prepare', direct FROM h""")
def embedded_sql(spark, sf_dir):
    return exploded(php_files(spark, sf_dir), sqltext.embedded_sql(F.col("text")), "s", "path").select("path", "s.*")


@query(f"""WITH {_BODY} SELECT path, method, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, array_to_string(list_filter(['$_REQUEST', '$_GET', '$_POST', '$_SESSION', '$_FILES', '$_SERVER', '$_COOKIE'], lambda x: contains(body, x)), ',') AS superglobals,
 array_to_string(list_filter(regexp_extract_all(body, '(\\$\\w+->\\w+)\\s*\\(', 1), lambda x: NOT (regexp_matches(lower(x), '^\\$(stm|stmt|conn|pdo)->(prepare|bindvalue|execute|fetch|fetchall|query|closecursor)$'))), ',') AS calls,
 {_all('body', '(include [^;\\n]+)')} AS includes, {_all('body', 'action=([A-Z]\\w*\\.\\w+)')} AS actions, CAST(len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '(?i)(select|insert|update|delete|from|join|exec|where) '))) AS INT) AS sql_lines,
 {_all('body', '(?i)\\b(?:from|join|update|into)\\s+([\\w.]+)')} AS tables, {_all('body', '(?i)\\bexec\\s+([\\w.]+)')} AS procedures FROM m""")
def method_usage(spark, sf_dir):
    r = code.method_records(code.methods(php_files(spark, sf_dir), aware=True))
    called = F.transform("calls", lambda c: F.concat(c["object"], F.lit("->"), c["method"]))
    arrays = [_joined(c).alias(c) for c in ("superglobals", "includes", "actions", "tables", "procedures")]
    return r.select("path", "method", "start_line", "end_line", *arrays, _joined(called).alias("calls"), F.size("sql_lines").alias("sql_lines"))


@query(f"""WITH {_BODY} SELECT path, method, array_to_string(list_filter([CASE WHEN contains(body, '$_GET') THEN 'input' END, CASE WHEN contains(body, 'new ') THEN 'objects' END, CASE WHEN contains(body, '->salvar') THEN 'calls' END, CASE WHEN regexp_matches(body, '"SELECT') THEN 'sql' END,
 CASE WHEN regexp_matches(body, '(?i)\\bexec\\s+\\w') THEN 'procedures' END, CASE WHEN regexp_matches(body, '\\binclude\\b') THEN 'includes' END, CASE WHEN regexp_matches(body, '\\becho\\b') THEN 'output' END, CASE WHEN regexp_matches(body, '\\breturn\\b') THEN 'return' END], lambda x: x IS NOT NULL), ',') AS steps FROM m""")
def flow_steps(spark, sf_dir):
    m = code.methods(php_files(spark, sf_dir), aware=True)
    return m.select("path", "method", _joined(code.flow_steps(F.col("body"))).alias("steps"))


_AT = "SELECT path, string_agg(x || '@' || n, ',' ORDER BY n) AS v FROM (SELECT l.path, n, regexp_extract(line, '{p}', 1) AS x FROM l JOIN e USING (path) WHERE method = 'getId' AND n BETWEEN a AND b) WHERE x <> '' GROUP BY path"


@query(f"""WITH {_BODY}, o AS ({_AT.format(p='\\bnew\\s+(\\w+)\\s*\\(')}), st AS ({_AT.format(p='\\b(\\w+::\\w+)\\s*\\(')}), mc AS ({_AT.format(p='(\\$\\w+->\\w+)\\s*\\(')})
SELECT m.path, 'getId' AS method, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, o.v AS objects, st.v AS static_calls, mc.v AS method_calls, {_all('body', '(?i)\\bFROM\\s+([\\w.]+)')} AS tables,
 array_to_string(list_sort([regexp_extract(body, 'new (\\w+)', 1), regexp_extract(body, '(\\w+)::', 1)]), ',') AS dependencies,
 CAST(contains(body, '$_GET') AS INT) + CAST(contains(body, 'echo ') AS INT) + CAST(regexp_matches(body, '"[^"]*SELECT') AS INT) + CAST(contains(body, 'new Persistencia') AS INT) AS notes
FROM m JOIN o USING (path) JOIN st USING (path) JOIN mc USING (path) {_PUBLIC}""")
def facade_methods(spark, sf_dir):
    r = code.facade_methods(php_files(spark, sf_dir))
    at = lambda c: _joined(F.transform(c, lambda x: F.concat(x["name"], F.lit("@"), x["line"].cast("string")))).alias(c)
    return r.select("path", "method", "start_line", "end_line", *map(at, ("objects", "static_calls", "method_calls")), _joined("tables").alias("tables"), _joined("dependencies").alias("dependencies"), F.size("notes").alias("notes"))


@query(f"""WITH {_BODY} SELECT path, 'getId' AS method FROM (SELECT path, b - a AS size, len(regexp_extract_all(body, '"[^"]*(SELECT|EXEC)[^"]*"')) AS blocks,
 CAST(contains(body, '$_GET') AS INT) + CAST(contains(body, 'echo ') AS INT) AS notes FROM m {_PUBLIC}) ORDER BY blocks DESC, size DESC, notes DESC, path LIMIT 12""")
def relevant_methods(spark, sf_dir):
    return code.relevant_methods(code.facade_methods(php_files(spark, sf_dir))).select("path", "method")


@query(f"""WITH {_FILES.rstrip().rstrip(',')} SELECT path, regexp_extract(text, '@author (\\w+)', 1) AS author, CAST(NULL AS VARCHAR) AS package, regexp_extract(text, '@SGBD (\\w+)', 1) AS sgbd, regexp_extract(text, '@tabela (\\w+)', 1) AS tabela FROM f""")
def class_headers(spark, sf_dir):
    return php_files(spark, sf_dir).select("path", code.class_header(F.col("text")).alias("h")).select("path", "h.*")


@query(f"""WITH {_FILES} n AS (SELECT path, unnest(regexp_extract_all(text, 'function (\\w+)', 1)) AS method FROM f)
SELECT path, method, CASE WHEN regexp_matches(method, '(?i)^get.') THEN 'getter' WHEN regexp_matches(method, '(?i)^set.') THEN 'setter' ELSE 'other' END AS kind, lower(substr(method, 4, 1)) || substr(method, 5) AS property FROM n""")
def accessors(spark, sf_dir):
    m = code.methods(php_files(spark, sf_dir), aware=True)
    return m.select("path", "method", code.accessor(F.col("method")).alias("a")).select("path", "method", "a.*")


@query(f"""WITH {_FILES.rstrip().rstrip(',')} SELECT 1 AS rank_, min(path) AS path FROM f WHERE regexp_extract(path, '([^/]+)$', 1) = 'Fachada7.php' UNION ALL SELECT 2, min(path) FROM f WHERE contains(text, 'function getId(')
UNION ALL SELECT 3, path FROM f WHERE regexp_matches(text, 'class Fachada9\\b')""")
def located(spark, sf_dir):
    files = php_files(spark, sf_dir)
    a, b = rules.locate_file(files, "Fachada7"), rules.locate_method(files, "getId")
    c = code.locate_target(files, "Fachada9.getId").select("path")
    return a.select(F.lit(1).alias("rank_"), "path").unionByName(b.select(F.lit(2).alias("rank_"), "path")).unionByName(c.select(F.lit(3).alias("rank_"), "path"))


@query(f"""WITH {_FILES} n AS (SELECT DISTINCT '' AS parent, 'app' AS name, true AS is_dir FROM f UNION SELECT 'app', split_part(path, '/', 2), true FROM f UNION SELECT 'app/' || split_part(path, '/', 2), split_part(path, '/', 3), false FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) AS place FROM n) SELECT parent, name, is_dir, CAST(place AS INT) AS place FROM r WHERE place <= 25""")
def directory_tree(spark, sf_dir):
    return rules.directory_tree(php_files(spark, sf_dir)).select("parent", "name", "is_dir", "place")


@query(f"""WITH {_PAGES} SELECT k, {_all('html', '(?i)id="([^"]*modal[^"]*)"')} AS modals, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<button[^>]*>(.*?)</button>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS buttons,
 array_to_string(list_sort(regexp_extract_all(html, '(?is)onclick="([^"]+)"', 1)), '|') AS onclicks, replace(regexp_extract(html, 'data-\\w+="[^"]+"'), '"', '') AS data_attributes, {_all('html', 'include "([^"]+)"')} AS includes,
 {_all('html', '\\$\\.get\\("([^"]+)"')} || ',' || regexp_extract(html, 'action=([\\w.&=-]+)', 1) AS endpoints FROM p""")
def page_elements(spark, sf_dir):
    h = F.col("html")
    return ui_pages(spark, sf_dir).select(
        "k", _joined(web.modals(h)).alias("modals"), _joined(web.buttons(h)).alias("buttons"), _joined(F.array_sort(web.onclicks(h)), "|").alias("onclicks"),
        _joined(web.data_attributes(h)).alias("data_attributes"), _joined(F.array_sort(web.include_paths(h))).alias("includes"), _joined(F.array_sort(web.endpoints(h), lambda a, b: F.when(a < b, 1).when(a > b, -1).otherwise(0))).alias("endpoints"),
    )


@query(f"""WITH {_PAGES}, c AS (SELECT k, 'a' AS element, regexp_extract(html, '(?is)<a [^>]*>(.*?)</a>', 1) AS label, regexp_extract(html, '(?is)<a [^>]*onclick="([^"]*)"', 1) AS onclick, regexp_extract(html, '<a class="(\\w+)"', 1) AS class FROM p
 UNION ALL SELECT k, 'input', regexp_extract(html, 'value="([^"]*)"', 1), regexp_extract(html, '<input[^>]*onclick="([^"]*)"', 1), '' FROM p UNION ALL SELECT k, 'generic', regexp_extract(html, '<span[^>]*>([^<]*)<', 1), regexp_extract(html, '<span[^>]*onclick="([^"]*)"', 1), 'x' FROM p)
SELECT k, element, label, onclick, class, CASE WHEN regexp_matches(lower(class || ' ' || label), 'small-box-footer|detalhamento|financeiro|repasse|decreto|remanejamento') THEN 'high' WHEN regexp_matches(lower(class || ' ' || label), 'btn|link|modal|consultar|listar') THEN 'medium' ELSE 'normal' END AS priority,
 CASE WHEN contains(lower(label || ' ' || onclick), 'decreto') THEN 'detalhamento_decreto' WHEN contains(lower(label || ' ' || onclick), 'detalhamento') THEN 'detalhamento_generico' END AS hint,
 CASE WHEN regexp_matches(lower(onclick), 'action=|recuperaconteudodinamico|\\$\\.ajax') THEN 'backend_trigger' WHEN regexp_matches(lower(onclick), 'show\\(|hide\\(|style\\.display|\\.text\\(|#tab') THEN 'dom_toggle' WHEN contains(lower(onclick), 'datatable') THEN 'datatable_init' ELSE 'unknown' END AS behaviour FROM c""")
def clickables(spark, sf_dir):
    c = exploded(ui_pages(spark, sf_dir), web.clickables(F.col("html")), "c", "k").select("k", "c.element", "c.label", "c.onclick", "c.class")
    return c.withColumns({"priority": web.priority(F.col("class"), F.col("label")), "hint": web.semantic_hint(F.col("label"), F.col("onclick")), "behaviour": web.js_behaviour(F.col("onclick"))})


@query(f"""WITH {_PAGES}, o AS (SELECT k, unnest(regexp_extract_all(html, 'onclick="([^"]+)"', 1)) AS onclick FROM p), i AS (SELECT k, regexp_extract(onclick, '^(\\w+)\\(', 1) AS function, regexp_extract(onclick, '^\\w+\\((.*)\\)$', 1) AS inner_ FROM o)
SELECT k, function, CAST(len(string_split(regexp_replace(regexp_replace(inner_, chr(39) || '[^' || chr(39) || ']*' || chr(39), '', 'g'), '\\([^()]*\\)', '', 'g'), ',')) AS INT) AS args FROM i""")
def js_calls(spark, sf_dir):
    rows = exploded(ui_pages(spark, sf_dir), web.onclicks(F.col("html")), "o", "k").select("k", web.js_call(F.col("o")).alias("c"))
    return rows.select("k", "c.function", F.size("c.args").alias("args"))


@query(f"""WITH {_PAGES} SELECT k, regexp_extract(html, 'action=(\\w+)\\.', 1) AS class, regexp_extract(html, 'action=\\w+\\.(\\w+)', 1) AS method, regexp_extract(html, 'action=[\\w.]+&id=(\\d+)', 1) AS id_param, regexp_extract(html, 'action=(\\w+)\\.', 1) || 'CTR::' || regexp_extract(html, 'action=\\w+\\.(\\w+)', 1) || '()' AS backend,
 regexp_extract(html, 'this, ' || chr(39) || '([^' || chr(39) || ']*)', 1) AS endpoint, regexp_extract(html, chr(39) || '(#\\w+)', 1) AS target FROM p""")
def page_actions(spark, sf_dir):
    h = F.col("html")
    rows = exploded(ui_pages(spark, sf_dir), web.actions(h), "a", "k", web.dynamic_loads(h)[0].alias("d"))
    return rows.select("k", "a.class", "a.method", F.element_at("a.params", "id").alias("id_param"), "a.backend", "d.endpoint", "d.target")


@query(f"""WITH {_PAGES}, i AS (SELECT 'p' || k AS path, unnest(regexp_extract_all(html, 'include "([^"]+)"', 1)) AS include FROM p), x AS (SELECT 'inc/detalhe_' || (k * 2) || '.php' AS target, regexp_extract(html, 'action=(\\w+\\.\\w+)', 1) AS action FROM p)
SELECT path, include, CASE WHEN x.target IS NULL THEN 'não encontrado' ELSE 'ok' END AS status, action FROM i LEFT JOIN x ON include = x.target WHERE regexp_matches(include, 'modal_|financeiro|detalhe|resultado|consulta|decreto|encaminhamento')""")
def include_analysis(spark, sf_dir):
    pages = ui_pages(spark, sf_dir)
    files = pages.select(F.expr("'p' || k").alias("path"), F.col("html").alias("text"))
    known = pages.select(F.expr("'inc/detalhe_' || (k * 2) || '.php'").alias("path"), F.col("html").alias("text"))
    found = web.relevant_includes(files.unionByName(known)).where("path LIKE 'p%'")
    return found.select("path", "include", "status", F.concat_ws(".", F.col("actions")[0]["class"], F.col("actions")[0]["method"]).alias("a")).select("path", "include", "status", F.nullif("a", F.lit("")).alias("action"))


@query(f"""WITH {_PAGES}, b AS (SELECT k, html, unnest(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>')) AS s, unnest(range(len(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>')))) + 1 AS block FROM p)
SELECT k, CAST(block AS INT) AS block, nullif(regexp_extract(s, '^<script src="([^"]+)"', 1), '') AS src, CAST(length(split_part(html, s, 1)) - length(replace(split_part(html, s, 1), chr(10), '')) + 1 AS INT) AS start_line FROM b""")
def script_places(spark, sf_dir):
    return web.script_blocks(ui_pages(spark, sf_dir), "k").select("k", "block", "src", "start_line")


@query(f"""WITH {_PAGES} SELECT k, regexp_extract(html, 'const URL_A = "([^"]*)"', 1) AS url_a, trim(regexp_extract(html, 'const N = ([^;]*);', 1)) AS n, CAST(len(regexp_extract_all(html, '\\bfunction \\w+\\(')) AS INT) AS functions, CAST(len(regexp_extract_all(html, '\\.done\\(')) AS INT) AS callbacks, CAST(len(regexp_extract_all(html, 'Swal\\.fire')) AS INT) AS swals,
 CAST(len(regexp_extract_all(html, '\\.on\\("click"')) AS INT) AS events, regexp_extract(html, 'url: (\\w+)', 1) AS url, regexp_extract(html, 'method: "(\\w+)"', 1) AS method, trim(regexp_extract(html, 'timeout: (\\d+)', 1)) AS timeout, 'fd' AS form_data, regexp_extract(html, '\\$\\("([^"]*)"', 1) AS selector, CAST(len(regexp_extract_all(html, 'console\\.\\w+\\(')) AS INT) AS console,
 CAST(contains(html, 'FormData') AS INT) + CAST(contains(html, '$.ajax') AS INT) + CAST(contains(html, '.done(') AS INT) + CAST(contains(html, '.fail(') AS INT) + CAST(contains(html, 'Swal.fire') AS INT) + CAST(contains(html, 'console.') AS INT) + CAST(contains(html, '$(document).on(') AS INT) AS steps FROM p""")
def script_details(spark, sf_dir):
    s = web.script_blocks(ui_pages(spark, sf_dir), "k").where("src IS NULL")
    b = F.col("body")
    constant = lambda name: F.filter(web.js_constants(b), lambda x: x["name"] == name)[0]["value"]
    with_calls = s.select("k", "body", web.ajax_calls("body").alias("ajax"), web.js_functions("body").alias("fs"), web.callbacks("body").alias("cs"), web.swal_calls("body").alias("ws"), web.jquery_events("body").alias("es"), web.script_summary(b).alias("s"))
    f = web.ajax_fields(F.col("ajax")[0]["text"])
    return with_calls.select(
        "k", constant("URL_A").alias("url_a"), constant("N").alias("n"), F.size("fs").alias("functions"), F.size("cs").alias("callbacks"), F.size("ws").alias("swals"), F.size("es").alias("events"),
        f["url"].alias("url"), f["method"].alias("method"), f["timeout"].alias("timeout"), F.col("s.form_data")[0].alias("form_data"), F.col("s.selectors")[0].alias("selector"), F.size("s.console").alias("console"), F.size("s.steps").alias("steps"),
    )


@query(f"""WITH {_PAGES}, a AS (SELECT DISTINCT regexp_extract(html, 'action=(\\w+)\\.', 1) AS class, regexp_extract(html, 'action=\\w+\\.(\\w+)', 1) AS method FROM p UNION SELECT 'Fachada' || k, CASE WHEN k % 2 = 0 THEN 'getid' ELSE 'none' END FROM p)
SELECT class, method, CASE WHEN method = 'getid' THEN 'app/' || (CAST(substr(class, 8) AS INT) % 10) || '/' || class || '.php' END AS target, CASE WHEN method <> 'getid' THEN 'method not found' END AS error FROM a""")
def action_traces(spark, sf_dir):
    acts = exploded(ui_pages(spark, sf_dir), web.actions(F.col("html")), "a").select("a.class", "a.method")
    more = table(spark, sf_dir, "part").select(F.expr("'Fachada' || p_partkey").alias("class"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'getid' ELSE 'none' END").alias("method"))
    return code.action_traces(acts.unionByName(more), code.methods(php_files(spark, sf_dir), aware=True)).select("class", "method", "target", "error")


# Lines of SQL among comments, tags, styles and scripts.
_MIXED = lines_of_text(
    "CASE k % 9 WHEN 0 THEN 'SELECT a  FROM t' || (k % 3) WHEN 1 THEN '<select id=\"from\">' WHEN 2 THEN 'DELETE FROM log' WHEN 3 THEN '  // select a from b' WHEN 4 THEN 'from: select a from b;'"
    " WHEN 5 THEN 'body select { color: red; from x' WHEN 6 THEN 'x.onblur = select(y) from z' WHEN 7 THEN 'a <b class=\"c\"> select d from e' ELSE 'select from {' END",
    "'UPDATE x SET a = 1'", "'UPDATE  x SET a = 1'",
)


@query(f"""WITH p AS (SELECT 'm' || k AS path, {_MIXED} AS text FROM (SELECT p_partkey AS k FROM part)), l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(3)) + 1 AS n FROM p),
d AS (SELECT path, n, CASE WHEN regexp_matches(line, '(?i)\\bselect\\b.*\\bfrom\\b') THEN 'select_from' WHEN regexp_matches(line, '(?i)\\bupdate\\b.*\\bset\\b') THEN 'update_set' WHEN regexp_matches(line, '(?i)\\bdelete\\s+from\\b') THEN 'delete_from' END AS kind, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text
 FROM l WHERE NOT regexp_matches(trim(line), '^</?[a-z]|[{{]$|^[.#}}]|color:|[{{]$|from\\s*[{{]|<.* class=.*>|<.*>.* class='))
SELECT path, CAST(min(n) AS INT) AS line_no, kind, text FROM d WHERE kind IS NOT NULL GROUP BY path, kind, text""")
def suspect_sql(spark, sf_dir):
    files = part_keys(spark, sf_dir).select(F.expr("'m' || k").alias("path"), F.expr(_MIXED).alias("text"))
    return web.sql_lines(files)


# A fiftieth of the files have about as many lines as make a file large.
_LARGE = "repeat('x' || chr(10), CAST(CASE WHEN k % 50 = 0 THEN 1998 + floor(k / 50) % 5 ELSE k % 9 END AS INT)) || '$u == \"admin\"'"


@query(f"""WITH f AS (SELECT 'big' || k AS path, {_LARGE} AS text FROM (SELECT p_partkey AS k FROM part)), n AS (SELECT path, len(string_split(text, chr(10))) AS n FROM f)
SELECT path, CAST(1 AS INT) AS line_no, 'large_file' AS rule_id, CAST(n AS VARCHAR) AS matched_text FROM n WHERE n > 2000 UNION ALL SELECT path, CAST(n AS INT), 'hardcoded_login_generic', '$u == "admin"' FROM n UNION ALL SELECT path, CAST(n AS INT), 'possible_missing_semicolon', '$u == "admin"' FROM n""")
def large_files(spark, sf_dir):
    files = part_keys(spark, sf_dir).select(F.expr("'big' || k").alias("path"), F.expr(_LARGE).alias("text"))
    return rules.apply_rules(files, (*rules.RULES, rules.GENERIC_LOGIN)).select("path", "line_no", "rule_id", "matched_text")


@query("SELECT doc_id, regexp_replace(text, '(?i)tion', '[\\0]', 'g') AS marked FROM documents")
def highlighted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.highlight(F.col("text"), "tion").alias("marked"))


@query(f"""WITH {_BODY} SELECT path, method, sha256('{{"path":"' || path || '","method":"' || method || '"}}') AS key FROM m""")
def payload_keys(spark, sf_dir):
    m = code.methods(php_files(spark, sf_dir), aware=True)
    return m.select("path", "method", reports.payload_key("path", "method").alias("key"))


@query(f"""WITH {_BODY} SELECT path, method, array_to_string(list_concat(list_transform(regexp_extract_all(body, '->(salvar)\\(', 1), lambda x: regexp_extract(body, 'new (\\w+)', 1) || '::' || x),
 list_sort(list_distinct(regexp_extract_all(body, '(?i)\\b(?:from|join|update|into)\\s+([\\w.]+)', 1))), list_transform(list_sort(list_distinct(regexp_extract_all(body, 'EXEC ([\\w.]+)', 1))), lambda x: 'PROC:' || x)), ',') AS names FROM m""")
def analysis_inputs(spark, sf_dir):
    r = code.method_records(code.methods(php_files(spark, sf_dir), aware=True))
    return reports.analysis_input(r).select("path", "method", _joined("names").alias("names"))
