"""Queries over program files that call and include each other, facades and models with faults, and scripts.

As in text_queries, each kind of text is one expression over ``part`` that both engines read; the SQL computes its rows
from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exploded
from ..operators import closure, code, layouts, web
from ..shared import stored
from .queries import part_keys, query
from .text_queries import lines_of_text

_HALF = "CAST(floor(k / 10) AS INT)"

# Files that call and include the file of a tenth of their number, and a third of them that of ten times it, so that
# there are several levels, cycles, and calls and includes that lead nowhere.
LIB = lines_of_text(
    "'<?php'",
    "'class Mod' || k || ' {'",
    "'  public function run($x) {'",
    f"'    include \"m' || {_HALF} || '.php\";'",
    "CASE WHEN k % 3 = 1 THEN '    require_once(\"lib/m' || (k * 10) || '.php\");' ELSE '    // none' END",
    f"'    $a = new Mod' || {_HALF} || '();'",
    "'    $a->run($x);'",
    "CASE WHEN k % 3 = 1 THEN '    $b = new Mod' || (k * 10) || '(); $b->run($x); $b->missing($x);' ELSE '    // none' END",
    "'    $q = \"SELECT a FROM t' || (k % 5) || ' JOIN dbo.v' || (k % 7) || ' ON 1 = 1\";'",
    "'    $c->query($q);'",
    "'    $d->prepare(\"EXEC dbo.pr_' || (k % 2) || '\");'",
    "'    $u = \"?action=Mod' || k || '.open\";'",
    "'  }'",
    "'}'",
)

_LIB = f"f AS (SELECT k, 'lib/m' || k || '.php' AS path, {LIB} AS text FROM (SELECT p_partkey AS k FROM part))"
_CALLS = r"""
made AS (SELECT path, unnest(regexp_extract_all(text, '(\$\w+) = new (\w+)\(', 1)) AS v, unnest(regexp_extract_all(text, '(\$\w+) = new (\w+)\(', 2)) AS class FROM f),
called AS (SELECT path, unnest(regexp_extract_all(text, '(\$\w+)->(\w+)\(', 1)) AS v, unnest(regexp_extract_all(text, '(\$\w+)->(\w+)\(', 2)) AS m,
                  unnest(range(len(regexp_extract_all(text, '(\$\w+)->(\w+)\(')))) AS n FROM f),
files AS (SELECT path, text, regexp_extract(text, 'class (\w+)', 1) AS class FROM f)"""
_INCLUDES = r"""
asked AS (SELECT path, unnest(regexp_extract_all(text, '(?:include|require_once)\W+([\w/.]+)"', 1)) AS inc, unnest(range(len(regexp_extract_all(text, '(?:include|require_once)\W+([\w/.]+)"')))) AS n FROM f),
looked AS (SELECT a.path, inc, n, a.n AS place, coalesce(r.path, s.path, inc) AS target, r.path IS NOT NULL OR s.path IS NOT NULL AS found
           FROM asked a LEFT JOIN f r ON r.path = inc LEFT JOIN f s ON s.path = regexp_replace(a.path, '[^/]*$', '') || inc)"""
#: More levels than any of the driver's tables has.
_LEVELS = 16
_REACHED = f"""
r AS (SELECT source AS start, target AS node, 1 AS level FROM e
      UNION SELECT r.start, e.target, level + 1 FROM r JOIN e ON r.node = e.source WHERE level < {_LEVELS})
SELECT start, node, CAST(min(level) AS INT) AS level FROM r GROUP BY start, node"""


def lib_files(spark, sf_dir) -> DataFrame:
    k = part_keys(spark, sf_dir)
    return k.select(F.expr("'lib/m' || k || '.php'").alias("path"), F.expr(LIB).alias("text"))


@query(f"""WITH RECURSIVE {_LIB},{_CALLS},
e AS (SELECT DISTINCT c.path || '::run' AS source, t.path || '::' || m AS target FROM called c JOIN made USING (path, v) JOIN files t USING (class) WHERE contains(t.text, 'function ' || m || '(')),
{_REACHED}""")
def call_closure(spark, sf_dir):
    files = lib_files(spark, sf_dir)
    return closure.call_closure(stored(code.methods(files)), files)


@query(f"""WITH RECURSIVE {_LIB},{_INCLUDES}, e AS (SELECT DISTINCT path AS source, target FROM looked WHERE found),
{_REACHED}""")
def include_closure(spark, sf_dir):
    return closure.include_closure(lib_files(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LIB},{_INCLUDES}, e AS (SELECT DISTINCT path AS source, target FROM looked WHERE found),
r AS (SELECT path AS start, path AS node FROM f UNION SELECT r.start, e.target FROM r JOIN e ON r.node = e.source),
t AS (SELECT DISTINCT start, regexp_extract(text, 'FROM (\\w+)', 1) AS name FROM r JOIN f ON r.node = f.path)
SELECT start AS path, string_agg(name, ',' ORDER BY name) AS tables FROM t GROUP BY start""")
def tables_of_includes(spark, sf_dir):
    files = lib_files(spark, sf_dir)
    parts = files.select("path", F.regexp_extract("text", r"FROM (\w+)", 1).alias("name"))
    reached = closure.included_parts(files, parts)
    return reached.groupBy(F.col("start").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tables"))


@query(f"WITH {_LIB},{_INCLUDES} SELECT path, target, found FROM looked")
def include_targets(spark, sf_dir):
    files = lib_files(spark, sf_dir)
    asked = exploded(files, code.includes(F.col("text")), "include", "path")
    return code.resolve_includes(asked, files).select("path", "target", "found")


@query(
    f"""WITH {_LIB},{_CALLS},{_INCLUDES},"""
    + r"""
c AS (SELECT c.path, n, c.v, m, class FROM called c LEFT JOIN made USING (path, v)),
parts AS (SELECT path, regexp_extract(text, 'EXEC ([\w.]+)', 1) AS proc, regexp_extract(text, 'action=([\w.]+)', 1) AS action,
  list_sort(list_distinct(regexp_extract_all(text, '(?:FROM|JOIN) ([\w.]+)', 1))) AS tables,
  regexp_extract(text, '"(SELECT [^"]*)"', 1) AS sql, regexp_extract(text, '"(EXEC [^"]*)"', 1) AS exec,
  regexp_extract_all(text, '((?:include|require_once)[^;\n]+)', 1) AS includes FROM f),
items AS (SELECT p.path, array_to_string(list_concat(['arquivo: ' || split_part(p.path, '/', 2), 'assinatura: public function run($x)', 'linhas: 3-13'],
   (SELECT list('chama: ' || CASE WHEN class IS NULL THEN c.v || '->' ELSE class || '::' END || m || '()' ORDER BY n) FROM c WHERE c.path = p.path),
   list_transform(tables, lambda x: 'tabela: ' || x), ['procedure: ' || proc], list_transform(includes, lambda x: 'include: ' || x),
   ['action: ' || action, 'query: ' || sql, 'query: ' || exec, 'query: ' || sql]), '|') AS items FROM parts p),
calls AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS place, class, m FROM c WHERE class IS NOT NULL),
shown AS (SELECT path, 'include' AS kind, place, 'include ' || inc || CASE WHEN found THEN ' [OK]' ELSE ' [NÃO ENCONTRADO]' END AS text, '' AS items FROM looked
  UNION ALL SELECT calls.path, 'call', place, calls.class || '::' || m || CASE WHEN m = 'run' AND t.path IS NOT NULL THEN '() [OK]' ELSE '() [NÃO RESOLVIDO]' END,
    CASE WHEN t.path IS NULL THEN '' WHEN m = 'run' THEN items.items ELSE 'arquivo: ' || split_part(t.path, '/', 2) END
    FROM calls LEFT JOIN files t ON t.class = calls.class LEFT JOIN items ON items.path = t.path
  UNION ALL SELECT path, 'table', unnest(range(len(tables))), 'tabela ' || unnest(tables), '' FROM parts
  UNION ALL SELECT path, 'procedure', 0, 'procedure ' || proc, '' FROM parts UNION ALL SELECT path, 'action', 0, 'action ' || action, '' FROM parts
  UNION ALL SELECT path, 'query', unnest([0, 1, 2]), 'query ' || unnest([sql, exec, sql]), '' FROM parts)
SELECT path, kind, CAST(place AS INT) AS place, text, items FROM shown"""
)
def dependency_tree(spark, sf_dir):
    files = lib_files(spark, sf_dir)
    records = stored(code.method_records(code.methods(files)).select(*code.TREE_COLUMNS))  # no body, and no more of it than the tree shows
    return exploded(code.dependency_tree(records, files), F.col("children"), "c", "path").select("path", "c.kind", "c.place", "c.text", F.array_join("c.items", "|").alias("items"))


# Facades of which some have no class, no public method, many calls, long methods, SQL or very many lines.
FACADE = lines_of_text(
    "'<?php'",
    "CASE WHEN k % 4 = 0 THEN '// none' ELSE 'class F' || k || ' {' END",
    "CASE WHEN k % 4 = 1 THEN '  private function p() { return 1; }' ELSE '  public function go($a) {' END",
    "CASE WHEN k % 4 = 2 THEN repeat('    $a->b();' || chr(10), CAST(10 + k % 10 AS INT)) ELSE '' END",
    "CASE WHEN k % 5 = 0 THEN repeat(chr(10), 201) ELSE '' END",
    "CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN '    $q = \"SELECT a FROM t' || (k % 7) || '\";' ELSE '' END",
    "CASE WHEN k % 4 = 1 THEN '' ELSE '  }' END",
    "CASE WHEN k % 50 = 3 THEN repeat(chr(10), 5001) ELSE '' END",
    "'}'",
)


@query(
    f"WITH f AS (SELECT 'f' || k || '.php' AS path, {FACADE} AS text FROM (SELECT p_partkey AS k FROM part)),"
    + r"""
m AS (SELECT *, regexp_extract(text, '(?s)public function.*\n  \}') AS body, nullif(regexp_extract(text, 'class (\w+)', 1), '') AS class FROM f)
SELECT path, class, CAST(len(string_split(text, chr(10))) AS INT) AS lines, len(regexp_extract_all(text, 'public function')) AS methods, regexp_extract(body, 'FROM (\w+)', 1) AS tables,
 array_to_string(list_filter([CASE WHEN class IS NULL THEN 'Classe principal não identificada no arquivo.' END, CASE WHEN body = '' THEN 'Nenhum método público foi encontrado.' END,
  CASE WHEN len(string_split(text, chr(10))) > 5000 THEN 'Arquivo muito grande: revisão manual recomendada em trechos críticos.' END,
  CASE WHEN len(string_split(body, chr(10))) - 1 > 200 THEN '1 método(s) público(s) possuem mais de 200 linhas.' END, CASE WHEN contains(body, '"SELECT') THEN '1 método(s) público(s) contêm SQL embutido.' END,
  CASE WHEN len(regexp_extract_all(body, '\$a->b\(')) > 15 THEN '1 método(s) possuem alta densidade de chamadas.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM m"""
)
def facade_rollup(spark, sf_dir):
    k = part_keys(spark, sf_dir)
    files = k.select(F.expr("'f' || k || '.php'").alias("path"), F.expr(FACADE).alias("text"))
    r = code.facade_rollup(code.facade_methods(files), files)
    return r.select("path", "class", "lines", "methods", F.array_join("tables", ",").alias("tables"), F.array_join("warnings", "|").alias("warnings"))


# Models of which some lack a class, parts of its header, annotations, primary fields or accessors.
MODEL = lines_of_text(
    "'<?php'",
    "CASE k % 3 WHEN 0 THEN '/** @tabela t' || k || ' */' WHEN 1 THEN '/**' || chr(10) || ' * @tabela t' || chr(10) || ' * @SGBD ms' || chr(10) || ' */' ELSE '' END",
    "CASE WHEN k % 7 = 0 THEN '{' ELSE 'class M' || k || ' {' END",
    "CASE WHEN k % 11 = 0 THEN '' ELSE '  /** @campo id' || CASE WHEN k % 2 = 0 THEN chr(10) || '   * @primary sim' ELSE '' END || CASE WHEN k % 5 = 0 THEN chr(10) || '   * @auto-increment 1' ELSE '' END || chr(10) || '   */' || chr(10) || '  private $id;' END",
    "CASE k % 4 WHEN 0 THEN '  /** @var int' || chr(10) || '   * @primary true' || chr(10) || '   * @auto_increment yes' || chr(10) || '   */' || chr(10) || '  private $other;' WHEN 1 THEN chr(10) || '  private $other;' ELSE '' END",
    "CASE k % 6 WHEN 0 THEN '  public function getId() { return 1; }' WHEN 1 THEN '  public function run() { return 1; }' ELSE '' END",
    "'}'",
)


@query(
    f"WITH f AS (SELECT 'm' || k || '.php' AS path, {MODEL} AS text FROM (SELECT p_partkey AS k FROM part)),"
    + r"""
p AS (SELECT path, text, unnest(['id', 'other']) AS name, [split_part(text, '  private $id;', 1), regexp_replace(split_part(text, '  private $other;', 1), '(?s)^.*private \$id;', '')] AS befores FROM f),
d AS (SELECT path, name, regexp_extract(befores[CASE name WHEN 'id' THEN 1 ELSE 2 END], '(?s)\n  /\*\*(.*\*/)\n$', 1) AS doc, len(string_split(split_part(text, '  private $' || name, 1), chr(10))) AS line FROM p WHERE contains(text, 'private $' || name)),
g AS (SELECT path, '$' || name || ' (linha ' || line || ') ' AS who, doc, regexp_matches(doc, '@primary (sim|true)') AS primary_, regexp_matches(doc, '@auto.increment (1|yes)') AS auto FROM d),
t AS (SELECT f.path, text, regexp_extract(text, '^(?s)(.*)class M', 1) AS header, contains(text, 'class M') AS has_class, count(who) AS fields, count_if(primary_) AS primaries, count_if(auto) AS autos
      FROM f LEFT JOIN g USING (path) GROUP BY f.path, text)
SELECT path, 'A propriedade ' || who || unnest(list_filter([CASE WHEN doc = '' THEN 'não possui docblock associado.' END, CASE WHEN doc <> '' AND NOT contains(doc, '@campo') THEN 'não possui anotação @campo.' END,
  CASE WHEN doc <> '' AND NOT contains(doc, '@var') THEN 'não possui anotação @var.' END, CASE WHEN auto AND NOT primary_ THEN 'está com auto-increment=true sem ser primária.' END], lambda x: x IS NOT NULL)) AS warning FROM g
UNION ALL SELECT path, unnest(list_filter([CASE WHEN NOT has_class THEN 'Classe principal não identificada no arquivo.' END, CASE WHEN NOT contains(header, '@tabela') THEN 'Metadado @tabela não identificado no cabeçalho da classe.' END,
  CASE WHEN NOT contains(header, '@SGBD') THEN 'Metadado @SGBD não identificado no cabeçalho da classe.' END, CASE WHEN fields = 0 THEN 'Nenhuma propriedade de model foi encontrada.' END,
  CASE WHEN fields > 0 AND primaries = 0 THEN 'Nenhum campo primário foi identificado.' END, CASE WHEN primaries > 1 THEN primaries || ' campos marcados como primários foram encontrados.' END,
  CASE WHEN contains(text, 'function run') THEN 'Nenhum getter/setter foi identificado no model.' END, CASE WHEN autos > 1 THEN autos || ' campos marcados como auto-increment foram encontrados.' END], lambda x: x IS NOT NULL)) FROM t"""
)
def model_warnings(spark, sf_dir):
    k = part_keys(spark, sf_dir)
    files = k.select(F.expr("'m' || k || '.php'").alias("path"), F.expr(MODEL).alias("text"))
    return code.model_warnings(code.model_fields(files), code.methods(files), files)


# Scripts with nested objects, several handlers a tag, and endpoints of each kind.
SCRIPT = lines_of_text(
    "'<p onclick=\"go(' || k || ')\" onblur=\"out()\"><a ONCLICK=\"a.b()\">'",
    "'<script>'",
    "'const opts = { id: ' || k || ', inner: { deep: [1, 2] } };'",
    "'const URL_BASE = \"index.php?x=' || (k % 4) || '\";'",
    "'var last = { };'",
    "'$.ajax({ url: \"u' || (k % 3) || '.php\", type: \"POST\", data: { a: ' || k || ' }, timeout: 5 });'",
    "CASE WHEN k % 2 = 0 THEN 'fetch(\"index.php?action=Ped.lista\");' ELSE '$.get(URL_BASE);' END",
    "'</script>'",
    "'<script src=\"s' || (k % 3) || '.js\"></script>'",
)
_SCRIPTS = f"p AS (SELECT k, {SCRIPT} AS html FROM (SELECT p_partkey AS k FROM part))"


def script_pages(spark, sf_dir) -> DataFrame:
    return part_keys(spark, sf_dir).select("k", F.expr(SCRIPT).alias("html"))


@query(
    f"WITH {_SCRIPTS},"
    + r""" o AS (SELECT k, unnest([regexp_extract(html, '(const opts = \{[^;]*\});', 1), regexp_extract(html, '(inner: \{[^}]*\})', 1), regexp_extract(html, '(var last = \{[^;]*\});', 1), regexp_extract(html, '(data: \{[^}]*\})', 1)]) AS text, html FROM p)
SELECT k, text, CAST(len(string_split(split_part(html, text, 1), chr(10))) - 1 AS INT) AS line FROM o"""
)
def js_objects(spark, sf_dir):
    scripts = web.script_blocks(script_pages(spark, sf_dir), "k").where("src IS NULL")
    rows = exploded(scripts, web.js_objects("body"), "o", "k")
    return rows.select("k", "o.text", F.col("o.start_line").alias("line"))


@query(f"""WITH {_SCRIPTS}, t AS (SELECT k, unnest(regexp_extract_all(html, '<(\\w+) ([^>]*)>', 1)) AS tag, unnest(regexp_extract_all(html, '<(\\w+) ([^>]*)>', 2)) AS attrs FROM p)
SELECT k, tag, lower(unnest(regexp_extract_all(attrs, '(?i)(on\\w+)="([^"]*)"', 1))) AS event, unnest(regexp_extract_all(attrs, '(?i)(on\\w+)="([^"]*)"', 2)) AS handler FROM t""")
def inline_events(spark, sf_dir):
    return exploded(script_pages(spark, sf_dir), web.inline_events(F.col("html")), "e", "k").select("k", "e.tag", "e.event", "e.handler")


@query(
    f"WITH {_SCRIPTS}"
    + r""" SELECT k, regexp_extract(html, 'url: "([^"]*)"', 1) AS url, regexp_extract(html, 'type: "([^"]*)"', 1) AS method, regexp_extract(html, 'data: ([^,}]*[^,} ])', 1) AS data, regexp_extract(html, 'timeout: (\d+)', 1) AS timeout, regexp_extract(html, 'ajax\((\{.*\})\)', 1) AS raw FROM p"""
)
def ajax_calls(spark, sf_dir):
    scripts = web.script_blocks(script_pages(spark, sf_dir), "k").where("src IS NULL")
    rows = exploded(scripts, web.ajax_calls("body"), "a", "k").select("k", web.ajax_fields(F.col("a.text")).alias("f"))
    return rows.select("k", "f.url", "f.method", "f.data", "f.timeout", "f.raw")


@query(
    f"WITH {_SCRIPTS}"
    + r""" SELECT k, len(regexp_extract_all(html, '<script>')) AS script_blocks, len(regexp_extract_all(html, '<script')) AS script_blocks_total, regexp_extract(html, 'src="([^"]*)"', 1) AS external_scripts,
 len(regexp_extract_all(html, '\$\.ajax\(')) + len(regexp_extract_all(html, '\$\.get\(')) + len(regexp_extract_all(html, 'fetch\(')) AS calls_total, CASE WHEN contains(html, '$.get(') THEN 1::BIGINT END AS gets,
 array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(html, 'action=([A-Z]\w*\.\w+)', 1), regexp_extract_all(html, 'url: "([^"]*)"', 1), regexp_extract_all(html, '\bURL_\w+', 0), regexp_extract_all(html, 'const \w+ = "(index[^"]*)"', 1)))), ',') AS endpoints FROM p"""
)
def script_rollup(spark, sf_dir):
    r = web.script_rollup(web.script_blocks(script_pages(spark, sf_dir), "k"), "k")
    return r.select("k", "script_blocks", "script_blocks_total", F.array_join("external_scripts", ",").alias("external_scripts"), "calls_total", F.element_at("calls", "$.get").alias("gets"), F.array_join("endpoints", ",").alias("endpoints"))


@query(
    f"WITH f AS (SELECT 'm' || k || '.php' AS path, {MODEL} AS text FROM (SELECT p_partkey AS k FROM part)),"
    + r"""
h AS (SELECT path, text, regexp_extract(text, '^(?s)(.*)class M', 1) AS header, nullif(regexp_extract(text, 'class (\w+)', 1), '') AS class FROM f)
SELECT path AS name, coalesce(class, 'Classe não identificada') AS title, CASE WHEN contains(header, '@SGBD') THEN regexp_extract(header, '@SGBD (\w+)', 1) ELSE 'não identificado' END AS sgbd,
 CASE WHEN contains(header, '@tabela') THEN regexp_extract(header, '@tabela (\w+)', 1) ELSE 'não identificada' END AS tabela, CAST(len(string_split(text, chr(10))) AS INT) AS lines,
 CAST(len(regexp_extract_all(text, 'private \$\w+;')) AS INT) AS fields, CAST(len(regexp_extract_all(text, 'function get\w+')) AS INT) AS getters,
 CASE WHEN contains(text, 'private $id;') AND regexp_matches(split_part(text, 'private $id;', 1), '@primary sim') THEN '- `$id` → `id`' ELSE '' END
 || CASE WHEN contains(text, 'private $other;') AND contains(text, '@primary true') THEN '- `$other`' ELSE '' END AS primaries FROM h"""
)
def model_reports(spark, sf_dir):
    k = part_keys(spark, sf_dir)
    files = k.select(F.expr("'m' || k || '.php'").alias("path"), F.expr(MODEL).alias("text"))
    r = layouts.model_reports(files, code.methods(files))
    told = lambda name: F.regexp_extract("report", rf"- \*\*{name}:\*\* ([^\n]*)", 1)
    part = F.regexp_extract("report", r"(?s)## Chave primária\n\n(.*?)\n\n## Campos", 1)
    primaries = F.when(part.contains("Nenhum"), "").otherwise(F.regexp_replace(part, "\n", ""))
    return r.select(
        "name", F.regexp_extract("report", r"^# Análise de Model: ([^\n]*)", 1).alias("title"), told("SGBD").alias("sgbd"), told("Tabela").alias("tabela"), told("Total de linhas").cast("int").alias("lines"),
        told("Campos encontrados").cast("int").alias("fields"), told("Getters").cast("int").alias("getters"), primaries.alias("primaries"),
    )


# Included files with all that their summary tells.
INCLUDED = lines_of_text(
    "'<?php class Inc' || k || ' { } function f' || (k % 3) || '() { } function g() { } include \"a' || (k % 4) || '.php\"; ?>'",
    "'<link rel=\"x\" href=\"c' || (k % 5) || '.css\"><script src=\"s' || (k % 2) || '.js\"></script><b>x</b>'",
    "'<script>fetch(\"u' || (k % 6) || '?action=Ped.lista&z=1\"); $.post(\"p' || (k % 7) || '.php\"); new XMLHttpRequest(); fetch(\"v\");</script>'",
)


@query(
    f"WITH f AS (SELECT 'i' || k AS path, {INCLUDED} AS text FROM (SELECT p_partkey AS k FROM part))"
    + r""" SELECT path, array_to_string(list_distinct(regexp_extract_all(text, 'function (\w+)\(', 1)), ',') LIKE '%g%' AS has_g, len(regexp_extract_all(text, 'function \w+\(')) AS functions, regexp_extract(text, 'class (\w+)', 1) AS classes, regexp_extract(text, 'src="([^"]*)"', 1) AS scripts,
 regexp_extract(text, 'href="([^"]*)"', 1) AS styles, regexp_extract(text, 'include "([^"]*)"', 1) AS includes, CAST(len(regexp_extract_all(text, '<[a-z]\w*\b')) AS INT) AS tags, len(regexp_extract_all(text, 'fetch\(')) AS fetches, len(regexp_extract_all(text, '\$\.post\(')) AS posts,
 regexp_extract(text, 'action=([\w.&=]+)', 1) || ',' || regexp_extract(text, 'post\("([^"]*)"', 1) || ',' || array_to_string(regexp_extract_all(text, 'fetch\("([^"]*)"', 1), ',') AS endpoints, regexp_extract(text, 'action=(\w+\.\w+)', 1) AS actions FROM f"""
)
def page_summaries(spark, sf_dir):
    k = part_keys(spark, sf_dir)
    s = k.select(F.expr("'i' || k").alias("path"), web.page_summary(F.expr(INCLUDED)).alias("s")).select("path", "s.*")
    listed = [F.array_join(c, ",").alias(c) for c in ("classes", "scripts", "styles", "includes", "endpoints", "actions")]
    calls = [F.element_at("ajax", name).cast("long").alias(c) for name, c in (("fetch", "fetches"), ("$.post", "posts"))]
    return s.select("path", F.array_contains("functions", "g").alias("has_g"), F.size("functions").cast("long").alias("functions"), *listed, "tags", *calls)
