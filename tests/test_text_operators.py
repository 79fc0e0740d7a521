from pyspark.sql import functions as F

from orrery.functions.blocks import match_brace, split_arguments
from orrery.functions.columns import text_lines
from orrery.operators import catalog, code, domain, rules, sqltext, web


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_lines_equal_splitlines(spark):
    for t in ("", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0c\x85c d", "\n\n", "a\n\nb\n"):
        assert one(spark, text_lines, t) == t.splitlines(), repr(t)


def test_rules_and_rollup(spark):
    files = spark.createDataFrame([("a.php", "<?php\nvar_dump($x);\n$x = $SESSION['a']\n$y = $_SESSION;"), ("b.php", "x\n" * 2001)], "path string, text string")
    found = rules.apply_rules(files)
    assert {(r["path"], r["line_no"], r["rule_id"]) for r in found.collect()} == {
        ("a.php", 2, "debug_var_dump"),
        ("a.php", 3, "invalid_superglobal_session"),
        ("a.php", 3, "possible_missing_semicolon"),
        ("b.php", 1, "large_file"),
    }
    assert {(r["dimension"], r["value"]): r["findings"] for r in rules.findings_rollup(found).collect()}[("severity", "info")] == 2
    assert rules.file_ranking(found).first()["path"] == "a.php"
    assert {r["value"] for r in rules.findings_rollup(found.limit(0)).collect()} == {"critical", "warning", "info"}


def test_search_context(spark):
    files = spark.createDataFrame([("a", "one\nTwo\nthree\ntwo")], "path string, text string")
    hits = [(r["line_no"], [c["line_no"] for c in r["context"]]) for r in rules.search(files, "two", 1).collect()]
    assert hits == [(2, [1, 2, 3]), (4, [3, 4])]
    assert one(spark, lambda c: rules.highlight(c, "a.b"), "xA.Bx") == "x[A.B]x"


def test_sql(spark):
    text = "UPDATE t SET a = 1\nWHERE b = 2; MERGE INTO [x].y USING #s; -- FROM z\nEXEC p"
    r = sqltext.analyse_sql(spark.createDataFrame([(text,), (None,)], "sql string")).collect()
    assert r[0]["tables_write"] == ["t", "x.y"] and r[0]["tables_read"] == [] and r[0]["procedure_calls"] == ["p"]
    assert not r[0]["update_without_where"] and r[0]["kind"] == "write" and r[1]["kind"] == "read"
    assert one(spark, lambda c: sqltext.without_where(c, "UPDATE", strict=True), text)
    for strict in (True, False):
        assert one(spark, lambda c: sqltext.statements(c, "SELECT", strict), "BEGIN\nSELECT 1\nEND\nselect  1\nDELETE x") == ["SELECT 1"]


def test_sql_is_read_as_tokens(spark):
    rows = {
        "SELECT '-- no' FROM t -- FROM u": (["SELECT"], ["t"], []),
        "SELECT 'it''s DELETE FROM z' FROM [a].[b c] /* JOIN d */": (["SELECT"], ["a.b"], []),
        "SELECT [delete], \"update\" FROM t": (["SELECT"], ["t"], []),
        "/* x -- y */ INSERT INTO h SELECT 1 FROM t WHERE a = '/*' AND b = '*/'": (["INSERT", "SELECT"], ["t"], ["h"]),
        "SELECT 'open FROM t": (["SELECT"], [], []),
        "": ([], [], []),
        None: ([], [], []),
    }
    df = spark.createDataFrame([(k,) for k in rows], "sql string")
    got = {r["sql"]: (r["operations"], r["tables_read"], r["tables_write"]) for r in sqltext.analyse_sql(df).collect()}
    assert got == rows
    strict = {r["sql"]: r["operations"] for r in sqltext.analyse_sql(df, strict=True).collect()}
    assert strict["SELECT 'it''s DELETE FROM z' FROM [a].[b c] /* JOIN d */"] == ["DELETE", "SELECT"]
    deleted = "DELETE FROM a\nWHERE b = 1; DELETE FROM c WHERE d = 'x'; DELETE FROM e -- WHERE"
    r = sqltext.analyse_sql(spark.createDataFrame([(deleted,)], "sql string")).first()
    assert r["delete_without_where"]
    assert one(spark, lambda c: sqltext.statements(c, "DELETE"), deleted.replace("x", "DELETE x")) == ["DELETE FROM a\nWHERE b = 1;", "DELETE FROM c WHERE d = 'DELETE x';", "DELETE FROM e"]
    long = "SELECT '" + "it''s " * 100_000 + "' FROM t"
    assert one(spark, lambda c: F.array_join(sqltext.tokens(c), ""), long) == long
    assert one(spark, lambda c: sqltext.restored(sqltext.masked(sqltext.tokens(c)), sqltext.tokens(c)), "a 'b' [c] \"d\" 1") == "a 'b' [c] \"d\" 1"


def test_embedded_sql(spark):
    text = '$s = "SELECT a {$x}"; $s .= " FROM t"; $o->query($s); prepare("DELETE FROM u");'
    got = [(r["kind"], r["variable"], r["method"], r["sql"]) for r in one(spark, sqltext.embedded_sql, text)]
    assert got == [("variavel", "$s", None, "SELECT a :var\nFROM t"), ("direto", None, "prepare", "DELETE FROM u"), ("variavel_em_chamada", "$s", "query", "SELECT a :var\nFROM t")]


def test_html_and_urls(spark):
    html = '<a href="x" class=\'k\' onclick="go(1, \'a,b\')">T <b>u</b></a><a href="y"></a><div onclick="f()">D</div><input type="button" value="V">'
    assert [tuple(r) for r in one(spark, web.links, html)] == [("T u", "x", "go(1, 'a,b')", "k", "")]
    assert [(r["element"], r["label"]) for r in one(spark, web.clickables, html)] == [("a", "T u"), ("input", "V"), ("generic", "D")]
    u = one(spark, web.parse_action_url, "http://h/p?action=A.b&x=1&x=1&y=%C3%A9")
    assert (u["class"], u["method"], [tuple(p) for p in u["params"]]) == ("A", "b", [("x", "1"), ("y", "é")])
    assert one(spark, web.parse_action_url, "100%")["class"] == ""
    a = one(spark, web.actions, 'href="?action=C.m&k=v&k=w"')
    assert (a[0]["class"], a[0]["params"], a[0]["backend"]) == ("C", {"k": "w"}, "CCTR::m()")
    pages = spark.createDataFrame([(1, "x\n<script src='a.js'></script>\n<script>\nfetch('u')\n</script>")], "id int, html string")
    blocks = web.script_blocks(pages, "id")
    assert [(r["block"], r["src"], r["start_line"]) for r in blocks.collect()] == [(1, "a.js", 2), (2, None, 3)]
    assert web.script_rollup(blocks, "id").first()["endpoints"] == []
    assert [tuple(r) for r in one(spark, web.js_constants, "const A = 'x'; const B = 1 + 2;")] == [("A", "string", "x"), ("B", "expression", "1 + 2")]


def test_braces_and_arguments():
    assert match_brace("{ '}' }", 0, True) == 7 and match_brace("{ '}' }", 0, False) == 4 and match_brace("{ {", 0, True) == -1
    assert split_arguments("a, 'b,c', f(1, 2), \"d\"") == ["a", "b,c", "f(1, 2)", "d"] and split_arguments("") == []


CODE = """<?php
/**
 * @author me
 * @tabela t
 */
class K {
  /** @label L
   * @required sim
   */
  private $near;


  private $far;
  public function getNear($a, $b) {
    $o = new Other();
    $o->go();
    $stmt->execute();
    return "}";
  }
}
"""


def test_code_model(spark):
    files = spark.createDataFrame([("src/K.php", CODE), ("src/Other.php", "<?php class Other {\n function go() { include 'K.php'; } }")], "path string, text string")
    m = {r["method"]: r for r in code.method_records(code.methods(files, aware=True)).collect()}
    assert m["getNear"]["params"] == ["$a", "$b"] and [c["class"] for c in m["getNear"]["calls"]] == ["Other"]
    assert (m["getNear"]["start_line"], m["getNear"]["end_line"]) == (14, 19)
    ext = code.external_calls(code.methods(files, aware=True), files).collect()
    assert [(r["class"], r["method"], r["path"]) for r in ext] == [("Other", "go", "src/Other.php")]
    f = {r["name"]: r for r in code.model_fields(files).collect()}
    assert f["near"]["documented"] and f["near"]["annotations"]["label"] == "L" and not f["far"]["documented"]
    assert one(spark, code.class_header, CODE)["author"] == "me"
    assert one(spark, lambda c: code.accessor(c), "getNear")["property"] == "near"
    inc = spark.createDataFrame([("src/Other.php", "include 'K.php'")], "path string, include string")
    assert code.resolve_includes(inc, files).first()["target"] == "src/K.php"
    warned = {tuple(r) for r in code.model_warnings(code.model_fields(files), code.methods(files, aware=True), files).collect()}
    assert warned == {
        ("src/K.php", "Metadado @SGBD não identificado no cabeçalho da classe."),
        ("src/K.php", "Nenhum campo primário foi identificado."),
        ("src/K.php", "A propriedade $near (linha 10) não possui anotação @campo."),
        ("src/K.php", "A propriedade $near (linha 10) não possui anotação @var."),
        ("src/K.php", "A propriedade $far (linha 13) não possui docblock associado."),
        ("src/Other.php", "Metadado @tabela não identificado no cabeçalho da classe."),
        ("src/Other.php", "Metadado @SGBD não identificado no cabeçalho da classe."),
        ("src/Other.php", "Nenhuma propriedade de model foi encontrada."),
        ("src/Other.php", "Nenhum getter/setter foi identificado no model."),
    }


def test_embedded_sql_runs_each_pattern_over_the_text_once(spark):
    texts = [None, "", '$q = "select 1 from t" ; $q .= " where a = 1"; run($q); query( $q ); prepare("exec p \\"x\\" (1)" );', '$a = "x"; $b = "SELECT\n{$c}"; exec("with a");']
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(sqltext.embedded_sql(F.col("text")).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4
    got = [[(x["kind"], x["variable"], x["method"], x["sql"]) for x in r["s"]] for r in df.collect()]
    whole = "select 1 from t\nwhere a = 1"
    assert got[:2] == [[], []]
    assert got[2] == [("variavel", "$q", None, whole), ("direto", None, "prepare", 'exec p \\"x\\" (1)'), ("variavel_em_chamada", "$q", "query", whole)]
    assert got[3] == [("variavel", "$b", None, "SELECT\n:var"), ("direto", None, "exec", "with a")]


def test_a_tree_needs_its_columns_only(spark):
    files = spark.createDataFrame([("src/K.php", CODE)], "path string, text string")
    records = code.method_records(code.methods(files, aware=True))
    told = lambda r: sorted(map(str, code.dependency_tree(r, files).collect()))
    assert told(records.select(*code.TREE_COLUMNS)) == told(records)


def test_model_fields_are_made_within_a_file(spark):
    doc = lambda name: f"/** @label {name} */"
    lines = ["<?php", doc("far"), "", doc("two"), "", "private $two;", "private $none;", doc("a") + " " + doc("b"), "public $last;", "/**", " * @var int", " */", "protected $long;", doc("own") + " private $same;"]
    rows = [("a.php", "\n".join(lines)), ("null", None), ("empty", ""), ("bare", "private $x;"), ("two.php", doc("one") + "\nprivate $y;")]
    df = code.model_fields(spark.createDataFrame(rows, "path string, text string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r["path"], r["visibility"], r["name"], r["line"]): (r["annotations"].get("label"), r["type"], r["documented"]) for r in df.collect()}
    assert got == {
        ("a.php", "private", "two", 6): ("two", None, True),
        ("a.php", "private", "none", 7): (None, None, False),
        ("a.php", "public", "last", 9): ("b", None, True),
        ("a.php", "protected", "long", 13): (None, "int", True),
        ("bare", "private", "x", 1): (None, None, False),
        ("two.php", "private", "y", 2): ("one", None, True),
    }


def test_catalog_and_domain(spark):
    assert one(spark, lambda c: catalog.split_name(c)["name"], "[a].[b.c]") == "b.c"
    assert one(spark, lambda c: catalog.format_type(c, F.lit(-1), F.lit(None).cast("int"), F.lit(None).cast("int")), "VARCHAR") == "varchar(max)"
    assert one(spark, lambda c: catalog.format_type(c, F.lit(20), F.lit(None).cast("int"), F.lit(None).cast("int"), True), "nvarchar") == "nvarchar(10)"
    assert [tuple(r) for r in one(spark, catalog.parse_columns, "a: int\nb")] == [("a", "int4"), ("b", "unknown")]
    names = {n: one(spark, domain.canonical_name, n) for n in ("x_a", "Meta_Descricao", "foo_old_tmp", "foo_tmp_old", "a", None)}
    assert names == {"x_a": None, "Meta_Descricao": "metadescritiva", "foo_old_tmp": "foo", "foo_tmp_old": "foo_tmp", "a": None, None: None}
    expected = spark.createDataFrame([("A",), ("b",)], "name string")
    crossed = domain.cross_entities(expected, spark.createDataFrame([(" a ",)], "name string"))
    assert tuple(domain.adherence(crossed).first()) == (2, 1, 1, 50.0)
    assert tuple(domain.adherence(crossed.limit(0)).first()) == (0, 0, 0, 0.0)
    edges = spark.createDataFrame([("e", "1", "2"), ("f", "1", "9")], "id string, source_id string, target_id string")
    ents = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, name string")
    assert catalog.resolve_edges(edges, ents).count() == 1 and catalog.resolve_edges(edges, ents, strict=False).count() == 2
    kind = "domain string, has_structural boolean, has_domain_map boolean, has_cross boolean, has_cross_ia boolean, adherence_entities double, adherence_relationships double, rule_count int"
    rows = [("a", False, True, True, True, 99.0, 99.0, 9), ("b", True, False, True, True, 99.0, 99.0, 9), ("c", True, True, False, True, None, None, None), ("d", True, True, True, False, 99.0, 99.0, 9)]
    rows += [("e", True, True, True, True, 95.0, 90.0, 2), ("f", True, True, True, True, 95.0, 90.0, 1), ("g", True, True, True, True, 69.0, 50.0, 0), ("h", True, True, True, True, 69.9, 49.9, 0)]
    levels = {r["domain"]: r["maturity"] for r in domain.maturity(spark.createDataFrame(rows, kind)).collect()}
    assert levels == {"a": "não iniciado", "b": "estrutural", "c": "semântico inicial", "d": "parcial", "e": "maduro", "f": "parcial", "g": "parcial", "h": "raso"}


def test_script_lines_count_whole_blocks(spark):
    pages = spark.createDataFrame([(1, '<p>\n<script>var a="<script x";\n\n</script>\n<script>f()</script>')], "id int, html string")
    assert [r["start_line"] for r in web.script_blocks(pages, "id").orderBy("block").collect()] == [2, 5]


def test_booleans_are_the_words_given(spark):
    words = {"true": True, "1": True, " Sim ": True, "yes": True, "false": False, "0": False, "nao": False, "NÃO": False, "no": False, "s": None, "n": None, "": None}
    assert {w: one(spark, code.as_boolean, w) for w in words} == words


def test_relevant_methods_put_sql_and_size_first(spark):
    body = lambda name, text: f"  public function {name}() {{\n{text}\n  }}\n"
    text = "class A {\n" + body("calls", "$a->b(); $a->c(); $a->d();") + body("sql", '$q = "SELECT 1 FROM t";') + body("two", '$q = "SELECT 1 FROM t"; $r = "DELETE FROM t";') + body("long", '$q = "SELECT 1 FROM t";\n\n\n') + "}"
    files = spark.createDataFrame([("a.php", text)], "path string, text string")
    assert [r["method"] for r in code.relevant_methods(code.facade_methods(files)).collect()] == ["two", "long", "sql", "calls"]
    assert code.locate_target(files.withColumn("text", F.lit("class X")), "A(b.c").count() == 0


def test_evidence_of_entities_and_relationships(spark):
    rules_ = spark.createDataFrame([("Estrutura programática",), ("Os objetivos pertencem a programas",), ("nada",)], "rule string")
    signals = spark.createDataFrame([], "signal string, entities array<string>")
    names = spark.createDataFrame([("Programa",), ("programaobjetivo",), ("acao",)], "name string")
    links = spark.createDataFrame([("acao", "programa"), ("programaobjetivo", "programa")], "source string, target string")
    got = {r["rule"]: (len(r["evidence"]), r["confidence"]) for r in domain.rule_evidence(rules_, signals, names, links).collect()}
    assert got == {"Estrutura programática": (3, "alta"), "Os objetivos pertencem a programas": (2, "média"), "nada": (0, "baixa")}
    assert {r["confidence"] for r in domain.rule_evidence(rules_, signals).collect()} == {"baixa"}


def test_ajax_fields_keep_quoted_commas(spark):
    r = one(spark, web.ajax_fields, '$.ajax({ url: "a,b}.php", type: \'GET\', data: { x: 1 }, timeout: 5, processData: false, contentType: false })')
    assert (r["url"], r["method"], r["timeout"], r["processData"], r["contentType"]) == ("a,b}.php", "GET", "5", "false", "false")
    assert one(spark, web.ajax_fields, '$.ajax({ method: "", type: "PUT" })')["method"] == "PUT"


def test_sql_lines_are_distinct_and_capped(spark):
    text = "SELECT a FROM b\nselect\n<select from>\nSELECT  a FROM b\n" + "\n".join(f"DELETE FROM t{i}" for i in range(60))
    got = web.sql_lines(spark.createDataFrame([("f", text), ("g", None)], "path string, text string")).collect()
    assert len(got) == 50 and got[0]["text"] == "SELECT a FROM b" and got[1]["line_no"] == 5


def test_sql_lines_among_html_css_and_scripts(spark):
    kinds = {
        "  // select a from b": "select_from",
        "from: select a from b;": "select_from",
        "document.queryselector(select) from x": "select_from",
        "x.onblur = select a from b": "select_from",
        "body select { color: red; from x": None,
        "select a from b {": None,
        ".c select a from b": None,
        "<a> select b from c": None,
        "x > y <b class='z'> select d from e": None,
        "x select '</select>' from y": None,
        "select a from b where c > 1": "select_from",
        "with a as (select 1)": "with_select",
        "": None,
    }
    got = {r["line"]: r["kind"] for r in spark.createDataFrame([(k,) for k in kinds], "line string").select("line", web.sql_line_kind(F.col("line")).alias("kind")).collect()}
    assert got == kinds


def test_facades_are_judged_by_their_whole_file(spark):
    short = "class A {\n  public function f() {\n    return 1;\n  }\n}\n"
    rows = [("long.php", short + "\n" * 6000), ("bare.php", "class B {\n  private function g() { }\n}"), ("none.php", "<?php\n"), ("null.php", None), ("ok.php", short)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["lines"], r["methods"], r["warnings"]) for r in code.facade_rollup(code.facade_methods(files), files).collect()}
    no_class, no_methods, large = code.FACADE_WARNINGS[:3]
    assert got == {
        "long.php": (6005, 1, [large]), "bare.php": (3, 0, [no_methods]), "none.php": (1, 0, [no_class, no_methods]),
        "null.php": (0, 0, [no_class, no_methods]), "ok.php": (5, 1, []),
    }


def test_dependency_tree_bounds_the_second_level_only(spark):
    tables = " ".join(f"FROM t{i}" for i in range(8))
    queries = "\n".join(f'$q{i} = "SELECT {i}";' for i in range(7))
    main = f'class Main {{\n function go($a) {{\n include "lib/b.php"; include "no.php"; include $x;\n $b = new B(); $b->run(); $b->none(); $c = new C(); $c->x();\n // {tables}\n {queries}\n $u = "action=A.b"; "_dbo.c";\n }}\n}}'
    other = f"class B {{\n function run() {{\n // {tables} EXEC p1\n {queries}\n " + "; ".join(f"$o->m{i}()" for i in range(9)) + ";\n }\n}"
    files = spark.createDataFrame([("main.php", main), ("lib/b.php", other)], "path string, text string")
    records = code.method_records(code.methods(files))
    tree = code.dependency_tree(records, files)
    children = next(r["children"] for r in tree.collect() if r["method"] == "go")
    texts = [c["text"] for c in children]
    assert texts == [
        "include lib/b.php [OK]", "include no.php [NÃO ENCONTRADO]", "include include $x [NÃO ENCONTRADO]",
        "B::run() [OK]", "B::none() [NÃO RESOLVIDO]", "C::x() [NÃO RESOLVIDO]",
        *(f"tabela t{i}" for i in range(8)), "action A.b", *(f"query SELECT {i}" for i in range(5)),
    ]
    assert children[3]["items"] == [
        "arquivo: b.php", "assinatura: function run()", "linhas: 2-12", *(f"chama: $o->m{i}()" for i in range(6)),
        *(f"tabela: t{i}" for i in range(6)), "procedure: p1", *(f"query: SELECT {i}" for i in range(3)),
    ]
    assert children[4]["items"] == ["arquivo: b.php"] and children[5]["items"] == []
    lines = next(r["lines"] for r in code.tree_lines(tree).collect() if r["method"] == "go")
    assert lines[:2] == ["function go($a)", "├── include lib/b.php [OK]"] and lines[5] == "│   ├── arquivo: b.php" and lines[-1] == "└── query SELECT 4"
    assert code.tree_lines(code.dependency_tree(records.limit(0), files)).count() == 0


def test_inline_events_of_one_tag(spark):
    got = [tuple(r) for r in one(spark, web.inline_events, "<a onClick='x()' href=\"#\" onblur=\" y \"><b>onclick='z'</b>")]
    assert got == [("a", "onclick", "x()"), ("a", "onblur", "y")]
