"""Reports of procedures, included files, facades and models as Markdown in a column, and their writer: nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text_lines
from . import code, sqltext, web

# Names of the resources of a procedure, in the order of its report.
RESOURCES = {
    "dynamic_sql": "SQL dinâmico",
    "cursor": "Cursor",
    "transaction": "Transação",
    "try_catch": "TRY/CATCH",
    "nolock": "NOLOCK",
    "temp_tables": "Temp table",
    "table_variables": "Table variable",
    "merge": "MERGE",
    "cte": "CTE",
}
#: Lines of SQL that a report of an included file shows.
SQL_SHOWN = 20


def facts(pairs: Sequence[tuple[str, Column]]) -> Column:
    """One ``- **name:** value`` line each; a dash for null."""
    return F.array(*(F.concat(F.lit(f"- **{name}:** "), F.coalesce(value.cast("string"), F.lit("-"))) for name, value in pairs))


def bullets(items: Column, empty: str) -> Column:
    """A line for each item, in code marks; ``empty`` if there is none."""
    return F.when(F.size(items) > 0, F.transform(items, lambda x: F.concat(F.lit("- `"), x, F.lit("`")))).otherwise(F.array(F.lit(empty)))


def lines_or(items: Column, empty: str) -> Column:
    """The items as they are, or ``empty``."""
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(empty)))


def section(title: str, lines: Column, level: int = 2) -> Column:
    return F.concat(F.array(F.lit("#" * level + " " + title), F.lit("")), lines, F.array(F.lit("")))


def page(title: Column, *sections: Column) -> Column:
    """A report: its title, then its sections, one text with a line end after each line."""
    return F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("# "), title), F.lit("")), *sections), "\n"))


def _joined(items: Column, empty: str = "-") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(empty))


def procedure_reports(procedures: DataFrame) -> DataFrame:
    """name, report of each procedure (schema, name, definition): what ``analyse_sql`` says of it, its statements and its text."""
    a = sqltext.analyse_sql(procedures.select("schema", "name", "definition"), "definition")
    count = lambda c: F.size(c).cast("string")
    summary = facts(
        [
            ("Schema", F.col("schema")), ("Procedure", F.col("name")), ("Linhas", F.size(text_lines(F.coalesce("definition", F.lit(""))))), ("Qtd. de tabelas detectadas", count("tables_all")),
            ("Qtd. de procedures chamadas", count("procedure_calls")), ("Qtd. de funções chamadas", count("function_calls")), ("Classificação", F.concat(F.lit("`"), "kind", F.lit("`"))), ("Operações detectadas", _joined(F.col("operations"))),
        ]
    )
    used = [F.concat(F.lit(f"| {label} | "), F.when(F.col("resources")[k], F.lit("Sim")).otherwise(F.lit("Não")), F.lit(" |")) for k, label in RESOURCES.items()]
    table = F.array(F.lit("| Recurso | Detectado |"), F.lit("|---|---:|"), *used)
    warned = lines_or(F.transform("warnings", lambda w: F.concat(F.lit("- ⚠️ "), w)), "_Nenhum warning relevante encontrado._")
    fenced = lambda sql: F.array(F.lit("```sql"), sql, F.lit("```"))
    shown = [section(v, F.flatten(F.transform(sqltext.statements(F.coalesce("definition", F.lit("")), v), fenced)), 3) for v in sqltext.VERBS]
    lists = (
        ("Tabelas de leitura", "tables_read", "_Nenhuma tabela de leitura detectada._"),
        ("Tabelas de escrita", "tables_write", "_Nenhuma tabela de escrita detectada._"),
        ("Temp tables", "temp_tables", "_Nenhuma temp table detectada._"),
        ("Table variables", "table_variables", "_Nenhuma table variable detectada._"),
        ("Procedures chamadas", "procedure_calls", "_Nenhuma chamada de procedure detectada._"),
        ("Funções chamadas", "function_calls", "_Nenhuma função detectada._"),
        ("Variáveis declaradas", "variables", "_Nenhuma variável declarada detectada._"),
    )
    title = F.concat(F.lit("Análise de Procedure: `"), F.concat_ws(".", "schema", "name"), F.lit("`"))
    report = page(
        title, section("Resumo", summary), *(section(t, bullets(F.col(c), e)) for t, c, e in lists), section("Recursos SQL Detectados", table), section("Pontos de Atenção", warned),
        section("Queries Extraídas", F.array().cast("array<string>")), *shown, section("SQL da Procedure", fenced(F.coalesce("definition", F.lit("")))),
    )
    return a.select(F.concat_ws(".", "schema", "name").alias("name"), report.alias("report"))


def include_reports(files: DataFrame) -> DataFrame:
    """name (path), report of each included file (path, text): ``page_summary``, superglobals and lines of SQL."""
    text = F.coalesce("text", F.lit(""))
    held = web.sql_lines(files, SQL_SHOWN).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "text"))).alias("sql"))
    rows = files.select("path", text.alias("text"), web.page_summary(text).alias("p"), code.superglobals(text).alias("globals")).join(held, "path", "left")
    sql = F.coalesce("sql", F.array().cast("array<struct<line_no:int,kind:string,text:string>>"))
    p = F.col("p")
    count = lambda c: F.size(c).cast("string")
    kinds = F.transform(F.map_entries(p["ajax"]), lambda e: F.concat(F.lit("- `"), e["key"], F.lit("`: "), e["value"].cast("string")))
    numbers = facts(
        [
            ("Linhas", F.size(text_lines(F.col("text")))), ("Includes internos", count(p["includes"])), ("Superglobais usadas", _joined(F.col("globals"), "nenhuma")), ("SQL suspeito", count(sql)),
            ("Actions encontradas", count(p["actions"])), ("Funções declaradas", count(p["functions"])), ("Classes declaradas", count(p["classes"])), ("Tags HTML detectadas", p["tags"]),
        ]
    )
    lines = F.transform(sql, lambda x: F.concat(F.lit("- Linha "), x["line_no"].cast("string"), F.lit(" — `"), x["kind"], F.lit("` — `"), x["text"], F.lit("`")))
    report = page(
        F.concat(F.lit("Análise de Include — "), "path"), section("Estatísticas", numbers), section("AJAX detectado", lines_or(kinds, "- Nenhum AJAX embutido detectado.")),
        section("Endpoints", bullets(web.script_endpoints(F.col("text")), "- Nenhum endpoint encontrado.")), section("Includes internos", bullets(p["includes"], "- Nenhum include interno encontrado.")),
        section("Actions", bullets(p["actions"], "- Nenhuma action encontrada.")), section("SQL suspeito", lines_or(lines, "- Nenhum trecho SQL suspeito encontrado.")),
        section("Scripts referenciados", bullets(p["scripts"], "- Nenhum script externo encontrado.")), section("CSS referenciados", bullets(p["styles"], "- Nenhum CSS externo encontrado.")),
        section("Funções declaradas", bullets(p["functions"], "- Nenhuma função declarada.")), section("Classes declaradas", bullets(p["classes"], "- Nenhuma classe declarada.")),
    )
    return rows.select(F.col("path").alias("name"), report.alias("report"))


def facade_reports(records: DataFrame, files: DataFrame) -> DataFrame:
    """name (path), report of each facade: summary, warnings, public methods with what they use, dependencies, tables."""
    rollup = code.facade_rollup(records, files)
    one = F.struct("start_line", "method", "signature", "end_line", F.size("sql_blocks").alias("sql"), "tables", (F.size("method_calls") + F.size("static_calls")).alias("calls"), "notes")
    listed = records.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("listed"))
    namespace = files.select("path", F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"\bnamespace\s+([^;]+);", 1)), F.lit("")).alias("namespace"))
    rows = rollup.join(listed, "path", "left").join(namespace, "path")
    empty = F.array().cast(records.select(F.array(one).alias("a")).schema["a"].dataType)
    each = F.coalesce("listed", empty)
    held = F.filter(each, lambda m: m["sql"] > 0)
    shown = F.transform(
        each,
        lambda m: F.concat(F.lit("- `"), m["signature"], F.lit("` (linhas "), m["start_line"].cast("string"), F.lit("-"), m["end_line"].cast("string"), F.lit(", chamadas "), m["calls"].cast("string"), F.lit(")"), F.when(F.size(m["notes"]) > 0, F.concat(F.lit(": "), F.array_join(m["notes"], " "))).otherwise("")),
    )
    with_sql = F.transform(held, lambda m: F.concat(F.lit("- `"), m["method"], F.lit("` — "), m["sql"].cast("string"), F.lit(" bloco(s) SQL, "), F.size(m["tables"]).cast("string"), F.lit(" tabela(s) detectada(s)")))
    summary = facts(
        [
            ("Arquivo analisado", F.col("path")), ("Classe", F.coalesce("class", F.lit("não identificada"))), ("Namespace", F.coalesce("namespace", F.lit("não identificado"))), ("Total de linhas", F.col("lines")),
            ("Métodos públicos", F.col("methods")), ("Dependências encontradas", F.size("dependencies")), ("Tabelas encontradas", F.size("tables")),
        ]
    )
    report = page(
        F.concat(F.lit("Análise de Fachada: "), F.coalesce("class", F.lit("Classe não identificada"))), section("Resumo", summary),
        section("Pontos de atenção", lines_or(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "- Nenhum ponto de atenção automático foi identificado.")),
        section("Métodos públicos", lines_or(shown, "- Nenhum método público encontrado.")), section("Dependências", bullets(F.col("dependencies"), "- Nenhuma dependência identificada.")),
        section("Tabelas envolvidas", bullets(F.col("tables"), "- Nenhuma tabela identificada.")), section("Métodos com SQL", lines_or(with_sql, "- Nenhum método com SQL detectado.")),
    )
    return rows.select(F.col("path").alias("name"), report.alias("report"))


def model_reports(files: DataFrame, found_methods: DataFrame) -> DataFrame:
    """name (path), report of each model: header, warnings, primary key, fields, getters and setters."""
    fields = code.model_fields(files)
    warned = code.model_warnings(fields, found_methods, files).groupBy("path").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    one = F.struct("line", "name", "type", F.element_at("annotations", "campo").alias("campo"), F.coalesce(code.as_boolean(F.element_at("annotations", "primary")), F.lit(False)).alias("primary"))
    listed = fields.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("fields"))
    kind = code.accessor(F.col("method"))["kind"]
    of = lambda k: F.array_sort(F.collect_set(F.when(kind == k, F.col("method")))).alias(f"{k}s")
    used = found_methods.groupBy("path").agg(F.count(F.lit(1)).alias("methods"), of("getter"), of("setter"))
    text = F.coalesce("text", F.lit(""))
    base = files.select("path", code.class_name(F.col("text")).alias("class"), code.class_header(F.col("text")).alias("h"), F.size(text_lines(text)).alias("lines"))
    rows = base.join(warned, "path", "left").join(listed, "path", "left").join(used, "path", "left")
    none = F.array().cast("array<string>")
    empty = F.array().cast(fields.select(F.array(one).alias("a")).schema["a"].dataType)
    own = F.coalesce("fields", empty)
    named = lambda f: F.concat(F.lit("- `$"), f["name"], F.lit("`"), F.when(F.coalesce(f["campo"], F.lit("")) != "", F.concat(F.lit(" → `"), f["campo"], F.lit("`"))).otherwise(""))
    typed = lambda f: F.concat(named(f), F.lit(" (linha "), f["line"].cast("string"), F.when(f["type"].isNotNull(), F.concat(F.lit(", "), f["type"])).otherwise(""), F.lit(")"))
    called = lambda c: F.transform(F.coalesce(c, none), lambda m: F.concat(m, F.lit("()")))
    summary = facts(
        [
            ("Arquivo analisado", F.col("path")), ("Classe", F.coalesce("class", F.lit("não identificada"))), *((n, F.coalesce(f"h.{c}", F.lit(e))) for n, c, e in (("Package", "package", "não identificado"), ("Author", "author", "não identificado"), ("SGBD", "sgbd", "não identificado"), ("Tabela", "tabela", "não identificada"))),
            ("Total de linhas", F.col("lines")), ("Campos encontrados", F.size(own)), ("Métodos encontrados", F.coalesce("methods", F.lit(0))), ("Getters", F.size(F.coalesce("getters", none))), ("Setters", F.size(F.coalesce("setters", none))),
        ]
    )
    report = page(
        F.concat(F.lit("Análise de Model: "), F.coalesce("class", F.lit("Classe não identificada"))), section("Resumo", summary),
        section("Pontos de atenção", lines_or(F.transform(F.coalesce("warnings", none), lambda w: F.concat(F.lit("- "), w)), "- Nenhum ponto de atenção automático foi identificado.")),
        section("Chave primária", lines_or(F.transform(F.filter(own, lambda f: f["primary"]), named), "- Nenhum campo primário identificado.")), section("Campos", lines_or(F.transform(own, typed), "- Nenhum campo identificado.")),
        section("Getters", bullets(called("getters"), "- Nenhum getter identificado.")), section("Setters", bullets(called("setters"), "- Nenhum setter identificado.")),
    )
    return rows.select(F.col("path").alias("name"), report.alias("report"))


def write_reports(reports: DataFrame, folder: str, mode: str = "error") -> None:
    """Each report (name, report) as a text file in a folder of its name, by the tasks that make them."""
    reports.select("name", "report").write.mode(mode).partitionBy("name").text(folder)
