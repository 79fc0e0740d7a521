"""What SQL texts do: operations, tables, resources, warnings; and SQL inside program text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_by, found, kept, let, sorted_set, text_lines
from .rules import stripped

# What names are in SQL, thresholds of warnings, methods that run SQL, words that SQL starts with.
_NAME = r"([#@\[\]\w.]+)"
TEMP_TABLES_MANY = 5
CALLS_MANY = 5
LINES_MANY = 300
EXECUTING = ("executarquery", "prepare", "query", "exec")
STARTS = ("select", "insert", "update", "delete", "exec", "with")
VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")
_NO_TABLE = ("SELECT", "WHERE", "SET", "ON", "INTO", "VALUES")


def strip_comments(sql: Column) -> Column:
    """Without ``/* */`` blocks, then without ``--`` to the end of a line."""
    return F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"(?m)--.*?$", " ")


#: One token of SQL: a comment, a literal (a doubled quote makes two in a row), a quoted or bracketed name, or what is
#: between them. Every character is in one token, and none is read twice.
TOKEN = r"""(?s)--[^\r\n]*+|/\*.*?(?:\*/|\z)|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|\[[^\]]*+(?:\]|\z)|[^'"\[/-]++|."""
_MASK = r"""(?s)'\d+'|"\d+"|\[\d+\]|[^'"\[]++|."""


def tokens(sql: Column) -> Column:
    """The tokens of a text, in order; joined they are the text. Comments don't nest."""
    return found(sql, TOKEN)


def masked(words: Column, brackets: bool = True) -> Column:
    """The text of tokens with a blank for each comment and its place for what each literal, quoted name and (brackets)
    bracketed name holds, so that patterns meet nothing that is no SQL."""

    def one(x: Column, i: Column) -> Column:
        out = F.when(x.startswith("--") | x.startswith("/*"), F.lit(" "))
        for begin, end in (("'", "'"), ('"', '"'), *((("[", "]"),) if brackets else ())):
            out = out.when(x.startswith(begin), F.concat(F.lit(begin), i.cast("string"), F.lit(end)))
        return out.otherwise(x)

    return F.array_join(F.transform(words, one), "")


def restored(text: Column, words: Column) -> Column:
    """A part of a masked text with what was masked."""
    place = lambda x: F.regexp_extract(x, r"""^['"\[](\d+)['"\]]$""", 1)
    each = F.transform(found(text, _MASK), lambda x: let(place(x), lambda p: F.when(p != "", F.get(words, p.try_cast("int"))).otherwise(x)))
    return F.array_join(each, "")


def has(sql: Column, pattern: str) -> Column:
    return sql.rlike(f"(?is){pattern}")


def operations(sql: Column) -> Column:
    """Verbs in use, sorted; INSERT only with INTO."""
    return F.array_sort(kept(*((has(sql, r"\bINSERT\s+INTO\b" if v == "INSERT" else rf"\b{v}\b"), v) for v in VERBS)))


def _names(sql: Column, *patterns: str) -> Column:
    raw = F.concat(*(found(sql, f"(?i){p}", 1) for p in patterns))
    clean = F.transform(raw, lambda x: F.regexp_replace(x, r"[\[\]]|^\.+|\.+$|;", ""))
    return sorted_set(F.filter(clean, lambda x: (x != "") & ~F.upper(x).isin(*_NO_TABLE)))


def read_tables(sql: Column) -> Column:
    """Names after FROM and JOIN, sorted: also of common table expressions, temp tables and of DELETE FROM."""
    return _names(sql, rf"\bFROM\s+{_NAME}", rf"\bJOIN\s+{_NAME}")


def write_tables(sql: Column) -> Column:
    """Names after INSERT INTO, UPDATE, DELETE FROM and MERGE, with or without INTO, sorted."""
    return _names(sql, rf"\bINSERT\s+INTO\s+{_NAME}", rf"\bUPDATE\s+{_NAME}", rf"\bDELETE\s+FROM\s+{_NAME}", rf"\bMERGE\s+(?:INTO\s+)?{_NAME}")


def temp_tables(sql: Column) -> Column:
    return sorted_set(found(sql, r"(?<!\w)(##?\w+)", 1))


def table_variables(sql: Column) -> Column:
    return sorted_set(found(sql, r"(?i)\bDECLARE\s+(@\w+)\s+TABLE\b", 1))


def variables(sql: Column) -> Column:
    return sorted_set(found(sql, r"(?i)\bDECLARE\s+(@\w+)", 1))


def procedure_calls(sql: Column) -> Column:
    return _names(sql, r"\bEXEC(?:UTE)?\s+([a-zA-Z0-9_.\[\]#]+)")


def function_calls(sql: Column) -> Column:
    """Names with a schema in front of a parenthesis."""
    return _names(sql, r"\b([a-zA-Z_][\w\[\]]*\.[a-zA-Z_][\w\[\]]*)\s*\(")


def resources(sql: Column) -> Column:
    """A map of nine features to whether the text uses them."""
    flags = {
        "dynamic_sql": has(sql, r"\bSP_EXECUTESQL\b|\bEXEC(UTE)?\s*\(@|\bSET\s+@\w+\s*=\s*['\"]|\bSELECT\s+@\w+\s*="),
        "cursor": has(sql, r"\bCURSOR\b"),
        "transaction": has(sql, r"\bBEGIN\s+TRAN\b|\bBEGIN\s+TRANSACTION\b|\bCOMMIT\b|\bROLLBACK\b"),
        "try_catch": has(sql, r"\bBEGIN\s+TRY\b.*\bBEGIN\s+CATCH\b"),
        "nolock": has(sql, r"\bNOLOCK\b"),
        "temp_tables": has(sql, r"(?<!\w)##?\w"),
        "table_variables": has(sql, r"\bDECLARE\s+@\w+\s+TABLE\b"),
        "merge": has(sql, r"\bMERGE\b"),
        "cte": has(sql, r"\bWITH\s+[A-Z_][A-Z0-9_]*\s+AS\s*\("),
    }
    return F.create_map(*(x for k, v in flags.items() for x in (F.lit(k), v)))


def without_where(sql: Column, verb: str, strict: bool = False) -> Column:
    """Whether a statement of this verb has no WHERE before its semicolon or the text's end.

    strict: only a WHERE between two blanks counts, so that one at the start of a line does not.
    """
    statements = found(sql, rf"(?is)\b{verb}\b.*?(?:;|\z)")
    return F.exists(statements, lambda s: ~(F.upper(s).contains(" WHERE ") if strict else s.rlike(r"(?i)\bWHERE\b")))


def _split(sql: Column, verb: str) -> Column:
    raw = found(sql, rf"(?is)\b{verb}\b.*?(?=\b(?:{'|'.join(VERBS)})\b|\z)")
    ends = r"(?i)^(\s*(BEGIN|END)\s*(\n|\z))+|((\A|\n)\s*(BEGIN|END)\s*)+\z"
    tidy = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[ \t]+(?=\n|\z)", ""), r"\n\s*\n+", "\n"), ends, "")
    return F.filter(F.transform(raw, lambda s: F.trim(tidy(stripped(s)))), lambda s: s != "")


def statements(sql: Column, verb: str, strict: bool = False) -> Column:
    """Statements of a verb, each up to the next verb or the end, trimmed of outer BEGIN and END lines; distinct
    but for white space and case. Verbs in comments, literals and brackets are none.

    strict: the text is taken as it is, without a look at what is quoted; comments are to be taken out before.
    """
    if strict:
        return first_by(_split(sql, verb), _folded)
    return let(tokens(sql), lambda words: first_by(F.transform(_split(masked(words), verb), lambda s: restored(s, words)), _folded))


def _folded(statement: Column) -> Column:
    return F.upper(F.regexp_replace(statement, r"\s+", " "))


def all_statements(sql: Column) -> Column:
    """verb, statement of the statements of all verbs, as ``statements`` has them; the text is read as tokens once."""
    kind = "array<struct<verb:string,statement:string>>"

    def of(verb: str, text: Column, words: Column) -> Column:
        each = first_by(F.transform(_split(text, verb), lambda s: restored(s, words)), _folded)
        return F.transform(each, lambda s: F.struct(F.lit(verb).alias("verb"), s.alias("statement"))).cast(kind)

    return let(tokens(sql), lambda words: let(masked(words), lambda text: F.concat(*(of(v, text, words) for v in VERBS))))


def classify(ops: Column) -> Column:
    """read, write or read_write from the operations in use; read if there are none."""
    reads, writes = F.array_contains(ops, "SELECT"), F.arrays_overlap(ops, F.array(*map(F.lit, VERBS[1:])))
    return F.when(reads & writes, "read_write").when(writes, "write").otherwise("read")


def analyse_sql(texts: DataFrame, sql: str = "sql", strict: bool = False) -> DataFrame:
    """Everything above for each row: the input's columns, then operations, tables_read, tables_write, tables_all,
    temp_tables, table_variables, variables, procedure_calls, function_calls, resources, line_count,
    update_without_where, delete_without_where, kind and warnings. One projection, no shuffle.

    The text is read as tokens: what comments, literals and quoted names hold is no SQL, and a bracketed verb is none.
    strict: comments are found by pattern wherever they are, literals are read as SQL, and WHERE counts only between blanks.
    """
    text = F.coalesce(F.col(sql), F.lit(""))
    lines = F.size(F.filter(text_lines(text), lambda x: stripped(x) != ""))
    # columns of their own, so that each is made once
    if strict:
        staged = texts.withColumn("__plain", strip_comments(text)).withColumn("__verbs", F.col("__plain"))
    else:
        staged = texts.withColumn("__tokens", tokens(text)).withColumns({"__plain": masked(F.col("__tokens"), False), "__verbs": masked(F.col("__tokens"))}).drop("__tokens")
    plain, verbs = F.col("__plain"), F.col("__verbs")
    first = staged.withColumns(
        {
            "operations": operations(verbs),
            "tables_read": read_tables(plain),
            "tables_write": write_tables(plain),
            "temp_tables": temp_tables(plain),
            "table_variables": table_variables(plain),
            "variables": variables(plain),
            "procedure_calls": procedure_calls(plain),
            "function_calls": function_calls(plain),
            "resources": resources(verbs),
            "line_count": lines,
            "update_without_where": without_where(verbs, "UPDATE", strict),
            "delete_without_where": without_where(verbs, "DELETE", strict),
        }
    )
    used = F.col("resources")
    warnings = kept(
        (used["dynamic_sql"], "Uso de SQL dinâmico"),
        (used["cursor"], "Uso de cursor"),
        (used["transaction"], "Uso de transações"),
        (F.size("temp_tables") >= TEMP_TABLES_MANY, "Uso intenso de temp tables"),
        (F.col("delete_without_where"), "DELETE sem WHERE detectado"),
        (F.col("update_without_where"), "UPDATE sem WHERE detectado"),
        (F.col("line_count") >= LINES_MANY, "Procedure muito grande"),
        (F.size("procedure_calls") >= CALLS_MANY, "Múltiplas chamadas para outras procedures"),
    )
    return first.drop("__plain", "__verbs").withColumns({"tables_all": sorted_set(F.col("tables_read"), F.col("tables_write")), "kind": classify(F.col("operations")), "warnings": warnings})


def normalise_embedded(sql: Column) -> Column:
    """Embedded SQL: ``{$x}`` as ``:var``, no braces, lines trimmed, no empty ones."""
    plain = F.regexp_replace(F.regexp_replace(sql, r"\{\$\w+\}", ":var"), r"[{}]", "")
    return F.array_join(F.filter(F.transform(text_lines(plain), stripped), lambda x: x != ""), "\n")


def looks_like_sql(text: Column) -> Column:
    return text.rlike(rf"(?i)^\s*({'|'.join(STARTS)})")


# How SQL is put into a variable, added to it, passed to a method, and passed as a variable.
ASSIGN = r'(?is)(\$\w+)\s*=\s*"(.*?)"\s*;'
APPEND = r'(?is)(\$\w+)\s*\.=\s*"(.*?)"\s*;'
DIRECT = r'(?is)(\w+)\s*\(\s*"((?:[^"\\]|\\.)*?)"\s*\)'
USE = r"(?i)(\w+)\s*\(\s*(\$\w+)\s*\)"
_EMBEDDED = "array<struct<kind:string,variable:string,method:string,sql:string>>"


def embedded_sql(text: Column) -> Column:
    """SQL in program text, distinct, as an array of kind, variable, method, sql.

    ``variavel``: assigned in double quotes, later ``.=`` parts appended; the last assignment of a variable counts.
    ``direto``: passed to a method that runs SQL. ``variavel_em_chamada``: such a variable passed to such a method.
    """
    text = F.coalesce(text, F.lit(""))
    # a pattern's groups are read from its matches, which are short, not by a further run over the text
    pairs = lambda p: F.transform(found(text, p), lambda x: F.struct(F.regexp_extract(x, p, 1).alias("v"), F.regexp_extract(x, p, 2).alias("s")))
    clean = lambda a: F.transform(a, lambda x: F.struct(x["v"].alias("v"), normalise_embedded(x["s"]).alias("s")))
    null = F.lit(None).cast("string")
    item = lambda kind, variable, method, sql: F.struct(F.lit(kind).alias("kind"), variable.alias("variable"), method.alias("method"), sql.alias("sql"))

    def all_(assigned: Column, appended: Column, called: Column, uses: Column) -> Column:
        last = lambda v: F.element_at(F.filter(assigned, lambda x: x["v"] == v), -1)["s"]
        more = lambda v: F.transform(F.filter(appended, lambda x: x["v"] == v), lambda x: x["s"])
        names = F.array_distinct(F.transform(assigned, lambda x: x["v"]))
        held_ = F.transform(names, lambda v: item("variavel", v, null, normalise_embedded(F.array_join(F.concat(F.array(last(v)), more(v)), "\n"))))
        direct = F.transform(called, lambda x: item("direto", null, x["v"], x["s"]))

        def with_calls(held: Column) -> Column:
            of = lambda v: F.filter(held, lambda h: h["variable"] == v)
            used = F.filter(uses, lambda x: F.exists(held, lambda h: h["variable"] == x["s"]))
            through = F.transform(used, lambda x: item("variavel_em_chamada", x["s"], x["v"], of(x["s"])[0]["sql"]))
            return F.array_distinct(F.concat(held.cast(_EMBEDDED), direct.cast(_EMBEDDED), through.cast(_EMBEDDED)))

        return let(held_, with_calls)

    # each pattern runs over the text once; what it finds is bound to a name
    runs = lambda x: F.lower(x["v"]).isin(*EXECUTING)
    assigned = F.filter(clean(pairs(ASSIGN)), lambda x: looks_like_sql(x["s"]))
    called = F.filter(clean(F.filter(pairs(DIRECT), runs)), lambda x: looks_like_sql(x["s"]))
    return let(assigned, lambda a: let(clean(pairs(APPEND)), lambda b: let(called, lambda c: let(F.filter(pairs(USE), runs), lambda d: all_(a, b, c, d)))))


def suspect_lines(text: Column) -> Column:
    """Trimmed lines that hold an SQL word and a blank."""
    words = r"(?i)(select|insert|update|delete|from|join|exec|where) "
    return F.filter(F.transform(text_lines(F.coalesce(text, F.lit(""))), stripped), lambda x: x.rlike(words))


def sql_literals(text: Column) -> Column:
    """String literals of either quote, double ones first, that hold an SQL verb."""
    literals = F.concat(found(text, r'(?s)"((?:[^"\\]|\\.)*)"', 1), found(text, r"(?s)'((?:[^'\\]|\\.)*)'", 1))
    return F.filter(literals, lambda x: x.rlike(r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|EXEC|MERGE)\b"))


def tables_in_literals(text: Column) -> Column:
    """Tables named by SQL inside string literals of either quote, sorted."""
    sql = F.array_join(sql_literals(text), "\n")
    return sorted_set(read_tables(sql), write_tables(sql))
