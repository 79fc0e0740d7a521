"""The engine's own queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import exploded
from ..operators import anomaly, catalog, code, domain, profile, rules, sqltext, states, terms, web
from ..shared import shared_folder, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that a task makes of narrow rows, and the fewest for which a further task is worth starting.
TEXTS_A_TASK, FEWEST_TEXTS = 10_000, 500


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows, dealt evenly over tasks by their number.

    The texts that are made of them are hundreds of times as large as the rows, whose file may be a single split; without
    this all texts would be the work of one task, however many there are.
    """
    n = rows.count()
    most = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FEWEST_TEXTS))
    return rows.repartition(max(1, most, -(-n // TEXTS_A_TASK)))


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k: the keys of part, spread; files, pages and models are made as text from them."""
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))


# A table with nulls, a constant, and years and months out of range, derived from events.
def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 3 == 0, F.col("value")).alias("mostly_null"),
        F.lit("BR").alias("const_col"),
        (F.lit(1990) + e % 40).cast("string").alias("ano"),
        (e % 14).cast("string").alias("mes"),
        (F.col("user_id") % 7).alias("grp_id"),
    )


_DIRTY = """dirty AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS mostly_null, 'BR' AS const_col,
  CAST(1990 + event_id % 40 AS VARCHAR) AS ano, CAST(event_id % 14 AS VARCHAR) AS mes, user_id % 7 AS grp_id FROM events)"""


# SQL statements and program lines derived from orders, one for each order.
def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _sql_text().alias("sql"))


def _sql_text() -> Column:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    forms = (
        F.concat(F.lit("SELECT a.x FROM dbo.orders a JOIN [dbo].[t"), (k % 5).cast("string"), F.lit("] b ON a.id = b.id -- "), p),
        F.concat(F.lit("UPDATE stock SET q = "), k.cast("string"), F.lit(";")),
        F.concat(F.lit("UPDATE stock SET q = 1\nWHERE id = "), k.cast("string")),
        F.concat(F.lit("DELETE FROM log; EXEC dbo.purge"), (k % 3).cast("string")),
        F.concat(F.lit("MERGE INTO target USING #src ON 1 = 1 /* "), p, F.lit(" */")),
        F.concat(F.lit("INSERT INTO hist SELECT x FROM live WITH (NOLOCK) WHERE id = "), k.cast("string")),
        F.concat(F.lit("DECLARE @t TABLE (i int); DECLARE c CURSOR FOR SELECT i FROM @t; BEGIN TRAN COMMIT "), p),
    )
    out = F.when(k % 7 == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        out = out.when(k % 7 == i, f)
    return out


_SQL_TEXTS = """t AS (SELECT o_orderkey AS id, CASE o_orderkey % 7
  WHEN 0 THEN 'SELECT a.x FROM dbo.orders a JOIN [dbo].[t' || (o_orderkey % 5) || '] b ON a.id = b.id -- ' || o_orderpriority
  WHEN 1 THEN 'UPDATE stock SET q = ' || o_orderkey || ';'
  WHEN 2 THEN 'UPDATE stock SET q = 1' || chr(10) || 'WHERE id = ' || o_orderkey
  WHEN 3 THEN 'DELETE FROM log; EXEC dbo.purge' || (o_orderkey % 3)
  WHEN 4 THEN 'MERGE INTO target USING #src ON 1 = 1 /* ' || o_orderpriority || ' */'
  WHEN 5 THEN 'INSERT INTO hist SELECT x FROM live WITH (NOLOCK) WHERE id = ' || o_orderkey
  ELSE 'DECLARE @t TABLE (i int); DECLARE c CURSOR FOR SELECT i FROM @t; BEGIN TRAN COMMIT ' || o_orderpriority END AS sql
  FROM orders),
p AS (SELECT id, sql, regexp_replace(regexp_replace(sql, '/\\*.*?\\*/', ' ', 'gs'), '--[^' || chr(10) || ']*', ' ', 'g') AS plain FROM t)"""


def program_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = (
        F.when(k % 6 == 0, F.lit("var_dump($x);"))
        .when(k % 6 == 1, F.lit("$a = $SESSION['u'];"))
        .when(k % 6 == 2, F.lit("echo $_REQUEST['q'];"))
        .when(k % 6 == 3, F.lit('$q = "SELECT 1 FROM t";'))
        .when(k % 6 == 4, F.lit("$b = 1"))
        .otherwise(F.lit("// gambiarra"))
    )
    text = F.concat_ws("\n", F.lit("<?php"), line, F.concat(F.lit("// "), F.col("o_orderpriority")), F.when(k % 10 == 0, F.lit("die();")))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".php")).alias("path"), text.alias("text"))


_PROGRAM = """f AS (SELECT 'src/f' || o_orderkey || '.php' AS path, '<?php' || chr(10) || CASE o_orderkey % 6 WHEN 0 THEN 'var_dump($x);' WHEN 1 THEN '$a = $SESSION[''u''];' WHEN 2 THEN 'echo $_REQUEST[''q''];'
  WHEN 3 THEN '$q = "SELECT 1 FROM t";' WHEN 4 THEN '$b = 1' ELSE '// gambiarra' END || chr(10) || '// ' || o_orderpriority || CASE WHEN o_orderkey % 10 = 0 THEN chr(10) || 'die();' ELSE '' END AS text FROM orders),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS line_no FROM f)"""

# id, severity, category and pattern of each rule; what stands before a superglobal is part of the pattern here
_RULE_PATTERNS = (
    ("debug_var_dump", "warning", "debug", r"(?i)\bvar_dump\s*\("),
    ("debug_print_r", "warning", "debug", r"(?i)\bprint_r\s*\("),
    ("debug_die_exit", "warning", "debug", r"(?i)\b(die|exit)\s*\("),
    ("invalid_superglobal_session", "critical", "erro-provavel", r"(^|[^_])\$SESSION\b"),
    ("invalid_superglobal_generic", "critical", "erro-provavel", r"(^|[^_])\$(GET|POST|REQUEST|SERVER)\b"),
    ("direct_request_usage", "warning", "input", r"(?i)\$_REQUEST\b"),
    ("suspicious_comment", "info", "comentario", r"(?i)mock|mocado|tempor[aá]rio|remover depois|gambiarra|hotfix|teste r[aá]pido"),
    ("sql_inline", "warning", "sql", r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|EXEC|MERGE)\b"),
)
_STATEMENT_LINE = r"""regexp_matches(line, '^(return|echo|\$[A-Za-z_])') AND (contains(line, '=') OR starts_with(line, 'return ') OR starts_with(line, 'echo ')) AND NOT regexp_matches(line, '[;{}:,]$')"""
_RULED = _PROGRAM + ",\nhits AS (" + "\nUNION ALL ".join(
    [f"SELECT path, CAST(line_no AS INT) AS line_no, '{i}' AS rule_id, '{s}' AS severity, '{c}' AS category FROM l WHERE regexp_matches(line, '{p}')" for i, s, c, p in _RULE_PATTERNS]
    + [f"SELECT path, CAST(line_no AS INT), 'possible_missing_semicolon', 'info', 'sintaxe-suspeita' FROM l WHERE {_STATEMENT_LINE}"]
) + ")"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"WITH {_DIRTY} " + _union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*) * 100, 2) AS pct_nulls FROM dirty" for c in ("event_id", "mostly_null", "const_col", "ano", "mes", "grp_id")]))
def null_profile(spark, sf_dir):
    return profile.null_profile(dirty(spark, sf_dir))


@query(_union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", round(count(DISTINCT {c}) / count(*) * 100, 2) AS pct_distinct FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]))
def cardinality(spark, sf_dir):
    return profile.cardinality(table(spark, sf_dir, "orders"))


@query(_union([f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicated_rows, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n) * 100, 2) AS pct_duplicated FROM (SELECT count(*) AS n FROM events GROUP BY {c})" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")]))
def column_duplicates(spark, sf_dir):
    return profile.column_duplicates(table(spark, sf_dir, "events"))


@query("SELECT 'o_orderdate' AS \"column\", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last FROM orders")
def date_ranges(spark, sf_dir):
    return profile.date_ranges(table(spark, sf_dir, "orders"))


@query(_union([f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in _LINEITEM]))
def numeric_stats(spark, sf_dir):
    return profile.numeric_stats(table(spark, sf_dir, "lineitem")).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation ORDER BY nation.n_nationkey LIMIT 10")
def sample_rows(spark, sf_dir):
    return profile.sample_rows(table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("SELECT 'customer' AS tbl, 'c_acctbal' AS \"column\", count(*) AS quantity FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'supplier', 's_acctbal', count(*) FROM supplier WHERE s_acctbal < 0 HAVING count(*) > 0")
def negatives(spark, sf_dir):
    parts = [anomaly.negatives(table(spark, sf_dir, t)).select(F.lit(t).alias("tbl"), "column", "quantity") for t in ("customer", "supplier")]
    return parts[0].unionByName(parts[1])


@query(_union([f"SELECT '{t}' AS tbl, '{c}' AS \"column\", count(*) AS quantity FROM {t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}) WHERE b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) HAVING count(*) > 0" for t, c in (("events", "event_id"), ("events", "user_id"), ("events", "value"), ("documents", "doc_id"), ("documents", "n_chars"))]))
def iqr_outliers(spark, sf_dir):
    parts = [anomaly.iqr_outliers(table(spark, sf_dir, t)).select(F.lit(t).alias("tbl"), "column", "quantity") for t in ("events", "documents")]
    return parts[0].unionByName(parts[1])


@query("SELECT 'user_id, event_type' AS \"column\", CAST(sum(n) AS BIGINT) AS quantity, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1) HAVING count(*) > 0")
def key_duplicates(spark, sf_dir):
    return anomaly.key_duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("column", "quantity", "detail")


_FINDINGS = f"""{_DIRTY},
q AS (SELECT quantile_cont(mostly_null, 0.25) AS a, quantile_cont(mostly_null, 0.75) AS b FROM dirty),
fs AS (SELECT 'muitos_nulos' AS kind, 'mostly_null' AS "column", count(*) - count(mostly_null) AS quantity FROM dirty HAVING round((count(*) - count(mostly_null)) / count(*) * 100, 2) >= 50
 UNION ALL SELECT 'coluna_constante', 'const_col', NULL FROM dirty HAVING count(DISTINCT const_col) = 1
 UNION ALL SELECT 'valores_negativos', 'mostly_null', count(*) FROM dirty WHERE mostly_null < 0 HAVING count(*) > 0
 UNION ALL SELECT 'outlier_iqr', 'mostly_null', count(*) FROM dirty, q WHERE b > a AND (mostly_null < a - 1.5 * (b - a) OR mostly_null > b + 1.5 * (b - a)) HAVING count(*) > 0
 UNION ALL SELECT 'ano_fora_faixa', 'ano', count(*) FROM dirty WHERE CAST(ano AS INT) NOT BETWEEN 2000 AND 2100 HAVING count(*) > 0
 UNION ALL SELECT 'mes_fora_faixa', 'mes', count(*) FROM dirty WHERE CAST(mes AS INT) NOT BETWEEN 1 AND 12 HAVING count(*) > 0
 UNION ALL SELECT 'duplicidade_combinacao', 'ano, mes, grp_id', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty GROUP BY ano, mes, grp_id HAVING count(*) > 1) HAVING count(*) > 0)"""


@query(f"WITH {_FINDINGS} SELECT kind, \"column\", coalesce(quantity, 0) AS quantity FROM fs")
def anomaly_findings(spark, sf_dir):
    return anomaly.detect(dirty(spark, sf_dir), ["ano", "mes", "grp_id"]).select("kind", "column", F.coalesce("quantity", F.lit(0)).alias("quantity"))


@query(f"WITH {_FINDINGS} SELECT kind, \"column\", coalesce(quantity, 0) AS quantity FROM fs")
def merged_findings(spark, sf_dir):
    rows, keys, part = dirty(spark, sf_dir), ["ano", "mes", "grp_id"], F.col("event_id") % 5
    kept = stored(states.table_state(rows, part)), stored(states.key_state(rows, keys, part))
    return states.findings_of(*kept, rows, keys).select("kind", "column", F.coalesce("quantity", F.lit(0)).alias("quantity"))


@query(f"""WITH {_FINDINGS} SELECT CAST(sum(CASE kind WHEN 'muitos_nulos' THEN 4 WHEN 'coluna_constante' THEN 2 WHEN 'valores_negativos' THEN 3
  WHEN 'outlier_iqr' THEN 3 WHEN 'duplicidade_combinacao' THEN 6 ELSE 5 END) AS BIGINT) AS score, count(*) AS findings FROM fs""")
def anomaly_score(spark, sf_dir):
    return anomaly.score(anomaly.detect(dirty(spark, sf_dir), ["ano", "mes", "grp_id"]))


#: All tables of the folder: columns with numbers, then the others.
SCHEMA = {
    "region": (("r_regionkey",), ("r_name",)),
    "nation": (("n_nationkey", "n_regionkey"), ("n_name",)),
    "customer": (("c_custkey", "c_nationkey", "c_acctbal"), ("c_name", "c_mktsegment")),
    "supplier": (("s_suppkey", "s_nationkey", "s_acctbal"), ("s_name",)),
    "part": (("p_partkey", "p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")),
    "orders": (("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderdate", "o_orderpriority")),
    "lineitem": (_LINEITEM, ("l_returnflag", "l_linestatus", "l_shipdate")),
    "events": (("event_id", "user_id", "value"), ("ts", "event_type", "props")),
    "documents": (("doc_id", "n_chars"), ("text", "lang", "source")),
    "embeddings": (("vec_id", "label"), ("embedding",)),
    "pages": (("page_id",), ("url", "html")),
    "benchmark": (("item_id",), ("text",)),
    "labels": (("doc_id", "quality", "toxic"), ()),
    "conversations": (("conv_id", "turn"), ("role", "text")),
    "dirty": (("event_id", "mostly_null", "grp_id"), ("const_col", "ano", "mes")),
}


def _radar_sql() -> str:
    """Every finding that a table can have as a row with its weight."""
    found = []
    for t, (numbers, others) in SCHEMA.items():
        add = lambda weight, rest, t=t: found.append(f"SELECT '{t}' AS t, {weight} AS w FROM {rest}")
        for c in (*numbers, *others):
            add(4, f"{t} HAVING round((count(*) - count({c})) / count(*) * 100, 2) >= 50")
            add(2, f"{t} HAVING count(DISTINCT {c}) = 1")
        for c in numbers:
            add(3, f"{t} WHERE {c} < 0 HAVING count(*) > 0")
            add(3, f"{t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, count({c}) AS n FROM {t}) WHERE n >= 8 AND b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) HAVING count(*) > 0")
        if "ano" in others:
            add(5, f"{t} WHERE CAST(ano AS INT) NOT BETWEEN 2000 AND 2100 HAVING count(*) > 0")
            add(5, f"{t} WHERE CAST(mes AS INT) NOT BETWEEN 1 AND 12 HAVING count(*) > 0")
        keys = ", ".join(c for c in (*numbers, *others) if c.endswith("_id") or c in ("ano", "mes"))
        if keys:
            add(6, f"(SELECT count(*) AS n FROM {t} GROUP BY {keys} HAVING count(*) > 1) HAVING count(*) > 0")
    names = ", ".join(f"('{t}')" for t in SCHEMA)
    return f"""WITH {_DIRTY}, fs AS ({_union(found)})
SELECT n.t AS "table", true AS ok, CAST(coalesce(sum(w), 0) AS BIGINT) AS score, count(w) AS findings, CAST(NULL AS VARCHAR) AS error FROM (VALUES {names}) n(t) LEFT JOIN fs ON n.t = fs.t GROUP BY n.t"""


@query(_radar_sql())
def radar(spark, sf_dir):
    return anomaly.radar({t: dirty(spark, sf_dir) if t == "dirty" else table(spark, sf_dir, t) for t in SCHEMA})


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM l)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i + 1 AS INT) AS line_no, line, CAST(least(i + 1, n - 1) - greatest(i - 1, 0) + 1 AS INT) AS n_context FROM p WHERE contains(lower(line), 'tion')""")
def term_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return rules.search(docs, "tion", 1).withColumn("n_context", F.size("context")).drop("context")


_WORDS = "t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS term FROM benchmark), w AS (SELECT term FROM t WHERE length(term) >= 6)"


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS line_no FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INT) AS line_no, count(*) AS n, min(term) AS first FROM l JOIN w ON contains(lower(line), term) GROUP BY doc_id, line_no""")
def terms_search(spark, sf_dir):
    words = exploded(table(spark, sf_dir, "benchmark"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "w")
    wanted = words.select(F.lower("w").alias("term")).where(F.length("term") >= 6)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return terms.search_terms(docs, wanted).select("path", "line_no", F.size("terms").cast("long").alias("n"), F.col("terms")[0].alias("first"))


_INDEXED = "license"


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM l)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i + 1 AS INT) AS line_no, line, CAST(least(i + 1, n - 1) - greatest(i - 1, 0) + 1 AS INT) AS n_context FROM p WHERE contains(lower(line), '{_INDEXED}')""")
def indexed_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    index = terms.TermIndex(spark, f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}", 16)
    index.add(docs)
    return index.search(_INDEXED, 1).withColumn("n_context", F.size("context")).drop("context")


@query(f"WITH {_RULED} SELECT * FROM hits")
def line_rules(spark, sf_dir):
    return rules.apply_rules(program_files(spark, sf_dir)).drop("matched_text")


@query(f"""WITH {_RULED}, t(rule_id, title, message) AS (VALUES ('debug_var_dump', 'Uso de var_dump', 'Uso de var_dump encontrado no código.'), ('debug_print_r', 'Uso de print_r', 'Uso de print_r encontrado no código.'),
 ('debug_die_exit', 'Uso de die/exit', 'Uso de die/exit encontrado no código.'), ('hardcoded_login_session', 'Login hardcoded em sessão', 'Comparação direta de login em sessão encontrada.'), ('invalid_superglobal_session', 'Superglobal inválida $SESSION', 'Uso de $SESSION encontrado. O correto provavelmente é $_SESSION.'),
 ('invalid_superglobal_generic', 'Superglobal inválida', 'Uso de superglobal sem underscore encontrado.'), ('direct_request_usage', 'Uso direto de $_REQUEST', 'Uso direto de $_REQUEST encontrado.'), ('suspicious_comment', 'Comentário suspeito', 'Comentário suspeito encontrado.'), ('sql_inline', 'SQL inline', 'Possível SQL inline encontrado.'))
SELECT title, message, severity, category, count(*) AS findings FROM hits JOIN t USING (rule_id) GROUP BY ALL""")
def rule_messages(spark, sf_dir):
    found = rules.apply_rules(program_files(spark, sf_dir)).groupBy("rule_id", "severity", "category").agg(F.count(F.lit(1)).alias("findings"))
    return found.join(rules.rule_texts(spark), "rule_id").drop("rule_id")


@query(f"WITH {_RULED} SELECT 'severity' AS dimension, severity AS value, count(*) AS findings FROM hits GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM hits GROUP BY category")
def rule_rollup(spark, sf_dir):
    return rules.findings_rollup(rules.apply_rules(program_files(spark, sf_dir)))


@query(f"""WITH {_RULED} SELECT path, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
 count(*) FILTER (severity = 'info') AS info, CAST(5 * count(*) FILTER (severity = 'critical') + 3 * count(*) FILTER (severity = 'warning') + count(*) FILTER (severity = 'info') AS BIGINT) AS score
 FROM hits GROUP BY path ORDER BY score DESC, critical DESC, warning DESC, path LIMIT 20""")
def file_ranking(spark, sf_dir):
    return rules.file_ranking(rules.apply_rules(program_files(spark, sf_dir)))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)\\b')) AS INT) AS tags, CAST(len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script>')) AS INT) AS scripts FROM pages")
def page_tags(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", web.tag_count(h).alias("tags"), F.size(F.regexp_extract_all(h, F.lit(r"(?is)<script\b[^>]*>.*?</script>"), F.lit(0))).alias("scripts"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 1)) AS attrs, unnest(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 2)) AS inner_ FROM pages)
SELECT DISTINCT page_id, trim(regexp_replace(regexp_replace(inner_, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, regexp_extract(attrs, 'href="([^"]*)"', 1) AS href FROM a
WHERE trim(regexp_replace(regexp_replace(inner_, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) <> ''""")
def page_links(spark, sf_dir):
    rows = exploded(table(spark, sf_dir, "pages"), web.links(F.col("html")), "a", "page_id")
    return rows.select("page_id", "a.text", "a.href").distinct()


@query("""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script>', 1) AS bs, regexp_extract_all(html, '(?is)(.*?)<script\\b[^>]*>.*?</script>', 1) AS gaps, regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script>') AS alls FROM pages),
b AS (SELECT page_id, unnest(range(len(bs))) + 1 AS i, bs, array_to_string(gaps, '') AS g, gaps, alls FROM s)
SELECT page_id, CAST(i AS INT) AS block, bs[i] AS body, CAST(len(string_split(array_to_string(gaps[:i], '') || array_to_string(alls[:i - 1], ''), chr(10))) AS INT) AS start_line FROM b""")
def script_blocks(spark, sf_dir):
    return web.script_blocks(table(spark, sf_dir, "pages"), "page_id").select("page_id", "block", "body", "start_line")


@query("""WITH u AS (SELECT page_id, url || '?action=Page.show&id=' || page_id AS raw FROM pages), q AS (SELECT page_id, regexp_extract(raw, 'action=([^&]*)', 1) AS action, regexp_extract(raw, '&id=([^&]*)', 1) AS id_param FROM u)
SELECT page_id, action, split_part(action, '.', 1) AS class, split_part(action, '.', 2) AS method, id_param FROM q""")
def url_parts(spark, sf_dir):
    raw = F.concat(F.col("url"), F.lit("?action=Page.show&id="), F.col("page_id").cast("string"))
    u = table(spark, sf_dir, "pages").select("page_id", web.parse_action_url(raw).alias("u"))
    return u.select("page_id", "u.action", "u.class", "u.method", F.filter("u.params", lambda x: x["key"] == "id")[0]["value"].alias("id_param"))


@query(f"""WITH {_SQL_TEXTS} SELECT id, array_to_string(list_filter(['DELETE', 'INSERT', 'MERGE', 'SELECT', 'UPDATE'], lambda x: regexp_matches(upper(plain), CASE x WHEN 'INSERT' THEN '\\bINSERT\\s+INTO\\b' ELSE '\\b' || x || '\\b' END)), ',') AS operations FROM p""")
def sql_operations(spark, sf_dir):
    return sqltext.analyse_sql(sql_texts(spark, sf_dir)).select("id", F.array_join("operations", ",").alias("operations"))


_TABLES_OF = "array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(plain, '{}', 1), lambda x: regexp_replace(x, '[\\[\\];]', '', 'g')))), ',')"
_NAMED = r"([#@\[\]\w.]+)"


@query(
    f"WITH {_SQL_TEXTS} SELECT id, "
    + _TABLES_OF.format(rf"(?i)\b(?:FROM|JOIN)\s+{_NAMED}") + " AS tables_read, "
    + _TABLES_OF.format(rf"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+{_NAMED}") + " AS tables_write, "
    + _TABLES_OF.format(r"(?i)\bEXEC(?:UTE)?\s+([\w.]+)") + " AS procedures FROM p"
)
def sql_tables(spark, sf_dir):
    a = sqltext.analyse_sql(sql_texts(spark, sf_dir))
    return a.select("id", F.array_join("tables_read", ",").alias("tables_read"), F.array_join("tables_write", ",").alias("tables_write"), F.array_join("procedure_calls", ",").alias("procedures"))


def _lacks_where(verb: str) -> str:
    return f"len(list_filter(regexp_extract_all(plain, '(?is)\\b{verb}\\b[^;]*'), lambda x: NOT regexp_matches(x, '(?i)\\bWHERE\\b'))) > 0"


@query(f"""WITH {_SQL_TEXTS} SELECT id, regexp_matches(upper(plain), '\\bCURSOR\\b') AS cursor, regexp_matches(upper(plain), '\\bBEGIN\\s+TRAN\\b|\\bCOMMIT\\b|\\bROLLBACK\\b') AS transaction,
 regexp_matches(upper(plain), '\\bNOLOCK\\b') AS nolock, regexp_matches(upper(plain), '\\bMERGE\\b') AS merge, regexp_matches(upper(plain), '\\bDECLARE\\s+@\\w+\\s+TABLE\\b') AS table_variables,
 {_lacks_where('UPDATE')} AS update_without_where, {_lacks_where('DELETE')} AS delete_without_where,
 CASE WHEN NOT regexp_matches(upper(plain), '\\b(INSERT\\s+INTO|UPDATE|DELETE|MERGE)\\b') THEN 'read' WHEN regexp_matches(upper(plain), '\\bSELECT\\b') THEN 'read_write' ELSE 'write' END AS kind FROM p""")
def sql_flags(spark, sf_dir):
    a = sqltext.analyse_sql(sql_texts(spark, sf_dir))
    r = F.col("resources")
    return a.select("id", *(r[k].alias(k) for k in ("cursor", "transaction", "nolock", "merge", "table_variables")), "update_without_where", "delete_without_where", "kind")


@query("""WITH w AS (SELECT DISTINCT lower(n_name) AS name FROM nation), h AS (SELECT DISTINCT trim(CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE ' ' || lower(n_name) END) AS name FROM nation WHERE n_nationkey % 4 <> 1)
SELECT w.name, h.name IS NOT NULL AS found FROM w LEFT JOIN h ON w.name = h.name""")
def entity_cross(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    have = nation.where("n_nationkey % 4 <> 1").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("name"))
    return domain.cross_entities(nation.select(F.col("n_name").alias("name")), have)


@query("""SELECT count(*) AS rows, count(c_custkey) AS matched, count(*) - count(c_custkey) AS orphans, round(count(c_custkey) / count(*) * 100, 2) AS pct_matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def fk_coverage(spark, sf_dir):
    return catalog.foreign_key_coverage(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


def _entities(spark, sf_dir) -> DataFrame:
    """Entities derived from parts: a name of a kind, a copy of it, and columns by kind."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 9 == 0, F.lit("x_")).otherwise(""), F.element_at(F.array(*map(F.lit, ("programa", "acao", "meta", "fonte", "regiao"))), (k % 5 + 1).cast("int")), (k % 11).cast("string"), F.when(k % 4 == 0, F.lit("_old")).otherwise(""))
    columns = F.when(k % 2 == 0, F.array(F.struct(F.lit("ano1").alias("name")), F.struct(F.lit("status").alias("name")))).otherwise(F.array(F.struct(F.lit("valor").alias("name"))))
    return table(spark, sf_dir, "part").select(k.alias("position"), name.alias("name"), columns.alias("columns"))


_ENTITIES = """e AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 9 = 0 THEN 'x_' ELSE '' END || ['programa', 'acao', 'meta', 'fonte', 'regiao'][p_partkey % 5 + 1] || (p_partkey % 11)
  || CASE WHEN p_partkey % 4 = 0 THEN '_old' ELSE '' END AS name, p_partkey % 2 AS odd FROM part)"""


@query(f"""WITH {_ENTITIES}, g AS (SELECT 'temporal_signals' AS signal, name FROM e WHERE odd = 0 UNION ALL SELECT 'status_signals', name FROM e WHERE odd = 0 UNION ALL SELECT 'financial_signals', name FROM e WHERE odd = 1)
SELECT s AS signal, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS entities FROM (SELECT unnest(['temporal_signals', 'financial_signals', 'regional_signals', 'status_signals', 'versioning_signals']) AS s) LEFT JOIN g ON s = signal GROUP BY s""")
def schema_signals(spark, sf_dir):
    return domain.signals(_entities(spark, sf_dir)).withColumn("entities", F.array_join("entities", ","))


@query(f"""WITH {_ENTITIES}, c AS (SELECT *, regexp_replace(name, '_old$', '') AS canonical, 2 - odd AS n FROM e WHERE name NOT LIKE 'x\\_%' ESCAPE '\\'),
r AS (SELECT *, CASE WHEN name = canonical THEN 50 ELSE 0 END + CASE WHEN name NOT LIKE '%old%' THEN 20 ELSE 0 END + n AS score FROM c)
SELECT canonical, name, position, CAST(score AS INT) AS score, CASE WHEN canonical LIKE 'programa%' OR canonical LIKE 'acao%' THEN 'operacional' WHEN canonical LIKE 'meta%' THEN 'monitoramento' WHEN canonical LIKE 'fonte%' THEN 'financeira' ELSE 'territorial' END AS category
FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY score DESC, position) AS k FROM r) WHERE k = 1""")
def domain_entities(spark, sf_dir):
    d = domain.distinct_entities(_entities(spark, sf_dir))
    return d.select("canonical", "name", "position", "score", domain.category(F.col("canonical")).alias("category"))


def _program(spark, sf_dir) -> DataFrame:
    """A class file for each part, with a documented property, a method that calls another class, and SQL."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("<?php\nclass C"), k, F.lit(" {\n  /** @var int\n   * @label "), F.col("p_brand"), F.lit("\n   */\n  private $id;\n\n  private $other;\n  public function run($a, $b) {\n    $o = new C"),
        (F.col("p_partkey") + 1).cast("string"), F.lit('();\n    $o->run($a);\n    $sql = "SELECT x FROM t'), (F.col("p_partkey") % 3).cast("string"), F.lit('";\n    if ($a) { return $_GET["q"]; }\n  }\n}\n'),
    )
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    return rows.select(F.concat(F.lit("src/C"), k, F.lit(".php")).alias("path"), text.alias("text"))


_PROGRAMS = r"""f AS (SELECT p_partkey AS k, 'src/C' || p_partkey || '.php' AS path, '<?php' || chr(10) || 'class C' || p_partkey || ' {' || chr(10) || '  /** @var int' || chr(10) || '   * @label ' || p_brand || chr(10) || '   */' || chr(10)
  || '  private $id;' || chr(10) || chr(10) || '  private $other;' || chr(10) || '  public function run($a, $b) {' || chr(10) || '    $o = new C' || (p_partkey + 1) || '();' || chr(10) || '    $o->run($a);' || chr(10)
  || '    $sql = "SELECT x FROM t' || (p_partkey % 3) || '";' || chr(10) || '    if ($a) { return $_GET["q"]; }' || chr(10) || '  }' || chr(10) || '}' || chr(10) AS text FROM part),
d AS (SELECT path, text, len(string_split(split_part(text, '  public function', 1), chr(10))) AS start_line, len(string_split(split_part(text, chr(10) || '  }', 1), chr(10))) + 1 AS end_line,
  regexp_extract(text, '(?s)public function.*\n  \}') AS body, regexp_extract(text, 'class (\w+)', 1) AS class FROM f)"""


@query(f"WITH {_PROGRAMS}" + r""" SELECT path, regexp_extract(body, 'function (\w+)', 1) AS method, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, regexp_extract(body, 'new (\w+)', 1) AS class,
 regexp_extract(body, 'FROM (\w+)', 1) AS tables, CAST(len(string_split(regexp_extract(body, '\(([^)]*)\)', 1), ',')) AS INT) AS params, regexp_extract(body, '\$_\w+') AS superglobals,
 array_to_string([end_line - start_line + 1, len(string_split(regexp_extract(body, '\(([^)]*)\)', 1), ',')), len(regexp_extract_all(body, '\$_(GET|POST)')), len(regexp_extract_all(body, '= new \w+\(')), len(regexp_extract_all(body, '->\w+\(')),
  len(regexp_extract_all(body, 'include ')), len(regexp_extract_all(body, 'action=')), len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '(?i)(select|insert|update|delete|from|join|exec|where) '))), len(regexp_extract_all(body, '= "SELECT')),
  len(regexp_extract_all(body, 'FROM \w+')), len(regexp_extract_all(body, 'EXEC '))], ',') AS counts FROM d""")  # fmt: skip
def method_records(spark, sf_dir):
    r = code.method_records(code.methods(_program(spark, sf_dir)))
    sizes = ("lines", "params", "superglobals", "instantiations", "calls", "includes", "actions", "sql_lines", "queries", "tables", "procedures")
    counts = F.array_join(F.array(*(F.element_at("counts", s).cast("string") for s in sizes)), ",")
    return r.select("path", "method", "start_line", "end_line", F.col("calls")[0]["class"].alias("class"), F.array_join("tables", ",").alias("tables"), F.size("params").alias("params"), F.array_join("superglobals", ",").alias("superglobals"), counts.alias("counts"))


@query(f"WITH {_PROGRAMS}" + r""", e AS (SELECT path, regexp_extract(body, 'new (\w+)', 1) AS made, regexp_extract(body, '->(\w+)\(', 1) AS method FROM d),
c AS (SELECT e.path AS caller_path, made AS class, method, d.path FROM e LEFT JOIN d ON d.class = made)
SELECT 1 AS level, caller_path, class, method, path FROM c UNION SELECT 2, b.caller_path, b.class, b.method, b.path FROM c a JOIN c b ON b.caller_path = a.path""")  # fmt: skip
def external_calls(spark, sf_dir):
    files = _program(spark, sf_dir)
    every = stored(code.methods(files))  # read by the first level and by both look-ups
    return code.external_calls(every, files, deep=2, every=every).select("level", "caller_path", "class", "method", "path")


@query(f"WITH {_PROGRAMS}" + r""", p AS (SELECT path, unnest(regexp_extract_all(text, 'private \$(\w+);', 1)) AS name, text FROM d), q AS (SELECT path, name, regexp_extract(split_part(text, '  private $' || name, 1), '(?s)(/\*\*.*\*/)\n$', 1) AS doc FROM p)
SELECT path, name, doc <> '' AS documented, nullif(regexp_extract(doc, '@var (\w+)', 1), '') AS type, nullif(regexp_extract(doc, '@label ([^\n]*)', 1), '') AS label FROM q""")  # fmt: skip
def model_fields(spark, sf_dir):
    return code.model_fields(_program(spark, sf_dir)).select("path", "name", "documented", "type", F.element_at("annotations", "label").alias("label"))
