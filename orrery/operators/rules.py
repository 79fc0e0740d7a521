"""Line rules over a corpus of files, their rollups, and search with context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import exploded, text_lines


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    pattern: str
    title: str
    message: str


# Rules by id, severity, category, Java pattern, title and message.
RULES = (
    Rule("debug_var_dump", "warning", "debug", r"(?i)\bvar_dump\s*\(", "Uso de var_dump", "Uso de var_dump encontrado no código."),
    Rule("debug_print_r", "warning", "debug", r"(?i)\bprint_r\s*\(", "Uso de print_r", "Uso de print_r encontrado no código."),
    Rule("debug_die_exit", "warning", "debug", r"(?i)\b(die|exit)\s*\(", "Uso de die/exit", "Uso de die/exit encontrado no código."),
    Rule("hardcoded_login_session", "critical", "seguranca", r"""(?i)\$_SESSION\s*\[\s*['"]login['"]\s*\]\s*([=!]==?|===)\s*['"][^'"]+['"]""", "Login hardcoded em sessão", "Comparação direta de login em sessão encontrada."),
    Rule("invalid_superglobal_session", "critical", "erro-provavel", r"(?<!_)\$SESSION\b", "Superglobal inválida $SESSION", "Uso de $SESSION encontrado. O correto provavelmente é $_SESSION."),
    Rule("invalid_superglobal_generic", "critical", "erro-provavel", r"(?<!_)\$(GET|POST|REQUEST|SERVER)\b", "Superglobal inválida", "Uso de superglobal sem underscore encontrado."),
    Rule("direct_request_usage", "warning", "input", r"(?i)\$_REQUEST\b", "Uso direto de $_REQUEST", "Uso direto de $_REQUEST encontrado."),
    Rule("suspicious_comment", "info", "comentario", r"(?iu)(mock|mocado|tempor[aá]rio|remover depois|gambiarra|hotfix|teste r[aá]pido)", "Comentário suspeito", "Comentário suspeito encontrado."),
    Rule("sql_inline", "warning", "sql", r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|EXEC|MERGE)\b", "SQL inline", "Possível SQL inline encontrado."),
)
# Fixed value: the further rule of the second rule set.
GENERIC_LOGIN = Rule("hardcoded_login_generic", "critical", "seguranca", r"""(?i)\$[A-Za-z_][A-Za-z0-9_]*\s*([=!]==?|===)\s*['"](admin|teste|root|guest|usuario)['"]""", "Login hardcoded", "Comparação direta de usuário encontrada.")
# Severities, their weight in a file's score, and sizes.
SEVERITIES = {"critical": 5, "warning": 3, "info": 1}
LARGE_FILE_LINES = 2000
SHOWN = 220
# How a statement line that may lack its semicolon is told.
_NO_STATEMENT = r"^(//|#|\*)|[;{}:,]$|^(if|elseif|else|for|foreach|while|switch|case|default|function|class)\b"
_STATEMENT = r"^(return|echo|\$[A-Za-z_])"


def lines_of(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no (from 1), line of every line of every file."""
    return files.select(F.col(path).alias("path"), F.posexplode(text_lines(F.col(text))).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def missing_semicolon(line: Column) -> Column:
    """Whether a line looks like a statement without its semicolon."""
    s = stripped(line)
    told = s.rlike(_STATEMENT) & (s.contains("=") | s.startswith("return ") | s.startswith("echo "))
    return (s != "") & ~s.rlike(_NO_STATEMENT) & told


def apply_rules(files: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, rule_id, severity, category, matched_text: a finding for each rule that a line matches,
    for each line that may lack a semicolon, and for each file over ``LARGE_FILE_LINES`` lines. Titles and messages
    are the rules' own (``rule_texts``).

    The rules are columns of one projection, so lines are matched in the scan and nothing is shuffled. Files are read
    and split once: the finding for a large file comes from its last line's place.
    """
    row = files.select(F.col(path).alias("path"), text_lines(F.col(text)).alias("lines"))
    rows = row.select("path", F.size("lines").alias("n"), F.posexplode_outer("lines").alias("p", "line")).withColumn("line_no", F.col("p") + 1)
    hits = [F.when(F.col("line").rlike(r.pattern), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))) for r in rules]
    hits.append(F.when(missing_semicolon(F.col("line")), F.struct(F.lit("possible_missing_semicolon").alias("rule_id"), F.lit("info").alias("severity"), F.lit("sintaxe-suspeita").alias("category"))))
    hits.append(F.when((F.col("n") > LARGE_FILE_LINES) & (F.col("line_no") == F.col("n")), F.struct(F.lit("large_file").alias("rule_id"), F.lit("info").alias("severity"), F.lit("estrutura").alias("category"))))
    matched = exploded(rows, F.array_compact(F.array(*hits)), "r", "path", "n", "line_no", "line")
    whole = F.col("r.rule_id") == "large_file"
    shown = F.when(whole, F.col("n").cast("string")).otherwise(F.substring(stripped(F.col("line")), 1, SHOWN))
    return matched.select("path", F.when(whole, 1).otherwise(F.col("line_no")).cast("int").alias("line_no"), "r.*", shown.alias("matched_text"))


def rule_texts(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule_id, title, message of each rule."""
    return spark.createDataFrame([(r.rule_id, r.title, r.message) for r in rules], "rule_id string, title string, message string")


def findings_rollup(findings: DataFrame) -> DataFrame:
    """dimension (severity or category), value, findings; every severity is there, with 0 if need be."""
    seed = findings.sparkSession.createDataFrame([("severity", s) for s in SEVERITIES], "dimension string, value string")
    counts = findings.select(F.explode(F.array(F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")), F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")))).alias("r"))
    counted = counts.groupBy("r.dimension", "r.value").agg(F.count(F.lit(1)).alias("findings"))
    return seed.join(counted, ["dimension", "value"], "full").select("dimension", "value", F.coalesce("findings", F.lit(0)).alias("findings"))


def file_ranking(findings: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` files by score: path, total, critical, warning, info, score; ties by critical, warning, path."""
    each = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    counts = findings.groupBy("path").agg(F.count(F.lit(1)).alias("total"), *each)
    value = sum((F.col(s) * w for s, w in SEVERITIES.items()), F.lit(0))
    return counts.withColumn("score", value).orderBy(F.desc("score"), F.desc("critical"), F.desc("warning"), "path").limit(top)


def search(files: DataFrame, term: str, context: int = 2, ignore_case: bool = True, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, line, context (array of line_no, line): lines that hold ``term``, with their neighbours.

    Contexts are clamped to the file and may overlap. They are slices of a file's own lines, so nothing is shuffled.
    """
    all_lines = F.col("__lines")
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    needle = F.lit(term.lower() if ignore_case else term)
    holding = files.where(fold(F.col(text)).contains(needle))  # only these are split
    row = holding.select(F.col(path).alias("path"), text_lines(F.col(text)).alias("__lines"))
    hit = row.select("path", "__lines", F.posexplode_outer("__lines").alias("p", "line")).where(fold(F.col("line")).contains(needle))
    low = F.greatest(F.col("p") - context, F.lit(0))
    high = F.least(F.col("p") + context + 1, F.size(all_lines))
    near = F.transform(F.sequence(low, high - 1), lambda i: F.struct((i + 1).cast("int").alias("line_no"), F.get(all_lines, i).alias("line")))
    return hit.select("path", (F.col("p") + 1).alias("line_no"), "line", near.alias("context"))


def highlight(text: Column, term: str, before: str = "[", after: str = "]") -> Column:
    """Every occurrence of ``term``, in any case, between two marks."""
    import re

    return F.regexp_replace(text, F.lit("(?iu)" + re.sub(r"([^\w\s])", r"\\\1", term)), F.lit(f"{before}$0{after}"))


def locate_file(files: DataFrame, name: str) -> DataFrame:
    """The path that best fits a class: ``<name>CTR.php``, ``<name>.php``, then any name that holds it; ties by path."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    n = name.strip().lower()
    rank = F.when(base == f"{n}ctr.php", 0).when(base == f"{n}.php", 1).when(base.contains(n) & base.endswith(".php"), 2)
    return files.select("path", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "path").limit(1).select("path")


def locate_method(files: DataFrame, method: str) -> DataFrame:
    """The first path, in order, of a file that holds ``function <method>(``."""
    return files.where(F.col("text").contains(f"function {method}(")).agg(F.min("path").alias("path")).where("path IS NOT NULL")


def directory_tree(files: DataFrame, depth: int = 4, children: int = 25) -> DataFrame:
    """parent, name, is_dir, level: at most ``children`` entries a folder down to ``depth``, folders first."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("parent"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir"), i.alias("level")))
    nodes = files.where(F.size(parts) > 0).select(F.explode(levels).alias("n")).select("n.*").distinct()
    order = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    return nodes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= children)
