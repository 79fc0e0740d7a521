"""Anomalies of a table, their score, and a ranking of tables by it."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalised, numeric_columns, percent, unpivot
from .quantiles import Bracket, brackets, exact_quantiles

# Kinds of findings and what each adds to a table's score; any other kind adds 1.
WEIGHTS = {
    "muitos_nulos": 4,
    "coluna_constante": 2,
    "valores_negativos": 3,
    "outlier_iqr": 3,
    "ano_fora_faixa": 5,
    "mes_fora_faixa": 5,
    "duplicidade_combinacao": 6,
}
# Parts of names that make a column a candidate for a key.
KEY_PARTS = ("ano", "mes", "exercicio", "reg_", "pro_", "pa_", "uno_")
FINDING = "kind string, column string, quantity long, pct double, detail string"


def _findings(df: DataFrame, kind: str) -> DataFrame:
    have = dict.fromkeys(df.columns)
    full = df.withColumns({c: F.lit(None).cast(t) for c, t in (("quantity", "long"), ("pct", "double"), ("detail", "string")) if c not in have})
    return full.select(F.lit(kind).alias("kind"), "column", F.col("quantity").cast("long").alias("quantity"), "pct", "detail")


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDING)


def year_and_month(columns: list[str]) -> dict[str, tuple[str, int, int]]:
    """The first columns whose names hold ``ano`` and ``mes``, with kind of finding and range; nothing without either."""
    year = next((c for c in columns if "ano" in c.lower()), None)
    month = next((c for c in columns if "mes" in c.lower()), None)
    return {year: ("ano_fora_faixa", 2000, 2100)} | {month: ("mes_fora_faixa", 1, 12)} if year is not None and month is not None else {}


def _simple(df: DataFrame, kinds: set[str], least_pct: float = 50.0) -> DataFrame:
    """Findings that plain aggregates tell, all in one pass over the table: one wide row, turned into findings."""
    plain, cells, told = normalised(df), [F.count(F.lit(1)).alias("n")], []
    null = {t: F.lit(None).cast(t) for t in ("long", "double", "string")}

    def add(kind: str, column: str, condition: Column, quantity=null["long"], pct=null["double"], detail=null["string"]) -> None:
        finding = F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column"), quantity.cast("long").alias("quantity"), pct.alias("pct"), detail.alias("detail"))
        told.append(F.when(condition, finding))

    def cell(name: str, value: Column) -> Column:
        cells.append(value.alias(name))
        return F.col(name)

    for i, f in enumerate(plain.schema.fields if "muitos_nulos" in kinds else []):
        nulls = cell(f"{i}_nulls", F.count_if(F.col(f"`{f.name}`").isNull()))
        add("muitos_nulos", f.name, percent(nulls, F.col("n")) >= least_pct, nulls, percent(nulls, F.col("n")))
    for i, f in enumerate(plain.schema.fields if "coluna_constante" in kinds else []):
        if f.dataType.typeName() not in ("map", "variant"):
            x = F.col(f"`{f.name}`")
            same, value = cell(f"{i}_same", F.min(x).eqNullSafe(F.max(x)) & (F.count(x) > 0)), cell(f"{i}_value", F.min(x).cast("string"))
            add("coluna_constante", f.name, same, detail=value)
    for i, c in enumerate(numeric_columns(plain) if "valores_negativos" in kinds else []):
        below = cell(f"{i}_below", F.count_if(F.col(f"`{c}`") < 0))
        add("valores_negativos", c, below > 0, below)
    if "ano_fora_faixa" in kinds:
        for c, (kind, low, high) in year_and_month(df.columns).items():
            whole = F.col(f"`{c}`").cast("string").try_cast("double").try_cast("long")
            outside = cell(kind, F.count_if(~whole.between(low, high)))
            add(kind, c, outside > 0, outside)
    if not told:
        return _none(df)
    return plain.agg(*cells).select(F.explode(F.array_compact(F.array(*told))).alias("f")).select("f.*")


def mostly_null(df: DataFrame, least_pct: float = 50.0) -> DataFrame:
    """Columns whose share of nulls (NaN is one), rounded to two places, is at least ``least_pct``."""
    return _simple(df, {"muitos_nulos"}, least_pct)


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value; detail is that value.

    Least and greatest value decide, so nothing is shuffled but one row a task.
    """
    return _simple(df, {"coluna_constante"})


def negatives(df: DataFrame) -> DataFrame:
    """Numeric columns with values below zero, and how many."""
    return _simple(df, {"valores_negativos"})


def year_month_range(df: DataFrame) -> DataFrame:
    """Values of the first year column outside 2000-2100 and of the first month column outside 1-12.

    The columns are the first whose names hold ``ano`` and ``mes``; without either there are no findings. Values
    are read as numbers and truncated; what is no number is left out.
    """
    return _simple(df, {"ano_fora_faixa"})


def iqr_outliers(df: DataFrame, least: int = 8, reach: float = 1.5) -> DataFrame:
    """Numeric columns with values beyond the quartiles by more than ``reach`` times their distance.

    A pass with a sketch leaves out columns that can't have any. Quartiles are exact, interpolated linearly. Columns with under ``least`` values or equal quartiles are left
    out. The quartiles, two numbers a column, come to the driver and are literals of one counting pass.
    """
    plain = normalised(df)
    columns = numeric_columns(plain)
    return iqr_by_brackets(df, dict(zip(columns, brackets(plain, columns), strict=True)), least, reach)


def iqr_by_brackets(df: DataFrame, told: Mapping[str, Bracket], least: int = 8, reach: float = 1.5) -> DataFrame:
    """``iqr_outliers`` of columns of which a bracket of each quartile is known: only columns that may have any are read.
    A bracket that doesn't hold its quartile is made anew."""
    df = normalised(df)
    asked = []  # fences are at q1 - reach (q3 - q1) and q3 + reach (q3 - q1)
    for c, t in told.items():
        if t.n >= least:
            (a, b), (x, y) = t.around
            if t.least < (1 + reach) * b - reach * x or t.greatest > (1 + reach) * x - reach * b:
                asked.append((c, t))
    if not asked:
        return _none(df)
    columns = [c for c, _ in asked]

    def quartiles(wanted: list[int], around: list[Bracket]) -> dict[int, dict]:
        found: dict[int, dict] = {}
        for r in exact_quantiles(df, [columns[i] for i in wanted], told=around).collect():  # two rows a column
            if r["value"] is not None:
                found.setdefault(wanted[r["position"]], {})[r["k"]] = r["value"]
        return found

    exact = quartiles(list(range(len(columns))), [t for _, t in asked])
    missed = [i for i in range(len(columns)) if len(exact.get(i, {})) < 2]
    if missed:
        exact |= quartiles(missed, brackets(df, [columns[i] for i in missed]))
    bounds = {i: (q[0] - reach * (q[1] - q[0]), q[1] + reach * (q[1] - q[0])) for i, q in exact.items() if len(q) == 2 and q[1] > q[0]}
    if not bounds:
        return _none(df)
    x = {i: F.col(f"`{columns[i]}`").cast("double") for i in bounds}
    row = df.agg(*(F.count_if((x[i] < low) | (x[i] > high)).alias(f"{k}_quantity") for k, (i, (low, high)) in enumerate(bounds.items())))
    return _findings(unpivot(row, [columns[i] for i in bounds], ["quantity"], ["long"]).where("quantity > 0"), "outlier_iqr")


def suggest_keys(columns: list[str], most: int = 8) -> list[str]:
    """The first ``most`` columns whose names look like parts of a key."""
    return [c for c in columns if c.lower().endswith("_id") or any(p in c.lower() for p in KEY_PARTS)][:most]


def key_suggestions(columns: DataFrame, most: int = 8) -> DataFrame:
    """TABLE_SCHEMA, TABLE_NAME, keys: of every table of a catalog the first ``most`` columns, by position, whose names look
    like parts of a key; tables without any are left out. columns: a row a column, as the catalog has them."""
    name = F.lower("COLUMN_NAME")
    looks = name.endswith("_id")
    for part in KEY_PARTS:
        looks = looks | name.contains(part)
    table = ["TABLE_SCHEMA", "TABLE_NAME"]
    listed = columns.where(looks).groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("ORDINAL_POSITION", "COLUMN_NAME"))).alias("all"))
    return listed.select(*table, F.transform(F.slice("all", 1, most), lambda c: c["COLUMN_NAME"]).alias("keys"))


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their combination of ``keys`` with another row (nulls equal); detail counts the groups
    without any null."""
    if not keys:
        return _none(df)
    counts = normalised(df).groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    full = F.lit(True)
    for k in keys:
        full = full & F.col(f"`{k}`").isNotNull()
    row = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("quantity"), F.count_if(full).cast("string").alias("detail")).where("quantity > 0")
    return _findings(row.withColumn("column", F.lit(", ".join(keys))), "duplicidade_combinacao")


def detect(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All findings of a table. keys: of the check for repeated combinations, by default those suggested by name."""
    keys = suggest_keys(df.columns) if keys is None else keys
    plain = _simple(df, {"muitos_nulos", "coluna_constante", "valores_negativos", "ano_fora_faixa"})
    return plain.unionByName(iqr_outliers(df)).unionByName(key_duplicates(df, keys))


def score(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """score (sum of the findings' weights) and findings (their number), for each value of ``by``."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")], F.lit(1))
    return findings.groupBy(*(by or [])).agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("score"), F.count(F.lit(1)).alias("findings"))


def judged(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]] | None = None, at_once: int = 8) -> list[tuple[str, list, str | None]]:
    """name, findings (rows) and error of each table: by falling score, then name; those that can't be read come last.

    Every table is a job of its own, ``at_once`` at a time, that brings its findings to the driver: a few rows a column. So a
    table that fails, in planning or in a task that meets a broken file, becomes a row with its error, as one given as
    an exception does.
    """

    def judge(name: str, df: DataFrame) -> tuple[str, list, str | None]:
        try:
            if not isinstance(df, DataFrame):
                raise df
            return name, detect(df, (keys or {}).get(name)).collect(), None
        except (PySparkException, Py4JError, ValueError, OSError) as e:
            return name, [], str(e)[:500]

    out: list[tuple] = []

    def work(mine: list) -> None:
        out.extend(judge(*pair) for pair in mine)

    pairs = list(tables.items())
    threads = [InheritableThread(target=work, args=(pairs[k::at_once],)) for k in range(min(at_once, len(pairs)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return sorted(out, key=lambda r: (r[2] is not None, -_weight(r[1]), r[0]))


def _weight(findings: list) -> int:
    return sum(WEIGHTS.get(f["kind"], 1) for f in findings)


def radar(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]] | None = None, at_once: int = 8) -> DataFrame:
    """table, ok, score, findings, error: tables by falling score, then name; those that can't be read come last."""
    return ranking(SparkSession.active(), judged(tables, keys, at_once))


def ranking(spark: SparkSession, told: list[tuple[str, list, str | None]]) -> DataFrame:
    """The rows of ``radar`` from what ``judged`` says."""
    rows = [(name, error is None, _weight(found), len(found), error) for name, found, error in told]
    return spark.createDataFrame(rows, "table string, ok boolean, score long, findings long, error string")
