"""Semantic signals of a schema, maps of a domain, and how well they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import kept

# Words in column names by the signal that they give.
SIGNALS = {
    "temporal_signals": ("ano1", "ano2", "ano3", "ano4", "ano", "exercicio", "vigencia", "inicio", "fim", "data"),
    "financial_signals": ("vl", "valor", "orc", "finance", "despesa", "receita", "credito", "debito", "saldo", "custo"),
    "regional_signals": ("reg", "mun", "municipio", "territorio", "bairro", "localidade", "regional"),
    "status_signals": ("status", "situacao", "flag", "ativo", "inativo", "visivel", "invisivel"),
    "versioning_signals": ("revisao", "versao", "original", "ajuste", "reduz", "suplement", "complement"),
}
# Parts of entity names that are noise, aliases, and words of copies.
NOISY_PREFIXES = ("x_", "w_", "z_")
NOISY_SUFFIXES = ("_copia", "_copy", "_temp", "_tmp", "_old", "_old2", "_new", "_bk", "_507")
ALIASES = {"meta_descricao": "metadescritiva", "objetivo_descricao": "objdescritivo"}
COPY_WORDS = ("temp", "copia", "copy", "old", "new", "_bk", "x_", "w_", "z_")
# Categories by words of the name, the first that fits counts; those of the process domain come first there.
PROCESS_DOMAINS = ("_pae", "pae")
PROCESS_CATEGORIES = (
    ("operacional", ("processo", "despacho", "notificacao")),
    ("organizacional", ("orgao", "departamento", "setor", "unidade")),
    ("controle_acesso", ("acesso", "usuario", "grupo", "perfil", "permissao")),
    ("classificacao", ("tag", "tipodocumento", "documento")),
)
CATEGORIES = (
    ("estrategica", ("diretriz", "eixo", "objetivoestrategico")),
    ("operacional", ("programa", "acao", "objetivo")),
    ("financeira", ("fonte", "valor", "teto", "despesa", "finance")),
    ("monitoramento", ("meta", "indicador")),
    ("territorial", ("regiao", "municip", "territ")),
    ("controle", ("status", "config")),
)
# Signals that a domain map expects.
EXPECTED_SIGNALS = {
    "temporalidade": ("ano", "ano1", "ano2", "ano3", "ano4", "exercicio", "inicio", "fim"),
    "financeiro": ("valor", "vl", "fonte", "orcamento", "despesa", "receita", "teto"),
    "regionalizacao": ("regiao", "municipio", "territorio", "regional"),
    "status": ("status", "ativo", "inativo", "flag", "situacao"),
    "versionamento": ("revisao", "versao", "original", "ajuste", "reducao"),
}
# Words of a rule by the signals that are evidence for it.
EVIDENCE = (
    (("4 anos", "quadrien", "ano", "plurianual"), ("temporal_signals",)),
    (("valor", "finance", "fonte", "revis", "teto", "orc"), ("financial_signals", "versioning_signals")),
    (("região", "regional", "município", "territ", "territorial"), ("regional_signals",)),
    (("status", "situação", "avali"), ("status_signals",)),
)


def _holds(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def signals(entities: DataFrame) -> DataFrame:
    """signal, entities (sorted names of those with a column that gives it); entities: name, columns.

    Every column is looked at where it is; what is shuffled is a pair of signal and name for each entity at most.
    """
    names = F.transform("columns", lambda c: F.lower(F.trim(c["name"])))
    given = kept(*((_any_column(names, words), signal) for signal, words in SIGNALS.items()))
    rows = entities.where(F.trim("name") != "").select(F.trim("name").alias("name"), F.explode(given).alias("signal"))
    counted = rows.groupBy("signal").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    seed = entities.sparkSession.createDataFrame([(s,) for s in SIGNALS], "signal string")
    return seed.join(counted, "signal", "left").select("signal", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def _any_column(names: Column, words) -> Column:
    return F.exists(names, lambda n: _holds(n, words))


def canonical_name(name: Column) -> Column:
    """An entity's name without noise: null for noisy prefixes and names under two letters; suffixes go in turn."""
    raw = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    cut = lambda n, suffix: F.when(n.endswith(suffix), F.substring(n, F.lit(1), F.length(n) - F.length(suffix))).otherwise(n)
    n = F.aggregate(F.array(*map(F.lit, NOISY_SUFFIXES)), raw, cut)
    n = F.coalesce(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[n], n)
    noisy = F.lit(False)
    for prefix in NOISY_PREFIXES:
        noisy = noisy | raw.startswith(prefix)
    return F.when(~noisy & (F.length(n) >= 2), n)


def distinct_entities(entities: DataFrame) -> DataFrame:
    """Of the entities (position, name, columns) with one canonical name the best: its own name is canonical (50),
    no word of a copy in it (20), its number of columns (30 at most); of equals the first."""
    raw = F.lower(F.trim("name"))
    score = F.when(raw == F.col("canonical"), 50).otherwise(0) + F.when(~_holds(raw, COPY_WORDS), 20).otherwise(0) + F.least(F.size("columns"), F.lit(30))
    named = entities.withColumn("canonical", canonical_name(F.col("name"))).where("canonical IS NOT NULL").withColumn("score", score)
    best = F.max_by(F.struct("position", "name", "columns", "score"), F.struct("score", -F.col("position")))
    return named.groupBy("canonical").agg(best.alias("b")).select("canonical", "b.*")


def category(name: Column, domain: str = "") -> Column:
    """The first category whose words the name holds; else geral."""
    rules = (*(PROCESS_CATEGORIES if domain in PROCESS_DOMAINS else ()), *CATEGORIES)
    out = None
    for label, words in rules:
        held = _holds(F.lower(name), words)
        out = F.when(held, label) if out is None else out.when(held, label)
    return out.otherwise("geral")


# Descriptions of entities by words of their names, the first that fits counts; those of the process
# domain come first there.
PROCESS_DESCRIPTIONS = (
    (("processo",), "Entidade associada ao fluxo de processos do planejamento."),
    (("despacho",), "Entidade associada ao registro de despacho ou movimentação de processo."),
    (("notificacao",), "Entidade associada a notificações do fluxo."),
    (("tipodocumento", "documento"), "Entidade associada à classificação documental."),
    (("departamento", "orgao", "setor"), "Entidade associada à estrutura organizacional."),
    (("acesso", "usuario", "grupo", "perfil"), "Entidade associada a controle de acesso e permissões."),
    (("tag",), "Entidade associada à classificação ou etiquetagem de processos."),
)
DESCRIPTIONS = (
    (("diretriz",), "Entidade associada a direcionamento estratégico."),
    (("programaobjetivo",), "Entidade associada a objetivos vinculados a programas."),
    (("programa",), "Entidade associada à organização programática do domínio."),
    (("acao",), "Entidade associada à execução operacional."),
    (("meta",), "Entidade associada a metas físicas, qualitativas ou financeiras."),
    (("indicador",), "Entidade associada à medição de desempenho."),
    (("fonte",), "Entidade associada à origem de recursos ou detalhamento financeiro."),
    (("regiao", "municip"), "Entidade associada à regionalização ou recorte territorial."),
    (("status",), "Entidade associada à classificação de estado ou situação."),
    (("config",), "Entidade associada a configuração sistêmica."),
)


def description(name: Column, domain: str = "") -> Column:
    """The description that the name's first fitting words give; null if none fits."""
    rules = (*(PROCESS_DESCRIPTIONS if domain in PROCESS_DOMAINS else ()), *DESCRIPTIONS)
    return F.coalesce(*(F.when(_holds(F.lower(name), words), text) for words, text in rules))


def expected_signals(spark: SparkSession) -> DataFrame:
    """signal, words: what every domain map expects."""
    return spark.createDataFrame(list(EXPECTED_SIGNALS.items()), "signal string, words array<string>")


def relation_kind(source: Column, target: Column, domain: str = "") -> Column:
    """What a relation between two entities is, by their names."""
    s, t = F.lower(source), F.lower(target)
    rules: list[tuple[Column, str]] = []
    if domain in PROCESS_DOMAINS:
        rules += [
            (s.contains("despacho") & t.contains("processo"), "tramita_em"),
            (s.contains("notificacao") & _holds(t, ("usuario", "grupo")), "notifica"),
            (s.contains("processo") & _holds(t, ("departamento", "orgao")), "pertence_a"),
            (s.contains("tag") & t.contains("processo"), "classifica"),
            ((s == t) & _holds(s, ("grupo", "modulo", "transacao")), "auto_relaciona"),
        ]
    rules += [
        (_holds(s, ("meta", "fonte")), "detalha"),
        (s.contains("indicador"), "mede"),
        (_holds(s, ("regiao", "municip")), "regionaliza"),
        (s.contains("programaobjetivo") & t.contains("programa"), "pertence_a"),
        ((s == "acao") & t.contains("programa"), "pertence_a"),
        ((s == "acao") & t.contains("objetivo"), "pode_vincular_a"),
    ]
    out = F.when(*rules[0])
    for condition, label in rules[1:]:
        out = out.when(condition, label)
    return out.otherwise("relaciona_com")


def domain_relations(relationships: DataFrame, entities: DataFrame, domain: str = "") -> DataFrame:
    """source, target, kind of relationships (source_name, target_name) between canonical names of entities that
    both are there; distinct."""
    valid = distinct_entities(entities).select("canonical")
    named = relationships.select(canonical_name(F.col("source_name")).alias("source"), canonical_name(F.col("target_name")).alias("target"))
    both = named.join(valid.withColumnRenamed("canonical", "source"), "source", "left_semi").join(valid.withColumnRenamed("canonical", "target"), "target", "left_semi")
    return both.select("source", "target", relation_kind(F.col("source"), F.col("target"), domain).alias("kind")).distinct()


# Texts of the rules that a domain may suggest.
RULE_TEXTS = {
    "processes": "O domínio possui gestão de processos.",
    "dispatch": "O domínio possui tramitação ou despacho associado a processos.",
    "notifications": "O domínio possui envio ou controle de notificações.",
    "access_control": "O domínio possui controle de acesso por usuários, grupos ou permissões.",
    "document_classes": "O domínio possui mecanismos de classificação documental ou temática.",
    "multi_year": "O domínio possui distribuição temporal em múltiplos anos, possivelmente com planejamento plurianual.",
    "financial_detail": "O domínio possui componentes financeiros com detalhamento por valores e possivelmente por fonte de recurso.",
    "revision": "O domínio possui sinais de revisão, versionamento ou ajuste de valores/metas.",
    "regional": "O domínio possui regionalização ou recorte territorial.",
    "program_action_hierarchy": "Há indícios de uma estrutura hierárquica entre programa e ação.",
    "objective_goal": "Há indícios de associação entre objetivos e metas.",
    "indicator": "Há entidades voltadas à medição de desempenho por indicadores.",
}


def candidate_rules(entities: DataFrame, domain: str = "") -> DataFrame:
    """rule, text: which rules the names and columns of the entities suggest, sorted by text."""
    e = distinct_entities(entities).select("canonical", F.transform("columns", lambda c: F.lower(F.trim(c["name"]))).alias("cols"))
    in_any = lambda words: F.bool_or(_holds(F.col("canonical"), words) | _any_column(F.col("cols"), words))
    in_name = lambda *words: F.bool_or(_holds(F.col("canonical"), words))
    told = {
        "multi_year": in_any(("ano1", "ano2", "ano3", "ano4")),
        "financial_detail": in_any(("fonte", "valor", "vl", "teto")),
        "revision": in_any(("revisao", "original", "ajuste", "reducao")),
        "regional": in_any(("regiao", "municip", "territ")),
        "program_action_hierarchy": in_name("programa") & in_name("acao"),
        "objective_goal": in_name("objetivo") & in_name("meta"),
        "indicator": in_name("indicador"),
    }
    if domain in PROCESS_DOMAINS:
        told |= {
            "processes": in_name("processo"),
            "dispatch": in_name("despacho"),
            "notifications": in_name("notificacao"),
            "access_control": in_name("acesso", "usuario", "grupo", "perfil"),
            "document_classes": in_name("tag", "tipodocumento", "documento"),
        }
    row = e.agg(*(v.alias(k) for k, v in told.items()))
    held = [F.when(F.coalesce(k, F.lit(False)), F.struct(F.lit(k).alias("rule"), F.lit(RULE_TEXTS[k]).alias("text"))) for k in told]
    return row.select(F.explode(F.array_compact(F.array(*held))).alias("r")).select("r.*").orderBy("text")


def refine(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, aliases, category: entities grouped to their canonical name by (alias, canonical), other names kept."""
    joined = entities.select(F.lower(F.trim("name")).alias("alias"), "category").join(aliases, "alias", "left")
    named = joined.select("alias", F.coalesce("canonical", "alias").alias("name"), "category")
    others = F.array_sort(F.collect_set(F.when(F.col("alias") != F.col("name"), F.col("alias"))))
    return named.groupBy("name").agg(others.alias("aliases"), F.min("category").alias("category"))


def merge_relations(relations: DataFrame, manual: DataFrame, entities: DataFrame, check_manual: bool = True) -> DataFrame:
    """source, target, kind: relations between known entities, and manual ones; distinct. check_manual: these too
    must be between known entities."""
    names = entities.select("name")

    def inside(df: DataFrame) -> DataFrame:
        return df.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")

    cols = ["source", "target", "kind"]
    return inside(relations).select(*cols).unionByName((inside(manual) if check_manual else manual).select(*cols)).distinct()


def cross_entities(expected: DataFrame, schema: DataFrame) -> DataFrame:
    """name, found for every expected name (lower-cased); schema names are only trimmed. One left join."""
    have = schema.select(F.trim("name").alias("name")).distinct().withColumn("found", F.lit(True))
    want = expected.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    return want.join(have, "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("found"))


def cross_relations(expected: DataFrame, schema: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """source, target, found of expected relations: in the schema, or inferred."""
    cols = ["source", "target"]
    have = schema.select(*cols) if inferred is None else schema.select(*cols).unionByName(inferred.select(*cols))
    return expected.select(*cols).distinct().join(have.distinct().withColumn("found", F.lit(True)), cols, "left").select(*cols, F.coalesce("found", F.lit(False)).alias("found"))


def infer_relations(expected: DataFrame, columns: DataFrame) -> DataFrame:
    """Expected relations whose source has a column named like a key to the target: target_id, id_target, targetid,
    target_codigo or cod_target. columns: entity, column. An equi-join on (entity, column)."""
    forms = lambda t: F.array(F.concat(t, F.lit("_id")), F.concat(F.lit("id_"), t), F.concat(t, F.lit("id")), F.concat(t, F.lit("_codigo")), F.concat(F.lit("cod_"), t))
    wanted = expected.select("source", "target", F.explode(forms(F.col("target"))).alias("column"))
    have = columns.select(F.lower(F.trim("entity")).alias("source"), F.lower(F.trim("column")).alias("column")).distinct()
    return wanted.join(have, ["source", "column"], "left_semi").select("source", "target").distinct()


def adherence(crossed: DataFrame) -> DataFrame:
    """expected, found, missing, pct (two places; 0 if nothing is expected)."""
    row = crossed.agg(F.count(F.lit(1)).alias("expected"), F.count_if("found").alias("found"))
    return row.select("expected", "found", (F.col("expected") - F.col("found")).alias("missing"), F.when(F.col("expected") == 0, 0.0).otherwise(F.round(F.col("found") / F.col("expected") * 100, 2)).alias("pct"))


# Words of a rule, and the groups of entities and the relationships (source, target) that are evidence for it.
KEY_EVIDENCE = (
    (("estrutura programática", "programas, objetivos e ações"), (("programa", "programaobjetivo", "acao"),), (("acao", "programa"), ("programaobjetivo", "programa"))),
    (("direcionamento estratégico", "diretrizes, programas"), (("diretriz", "diretriz_programa", "programa"),), (("diretriz_programa", "diretriz"), ("diretriz_programa", "programa"))),
    (("detalhamento financeiro", "fontes de recurso"), (("acaofonte",), ("despesateto",), ("tetoorgao",), ("unidorca_fonteger",)), ()),
    (("metas associadas", "monitoramento"), (("acaometa",), ("programaobjetivometa",), ("opameta",)), ()),
    (("indicadores", "medição de desempenho"), (("indicador",),), (("indicador", "programa"),)),
    (("regionalização", "territorial"), (("acaoregiao",), ("tbmeta_e_regioes",), ("tbpropostametareg",)), (("acaoregiao", "acao"), ("tbmeta_e_regioes", "tbpropostametareg"))),
    (("ação está semanticamente vinculada ao programa",), (("acao", "programa"),), (("acao", "programa"),)),
    (("objetivos pertencem a programas",), (("programaobjetivo", "programa"),), (("programaobjetivo", "programa"),)),
    (("metas detalham os objetivos",), (("programaobjetivometa", "programaobjetivo"),), (("programaobjetivometa", "programaobjetivo"),)),
)


def rule_evidence(rules: DataFrame, found_signals: DataFrame, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> DataFrame:
    """rule, evidence, confidence: signals that a rule's words ask for and the schema gives, groups of key entities
    (name) and key relationships (source, target) that are there. Three pieces of evidence or more are alta, one or
    two média, none baixa.

    Only the signals, key entities and key relationships, fixed in number, are gathered to one row.
    """
    spark = rules.sparkSession
    keys = sorted({n for _, groups, _ in KEY_EVIDENCE for g in groups for n in g})
    pairs = sorted({f"{a} → {b}" for _, _, links in KEY_EVIDENCE for a, b in links})
    none = spark.createDataFrame([], "name string")
    named = none if entities is None else entities.select(F.lower(F.trim("name")).alias("name"))
    linked = none if relationships is None else relationships.select(F.concat(F.lower(F.trim("source")), F.lit(" → "), F.lower(F.trim("target"))).alias("name"))
    there = found_signals.where(F.size("entities") > 0).select(F.col("signal").alias("name"))
    there = there.unionByName(named.where(F.col("name").isin(keys))).unionByName(linked.where(F.col("name").isin(pairs)))
    have = there.agg(F.collect_set("name").alias("have"))
    text, held = F.lower("rule"), (lambda names: F.forall(F.array(*map(F.lit, names)), lambda x: F.array_contains("have", x)))
    told = [(_holds(text, words) & held([s]), s) for words, names in EVIDENCE for s in names]
    told += [(_holds(text, words) & held(g), "Entidades presentes: " + ", ".join(g)) for words, groups, _ in KEY_EVIDENCE for g in groups]
    told += [(_holds(text, words) & held([f"{a} → {b}"]), f"Relacionamento presente: {a} → {b}") for words, _, links in KEY_EVIDENCE for a, b in links]
    joined = rules.select("rule").join(F.broadcast(have)).withColumn("evidence", F.array_distinct(kept(*told)))  # have: one row
    n = F.size("evidence")
    return joined.select("rule", "evidence", F.when(n >= 3, "alta").when(n >= 1, "média").otherwise("baixa").alias("confidence"))


def maturity(domains: DataFrame) -> DataFrame:
    """Domains with their maturity: by what files they have, adherence of entities and relationships, and rules."""
    e, r = F.coalesce("adherence_entities", F.lit(0.0)), F.coalesce("adherence_relationships", F.lit(0.0))
    n = F.coalesce("rule_count", F.lit(0))
    level = (
        F.when(~F.col("has_structural"), "não iniciado")
        .when(~F.col("has_domain_map"), "estrutural")
        .when(~F.col("has_cross"), "semântico inicial")
        .when(~F.col("has_cross_ia"), "parcial")
        .when((e >= 95) & (r >= 90) & (n >= 2), "maduro")
        .when((e >= 70) | (r >= 50) | (n >= 1), "parcial")
        .otherwise("raso")
    )
    return domains.withColumn("maturity", level)


def inventory(structural: DataFrame, maps: DataFrame, crosses: DataFrame, commented: DataFrame) -> DataFrame:
    """A row for each domain that any of the four tables names: which of them it is in, its adherences and number of
    rules (of ``crosses``: domain, adherence_entities, adherence_relationships, rule_count), and its maturity.

    The tables hold a row a domain; one outer join by equal keys, no file is parsed.
    """
    out = structural.select("domain", F.lit(True).alias("has_structural"))
    out = out.join(maps.select("domain", F.lit(True).alias("has_domain_map")), "domain", "full")
    out = out.join(crosses.select("domain", F.lit(True).alias("has_cross"), "adherence_entities", "adherence_relationships", "rule_count"), "domain", "full")
    out = out.join(commented.select("domain", F.lit(True).alias("has_cross_ia")), "domain", "full")
    flags = ("has_structural", "has_domain_map", "has_cross", "has_cross_ia")
    filled = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}).withColumn("rule_count", F.coalesce("rule_count", F.lit(0)))
    return maturity(filled).select("domain", *flags, "adherence_entities", "adherence_relationships", "rule_count", "maturity").orderBy("domain")


def expected_entities(maps: DataFrame) -> DataFrame:
    """name, distinct: the entities of domain maps, given as an object by name or as a list of names or of objects
    with a name. maps: one column ``entities`` with the JSON text of either."""
    text = F.col("entities")
    by_name = F.map_keys(F.from_json(text, "map<string,string>"))
    listed = F.from_json(text, "array<string>")
    names = F.transform(listed, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    each = F.when(F.trim(text).startswith("["), names).otherwise(by_name)
    return maps.select(F.explode(each).alias("name")).select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in this order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
