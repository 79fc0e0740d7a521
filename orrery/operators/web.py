"""HTML, script and URL text: elements, actions, endpoints, calls. Built-in functions over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import blocks, js_arguments
from ..functions.columns import exploded, first_by, found, found_once, kept, last_entries, let, sorted_set, text_lines
from .rules import stripped

# What the texts' parts look like.
MODAL = r'(?i)id="([^"]*modal[^"]*)"'
BUTTON = r"(?is)<button\b[^>]*>(.*?)</button>"
LINK = r"(?is)<a\b([^>]*)>(.*?)</a>"
INPUT = r"(?is)<input\b([^>]*)>"
GENERIC = r"(?is)<(div|span|li|p|h1|h2|h3|h4|h5|h6)\b([^>]*)>(.*?)</\1>"
ATTRIBUTE_DOUBLE = r'([a-zA-Z_:][-a-zA-Z0-9_:.]*)="([^"]*)"'
ATTRIBUTE_SINGLE = r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)='([^']*)'"
ONCLICK_DOUBLE = r'(?is)onclick="([^"]+)"'
ONCLICK_SINGLE = r"(?is)onclick='([^']+)'"
DATA_ATTRIBUTE = r'(?i)data-[a-zA-Z0-9_-]+="[^"]+"'
INCLUDED = r"""(?i)\b(?:include|include_once|require|require_once)\s*\(?\s*["']([^"']+)["']"""
ACTION = r"""(?i)action=([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)([^"']*)"""
ACTION_TEXT = r"(?i)action=([a-zA-Z0-9_.&=-]+)"
URL_FIELD = r"""(?i)url\s*:\s*["']([^"']+)["']"""
GET_POST = r"""(?i)\$\s*\.\s*(?:get|post)\s*\(\s*["']([^"']+)["']"""
FETCH = r"""(?i)\bfetch\s*\(\s*["']([^"']+)["']"""
SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"
SCRIPT_SRC = r"""(?i)src=["']([^"']+)["']"""
CONST_STRING = r"""(?s)\bconst\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(["'])(.*?)\2\s*;?"""
CONST_ANY = r"\bconst\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*([^;]+);"
FORM_DATA = r"\bconst\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*new\s+FormData\s*\(\s*\)"
SELECTOR = r"""\$\s*\(\s*(["'])(.*?)\1\s*\)"""
CONSOLE = r"(?s)\bconsole\.(log|error|warn|info)\s*\(.*?\)\s*;"
URL_CONSTANT = r"\b(?:URL_[A-Za-z0-9_]+)\b"
FUNCTION = r"(?i)\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
CLASS = r"(?i)\bclass\s+([A-Za-z_][A-Za-z0-9_]*)\b"
SCRIPT_FILE = r"""(?i)<script\b[^>]*src=["']([^"']+)["']"""
STYLE_FILE = r"""(?i)<link\b[^>]*href=["']([^"']+)["']"""
TAG_WHOLE = r"(?i)<([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>"
HANDLER = r"""(?i)(on[a-z]+)\s*=\s*["']([^"']+)["']"""
ACTION_OF_CLASS = r"action=([A-Z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)"
TAG = r"<([a-zA-Z][a-zA-Z0-9]*)\b"
# Kinds of calls to a server, by name and pattern.
AJAX = {
    "$.ajax": r"\$\s*\.ajax\s*\(",
    "jQuery.ajax": r"jQuery\s*\.ajax\s*\(",
    "$.get": r"\$\s*\.get\s*\(",
    "$.post": r"\$\s*\.post\s*\(",
    "fetch": r"\bfetch\s*\(",
    "XMLHttpRequest": r"\bXMLHttpRequest\b",
}
# Words that set an element's priority.
HIGH = ("small-box-footer", "detalhamento", "financeiro", "repasse", "decreto", "remanejamento")
MEDIUM = ("btn", "link", "modal", "consultar", "listar")
# Steps of a script by what its text holds.
STEPS = (
    ("FormData", "Monta payload com FormData."),
    ("$.ajax", "Envia dados via $.ajax."),
    (".done(", "Trata resposta de sucesso com callback .done()."),
    (".fail(", "Trata falhas com callback .fail()."),
    ("Swal.fire", "Exibe feedback visual com SweetAlert."),
    ("console.", "Registra mensagens de depuração no console."),
    ("$(document).on(", "Usa delegação de eventos com jQuery."),
)
# SQL that an included file may hold, the first that fits counts.
SQL_KINDS = (
    ("select_from", r"(?i)\bselect\b[\s\S]{0,500}?\bfrom\b"),
    ("insert_into", r"(?i)\binsert\s+into\b"),
    ("update_set", r"(?i)\bupdate\b[\s\S]{0,300}?\bset\b"),
    ("delete_from", r"(?i)\bdelete\s+from\b"),
    ("exec", r"(?i)\bexec(?:ute)?\b\s+[a-zA-Z_][\w.]*"),
    ("call", r"(?i)\bcall\b\s+[a-zA-Z_][\w.]*"),
    ("with_select", r"(?i)\bwith\b[\s\S]{0,500}?\bas\b[\s\S]{0,500}?\bselect\b"),
)
# Attributes and tags by which a line is HTML.
HTML_ATTRIBUTES = (
    " id=", " class=", " style=", " name=", " value=", " type=",
    " onclick=", " onchange=", " onsubmit=", " onblur=", " onkeyup=",
    " href=", " src=", " selected", " checked", " disabled",
)
HTML_STARTS = ("<select", "<option", "<input", "<form", "<div", "<span", "<table", "<tr", "<td", "<label", "<script", "<link")
# Properties by which a line is a style.
CSS_PROPERTIES = (
    "color:", "background:", "display:", "margin:", "padding:",
    "font-size:", "font-family:", "border:", "width:", "height:",
    "position:", "top:", "left:", "right:", "bottom:",
    "transform:", "transition:", "z-index:", "overflow:",
    "text-align:", "vertical-align:", "float:", "clear:",
)
SQL_LINES = 50


def clean_html(text: Column) -> Column:
    """Text without tags, ``&nbsp;`` and repeated white space."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), "(?i)&nbsp;", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def attributes(tag: Column) -> Column:
    """A map of attribute names, in lower case, to values; of repeated names the last, single quotes after double."""
    entry = lambda p: F.arrays_zip(F.transform(found(tag, p, 1), F.lower).alias("k"), found(tag, p, 2).alias("v"))
    return last_entries(F.concat(entry(ATTRIBUTE_DOUBLE), entry(ATTRIBUTE_SINGLE)))


def modals(html: Column) -> Column:
    return found_once(html, MODAL, 1)


def buttons(html: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found(html, BUTTON, 1), clean_html), lambda x: x != ""))


def links(html: Column) -> Column:
    """Distinct anchors with a text: array of text, href, onclick, class, id (empty if not given)."""
    pairs = F.arrays_zip(found(html, LINK, 1).alias("attrs"), found(html, LINK, 2).alias("inner"))
    given = lambda m, n: F.coalesce(F.element_at(m, n), F.lit("")).alias(n)
    item = lambda x: let(attributes(x["attrs"]), lambda m: F.struct(clean_html(x["inner"]).alias("text"), *(given(m, n) for n in ("href", "onclick", "class", "id"))))
    return F.array_distinct(F.filter(F.transform(pairs, item), lambda x: x["text"] != ""))


def attribute(tag: Column, name: str) -> Column:
    """One attribute's value; empty if not given."""
    return F.coalesce(F.element_at(attributes(tag), name), F.lit(""))


def onclicks(html: Column) -> Column:
    raw = F.concat(found(html, ONCLICK_DOUBLE, 1), found(html, ONCLICK_SINGLE, 1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def data_attributes(html: Column) -> Column:
    return F.array_distinct(F.transform(found(html, DATA_ATTRIBUTE), lambda x: F.replace(x, F.lit('"'), F.lit(""))))


def include_paths(text: Column) -> Column:
    return found_once(text, INCLUDED, 1)


def parameters(raw: Column) -> Column:
    """``a=1&b`` as a map; without ``=`` the value is empty; of repeated keys the last."""
    chunks = F.filter(F.transform(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("&amp;"), F.lit("&")), "[&?]"), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.filter(F.transform(chunks, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.when(x.contains("="), F.trim(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v"))), lambda x: x["k"] != "")
    return last_entries(entries)


def actions(text: Column) -> Column:
    """``action=Class.method&k=v``: array of class, method, params, backend; distinct regardless of case."""
    p = ACTION
    rows = F.arrays_zip(found(text, p, 1).alias("c"), found(text, p, 2).alias("m"), found(text, p, 3).alias("r"))
    first = first_by(rows, lambda x: F.lower(F.concat_ws("|", x["c"], x["m"], x["r"])))
    return F.transform(first, lambda x: F.struct(x["c"].alias("class"), x["m"].alias("method"), parameters(x["r"]).alias("params"), F.concat(x["c"], F.lit("CTR::"), x["m"], F.lit("()")).alias("backend")))


def endpoints(text: Column) -> Column:
    raw = F.concat(found(text, ACTION_TEXT, 1), found(text, URL_FIELD, 1), found(text, GET_POST, 1), found(text, FETCH, 1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def ajax_kinds(text: Column) -> Column:
    """How often each kind of call to a server occurs, as a map of those that do."""
    all_ = F.create_map(*(x for k, p in AJAX.items() for x in (F.lit(k), F.size(found(text, "(?i)" + p)))))
    return F.map_filter(all_, lambda _, n: n > 0)


def js_call(onclick: Column) -> Column:
    """function and args (split at commas outside quotes and parentheses) of the first call."""
    p = r"(?s)([a-zA-Z0-9_$.]+)\s*\((.*)\)"
    return F.struct(F.nullif(F.regexp_extract(F.coalesce(onclick, F.lit("")), p, 1), F.lit("")).alias("function"), js_arguments(F.regexp_extract(F.coalesce(onclick, F.lit("")), p, 2)).alias("args"))


def dynamic_loads(text: Column) -> Column:
    """Distinct endpoint and target of ``recuperaConteudoDinamico(_, endpoint, target)``."""
    p = r"""(?is)recuperaConteudoDinamico\s*\(\s*[^,]*?\s*,\s*('(?:\\'|[^'])*'|"(?:\\"|[^"])*"|[^,]+)\s*,\s*('(?:\\'|[^'])*'|"(?:\\"|[^"])*"|[^,)]+)"""
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^(['"])(.*)\1$""", "$2")
    pairs = F.arrays_zip(found(text, p, 1).alias("e"), found(text, p, 2).alias("t"))
    return F.array_distinct(F.transform(pairs, lambda x: F.struct(bare(x["e"]).alias("endpoint"), bare(x["t"]).alias("target"))))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def priority(css_class: Column, label: Column) -> Column:
    raw = F.lower(F.concat_ws(" ", css_class, label))
    return F.when(_any(raw, HIGH), "high").when(_any(raw, MEDIUM), "medium").otherwise("normal")


def semantic_hint(label: Column, onclick: Column) -> Column:
    raw = F.lower(F.concat_ws(" ", label, onclick))
    return (
        F.when(raw.contains("repasse") & raw.contains("remanejamento"), "detalhamento_repasse_remanejamento")
        .when(raw.contains("decreto"), "detalhamento_decreto")
        .when(raw.contains("detalhamento"), "detalhamento_generico")
        .when(raw.contains("mostraritensdetalhamento"), "funcao_js_detalhamento")
    )


def js_behaviour(onclick: Column) -> Column:
    raw = F.lower(F.coalesce(onclick, F.lit("")))
    return (
        F.when(_any(raw, ("action=", "recuperaconteudodinamico", "$.ajax")), "backend_trigger")
        .when(_any(raw, ("show(", "hide(", "style.display", ".text(", "#tab")), "dom_toggle")
        .when(raw.contains("datatable"), "datatable_init")
        .otherwise("unknown")
    )


def clickables(html: Column) -> Column:
    """Distinct elements that can be clicked: anchors with a text, buttons among inputs, other tags with onclick.
    Array of element, label, href, onclick, class, id."""
    get = lambda m, n: F.coalesce(F.element_at(m, n), F.lit(""))
    item = lambda kind, label, m: F.struct(F.lit(kind).alias("element"), label.alias("label"), *(get(m, n).alias(n) for n in ("href", "onclick", "class", "id")))
    read = lambda tags, inner: F.transform(F.arrays_zip(tags.alias("t"), inner.alias("i")), lambda x: F.struct(attributes(x["t"]).alias("m"), clean_html(x["i"]).alias("i")))
    anchors = F.transform(read(found(html, LINK, 1), found(html, LINK, 2)), lambda x: item("a", x["i"], x["m"]))
    fields = F.filter(F.transform(found(html, INPUT, 1), attributes), lambda m: F.lower(get(m, "type")).isin("button", "submit", "image"))
    inputs = F.transform(fields, lambda m: item("input", F.trim(F.coalesce(F.nullif(get(m, "value"), F.lit("")), get(m, "title"))), m))
    clicked = F.filter(read(found(html, GENERIC, 2), found(html, GENERIC, 3)), lambda x: F.trim(get(x["m"], "onclick")) != "")
    others = F.transform(clicked, lambda x: item("generic", x["i"], x["m"]))
    return F.array_distinct(F.filter(F.concat(anchors, inputs, others), lambda x: x["label"] != ""))


def parse_action_url(raw: Column) -> Column:
    """query, action, class, method, params (array of key, value, distinct, in order) of a URL or query text.

    The text is percent-decoded first; the query starts at the last ``action=``. Text that can't be decoded is
    taken as it is.
    """
    decoded = F.coalesce(F.try_url_decode(F.trim(raw)), F.trim(raw), F.lit(""))
    query = F.when(decoded.contains("action="), F.concat(F.lit("action="), F.element_at(F.split(decoded, "action="), -1))).otherwise(F.regexp_replace(decoded, r"^[^?]*\?", ""))
    pairs = F.filter(F.transform(F.split(query, "&"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("value"))), lambda x: x["key"] != "")
    text = lambda v: F.coalesce(F.try_url_decode(v), v)
    action = F.coalesce(text(F.get(F.filter(pairs, lambda x: x["key"] == "action"), F.lit(0))["value"]), F.lit(""))
    params = F.array_distinct(F.transform(F.filter(pairs, lambda x: x["key"] != "action"), lambda x: F.struct(x["key"].alias("key"), text(x["value"]).alias("value"))))
    dotted = action.contains(".")
    return F.struct(
        query.alias("query"),
        action.alias("action"),
        F.when(dotted, F.trim(F.substring_index(action, ".", 1))).otherwise("").alias("class"),
        F.trim(F.when(dotted, F.regexp_replace(action, r"^[^.]*\.", "")).otherwise(action)).alias("method"),
        params.alias("params"),
    )


def script_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, block (from 1), attrs, src (null if inline), body, start_line of every script element."""
    p = SCRIPT
    text = F.coalesce(F.col(html), F.lit(""))
    parts = F.arrays_zip(found(text, p, 1).alias("attrs"), found(text, p, 2).alias("body"), found(text, p, 0).alias("all"))
    gaps = F.split(text, p, -1)
    rows = pages.select(key, gaps.alias("gaps"), parts.alias("parts"), F.posexplode(parts).alias("p", "s"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda n, x: n + breaks(x))
    line = total(F.slice("gaps", 1, F.col("p") + 1)) + total(F.slice(F.transform("parts", lambda x: x["all"]), 1, F.col("p"))) + 1
    return rows.select(key, (F.col("p") + 1).alias("block"), F.trim("s.attrs").alias("attrs"), F.nullif(F.regexp_extract("s.attrs", SCRIPT_SRC, 1), F.lit("")).alias("src"), "s.body", line.alias("start_line"))


def js_constants(script: Column) -> Column:
    """const declarations: array of name, kind (string or expression), value; a string wins over an expression."""
    pairs = lambda p, v: F.arrays_zip(found(script, p, 1).alias("n"), found(script, p, v).alias("v"))
    item = lambda kind: lambda x: F.struct(x["n"].alias("name"), F.lit(kind).alias("kind"), F.trim(x["v"]).alias("value"))
    rest = lambda strings: F.filter(pairs(CONST_ANY, 2), lambda x: ~F.exists(strings, lambda y: y["name"] == x["n"]))
    return let(F.transform(pairs(CONST_STRING, 3), item("string")), lambda strings: F.concat(strings, F.transform(rest(strings), item("expression"))))


js_functions = blocks(r"\bfunction\s+[A-Za-z_$][A-Za-z0-9_$]*\s*\([^)]*\)\s*\{", aware=False)
jquery_events = blocks(r"""(?is)\$\s*\(\s*[^)]+\s*\)\s*\.\s*on\s*\(\s*["'][a-zA-Z]+["']\s*,\s*["'][^"']+["']\s*,\s*function\s*\(.*?\)\s*\{""", aware=False)
ajax_calls = blocks(r"(?i)\$\s*\.ajax\s*\(\s*\{", aware=False)
swal_calls = blocks(r"(?i)\bSwal\s*\.\s*fire\s*\(\s*\{", aware=False)
js_objects = blocks(r"(?:\b(?:const|let|var)\s+)?[A-Za-z_$][A-Za-z0-9_$]*\s*(?:=|:)\s*\{", aware=False)
callbacks = blocks(r"(?is)\.(?:done|fail|always)\s*\(\s*function\s*\(.*?\)\s*\{", aware=False)


def object_field(text: Column, name: str) -> Column:
    """A field of an object's text: what its quotes hold if it is a string anywhere, else what runs to the next comma,
    line end or brace; null if there is none."""
    string = F.regexp_extract(text, rf"""(?is)\b{name}\s*:\s*(["'])(.*?)\1""", 2)
    has_string = text.rlike(rf"""(?is)\b{name}\s*:\s*(["'])(.*?)\1""")
    plain = F.regexp_extract(text, rf"(?i)\b{name}\s*:\s*([^,\n}}]+)", 1)
    return F.when(has_string, F.trim(string)).otherwise(F.nullif(F.trim(plain), F.lit("")))


def ajax_fields(call: Column) -> Column:
    """url, method (or type), data, dataType, timeout, processData, contentType of one ajax call's text, and its object
    as raw."""
    others = (object_field(call, n).alias(n) for n in ("data", "dataType", "timeout", "processData", "contentType"))
    method = F.coalesce(F.nullif(object_field(call, "method"), F.lit("")), object_field(call, "type"))
    return F.struct(object_field(call, "url").alias("url"), method.alias("method"), *others, F.regexp_replace(call, r"^[^{]*", "").alias("raw"))


def inline_events(html: Column) -> Column:
    """Handlers in tags, all of each tag: array of tag, event, handler."""
    tags = F.arrays_zip(found(html, TAG_WHOLE, 1).alias("t"), found(html, TAG_WHOLE, 2).alias("a"))
    pairs = lambda a: F.arrays_zip(found(a, HANDLER, 1).alias("e"), found(a, HANDLER, 2).alias("h"))
    each = lambda x: F.transform(pairs(x["a"]), lambda y: F.struct(x["t"].alias("tag"), F.lower(y["e"]).alias("event"), F.trim(y["h"]).alias("handler")))
    return F.flatten(F.transform(tags, each))


def script_summary(script: Column) -> Column:
    """form_data, selectors, console, constants_url, steps of one script."""
    return F.struct(
        found_once(script, FORM_DATA, 1).alias("form_data"),
        found_once(script, SELECTOR, 2).alias("selectors"),
        found(script, CONSOLE, 1).alias("console"),
        found_once(script, URL_CONSTANT).alias("constants_url"),
        kept(*((script.contains(w), step) for w, step in STEPS)).alias("steps"),
    )


def script_endpoints(script: Column) -> Column:
    """What a script asks for, sorted: actions of classes, quoted ``url:`` fields, names of ``URL_`` constants, and values of
    constants that hold an action or the index page."""
    told = F.filter(js_constants(script), lambda c: c["value"].contains("action=") | c["value"].contains("index.php"))
    urls = F.transform(found(script, URL_FIELD, 1), lambda x: F.trim(x))
    return sorted_set(found(script, ACTION_OF_CLASS, 1), urls, found(script, "(?i)" + URL_CONSTANT), F.transform(told, lambda c: c["value"]))


def script_rollup(blocks_: DataFrame, key: str) -> DataFrame:
    """For each file: inline blocks, all blocks, sources of external scripts, server calls in all and by kind (those that
    occur), endpoints over all its blocks."""
    kinds = {f"__{i}": F.size(found(F.col("body"), "(?i)" + p)) for i, p in enumerate(AJAX.values())}
    counted = blocks_.withColumns({"__e": script_endpoints(F.col("body")), **kinds})
    calls = F.create_map(*(x for i, k in enumerate(AJAX) for x in (F.lit(k), F.sum(f"__{i}"))))
    grouped = counted.groupBy(key).agg(
        F.count_if(F.col("src").isNull()).alias("script_blocks"),
        F.count(F.lit(1)).alias("script_blocks_total"),
        F.array_sort(F.collect_set("src")).alias("external_scripts"),
        F.map_filter(calls, lambda _, n: n > 0).alias("calls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__e")))).alias("endpoints"),
    )
    return grouped.withColumn("calls_total", F.aggregate(F.map_values("calls"), F.lit(0).cast("long"), lambda n, x: n + x))


def tag_count(html: Column) -> Column:
    return F.size(found(html, TAG))


def page_summary(html: Column) -> Column:
    """functions, classes, scripts, styles, includes, tags, ajax, endpoints, actions of one file."""
    return F.struct(
        found_once(html, FUNCTION, 1).alias("functions"),
        found_once(html, CLASS, 1).alias("classes"),
        found_once(html, SCRIPT_FILE, 1).alias("scripts"),
        found_once(html, STYLE_FILE, 1).alias("styles"),
        include_paths(html).alias("includes"),
        tag_count(html).alias("tags"),
        ajax_kinds(html).alias("ajax"),
        endpoints(html).alias("endpoints"),
        sorted_set(found(html, ACTION_OF_CLASS, 1)).alias("actions"),
    )


# Parts of the paths of includes that are looked into.
RELEVANT_INCLUDES = ("modal_", "financeiro", "detalhe", "resultado", "consulta", "decreto", "encaminhamento")


def relevant_includes(files: DataFrame, base: str = "") -> DataFrame:
    """path, include, target, status, actions, endpoints of the included files that may matter, one level deep.

    An include is looked up from ``base``; one that isn't there has status ``não encontrado``. One join of paths
    with files, no recursion.
    """
    asked = exploded(files, include_paths(F.col("text")), "include", "path").where(_any(F.lower(F.trim("include")), RELEVANT_INCLUDES))
    asked = asked.withColumn("target", F.concat(F.lit(base), F.regexp_replace("include", r"^\./|^/", "")))
    known = files.select(F.col("path").alias("target"), actions(F.col("text")).alias("actions"), endpoints(F.col("text")).alias("endpoints"))
    joined = asked.join(known, "target", "left")
    return joined.select("path", "include", "target", F.when(F.col("actions").isNull(), "não encontrado").otherwise("ok").alias("status"), "actions", "endpoints")


def sql_lines(files: DataFrame, most: int = SQL_LINES) -> DataFrame:
    """path, line_no, kind, text: lines that hold SQL, white space collapsed, distinct by kind and text, the first
    ``most`` of each file. All within a file's own row."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    all_ = F.transform(text_lines(F.coalesce("text", F.lit(""))), lambda x, i: F.struct((i + 1).alias("line_no"), sql_line_kind(x).alias("kind"), plain(x).alias("text")))
    held = files.select("path", F.filter(all_, lambda x: x["kind"].isNotNull() & (x["text"] != "")).alias("held"))
    once = held.select("path", first_by(F.col("held"), lambda x: F.struct(x["kind"], x["text"])).alias("held"))
    return exploded(once, F.slice("held", 1, most), "h", "path").select("path", "h.*")


def looks_like_html(line: Column) -> Column:
    """Whether a trimmed line in lower case begins with a tag, or holds one with a common attribute."""
    starts = F.lit(False)
    for tag in HTML_STARTS:
        starts = starts | line.startswith(tag)
    return line.rlike(r"^</?[a-z][a-z0-9:_-]*\b") | (line.contains("<") & line.contains(">") & _any(line, HTML_ATTRIBUTES)) | starts


def looks_like_css(line: Column) -> Column:
    """Whether a trimmed line in lower case opens or closes a block, begins with a selector or names a property."""
    block = line.endswith("{") | (line == "}") | line.startswith(".") | line.startswith("#")
    return block | _any(line, CSS_PROPERTIES) | line.rlike(r"\bfrom\s*\{")


def sql_line_kind(line: Column) -> Column:
    """The first kind of SQL that a line holds; null for none and for lines of HTML or CSS. Comments and scripts count."""

    def kind(s: Column) -> Column:
        out = F.when(looks_like_html(s) | looks_like_css(s) | s.contains("<select") | s.contains("</select>"), F.lit(None).cast("string"))
        for name, pattern in SQL_KINDS:
            out = out.when(line.rlike(pattern), name)
        return out

    return let(F.lower(stripped(line)), kind)
