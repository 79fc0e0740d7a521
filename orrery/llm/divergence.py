"""Audit of how far sources of a language diverge, term by term, by inclusion-exclusion over their supports."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, stored, table

LEAST_DOCUMENTS = 10
TERM_RANKS = 10
#: Prices are out of this.
SCALE = 1_000_000_000
#: A worker hands its counts on once it holds so many terms.
HELD = 200_000
#: Letters, lower-cased if A-Z, and all bytes of other characters; the rest parts terms.
_TERMS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]  # the row without a term says that the group occurs
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(docs[t] for t in n)]]
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            n, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            words = text.as_py().translate(_TERMS).split()
            held -= len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n)
            if held >= HELD:
                yield from counted()
                held = 0
    yield from counted()


def term_counts(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, total, head: how often each kept term occurs in a source, and in its language.

    One row a language and kept term is its ``head``. A further row of each (lang, source) has a null term.
    Workers count before the one shuffle, by (lang, term), so a frequent word is a row a task and source there.
    """
    read = own(documents, "lang", "source", "text").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = read.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    # all of a term's sources meet in one place, which serves the window too
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    known = summed.withColumns({"total": F.sum("n").over(of_term), "df": F.sum("docs").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    kept = known.where(F.col("term").isNull() | (F.col("df") >= least_documents))
    return kept.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", (F.col("nth") == 1).alias("head"))


def _price(count: Column | str, everything: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE (count + 2) / (everything + 2 terms)); null without terms. Decimals, so that no count overflows."""
    count, everything, terms = (F.col(c) if isinstance(c, str) else c for c in (count, everything, terms))
    of = F.when(terms > 0, everything + 2 * terms).cast("decimal(20,0)")
    of_scale = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", of_scale, of) + 1


def _parted(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)), for prices of at most SCALE + 1."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """How far each two sources of a language lie apart, and the terms that mark a source within its language.

    Terms are runs of ASCII letters and of characters outside ASCII, A-Z in lower case; a language keeps those in at
    least ``least_documents`` of its rows. For a pair of sources, the sum over all kept terms is taken apart: terms
    in neither support cost a constant, terms in one are priced by that source's histogram of counts, as if they were
    in no other, and a join of postings corrects the terms in both. So no source is ever spread over the terms
    that it lacks.

    Returns lang, source, part, item, value, rank: part ``pair`` has a row for each other source of the language,
    part ``term`` the ``term_ranks`` terms of a source with the greatest value among those that it has more often
    than the language. Null lang, source and text are read as empty. Texts may be empty or of any length. Every
    row is a document, so repeated rows count again. Ties rank by item in UTF-8. A language that keeps no term has pairs of
    value 0 and no terms; a source alone in its language has no pairs. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    counts = stored(term_counts(documents, least_documents))
    postings = counts.where(F.col("term").isNotNull())
    by_lang = postings.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("head").cast("long")).alias("v"))
    by_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("support"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "support", "lang_n", "v"]).withColumn("p0", _price(F.lit(0), "group_n", "v"))
    groups = stored(groups)  # a row for each source of each language

    priced = postings.join(groups, ["lang", "source"])
    priced = priced.select("lang", "source", "term", "p0", _price("n", "group_n", "v").alias("p"), _price("total", "lang_n", "v").alias("q"))

    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("p0").alias(f"{name}_p0"), F.col("support").alias(f"{name}_support"), "v")
    pairs = side("a").join(side("b").drop("v"), "lang").where(F.col("a") < F.col("b"))
    neither = (F.col("v") - F.col("a_support") - F.col("b_support")) * _parted("a_p0", "b_p0")
    constants = pairs.select("lang", "a", "b", F.coalesce(neither, F.lit(0)).alias("value"))

    histogram = priced.groupBy("lang", F.col("source").alias("one"), "p").agg(F.count(F.lit(1)).alias("terms"))
    ordered = pairs.select("lang", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("b_p0").alias("other_p0")), F.struct(F.col("b").alias("one"), F.col("a_p0").alias("other_p0")))).alias("o")).select("lang", "a", "b", "o.*")
    one_sided = histogram.join(ordered, ["lang", "one"]).select("lang", "a", "b", (F.col("terms") * _parted("p", "other_p0")).alias("value"))

    of = lambda name: priced.select("lang", "term", F.col("source").alias(name), F.col("p").alias(f"{name}_p"), F.col("p0").alias(f"{name}_p0"))
    both = of("a").join(of("b"), ["lang", "term"]).where(F.col("a") < F.col("b"))
    right = _parted("a_p", "b_p") - _parted("a_p", "b_p0") - _parted("a_p0", "b_p") + _parted("a_p0", "b_p0")
    overlaps = both.groupBy("lang", "a", "b").agg(F.sum(right).alias("value"))

    parts = constants.unionByName(one_sided.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(overlaps)
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair = summed.select("lang", "value", F.explode(ends).alias("end")).select("lang", "end.source", F.lit("pair").alias("part"), "end.item", "value")
    term = priced.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _parted("p", "q").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pair.withColumn("rank", place).unionByName(term.withColumn("rank", place).where(F.col("rank") <= term_ranks))


def op11_audit_sources(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT lang, source, row_number() OVER () AS doc, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM d),
t AS (SELECT lang, source, doc, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.total
         FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
gn AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY lang, source),
p AS (SELECT cell.lang, cell.source, cell.term, cell.n,
             1 + (1000000000::HUGEINT * (cell.n + 2)) // CAST(gn.n + 2 * v.v AS HUGEINT) AS p,
             1 + (1000000000::HUGEINT * (cell.total + 2)) // CAST(v.n + 2 * v.v AS HUGEINT) AS q
      FROM cell JOIN gn ON gn.lang = cell.lang AND gn.source = cell.source JOIN v ON v.lang = cell.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
          FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
