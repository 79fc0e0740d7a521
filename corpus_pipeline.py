"""A training corpus from ``documents``: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import checkpointed, remainder, shielded, table
from orrery.llm.langid import fit_languages, identify_languages
from orrery.llm.lines import dedup_lines
from orrery.llm.mixing import mix_sources
from orrery.llm.packing import pack_pieces, tokenize_pieces
from orrery.llm.simhash import simhash_components
from orrery.session import ship

#: A byte that a language never showed costs about 21 bits. A text over so many bits a byte under its best language
#: is made of such bytes; capitals throughout, which a language shows seldom, cost 7 to 13.
FOREIGN_BITS = 14.0


#: The columns that operators read; all others are out of their sight, so that no name can clash.
READ = ("doc_id", "text", "lang", "source")


def _shielded(docs: DataFrame) -> DataFrame:
    return shielded(docs, READ)[0]


def _back(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out``, made of ``_shielded(docs)``, with the columns of ``docs``; n_chars, where there is one, follows the text."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    _, inner, names = shielded(docs, READ)
    return out.select(*(length if c == "n_chars" else F.col(name) for c, name in zip(names, inner, strict=True))).toDF(*names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no learned language helps to code, go. A null ``lang`` is filled in.

    How sure the choice among languages is doesn't matter: short texts of a learned language stay.

    Without any labelled document nothing can be rejected, and all stay. Repeated rows are judged alike; columns of
    any name come through unchanged.
    """
    ship(spark)
    model = fit_languages(_shielded(docs).where(remainder("doc_id", 3) != 1))
    if not model.langs:
        return docs
    kept = identify_languages(_shielded(docs), model).where((F.col("lang_pred") != "und") & (F.col("bits") < FOREIGN_BITS))
    return _back(docs, kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out of the texts; every document stays.

    The first occurrence by doc_id (null first), document and line stays. Null texts stay null, empty texts and texts
    under three lines stay as they are, and long texts are cut whole. Rows that repeat doc_id and text are one document and are
    cut alike; an empty table gives no rows.
    """
    ship(spark)
    return _back(docs, dedup_lines(_shielded(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest doc_id, rows without any coming last.

    Rows of a group with one doc_id are told apart by a hash of all columns, so reruns keep the same one.
    """
    ship(spark)
    inner = _shielded(docs)
    values = [*inner.columns, *(F.col(c).isNull() for c in inner.columns)]  # hashes pass over nulls
    marked = inner.withColumns({f"mark{k}": F.xxhash64(F.lit(k), *values) for k in (1, 2)})  # 128 bits name a row
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark1", "mark2")
    found = simhash_components(marked.select(place.alias("doc_id"), "text")).where(F.col("doc_id") == F.col("component_id"))
    kept = found.select("component_id.mark1", "component_id.mark2").distinct()
    once = marked.join(kept, ["mark1", "mark2"], "left_semi").dropDuplicates(["mark1", "mark2"])
    return _back(docs, once)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    A text of any length counts by its words; null, empty and wordless texts have none and are taken by rate all the
    same. Null sources are one source, null ids are hashed as empty text. Rows that repeat doc_id and text are ranked among
    each other in one window (the stage before leaves none), and get the copies by rank. An empty table gives no rows.
    """
    ship(spark)
    alike = Window.partitionBy("uid1", "uid2").orderBy("uid1")  # rows that repeat both doc_id and text are exchangeable
    named = F.struct(F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text")
    keyed = _shielded(docs).withColumns({f"uid{k}": F.xxhash64(F.lit(k), named) for k in (1, 2)})
    copies = mix_sources(keyed, also=["uid1", "uid2"]).select("uid1", "uid2", "copies").withColumn("nth", F.row_number().over(alike))
    taken = keyed.withColumn("nth", F.row_number().over(alike)).join(copies.where(F.col("copies") > 0), ["uid1", "uid2", "nth"])
    return _back(docs, taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens.

    Null and empty texts are one piece of the end token; longer texts than a sequence are cut. Repeated rows and null ids
    are packed as documents of their own, ties in length in any order; an empty table gives no rows.
    """
    ship(spark)
    pieces = tokenize_pieces(docs)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Tokenizers and code lengths are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is materialised, as the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
