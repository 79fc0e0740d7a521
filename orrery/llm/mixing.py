"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, hex_bits, own, table
from .ranks import rank_in_group

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: Sequence[int], budget_percent: int, most: int) -> DataFrame:
    """Words that each source is to give. ``sizes``: one row per ``key`` with ``source`` and ``source_size``.

    Sources by code point, null last, get the weights in turn and share ``budget_percent`` % of all words; none
    gives more than ``most`` times its size. Giving the excess to the rest by weight until none is above is the
    same as filling them to one level a unit of weight, so the full sources are a prefix in order of size by weight.
    One row per source is all that the two windows without a key hold.
    """
    everything = Window.partitionBy()
    in_turn = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("total_weight", F.sum("weight").over(everything))
    s = s.withColumn("caps_before", F.sum("cap").over(filling) - F.col("cap"))
    s = s.withColumn("weights_before", F.sum("weight").over(filling) - F.col("weight"))
    # all in hundredths of a word, so that the test for a full source is exact
    left = F.col("total") * budget_percent - F.col("caps_before") * 100
    s = s.withColumn("full", left * F.col("weight") >= F.col("cap") * 100 * (F.col("total_weight") - F.col("weights_before")))
    s = s.withColumn("given", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
    s = s.withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    level = (F.col("total") * budget_percent - F.col("given") * 100).cast("double") * F.col("weight") / (F.col("open_weight") * 100)
    return s.select("key", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def mix_sources(documents: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = 150, most: int = 2, seed: int = 0, also: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each document.

    A document of a source is expected target/source_size times. The documents of a source, ordered by size class
    (steps of 3 %), then a hash of doc_id, get these expectations prefix-summed; one offset in [0, 1) drawn from
    ``seed`` and the source is added, and a document is emitted once per integer that its step crosses. Size order
    keeps each source's words within about one document of the target.

    Returns doc_id, size, source_size, target, copies, taken (copies x size) and the columns named in ``also``
    (of any other names), one row per input row. Null or
    wordless texts have size 0; a source of size 0 has target 0. Null sources form a source of their own, null
    ids are hashed as an empty text. Repeated rows are separate documents; rows that tie in every key are alike,
    so which of them is emitted makes no difference to the result. An empty table gives no rows. Other columns
    are ignored.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    documents = own(documents, *dict.fromkeys(("doc_id", "source", "text", *also)))
    sized = checkpointed(documents.select("doc_id", "source", key.alias("key"), words.alias("size"), *(F.col(f"`{c}`").alias(f"also{k}") for k, c in enumerate(also))))
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, budget_percent, most)

    bits = (F.length(F.bin("size")) - 1).cast("int")  # sizes of 64 and more: the power of two and the next five bits
    steps = bits * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 6, 0))").bitwiseAND(F.lit(31)).cast("int")
    ordered = sized.drop("source").withColumn("class", F.when(F.col("size") < 64, F.col("size").cast("int")).otherwise(steps))
    ordered = ordered.withColumn("bucket", hex_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 3).cast("int"))
    ranked = rank_in_group(ordered, "key", "class", "bucket", ["size", "doc_id"], "rank").join(goal, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hex_bits(F.concat(F.lit(f"{seed}:"), F.col("key")), 8) / F.lit(4294967296.0)
    ranked = ranked.withColumn("rate", rate).withColumn("offset", offset)
    crossed = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(F.col(f"also{k}").alias(c) for k, c in enumerate(also)))


def op6_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight,
              source_size * 2 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight,
              sum(cap) OVER f - cap AS caps_before, sum(weight) OVER f - weight AS weights_before
       FROM s1 WINDOW f AS (ORDER BY cap / weight, key ROWS UNBOUNDED PRECEDING)),
s3 AS (SELECT *, (total * 150 - caps_before * 100) * weight >= cap * 100 * (total_weight - weights_before) AS is_full FROM s2),
s4 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS given,
              sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open_weight FROM s3),
s5 AS (SELECT key, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(total * 150 - given * 100 AS DOUBLE) * weight / CAST(open_weight * 100 AS DOUBLE) END AS target,
              CAST('0x' || substr(md5('0:' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s4),
c AS (SELECT *, CASE WHEN size < 64 THEN size
              ELSE (length(bin(size)) - 1) * 32 + ((size >> greatest(length(bin(size)) - 6, 0)) & 31) END AS class,
              CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS BIGINT) AS bucket FROM d),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY key ORDER BY class, bucket, size, doc_id) AS k
      FROM c JOIN s5 USING (key))
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate * k + u) - floor(rate * (k - 1) + u), 2) AS BIGINT) * size AS taken
FROM r
"""
