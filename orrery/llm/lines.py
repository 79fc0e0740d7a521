"""Line deduplication by overlapping windows of consecutive lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shielded, table

LINES = 3


def _covered(starts, n: int, width: int) -> list[bool]:
    covered, reach = [False] * n, 0
    for start in sorted(starts):
        for at in range(max(reach, start), start + width):
            covered[at] = True
        reach = max(reach, start + width)
    return covered


def dedup_lines(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """Remove later occurrences of repeated windows of ``lines`` consecutive lines.

    A line ends at ``\\n`` and is compared as it is. Every window of a document is hashed to 128 bits; of each
    window that occurs more than once, the first occurrence by (doc_id, document, line) stays, where documents of one
    doc_id are in the order of a hash of their text, and all lines that later occurrences cover go. Windows are judged on the input.

    Returns all columns of the input row with ``text`` cut down to the kept lines, then n_lines and n_removed
    (columns of these names in the input are replaced, in any case, all others come through unchanged). A null text has 0 lines and stays null; an empty text
    has one empty line. Texts under ``lines`` lines have no window and stay whole. Null ids come first in the
    order. Rows that repeat both doc_id and text are one document in this order, so they are cut alike; a
    window never counts as a repeat of itself. An empty table gives no rows.
    """
    inner, passed, names = shielded(documents, ("doc_id", "text"), ("n_lines", "n_removed"))
    named = F.struct(F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text")  # 128 bits name a document
    keyed = inner.withColumns({name: F.xxhash64(F.lit(k), named) for k, name in enumerate("uv")})
    split = keyed.select("u", "v", "doc_id", F.split("text", "\n", -1).alias("ls")).where(F.size("ls") >= lines)
    window = lambda i: F.slice("ls", i, lines)
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("ls") - (lines - 1)),
        lambda i: F.struct(F.xxhash64(F.lit(1), window(i)).alias("a"), F.xxhash64(F.lit(2), window(i)).alias("b")),
    )
    windows = split.select("u", "v", "doc_id", F.posexplode(hashed).alias("pos", "w"))
    windows = windows.select("u", "v", "pos", "w.a", "w.b", F.struct("doc_id", "u", "v", "pos").alias("at"))
    repeated = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = windows.join(repeated, ["a", "b"]).where(~F.col("at").eqNullSafe(F.col("first")))
    starts = later.groupBy("u", "v").agg(F.collect_set("pos").alias("starts"))

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in pairs:
            rows = []
            for text, at in zip(texts, starts, strict=True):
                if text is None or at is None:
                    rows.append((text, 0 if text is None else text.count("\n") + 1, 0))
                    continue
                own = text.split("\n")
                gone = _covered(at, len(own), lines)
                rows.append(("\n".join(x for x, g in zip(own, gone, strict=True) if not g), len(own), sum(gone)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    joined = keyed.join(starts, ["u", "v"], "left").withColumn("cut", cut("text", "starts"))
    kept = [F.col("cut.text") if c == "text" else F.col(c) for c in passed]
    return joined.select(*kept, "cut.n_lines", "cut.n_removed").toDF(*names, "n_lines", "n_removed")


def op1_dedup_lines(spark, sf_dir):
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.length("text").cast("long").alias("n_chars_kept"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
w AS (SELECT doc_id, pos, line,
             lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3
      FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS nth
      FROM w WHERE l3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM k, (SELECT unnest([0, 1, 2]) AS o) WHERE nth > 1),
kept AS (SELECT p.doc_id, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY p.pos), '') AS kept,
                count(*) AS n_lines, count(g.pos) AS n_removed
         FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT l.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(kept) AS kept_sha256, length(kept) AS n_chars_kept
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""
