"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest. DataFrame functions only."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, shared_folder, stored, table

#: Space and the ASCII controls from tab to carriage return don't tell texts apart.
_SPACES = " \t\n\x0b\x0c\r"
#: A group of copies with more than this share of a batch's rows is joined by broadcast: there are fewer such groups than this.
HOT = 1000
BUCKETS = 64


class DigestIndex:
    """Digests of all texts let through so far, as a Parquet table at ``path`` in buckets by digest, each file sorted by it.

    A row is (digest, keep_id, points): SHA-256 of the normalised text, and doc_id and code points of the document that
    stays. Any session opens the same path with the same number of buckets; Spark keeps a name of it in
    its catalog. At 100 TB some 10^11 digests of 32 bytes call for about 20,000 buckets.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.name = "digests_" + re.sub(r"\W", "_", path)
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id {id_type}, points INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")

    def add(self, documents: DataFrame) -> DataFrame:
        """Deduplicate a batch in itself and against the index, append its new digests, and tell what became of each row.

        Texts are equal if they are after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts of the batch the row with the
        most code points in its text stays, then that with the smallest doc_id (null last), then an arbitrary but fixed one
        of rows that repeat both. A sort-merge anti-join on the digest finds the groups that the index doesn't hold; these are
        appended. Where it holds the text, the document of the index stays, and all of the batch go.

        Returns a row for each row of the batch: doc_id, keep_id, group_size (rows of the batch with this text), kept,
        known (the index held it), text_sha256. A null text is empty; empty texts are equal to each other. An
        empty batch gives no rows and appends none. Other columns are ignored, whatever their names. Copies are
        counted before the shuffle; the few groups that hold over 1/1000 of the rows are joined by broadcast.
        """
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        digest = F.unhex(F.sha2(F.translate(text, _SPACES, ""), 256))
        read = own(documents, "doc_id", "text").select("doc_id", text.alias("text"))
        # written once, so that row numbers are fixed and texts are read once
        rows = stored(read.select("doc_id", digest.alias("digest"), F.char_length("text").alias("points"), F.monotonically_increasing_id().alias("row")))
        first = F.struct((-F.col("points")).alias("order"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        groups = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first")))
        held = self.rows().select("digest", F.col("keep_id").alias("held_id"), F.lit(True).alias("known")).hint("merge")
        new = groups.join(held, "digest", "left_anti").withColumns({"held_id": F.lit(None).cast(rows.schema["doc_id"].dataType), "known": F.lit(False)})
        # told apart before anything is appended, so that what is returned doesn't read the index again
        groups = stored(new.unionByName(groups.join(held, "digest")))
        added = groups.where(~F.col("known")).select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.order")).alias("points"))
        added.repartition(self.buckets, "digest").write.insertInto(self.name)

        hot = groups.where(F.col("group_size") * HOT > rows.count())  # fewer than HOT of them, whatever the table
        told = rows.join(F.broadcast(hot), "digest")
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        told = told.unionByName(rest.join(groups, "digest"))
        return told.select(
            "doc_id",
            F.when(F.col("known"), F.col("held_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            "group_size",
            (~F.col("known") & (F.col("row") == F.col("first.row"))).alias("kept"),
            "known",
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def op13_dedup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = DigestIndex(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}", docs.schema["doc_id"].dataType.simpleString())
    try:
        return index.add(docs).drop("known")
    finally:
        index.forget()


OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""
