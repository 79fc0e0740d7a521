"""Search for many terms at once, and an index for searches that come again."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import LINE_ENDS
from .rules import search

#: Terms that one search takes; they are sent to every executor.
MOST_TERMS = 100_000
GRAM = 3
#: Letters of texts whose trigrams a task of the index sorts at once; a longer text is taken by itself.
LETTERS = 1 << 20
_ENDS = re.compile(LINE_ENDS)
_AUTOMATA: dict = {}


def _automaton(terms: tuple[str, ...]):
    """All terms in one Aho-Corasick automaton, made once a worker."""
    import ahocorasick

    if terms not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            made.add_word(term, k)
        made.make_automaton()
        _AUTOMATA[terms] = made
    return _AUTOMATA[terms]


def line_hits(text: str, terms: tuple[str, ...], fold: bool) -> list[tuple[int, str, list[int]]]:
    """Number (from 1), text and terms (places, rising) of every line that holds a term; the text is read once."""
    lines = text.splitlines()
    folded = [x.lower() for x in lines] if fold else lines
    begin, at = [], 0
    for x in folded:
        begin.append(at)
        at += len(x) + 1
    found: dict[int, set[int]] = {}
    for end, k in _automaton(terms).iter("\n".join(folded)) if terms else ():
        found.setdefault(bisect_right(begin, end) - 1, set()).add(k)
    return [(i + 1, lines[i], sorted(found[i])) for i in sorted(found)]


def _terms(terms: DataFrame | Sequence[str], fold: bool) -> list[str]:
    listed = [r[0] for r in terms.select("term").where("term IS NOT NULL").distinct().limit(MOST_TERMS + 1).collect()] if isinstance(terms, DataFrame) else list(dict.fromkeys(terms))
    if len(listed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: search for them in parts")
    return sorted({t.lower() if fold else t for t in listed if t and not _ENDS.search(t)})


def search_terms(files: DataFrame, terms: DataFrame | Sequence[str], ignore_case: bool = True, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, line, terms (sorted, distinct): the lines that hold any of up to ``MOST_TERMS`` terms, and which.

    All terms are one automaton, so a text is read once whatever their number. terms: a sequence, or a DataFrame with a
    column ``term``. Empty terms and those with a line end are in no line. ignore_case: terms are told in lower case.
    Null and empty texts have no lines; an empty table gives no rows. A map over rows.
    """
    known = tuple(_terms(terms, ignore_case))
    shared = files.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows, number, line, told = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                for no, found, which in line_hits(value.as_py() or "", own, ignore_case):
                    rows.append(i)
                    number.append(no)
                    line.append(found)
                    told.append([own[k] for k in which])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(line, pa.string()), pa.array(told, pa.list_(pa.string()))], ["path", "line_no", "line", "terms"]
            )

    read = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    kind = T.StructType([read.schema["path"], T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    return read.mapInArrow(run, kind)


def locate_methods(files: DataFrame, methods: Sequence[str]) -> DataFrame:
    """method, path: for each method the first path, in order, of a file that holds ``function <method>(``."""
    hits = search_terms(files, [f"function {m}(" for m in methods], ignore_case=False)
    each = hits.select("path", F.explode("terms").alias("t"))
    return each.select(F.regexp_extract("t", r"^function (.*)\($", 1).alias("method"), "path").groupBy("method").agg(F.min("path").alias("path"))


def _bucket(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % buckets


def _grams(text: str) -> set[str]:
    low = text.lower()
    return {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}


def posted(paths: list, texts: list[str], buckets: int) -> pa.RecordBatch:
    """bucket, gram, paths: a row for each trigram of the texts, in lower case, with the paths that hold it.

    All places are sorted by trigram at once, three letters of 21 bits in a number; those over the end of a text go.
    """
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    inside = owner[: max(0, len(owner) - 2)] == owner[2:]
    keys = (letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[inside]
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[: len(inside)][inside][order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    once = first.copy()
    once[1:] |= owner[1:] != owner[:-1]
    keys, owner, starts = keys[once], owner[once], np.flatnonzero(first[once])
    told = keys[starts]
    spelled = np.stack([told >> 42, told >> 21 & 0x1FFFFF, told & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    grams = [spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)]
    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(paths, pa.string()).take(pa.array(owner)))
    return pa.RecordBatch.from_arrays([pa.array([_bucket(g, buckets) for g in grams], pa.int32()), pa.array(grams, pa.string()), listed], ["bucket", "gram", "paths"])


class TermIndex:
    """Postings of the trigrams of all files, and the files themselves, as Parquet under ``folder``.

    ``postings`` has (gram, paths), a row for each trigram of some hundreds of files, in folders by a hash of the gram, sorted by it; ``texts`` has (path, text) in folders by a hash of
    the path. A search reads the folders of its term's trigrams, of these the row groups that can hold them, then the
    folders of the files that hold them all, and looks at their lines. A path names one file.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def add(self, files: DataFrame) -> None:
        """Append files (path, text). Common trigrams are split over tasks by the writer's rebalancing."""
        buckets = self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths, texts, n = [], [], 0
            for batch in batches:
                for path, text in zip(*batch.columns, strict=True):
                    low = (text.as_py() or "").lower()
                    if texts and n + len(low) > LETTERS:
                        yield posted(paths, texts, buckets)
                        paths, texts, n = [], [], 0
                    paths.append(path.as_py())
                    texts.append(low)
                    n += len(low)
            if texts:
                yield posted(paths, texts, buckets)

        read = files.select(F.col("path").cast("string").alias("path"), "text")
        postings = read.mapInArrow(run, "bucket int, gram string, paths array<string>")
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/postings")
        shard = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
        texts = read.withColumn("shard", shard)
        texts.hint("rebalance", "shard").sortWithinPartitions("shard", "path").write.mode("append").partitionBy("shard").parquet(f"{self.folder}/texts")

    def candidates(self, term: str) -> DataFrame | None:
        """path of the files that hold all trigrams of the term; None if it is too short to have any."""
        grams = sorted(_grams(term))
        if not grams:
            return None
        postings = self.spark.read.schema("gram string, paths array<string>, bucket int").parquet(f"{self.folder}/postings")
        wanted = postings.where(F.col("bucket").isin(sorted({_bucket(g, self.buckets) for g in grams})) & F.col("gram").isin(grams))
        return wanted.select("gram", F.explode("paths").alias("path")).groupBy("path").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("path")

    def texts(self, term: str) -> DataFrame:
        """path and text of the files that may hold the term; of the folders only those that have any are read."""
        texts = self.spark.read.schema("path string, text string, shard int").parquet(f"{self.folder}/texts")
        found = self.candidates(term)
        if found is None:
            return texts.drop("shard")
        shards = [r[0] for r in found.select(F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most ``buckets``
        return texts.where(F.col("shard").isin(shards)).join(found, "path", "left_semi").drop("shard")

    def search(self, term: str, context: int = 2, ignore_case: bool = True) -> DataFrame:
        """As ``rules.search`` over all files of the index."""
        return search(self.texts(term), term, context, ignore_case)
