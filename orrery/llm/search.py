"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table
from .vectors import by_length, matrix, valid_vectors

NEAREST = 20
#: Vectors that the centroids are fitted on, and queries among them that the depth of search is set by.
SAMPLE = 20_000
CALIBRATION = 200
#: Centroids of a half at least and at most; there are more as soon as a cell would hold more than ``CELL`` entries on average.
CENTROIDS, MOST_CENTROIDS = 16, 256
CELL = 65_536
TARGET = 0.95
#: Entries and queries of a block that is compared in one go.
BLOCK = 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


class MultiIndex:
    """Centroids of the two halves of a vector; a cell is a pair of them, numbered first * k + second."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, target: float = TARGET, nearest: int = NEAREST, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.left = _kmeans(sample[:, : self.half], centroids, rng)
        self.right = _kmeans(sample[:, self.half :], centroids, rng)
        self.size = np.bincount(self.cells(sample), minlength=len(self.left) * len(self.right))
        self.share = self._calibrate(sample, target, nearest, rng)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.left) * len(self.right) + _nearest(x[:, self.half :], self.right)

    def _calibrate(self, sample: np.ndarray, target: float, nearest: int, rng: np.random.Generator) -> float:
        """Share of all entries that a query has to visit to find ``target`` of its nearest in the sample."""
        cell = self.cells(sample)
        depth = []
        for q in sample[rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)]:
            best = np.argsort(-(sample @ q), kind="stable")[: nearest + 1]
            place = np.empty(len(self.size), np.int64)
            order = np.fromiter(self.traverse(q), np.int64)
            place[order] = np.cumsum(self.size[order])
            depth.extend(place[cell[best]])
        return min(1.0, float(np.quantile(depth, target)) / len(sample))

    def traverse(self, query: np.ndarray) -> Iterator[int]:
        """All cells by falling sum of the inner products of the query's halves with the two centroids.

        The halves' centroids are each sorted; a heap holds the pairs whose two neighbours before them have been
        taken, so pairs come out in order of the sum without all of them being scored.
        """
        a, b = self.left @ query[: self.half], self.right @ query[self.half :]
        first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        x, y = (-a[first]).tolist(), (-b[second]).tolist()
        first, second = first.tolist(), second.tolist()
        heap, done, k = [(x[0] + y[0], 0, 0)], [0] * len(x), len(second)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield first[i] * k + second[j]
            done[i] = j + 1
            if i + 1 < len(x) and done[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < k and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))

    def visits(self, query: np.ndarray, population: np.ndarray, least: int) -> list[int]:
        """The cells to look into, from the best on, until enough entries have been seen. population: of each cell."""
        want = max(least, self.share * population.sum())
        out, seen = [], 0
        for cell in self.traverse(query):
            if population[cell]:
                out.append(cell)
                seen += population[cell]
                if seen >= want:
                    break
        return out


def centroids_for(count: int) -> int:
    """Centroids of each half for so many entries."""
    k = CENTROIDS
    while k < MOST_CENTROIDS and count > k * k * CELL:
        k *= 2
    return k


def fit_index(vectors: DataFrame, sample: int = SAMPLE, **options) -> MultiIndex | None:
    """Fit on about ``sample`` vectors, those with the least hash of vec_id; None if there are none."""
    count = vectors.count()
    if not count:
        return None
    limit = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 1.2 * sample / count) * (1 << 64)))
    some = vectors.where(F.xxhash64("vec_id") <= F.lit(limit)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    found = matrix(some.select("embedding").toArrow().column("embedding"))
    if not len(found):
        found = matrix(vectors.limit(sample).select("embedding").toArrow().column("embedding"))
    return MultiIndex(found, **{"centroids": centroids_for(count)} | options)


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame, nearest: int = NEAREST, index: MultiIndex | None = None) -> DataFrame:
    """The ``nearest`` rows of ``embeddings`` by inner product for each row of ``queries`` (both vec_id, embedding).

    Every vector is assigned to its cell. A query visits cells by summed score of their centroids until it has
    seen the share of all entries that held ``TARGET`` of the nearest of queries in the fitting sample. Visited
    entries are scored exactly in double precision on the original vectors. Cells are cut into blocks of about
    ``BLOCK`` entries and visits into blocks of as many queries, so a cell that holds a third of all rows is many
    tasks; a block gives at most ``nearest`` rows a query, and those are merged. Blocks are dealt by row, not by
    vec_id, so an id that many rows share is spread too, and equal rows of ``queries`` ask once.

    Returns query_id, rank (from 1), vec_id, score. A row is no candidate for a query with its own vec_id.
    Queries and candidates that are no valid vectors take no part (see ``valid_vectors``); vectors of each length
    are searched among themselves. Ties go to the smaller vec_id. A vec_id that several rows share, of queries or
    of candidates, counts once, with the largest inner product of any of its rows. Queries without candidates have
    no rows, nor has an empty table. Other columns are ignored.
    """
    every, asked = valid_vectors(embeddings), valid_vectors(queries)
    fits = lambda n: index is not None and index.left.shape[1] + index.right.shape[1] == n
    found = [_search(entries, asked.where(F.size("embedding") == n), nearest, index if fits(n) else fit_index(entries)) for n, entries in by_length(every)]
    if not found:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _ranked(reduce(DataFrame.unionByName, found), nearest)


def _search(entries: DataFrame, asked: DataFrame, nearest: int, index: MultiIndex) -> DataFrame:
    """The best ``nearest`` of each block for each query, unmerged. All vectors are of one length."""
    schema = "query_id long, vec_id long, score double"
    kind = entries.schema["embedding"].dataType.simpleString()
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.cells(matrix(batch.column(1)))
                place = np.arange(seen, seen + batch.num_rows)
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(place, pa.int64())], ["vec_id", "embedding", "cell", "place"])

    celled = checkpointed(entries.mapInArrow(assign, f"vec_id long, embedding {kind}, cell int, place long"))
    # materialised, so that a query keeps the mark that its visits are joined by
    asked = checkpointed(asked.dropDuplicates(["vec_id", "embedding"]).select("vec_id", "embedding", F.xxhash64("embedding").alias("mark")))
    population = np.zeros(len(index.size), np.int64)
    for cell, n in celled.groupBy("cell").count().collect():  # one row a cell
        population[cell] = n
    parts = np.maximum(1, -(-population // BLOCK))
    counts = spark.sparkContext.broadcast((population, parts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, _ = counts.value
        for batch in batches:
            for i, vector in enumerate(matrix(batch.column(1)) if batch.num_rows else []):
                cells = shared.value.visits(vector, sizes, 10 * nearest)
                row = pa.array([i] * len(cells), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(cells, pa.int32())], ["vec_id", "mark", "cell"])

    # a group is a block of a cell's entries with a block of the queries that visit the cell
    visits = checkpointed(asked.mapInArrow(visit, "vec_id long, mark long, cell int"))
    visitors = visits.groupBy("cell").count().withColumn("shares", F.ceil(F.col("count") / BLOCK).cast("int")).select("cell", "shares")
    # a row a cell, of which there are at most MOST_CENTROIDS squared
    visitors = visitors.join(F.broadcast(spark.createDataFrame([(c, int(p)) for c, p in enumerate(parts)], "cell int, blocks int")), "cell")
    here = visits.join(asked, ["vec_id", "mark"]).join(visitors, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id", "mark"), "shares").cast("int").alias("share"), "vec_id", "embedding", F.lit(True).alias("asks")
    )
    there = celled.join(visitors, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id", "place"), "blocks").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vec_id", "embedding", F.lit(False).alias("asks")
    )
    together = here.unionByName(there)

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        x, ids = matrix(group.column("embedding")), group.column("vec_id").to_numpy()
        return _best(x[asks], ids[asks], x[~asks], ids[~asks], nearest)

    return together.groupBy("cell", "part", "share").applyInArrow(compare, schema)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    """The best of all blocks: each id's largest score, then ranks; tasks pass on only ``nearest`` rows a query."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _best(queries: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, ids: np.ndarray, nearest: int) -> pa.Table:
    """The best ``nearest`` ids of a block for each of its queries, ties to the smaller id."""
    found = [[], [], []]
    order = np.argsort(ids, kind="stable")
    entries, ids = entries[order], ids[order]
    times = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # an id that repeats must not push others out
    keep = min((nearest + 1) * times, len(ids))
    for lo in range(0, len(queries) if len(ids) else 0, 512):
        q, own = queries[lo : lo + 512], query_ids[lo : lo + 512]
        score = np.where(ids == own[:, None], -np.inf, q @ entries.T)
        # everything that reaches the last place is kept, then cut by score and id
        last = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
        row, column = np.nonzero((score >= last[:, None]) & (score > -np.inf))
        if times > 1:
            by = np.lexsort((-score[row, column], ids[column], row))
            row, column = row[by], column[by]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[column[1:]] != ids[column[:-1]])])
            row, column = row[first], column[first]
        by = np.lexsort((ids[column], -score[row, column], row))
        row, column = row[by], column[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < nearest], column[place < nearest]
        for part, values in zip(found, (own[row], ids[column], np.einsum("ij,ij->i", q[row], entries[column])), strict=True):
            part.append(values)
    a, b, c = (np.concatenate(x) if x else np.zeros(0) for x in found)
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def op5_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
