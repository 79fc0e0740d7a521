"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own, table
from .graph import components
from .vectors import by_length, matrix, valid_vectors

SIMILARITY = 0.9
#: Share of links of the sample, and of pairs planted at exactly the similarity, that have to meet in some tree, and
#: how many of the latter are planted. Trees are added until then; from ``TREES`` on, less depth is tried instead.
RECALL = 0.9999
PLANTED = 20_000
TREES = 64
#: Vectors that the splits are fitted on, and how many of all a leaf is to hold on average.
SAMPLE = 20_000
LEAF = 600
#: Half the width of the strip round a split that goes to both sides.
SPILL = 0.01
#: Levels beyond those of even splits; places of a split, in the order tried; share of a node's links a split may part.
SLACK = 3
PLACES = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9)
PARTED = 1 / 16
#: Vectors of a leaf that are compared in one go.
TILE = 2048
#: One link in so many pairs of a leaf, and leaves are compared for all pairs at once.
DENSE = 64


class Forest:
    """Trees of random splits of the unit sphere: a direction for each level of each tree, a threshold for each node.

    A node sends vectors whose projection is at most ``SPILL`` from its threshold to both sides. The threshold is
    the sample's median there or, where that parts more than ``PARTED`` of the node's links in the sample, the first
    other place that doesn't. If none does, a dense group fills the node, and all go left: it is split no further.
    Nor is a node that holds at most ``least`` of the sample. Leaves are numbered within a tree.
    """

    def __init__(self, sample: np.ndarray, depth: int, links: np.ndarray | None = None, least: float = 0, spill: float = SPILL, seed: int = 0):
        self.sample, self.depth, self.spill, self.least = sample, depth, spill, least
        self.links = np.zeros((0, 2), np.int64) if links is None else links
        self.rng = np.random.default_rng(seed)
        self.directions = np.zeros((0, max(1, depth), sample.shape[1]))
        self.thresholds = np.zeros((0, max(1, 2**depth - 1)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("sample", "links", "rng")}  # routing needs none of them

    def grow(self) -> None:
        """Add a tree."""
        directions = self.rng.normal(size=self.directions.shape[1:])
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        thresholds = np.full(self.thresholds.shape[1], np.inf)
        level = [(0, np.arange(len(self.sample)), np.arange(len(self.links)))]
        for k in range(self.depth):
            projected, below = self.sample @ directions[k], []
            for node, rows, links in level:
                if len(rows) <= max(1, self.least):
                    continue
                x, ends = projected[rows], projected[self.links[links]]
                for place in np.quantile(x, PLACES):
                    left, right = (ends <= place + self.spill).all(1), (ends >= place - self.spill).all(1)
                    if (~left & ~right).sum() <= PARTED * len(links):
                        thresholds[node] = place
                        below += [(2 * node + 1, rows[x <= place], links[left]), (2 * node + 2, rows[x > place], links[right])]
                        break
            level = below
        self.directions = np.concatenate([self.directions, directions[None]])
        self.thresholds = np.concatenate([self.thresholds, thresholds[None]])

    def _down(self, tree: int, *ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves of this tree that all ends of the row go to."""
        row, node = np.arange(len(ends[0])), np.zeros(len(ends[0]), np.int64)
        for level in range(self.depth):
            gaps = [(x @ self.directions[tree, level])[row] - self.thresholds[tree, node] for x in ends]
            left, right = np.all([g <= self.spill for g in gaps], 0), np.all([g >= -self.spill for g in gaps], 0)
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (2**self.depth - 1)

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the leaves of this tree that they go to; a row that spills has several."""
        return self._down(tree, x)

    def meet(self, x: np.ndarray, y: np.ndarray, tree: int) -> np.ndarray:
        """Which rows of x share a leaf of this tree with the same row of y."""
        out = np.zeros(len(x), bool)
        out[self._down(tree, x, y)[0]] = True
        return out


def _sample_links(x: np.ndarray, similarity: float, rng: np.random.Generator, most: int = 8) -> np.ndarray:
    """Pairs of places of linked vectors, up to ``most`` drawn for each vector, so that groups of any size have some."""
    found = [np.zeros((0, 2), np.int64)]
    for lo in range(0, len(x), 500):
        near = _near(x[lo : lo + 500], x, similarity)
        many = 4 * most / np.maximum(near.sum(1, keepdims=True), 1)
        if many.min() < 1:  # thinned first
            near &= rng.random(near.shape, np.float32) < many
        a, b = np.nonzero(near)
        a += lo
        keep = rng.permutation(np.flatnonzero(a != b))
        keep = keep[np.argsort(a[keep], kind="stable")]
        first = np.searchsorted(a[keep], a[keep])
        keep = keep[np.arange(len(keep)) - first < most]
        found.append(np.stack([a[keep], b[keep]], 1))
    return np.concatenate(found)


def _planted(x: np.ndarray, similarity: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, each with one at exactly this cosine in a random direction: the links easiest to lose."""
    x = x[rng.integers(len(x), size=PLANTED)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    return x, similarity * x + np.sqrt(max(0.0, 1 - similarity**2)) * away / np.where(norm > 0, norm, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_forest(vectors: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, similarity: float = SIMILARITY, recall: float = RECALL) -> Forest | None:
    """Splits fitted on about ``sample`` vectors, as deep as leaves of ``leaf`` of all vectors need.

    Trees are added until ``recall`` of the sample's links and of as many planted ones meet in one of them. If
    ``TREES`` are not enough, the trees get a level less; without any level all vectors meet. Leaves hold about
    ``leaf`` vectors up to sample x leaf vectors; beyond, they grow unless ``sample`` does.
    """
    count = vectors.count()
    if not count:
        return None
    limit = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 1.2 * sample / count) * (1 << 64)))
    some = vectors.where(F.xxhash64("embedding") <= F.lit(limit)).orderBy(F.xxhash64("embedding"), "vec_id").limit(sample)
    found = matrix(some.select("embedding").toArrow().column("embedding"))
    if not len(found):
        found = matrix(vectors.limit(sample).select("embedding").toArrow().column("embedding"))
    found = _unit(found)
    even = max(0, int(np.ceil(np.log2(count / leaf))))
    told = max(0, len(found).bit_length() - 1)  # more levels than the sample tells apart would be guesses
    return _grown(found, min(even + SLACK if even else 0, told), leaf * len(found) / count, similarity, recall)


def _grown(sample: np.ndarray, depth: int, least: float, similarity: float = SIMILARITY, recall: float = RECALL) -> Forest:
    """The trees of ``fit_forest`` over unit vectors; nodes of at most ``least`` of them are leaves."""
    rng = np.random.default_rng(1)
    links = _sample_links(sample, similarity, rng) if depth else np.zeros((0, 2), np.int64)
    near, far = _planted(sample, similarity, rng)
    tested = links[rng.permutation(len(links))[:PLANTED]]
    pairs = [(near, far), (sample[tested[:, 0]], sample[tested[:, 1]])]
    while True:
        forest = Forest(sample, depth, links, least)
        missed = [np.arange(len(x)) for x, _ in pairs]
        while len(forest.directions) < TREES:
            forest.grow()
            missed = [m[~forest.meet(x[m], y[m], len(forest.directions) - 1)] for m, (x, y) in zip(missed, pairs, strict=True)]
            if all(len(m) <= (1 - recall) * len(x) for m, (x, _) in zip(missed, pairs, strict=True)):
                return forest
        depth -= 1


def _near(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of x and y have at least this cosine, decided in double precision."""
    return x @ y.T >= similarity


def _shared_before(a: np.ndarray, b: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Whether two vectors share a leaf of an earlier tree, or one of this tree with a lower number.

    a, b: their leaves as tree << 32 | leaf, sorted, padded with -1 and -2.
    """
    here = tree << 32 | leaf
    out = np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        own = a[:, k]
        out |= (own >= 0) & (own < here) & (b == own[:, None]).any(1)
    return out


def _earlier(leaves: np.ndarray, here: int) -> np.ndarray:
    """A row for each vector, with ones at those of its leaves before ``here`` that others can share."""
    row, column = np.nonzero((leaves >= 0) & (leaves < here))
    names, place, times = np.unique(leaves[row, column], return_inverse=True, return_counts=True)
    out = np.zeros((len(leaves), len(names)), np.float32)
    out[row, place] = 1
    return out[:, times > 1]


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, forest: Forest | None = None) -> DataFrame:
    """Link vectors with a cosine of at least ``similarity`` and group them by links.

    Every vector goes to a leaf, or by spill several, of each tree; vectors that share one are compared, and links
    are those that pass in double precision. A pair that shares several leaves is counted in the first, which both
    vectors' lists of leaves tell, so numbers of links are added up and no pair leaves its task; for the components
    a leaf emits only as many links as connect it. A leaf with more than ``TILE`` vectors, say of one that a third
    of all are copies of, is cut into tiles, each pair of which is a group of its own. Equal vectors are compared
    once and counted as often as they occur.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself
    included) and kept (vec_id = component_id), one row per input row. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do vectors of different lengths with each other; a null
    vec_id stays alone with null component_id and kept false. Rows are told apart by their vectors, not by vec_id:
    rows repeated with one vec_id and vector link with each other, and one vec_id with several vectors is several
    rows with links of their own. An empty table gives no rows. Other columns are ignored.
    """
    mark = [F.xxhash64(F.lit(k), "embedding").alias(f"mark{k}") for k in (1, 2)]  # 128 bits name a vector
    every = own(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fits = lambda n: forest is not None and forest.directions.shape[2] == n
    labels = [_labels(vectors, similarity, forest if fits(n) else None) for n, vectors in by_length(valid_vectors(every))]
    marked = every.select("vec_id", *mark)
    if not labels:
        return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    joined = marked.join(reduce(DataFrame.unionByName, labels), ["mark1", "mark2"], "left")
    joined = joined.withColumn("n_links", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))))
    joined = joined.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")))
    return joined.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _labels(valid: DataFrame, similarity: float, forest: Forest | None) -> DataFrame:
    """mark1, mark2, n_links and component_id of each distinct vector. All are of one length."""
    mark = [F.xxhash64(F.lit(k), "embedding").alias(f"mark{k}") for k in (1, 2)]
    grouped = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # materialised, so a vector keeps the number that stands for it
    distinct = checkpointed(grouped.select(F.monotonically_increasing_id().alias("vec_id"), "least", "embedding", "copies", *mark))
    forest = forest or fit_forest(distinct, similarity=similarity)
    spark = valid.sparkSession
    shared = spark.sparkContext.broadcast(forest)
    kind = valid.schema["embedding"].dataType.simpleString()
    trees = len(forest.directions)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(matrix(batch.column(1)))
            rows, keys = [], []
            for t in range(trees):
                row, leaf = shared.value.leaves(x, t)
                rows.append(row)
                keys.append(t << 32 | leaf)
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            offsets = np.searchsorted(row, np.arange(len(x) + 1))
            leaves = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], leaves], ["vec_id", "embedding", "copies", "leaves"])

    routed = checkpointed(distinct.select("vec_id", "embedding", "copies").mapInArrow(route, f"vec_id long, embedding {kind}, copies long, leaves array<long>"))
    members = routed.withColumn("leaf", F.explode("leaves"))
    # of a leaf with n tiles each vector goes to the n pairs that its tile is in
    tiles = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiled = members.join(tiles, "leaf").withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = tiled.select("leaf", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "vec_id", "embedding", "copies", "leaves")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _unit(matrix(group.column("embedding")))[order]
        copies, tile = group.column("copies").to_numpy()[order], group.column("tile").to_numpy()[order]
        lists = group.column("leaves").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        starts = lists.offsets.to_numpy()
        width = np.diff(starts)
        leaves = np.full((len(ids), width.max()), -1, np.int64)
        place = np.arange(width.max()) < width[:, None]
        leaves[place] = lists.values.to_numpy()[starts[0] : starts[-1]]
        leaves = leaves[order]
        padded = np.where(leaves < 0, -2, leaves)
        leaf = group.column("leaf")[0].as_py()
        within = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        earlier = None
        for lo in range(0, len(ids), 512):
            near = _near(x[lo : lo + 512], x[lo:], similarity)
            a, b = np.nonzero(near)
            a, b = a + lo, b + lo
            fits = (a < b) & (within | (tile[a] != tile[b]))
            a, b = a[fits], b[fits]
            if len(a) * DENSE > near.size:  # so many links that all pairs at once are cheaper
                earlier = _earlier(leaves, leaf) if earlier is None else earlier
                first = (earlier[lo : lo + 512] @ earlier[lo:].T)[a - lo, b - lo] == 0
            else:
                first = ~_shared_before(leaves[a], padded[b], leaf >> 32, leaf & 0xFFFFFFFF)
            a1, b1 = a[first], b[first]
            np.add.at(links, a1, copies[b1])
            np.add.at(links, b1, copies[a1])
            while len(a):  # union by the smallest place
                p, q = label[a], label[b]
                apart = p != q
                a, b, p, q = a[apart], b[apart], p[apart], q[apart]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label[label] != label).any():
                    label = label[label]
        some = (links > 0) | (label != np.arange(len(ids)))
        return pa.table({"vec_id": ids[some], "root": ids[label[some]], "links": links[some]})

    found = checkpointed(pairs.groupBy("leaf", "low", "high").applyInArrow(compare, "vec_id long, root long, links long"))
    nodes = components(found.where(F.col("vec_id") != F.col("root")).select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    rooted = distinct.select("vec_id", "least", "copies", "mark1", "mark2").join(links, "vec_id", "left").join(nodes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("component", "vec_id"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    counted = rooted.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return counted.join(smallest, "root").select("mark1", "mark2", "n_links", "component_id")


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
