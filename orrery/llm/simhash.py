"""SimHash near-duplicates, linked through a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own, schema, table
from .graph import components

SHINGLE = 3
DISTANCE = 2
_SEED = 42
_FLUSH = 1 << 17
_FAN = 16
_PAIRS = 1 << 20


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: bit i is set if it is set in over half the shingles' hashes."""
    votes = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    owners: list[int] = []
    hashes: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.cumsum([0, *map(len, hashes[:-1])])
        np.add.at(votes, owners, np.add.reduceat(bits, cuts, axis=0, dtype=np.int32))

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            continue
        for lo in range(0, max(1, len(words) - shingle + 1), _FLUSH):
            part = words[lo : lo + _FLUSH + shingle - 1]
            grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
            own = np.array([digest(b" ".join(g), _SEED) for g in grams], np.uint64)
            owners.append(i)
            hashes.append(own)
            totals[i] += len(own)
            waiting += len(own)
            if waiting >= _FLUSH:
                flush()
                owners, hashes, waiting = [], [], 0
    if hashes:
        flush()
    return np.packbits(votes * 2 > totals[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _gray_rank(fingerprint: Column) -> Column:
    """Place of a fingerprint in the sequence of Gray codes, as a long that orders as the unsigned rank does."""
    rank = fingerprint
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def near_pairs(values: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places i < j whose fingerprints differ in at most ``distance`` bits, in chunks.

    ``values`` are in Gray order, so neighbours share most bits. Every 16 nodes have a node above them that
    holds the bit pattern which all of them share, and a mask of its bits. From the top down, two nodes whose
    shared patterns already differ in more bits than allowed are dropped with all that is below them.
    """
    levels = [(values, np.full(len(values), (1 << 64) - 1, np.uint64))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        cuts = np.arange(0, len(pattern), _FAN)
        ones = np.bitwise_and.reduceat(pattern & mask, cuts)
        zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
        levels.append((ones, ones | zeros))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[near], b[near]
        if not level:
            near = a < b
            if near.any():
                yield a[near], b[near]
            continue
        below = len(levels[level - 1][0])
        for lo in range(0, len(a), _PAIRS // _FAN**2):  # memory is bounded by the depth
            x, y = a[lo : lo + _PAIRS // _FAN**2], b[lo : lo + _PAIRS // _FAN**2]
            left = (x[:, None] * _FAN + np.arange(_FAN)).repeat(_FAN, axis=1).ravel()
            right = np.tile(y[:, None] * _FAN + np.arange(_FAN), (1, _FAN)).ravel()
            fits = (left < below) & (right < below) & (left <= right)
            stack.append((level - 1, left[fits], right[fits]))


def _joined(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that has a near one: itself, and one that stands for all it is linked with here."""
    label = np.arange(len(values))
    for a, b in near_pairs(values, distance):
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def _search(distance: int):
    """A function over rows (key, value) sorted by key and Gray rank: links within each key's group."""

    def emit(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(keys)))
        left, right = [], []
        for k in range(1, _FAN):  # groups of one node: every pair of places, all groups at once
            small = np.repeat(sizes <= _FAN, sizes)
            at = np.flatnonzero(small[:-k] & (keys[:-k] == keys[k:])) if len(keys) > k else np.zeros(0, np.int64)
            if not len(at):
                break
            at = at[np.bitwise_count(values[at] ^ values[at + k]) <= distance]
            left.append(values[at + k])
            right.append(values[at])
        for start, size in zip(cuts[sizes > _FAN], sizes[sizes > _FAN], strict=True):
            a, b = _joined(values[start : start + size], distance)
            left.append(a)
            right.append(b)
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])
            if last:
                waiting.append((keys[:last], values[:last]))
                yield emit(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting = []
            elif waiting and waiting[-1][0][-1] != keys[0]:
                yield emit(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting = []
            waiting.append((keys[last:], values[last:]))
        if waiting:
            yield emit(*map(np.concatenate, zip(*waiting, strict=True)))

    return search


def hamming_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all within ``distance`` bits.

    The 64 bits fall into distance + 4 blocks. Two near fingerprints agree in at least four of them, so they
    meet in a group for each choice of four equal blocks; with 2 bits that is 15 groups each, and as the other
    two blocks have 22 bits, a group holds at most 2^22 distinct fingerprints. Groups are streamed in Gray order
    through the index; of a group's links only enough are emitted to connect it, fewer than it has members.
    """
    blocks = distance + 4
    limits = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(limits, limits[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(sum(c))))) for k, c in enumerate(combinations(masks, 4))]
    grouped = prints.select(F.explode(F.array(*keys)).alias("key"), "fp")
    parted = grouped.repartition("key").select("key", "fp").sortWithinPartitions("key", _gray_rank(F.col("fp")))
    return parted.mapInArrow(_search(distance), "a long, b long")


def simhash_components(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or over others, by ``distance`` or fewer bits.

    Texts are lower-cased in A-Z, split at ASCII white space, and hashed in runs of ``shingle`` words (the whole
    sequence if fewer) by XXH64 with seed 42; repeated shingles count again.

    Returns doc_id, fp (the fingerprint as a signed long), fingerprint (16 hex digits) and component_id, the
    smallest doc_id of its component, one row per input row. Texts that are null or without words have
    fingerprint zero, linked like any other. Null ids are never a component's smallest; a component without any
    id has null. Equal fingerprints are handled once, whatever the number of copies. An empty table gives no
    rows. Other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    read = own(documents, "doc_id", "text")
    prints = checkpointed(read.mapInArrow(score, schema(read.select("doc_id"), fp="long")))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(hamming_links(distinct, distance))
    rooted = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_components(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).drop("fp")
