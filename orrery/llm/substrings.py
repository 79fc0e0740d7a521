"""Substring deduplication: fixed-block anchors probed by every rolling window, hits extended by comparing words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, schema, shielded, table

WINDOW = 35
#: Bytes of text in a pack of documents; a longer document has a pack of its own.
PACK = 2 << 20
#: Hashes that a bucket is to hold on average, and the bytes of each that are sent beyond the bucket's own bits.
BUCKET_ROWS = 1 << 21
PROBE_BYTES, WINDOW_BYTES = 4, 6
#: Words whose hashes a worker keeps at hand.
CACHE = 500_000
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


class Words:
    """The words of several texts in a row. ``cuts``: where each text begins, and the end."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.words = [w for s in split for w in s]
        self.cuts = np.cumsum([0, *map(len, split)])

    def hashes(self, width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``width`` words inside one text, and their hashes of ``bits`` bits (from the top of 64)."""
        n = len(self.words)
        room = np.repeat(self.cuts[1:], np.diff(self.cuts)) - np.arange(n)
        starts = np.flatnonzero(room >= width)
        own = np.fromiter(map(_WORDS.__getitem__, self.words), np.uint64, n)
        parts = []
        inverse = pow(_BASE, -1, 1 << 64)
        for lo in range(0, n - width + 1, _SEGMENT):
            part = own[lo : lo + _SEGMENT + width - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _powers(_BASE, _SEGMENT + width)[: len(part)], out=sums[1:])
            parts.append(_mix((sums[width:] - sums[:-width]) * _powers(inverse, _SEGMENT + width)[: len(part) - width + 1]))
        every = np.concatenate(parts)[starts] if len(starts) else np.zeros(0, np.uint64)
        return starts, every & np.uint64((1 << 64) - (1 << 64 - bits))


def pack_documents(documents: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of about ``PACK`` bytes of text each: pack (an id), n (bytes), payload (compressed: ``columns``, then the text)."""
    names = [f"c{k}" for k in range(len(columns))] + ["text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = 0, TaskContext.get().partitionId() << 32
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), np.int64)
            lo = 0
            while lo < batch.num_rows:
                sums = np.cumsum(sizes[lo:])
                hi = lo + max(1, int(np.searchsorted(sums, PACK, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(lo, hi - lo))
                payload = codec.compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([int(sums[min(hi, batch.num_rows) - lo - 1])], pa.int64()), pa.array([payload], pa.binary())], ["pack", "n", "payload"])
                made += 1
                lo = hi

    read = documents.select(*(F.col(c).alias(n) for c, n in zip([*columns, "text"], names, strict=True)))
    return read.mapInArrow(pack, "pack long, n long, payload binary")


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all().combine_chunks().to_batches()[0]


def _texts(payload: bytes) -> Words:
    return Words([(t or "").encode() for t in unpack(payload).column("text").to_pylist()])


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _unzip(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """Equally long arrays of these kinds."""
    raw = zstandard.decompress(raw)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


class Entries:
    """The distinct hashes of one pack, dealt to buckets: what is sent, and what each answer means.

    ``order`` holds the distinct hashes by bucket and value; ``rows`` maps every occurrence to its place there.
    """

    def __init__(self, hashes: np.ndarray, buckets: int):
        self.order, self.first, self.rows, self.count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.bits = buckets.bit_length() - 1  # a bucket is named by the first bits, so hashes in order are in order of bucket too
        limits = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.cuts = np.concatenate([[0], np.searchsorted(self.order, limits), [len(self.order)]])

    def answers(self, found: list[dict]) -> np.ndarray:
        """For every occurrence, whether its hash was found to be repeated. found: a bitmap for each bucket."""
        hit = self.count > 1
        for x in found:
            lo, hi = self.cuts[x["bucket"]], self.cuts[x["bucket"] + 1]
            hit[lo:hi] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
        return hit[self.rows]

    def send(self, pack: int, width: int, marked: np.ndarray | None = None, at: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """A row for each bucket that has entries: of each hash the ``width`` bytes after the bucket's bits, with a bit (marked) or a place (at)."""
        full = [b for b in range(len(self.cuts) - 1) if self.cuts[b] < self.cuts[b + 1]]
        hashes, extra = [], []
        for b in full:
            lo, hi = self.cuts[b], self.cuts[b + 1]
            raw = (self.order[lo:hi] << np.uint64(self.bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
            hashes.append(raw.tobytes())
            extra.append(np.packbits(marked[lo:hi]).tobytes() if at is None else at[lo:hi].astype(np.uint32).tobytes())
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack] * len(full), pa.int64()), pa.array(hashes, pa.binary()), pa.array(extra, pa.binary())], ["bucket", "pack", "hashes", "extra"])


_SENT = "bucket int, pack long, hashes binary, extra binary"


def _values(part: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a bucket, and where each row's begin and end."""
    hashes = [np.frombuffer(h, np.uint8).reshape(-1, width) for h in part.column("hashes").to_pylist()]
    wide = np.zeros((sum(map(len, hashes)), 8), np.uint8)
    np.concatenate(hashes, out=wide[:, 8 - width :])
    return wide.view(">u8").ravel().astype(np.uint64), np.cumsum([0, *map(len, hashes)])


def _chained(values: np.ndarray) -> np.ndarray:
    """For each place that of the equal value before it, for the first of several that of the second; -1 if none is equal."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.full(len(values), -1)
    out[order[:-1][same]] = order[1:][same]
    out[order[1:][same]] = order[:-1][same]
    return out


def _hits(sent: DataFrame, width: int) -> DataFrame:
    """``found``, for each pack: in every bucket a bitmap of the hashes that two packs sent, at least one of them with its mark."""

    def meet(part: pa.Table) -> pa.Table:
        values, cuts = _values(part, width)
        marks = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(part.column("extra").to_pylist(), np.diff(cuts), strict=True)]
        _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        marked = np.bincount(inverse, np.concatenate(marks), len(count)) > 0
        hit = ((count > 1) & marked)[inverse]
        bits = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = pa.table({"bucket": part.column("bucket"), "pack": part.column("pack"), "bits": pa.array(bits, pa.binary())})
        return out.filter(pc.is_valid(out.column("bits")))

    met = sent.groupBy("bucket").applyInArrow(meet, "bucket int, pack long, bits binary")
    return met.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))


def _partners(sent: DataFrame, width: int) -> DataFrame:
    """For each pack and bucket: of every hash that other packs have too, its place here, one of those packs and its place there.

    Packs with equal hashes form a chain: each gets the one before it, the first gets the second. So however many
    packs share a passage, none is named by more than two others.
    """

    def meet(part: pa.Table) -> pa.Table:
        part = part.sort_by("pack")
        values, cuts = _values(part, width)
        packs = np.repeat(part.column("pack").to_numpy(), np.diff(cuts))
        place = np.frombuffer(b"".join(part.column("extra").to_pylist()), np.uint32).astype(np.int64)
        other = _chained(values)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = a + np.flatnonzero(other[a:b] >= 0)
            own = own[np.argsort(place[own])]
            to = other[own]
            out.append(_zip(np.diff(place[own], prepend=0).astype(np.uint32), packs[to], (place[to] - place[own]).astype(np.int32)) if len(own) else None)
        table = pa.table({"pack": part.column("pack"), "met": pa.array(out, pa.binary())})
        return table.filter(pc.is_valid(table.column("met")))

    return sent.groupBy("bucket").applyInArrow(meet, "pack long, met binary")


def _runs(own: np.ndarray, pack: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows whose partners follow each other too: first place, partner's pack and first place, number."""
    order = np.lexsort((there, pack, own))
    own, pack, there = own[order], pack[order], there[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1] + 1) | (pack[1:] != pack[:-1]) | (there[1:] != there[:-1] + 1)
    begin = np.flatnonzero(first)
    return own[begin], pack[begin], there[begin], np.diff(np.append(begin, len(own)))


def _equal(here: list[bytes], there: list[bytes], window: int) -> np.ndarray:
    """Which windows of two equally long runs of words are equal word by word."""
    n = len(here) - window + 1
    if here == there:
        return np.ones(n, bool)
    sums = np.cumsum([0, *(a == b for a, b in zip(here, there, strict=True))])
    return sums[window:] - sums[:n] == window


def _map_rows(rows: DataFrame, make: Callable[[dict], Iterator[pa.RecordBatch]], kind: str | T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from make(batch.slice(i, 1).to_pylist()[0])

    return rows.mapInArrow(run, kind)


def _gathered(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias("got"))


def _ranges(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return turns[::2], turns[1::2]


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Of n words, those that the windows at ``starts`` cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def dedup_substrings(documents: DataFrame, window: int = WINDOW, keep: list[str] | None = None, bits: int = 64) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose sequence also starts anywhere else.

    Words are runs of anything but ASCII white space. Blocks of (window + 1) // 2 words at multiples of that
    length are the reference index; every window holds one whole. All rolling windows of a block's length probe
    it: a hit is a probe that a reference block elsewhere has the hash of. Round hits, windows look for a partner
    of the same hash; partners that follow each other are one run, the maximal repeat round its hits, and its
    words are compared with the partner's own words. Only windows found equal word by word are removed. If a
    window's partner turns out to differ, all windows of its hash are grouped by their words instead, so hashes
    decide nothing. Windows are judged on the input.

    Documents travel in packs. A pack sends each distinct hash once to the bucket of its range, so a passage that
    a third of all documents hold counts once a pack, and as partners form chains, no pack is asked for a passage
    more than twice. No pair of occurrences beyond that is made.

    Returns the columns in ``keep`` (default: doc_id), then n_words, n_removed, text (the kept words joined by one
    space) and spans (covered [start, end) word ranges, merged), one row per input row; columns of these names in
    ``keep`` are replaced, in any case. Hashes have ``bits`` bits, on which the result doesn't depend.
    Null and empty texts have no words and an empty text. Repeated rows are documents of their own, so they
    repeat each other. Empty tables give no rows. Other columns are ignored.
    """
    made = ("n_words", "n_removed", "text", "spans")
    inner, passed, names = shielded(documents, ("text",), made, ["doc_id"] if keep is None else keep)
    return _dedup(inner, window, passed, False, bits).toDF(*names, *made)


def _dedup(documents: DataFrame, window: int, columns: list[str], digest: bool, bits: int = 64) -> DataFrame:
    block = (window + 1) // 2
    packs = checkpointed(pack_documents(documents, columns))
    n_bytes = packs.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(6, int(n_bytes // (6 * BUCKET_ROWS)).bit_length())  # about six bytes a word

    def send_probes(row: dict) -> Iterator[pa.RecordBatch]:
        texts = _texts(row["payload"])
        starts, hashes = texts.hashes(block, bits)
        entries = Entries(hashes, buckets)
        begin = np.repeat(texts.cuts[:-1], np.diff(texts.cuts))[starts]
        marked = np.zeros(len(entries.order), bool)
        marked[entries.rows[(starts - begin) % block == 0]] = True
        return entries.send(row["pack"], PROBE_BYTES, marked)

    def candidates(row: dict) -> Iterator[pa.RecordBatch]:
        """The spans of words whose every window holds a hit: where they begin in the pack, and their words."""
        texts = _texts(row["payload"])
        starts, hashes = texts.hashes(block, bits)
        hit = np.zeros(len(texts.words) + 1, np.int64)
        hit[starts + 1] = Entries(hashes, buckets).answers(row["found"] or [])
        sums = np.cumsum(hit)
        room = np.repeat(texts.cuts[1:], np.diff(texts.cuts)) - np.arange(len(texts.words))
        first = np.flatnonzero(room >= window)
        held = np.zeros(len(texts.words), bool)
        held[first] = sums[first + window - block + 1] > sums[first]
        own = np.repeat(np.arange(len(texts.cuts) - 1), np.diff(texts.cuts))
        begin, end = _ranges(held)
        cut = [np.flatnonzero(np.diff(own[a:b])) + a + 1 for a, b in zip(begin, end, strict=True)]  # windows of two texts can follow each other
        begin = np.sort(np.concatenate([begin, *cut]))
        end = np.sort(np.concatenate([end, *cut]))
        if len(begin):
            spans = b"\n".join(b" ".join(texts.words[a : b + window - 1]) for a, b in zip(begin.tolist(), end.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([row["pack"]], pa.int64()), pa.array([_zip(begin.astype(np.uint32))], pa.binary()), pa.array([zstandard.compress(spans, 3)], pa.binary())], ["pack", "begin", "spans"])

    def read(row: dict) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words of the spans, and place and hash of each window."""
        words = Words(zstandard.decompress(row["spans"]).split(b"\n"))
        return words, *words.hashes(window, bits)

    def send_windows(row: dict) -> Iterator[pa.RecordBatch]:
        _, starts, hashes = read(row)
        entries = Entries(hashes, buckets)
        return entries.send(row["pack"], WINDOW_BYTES, at=starts[entries.first])

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        own, packs_, there = [], [], []
        for x in row["got"]:
            a, b, c = _unzip(x["met"], "<u4", "<i8", "<i4")
            own.append(np.cumsum(a.astype(np.int64)))
            packs_.append(b)
            there.append(own[-1] + c)
        own, ref, there, n = _runs(*map(np.concatenate, (own, packs_, there)))
        order = np.argsort(ref, kind="stable")
        names, begin = np.unique(ref[order], return_index=True)
        for name, k in zip(names.tolist(), np.split(order, begin[1:]), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([row["pack"]], pa.int64()), pa.array([_zip(*(x[k].astype(np.uint32) for x in (own, there, n)))], pa.binary())], ["pack", "asks", "runs"])

    def answer(row: dict) -> Iterator[pa.RecordBatch]:
        words = Words(zstandard.decompress(row["spans"]).split(b"\n")).words
        for x in row["got"]:
            _, there, n = _unzip(x["runs"], "<u4", "<u4", "<u4")
            text = b"\n".join(b" ".join(words[a : a + k + window - 1]) for a, k in zip(there.tolist(), n.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x["asks"]], pa.int64()), pa.array([x["runs"]], pa.binary()), pa.array([zstandard.compress(text, 3)], pa.binary())], ["pack", "runs", "text"])

    def judge(row: dict) -> Iterator[pa.RecordBatch]:
        """Windows found equal to another one, as ranges of the pack's words; and places of those with partners, but none equal."""
        words, starts, hashes = read(row)
        met, equal = np.zeros(len(words.words), bool), np.zeros(len(words.words), bool)
        other = _chained(hashes)  # partners within the pack
        own, there = starts[other >= 0], starts[other[other >= 0]]
        for a, _, b, n in zip(*(x.tolist() for x in _runs(own, np.zeros(len(own), np.int64), there)), strict=True):
            met[a : a + n] = True
            equal[a : a + n] |= _equal(words.words[a : a + n + window - 1], words.words[b : b + n + window - 1], window)
        for x in row["got"] or []:
            own, _, many = _unzip(x["runs"], "<u4", "<u4", "<u4")
            for a, n, text in zip(own.tolist(), many.tolist(), zstandard.decompress(x["text"]).split(b"\n"), strict=True):
                met[a : a + n] = True
                equal[a : a + n] |= _equal(words.words[a : a + n + window - 1], text.split(b" "), window)
        failed = np.flatnonzero(met & ~equal)
        yield pa.RecordBatch.from_arrays([pa.array([row["pack"]], pa.int64()), pa.array([origin(row, words, np.flatnonzero(equal))], pa.binary()), pa.array([_zip(failed.astype(np.uint32)) if len(failed) else None], pa.binary())], ["pack", "gone", "failed"])

    def origin(row: dict, words: Words, at: np.ndarray) -> bytes:
        """The windows at these places of the spans, as ranges of the pack's words."""
        (begin,) = _unzip(row["begin"], "<u4")
        span = np.searchsorted(words.cuts, at, "right") - 1
        at = begin[span].astype(np.int64) + at - words.cuts[span]
        first, last = _ranges(_covered(at, int(at.max(initial=0)) + window, window)) if len(at) else (at, at)
        return _zip(first.astype(np.uint32), last.astype(np.uint32))

    def send_failed(row: dict) -> Iterator[pa.RecordBatch]:
        _, starts, hashes = read(row)
        entries = Entries(hashes, buckets)
        marked = np.zeros(len(entries.order), bool)
        if row["failed"]:
            marked[entries.rows[np.searchsorted(starts, _unzip(row["failed"], "<u4")[0])]] = True
        return entries.send(row["pack"], WINDOW_BYTES, marked)

    def spell(row: dict) -> Iterator[pa.RecordBatch]:
        """The words of all windows whose hash failed somewhere."""
        words, starts, hashes = read(row)
        entries = Entries(hashes, buckets)
        at = starts[entries.answers(row["found"] or [])].tolist()
        for lo in range(0, len(at), 4096):
            own = at[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([row["pack"]] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array([b" ".join(words.words[a : a + window]) for a in own], pa.binary())], ["pack", "at", "words"])

    def place(row: dict) -> Iterator[pa.RecordBatch]:
        words, _, _ = read(row)
        at = np.sort(np.array([x["at"] for x in row["got"]], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([row["pack"]], pa.int64()), pa.array([origin(row, words, at)], pa.binary())], ["pack", "gone"])

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        rows = unpack(row["payload"])
        texts = Words([(t or "").encode() for t in rows.column("text").to_pylist()])
        gone = np.zeros(len(texts.words), bool)
        for x in row["got"] or []:
            for a, b in zip(*(v.tolist() for v in _unzip(x["gone"], "<u4", "<u4")), strict=True):
                gone[a:b] = True
        removed, kept, spans = [], [], []
        for a, b in zip(texts.cuts[:-1].tolist(), texts.cuts[1:].tolist(), strict=True):
            words, own = texts.words[a:b], gone[a:b]
            removed.append(int(own.sum()))
            left = b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if removed[-1] else words)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            spans.append([] if digest else [{"start": int(s), "end": int(e)} for s, e in zip(*_ranges(own), strict=True)])
        names = [*columns, "n_words", "n_removed", *(["kept_sha256"] if digest else ["text", "spans"])]
        new = [pa.array(np.diff(texts.cuts), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        new += [] if digest else [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *new], names)

    hits = _hits(_map_rows(packs, send_probes, _SENT), PROBE_BYTES)
    spans = checkpointed(_map_rows(packs.join(hits, "pack", "left").select("pack", "payload", "found"), candidates, "pack long, begin binary, spans binary"))
    met = _gathered(_partners(_map_rows(spans, send_windows, _SENT), WINDOW_BYTES), "met")
    asked = _gathered(_map_rows(met, ask, "pack long, asks long, runs binary"), "asks", "runs")
    texts = _gathered(_map_rows(spans.join(asked, "pack"), answer, "pack long, runs binary, text binary"), "runs", "text")
    judged = checkpointed(_map_rows(spans.join(texts, "pack", "left"), judge, "pack long, gone binary, failed binary"))
    gone = judged.select("pack", "gone")
    if judged.where(F.col("failed").isNotNull()).limit(1).count():  # some windows of one hash differ
        failed = spans.join(judged.select("pack", "failed"), "pack", "left")
        again = spans.join(_hits(_map_rows(failed, send_failed, _SENT), WINDOW_BYTES), "pack", "left")
        spelt = checkpointed(_map_rows(again, spell, "pack long, at long, words binary"))
        twice = spelt.groupBy("words").count().where("count > 1").select("words")
        more = _gathered(spelt.join(twice, "words").select("pack", "at"), "at")
        gone = gone.unionByName(_map_rows(spans.join(more, "pack"), place, "pack long, gone binary"))
    more = {"kept_sha256": "string"} if digest else {"text": "string", "spans": "array<struct<start: bigint, end: bigint>>"}
    return _map_rows(packs.join(_gathered(gone, "gone"), "pack", "left"), cut, schema(documents.select(*columns), n_words="long", n_removed="long", **more))


def op3_dedup_substrings(spark, sf_dir):
    return _dedup(table(spark, sf_dir, "documents"), WINDOW, ["doc_id"], True)
