"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own, remainder, schema, shielded, table

#: Documents that statistics are taken from, at most: of a language, and of all together.
TRAINING_DOCUMENTS = 400
TRAINING_TOTAL = 20_000
#: Bytes of the longest contexts, and how often a context has to be seen to be a node of its tree.
ORDER = 4
LEAST = 2
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 20
_ROWS = 512


class _Costs:
    """A hash table from integer codes to bits, looked up by whole arrays."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(codes)).bit_length()))
        self.codes = np.zeros(1 << int(64 - self.shift), np.uint64)  # code + 1; 0: free
        self.bits = np.zeros(len(self.codes), np.float32)
        slots, waiting = self._slots(codes), np.arange(len(codes))
        while len(waiting):
            at, first = np.unique(slots[waiting], return_index=True)
            first = waiting[first[self.codes[at] == 0]]
            self.codes[slots[first]], self.bits[slots[first]] = codes[first] + np.uint64(1), bits[first]
            waiting = np.setdiff1d(waiting, first, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) % len(self.codes)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray) -> np.ndarray:
        """The bits of each code, -1 if it is not in the table."""
        slots, want = self._slots(codes), codes + np.uint64(1)
        out = np.full(len(codes), -1, np.float32)
        there = self.codes[slots]
        hit = there == want
        out[hit] = self.bits[slots[hit]]
        on = np.flatnonzero(~hit & (there != 0))
        while len(on):
            slots[on] = (slots[on] + 1) % len(self.codes)
            there = self.codes[slots[on]]
            hit = there == want[on]
            out[on[hit]] = self.bits[slots[on[hit]]]
            on = on[~hit & (there != 0)]
        return out


class _Tree:
    """Contexts of one language, up to ``order`` bytes long, and what they cost.

    A context that was seen n times with q distinct followers escapes with probability q / (n + q) to the context
    without its first byte; a follower seen c times has c / (n + q), and its share of what escapes. Below no
    context all 256 bytes are equally likely. A context seen less than ``least`` times is no node: the tree stops
    above it. ``seen[k]`` has the bits of every follower of a context of k bytes, by the code of both;
    ``escape[k]`` the bits of the escape from each context of k bytes. The sum over the 256 bytes is 1 after
    every context, so bits are exact code lengths.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, least: int):
        """codes: the distinct runs of order + 1 bytes, big-endian; counts: how often each was seen."""
        lower = np.full(256, 1 / 256)
        self.seen, self.escape = [], []
        for k in range(order + 1):
            own, place = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(place, counts, len(own))
            context, at = np.unique(own >> np.uint64(8), return_inverse=True)
            n, q = np.bincount(at, c), np.bincount(at).astype(float)
            below = lower if not k else shorter[np.searchsorted(names, own & np.uint64((1 << 8 * k) - 1))]
            if not k:
                p = np.zeros(256)
                p[own.astype(np.int64)] = c
                shorter = (p + q[0] * below) / (n[0] + q[0])
                names = np.arange(256, dtype=np.uint64)
                self.none = -np.log2(shorter).astype(np.float32)
                continue
            node = n >= least
            p = np.where(node[at], (c + q[at] * below) / (n + q)[at], below)
            self.seen.append(_Costs(own[node[at]], -np.log2(p[node[at]])))
            self.escape.append(_Costs(context[node], -np.log2(q[node] / (n + q)[node])))
            shorter, names = p, own

    def bits(self, code: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each code, given the bytes before it."""
        out, at = np.zeros(len(code), np.float32), None
        for k in range(len(self.seen), 0, -1):
            found = self.seen[k - 1].get(code)
            missed = np.flatnonzero(found < 0)
            if at is None:
                out, at = np.maximum(found, 0), missed
            else:
                out[at] += np.maximum(found, 0)
                at = at[missed]
            if not len(at):
                return out
            code = code[missed]
            out[at] += np.maximum(self.escape[k - 1].get(code >> np.uint64(8)), 0)
            code &= np.uint64((1 << 8 * k) - 1)
        out[at] += self.none[code.astype(np.int64)]
        return out

    def nbytes(self) -> int:
        return sum(t.codes.nbytes + t.bits.nbytes for t in self.seen + self.escape)


class PPM:
    """Frozen context trees, one for each language, over plain bytes: nothing is folded and no byte left out.

    Trees know nothing of each other, so a language keeps all its contexts however many others there are, and
    the size is that of the bounded sample: ``nbytes`` tells it.
    """

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, least: int = LEAST):
        """grams: for each language the distinct codes of order + 1 bytes (big-endian) of its texts, and their counts."""
        self.langs, self.order = langs, order
        self.trees = [_Tree(*grams[lang], order, least) for lang in langs]

    def nbytes(self) -> int:
        return sum(t.nbytes() for t in self.trees)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row for each text, a column for each language. A text starts after spaces."""
        out = np.zeros((len(texts), len(self.langs)))
        waiting: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            padded = b" " * self.order + text
            for lo in range(0, len(text), _SLICE):  # memory doesn't grow with a text's length
                waiting.append((i, padded[lo : lo + _SLICE + self.order]))
                size += len(waiting[-1][1])
                if size >= _SLICE:
                    self._add(out, waiting)
                    waiting, size = [], 0
        if waiting:
            self._add(out, waiting)
        return out

    def _add(self, out: np.ndarray, parts: list[tuple[int, bytes]]) -> None:
        raw = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        size = np.array([len(p) for _, p in parts])
        begin = np.cumsum(size) - size
        spans = np.stack([begin, begin + size - self.order], 1).ravel()  # what lies between parts is context only
        codes, place = np.unique(_codes(raw, self.order), return_inverse=True)
        for k, tree in enumerate(self.trees):
            sums = np.add.reduceat(np.append(tree.bits(codes)[place], np.float32(0)), spans, dtype=np.float64)[::2]
            np.add.at(out[:, k], [i for i, _ in parts], sums)


def _codes(raw: np.ndarray, order: int) -> np.ndarray:
    """Each byte from place ``order`` on and the bytes before it as one number, big-endian."""
    wide = raw.astype(np.uint64)
    code = np.zeros(len(raw) - order, np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | wide[k : k + len(code)]
    return code


def grams(raw: bytes, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of order + 1 bytes of a text that starts after spaces, and their counts."""
    return np.unique(_codes(np.frombuffer(b" " * order + raw, np.uint8), order), return_counts=True)


def fit_languages(documents: DataFrame, most: int = TRAINING_DOCUMENTS, total: int = TRAINING_TOTAL, order: int = ORDER) -> PPM:
    """PPM statistics of at most ``most`` documents of each non-null ``lang`` and ``total`` of all, those with the least hash of doc_id.

    The sample is chosen without reading texts: a bound on the hash, from the number of a language's documents,
    leaves little more than it, so no task ranks all documents of a language. Runs of bytes are counted and added
    up on the executors, and only the sums, bounded by the sample, come to the driver. Documents with a null id,
    lang or text are not learned from; an empty table, or one without labels, gives a model without languages.
    Of rows that repeat an id and a lang the least text is learned from. Only doc_id, lang and text are read.
    """
    labelled = own(documents, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = max(1, min(most, total // max(1, counts.count())))
    bound = counts.select("lang", ((2 * each + 50) / F.col("n")).alias("share"))
    place = F.xxhash64("doc_id").cast("double") / float(1 << 64) + 0.5
    few = labelled.select("doc_id", "lang").join(F.broadcast(bound), "lang").where(place <= F.col("share")).distinct()  # bound: a row for each language
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= each).select("doc_id", "lang")
    sample = labelled.where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = grams(text.encode(), order)
                if lang in sums:
                    codes, inverse = np.unique(np.concatenate([sums[lang][0], codes]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([sums[lang][1], n])).astype(np.int64)
                sums[lang] = codes, n
        for lang, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counted.toArrow().to_pandas()
    learned = {lang: (g["code"].to_numpy(np.uint64), g["n"].to_numpy(np.float64)) for lang, g in found.sort_values(["lang", "code"]).groupby("lang")}
    return PPM(sorted(learned), learned, order)


def identify_languages(documents: DataFrame, model: PPM, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text under each language's frozen statistics.

    Returns the input's columns, or those in ``keep``, then lang_pred, score and bits (bits a byte under lang_pred); columns of these
    names are replaced, in any case. lang_pred is the language with the shortest code, ties to the smaller name; score is its
    share of 2^-length over the languages. A text that is null or has no letter gets ``und``, score 0 and null
    bits, as does every text if no language was learned. An empty table gives no rows; repeated rows are scored
    alike; all other columns, whatever their names, come through unchanged. A map over rows: only texts go to Python.
    """
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    made = {"lang_pred": "string", "score": "double", "bits": "double"}
    inner, passed, names = shielded(documents, ("text",), tuple(made), keep)
    text_too, others = "text" in passed, [c for c in passed if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = broadcast.value
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):  # the texts of a batch are never all copied at once
                batch = whole.slice(lo, _ROWS)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                known = [i for i, t in enumerate(texts) if ppm.langs and t and _LETTER.search(t)]
                pred, share, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                if known:
                    raw = [texts[i].encode() for i in known]
                    bits = ppm.lengths(raw)
                    best = bits.argmin(1)
                    least = bits[np.arange(len(known)), best]
                    p = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    for i, text, b, x, q in zip(known, raw, best, least, p, strict=True):
                        pred[i], share[i], rate[i] = ppm.langs[b], float(q), float(x / len(text))
                new = [batch.column(batch.num_columns - 1)] * text_too
                new += [pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(rate, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], made_here.names)

    made_here = schema(inner.select(*others, *["text"] * text_too), **made)
    return inner.select(*others, "text").mapInArrow(score, made_here).select(*passed, *made).toDF(*names, *made)


def op2_identify_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = fit_languages(docs.where(remainder("doc_id", 3) != 1))
    texts = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return identify_languages(texts, model, keep=["doc_id", "held_out"]).drop("bits")
