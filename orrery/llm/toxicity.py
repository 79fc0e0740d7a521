"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own, remainder, schema, shielded, stored, table

#: Training documents of each class, at most; of any length.
TRAINING_DOCUMENTS = 2000
BUCKETS = 1 << 18
#: Log odds of a subword are shrunk by so many segments that didn't say.
SHRINK = 8.0
#: A toxic text weighs as much in training as its number of segments, but no more than so many.
MOST_WEIGHT = 8
#: Words of a text that are averaged together, and how many words of no meaning are averaged with them.
SEGMENT = 48
PRIOR = 8
THRESHOLD = 0.3
CACHE = 400_000
_GRAMS = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams, ends marked, and of the word itself; and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    owner, found = [], []
    position = np.arange(len(letters))
    word = np.repeat(np.arange(len(words)), size)
    for n in _GRAMS:
        at = position[position + n <= end[word]]
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = (code ^ letters[at + k]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        owner.append(word[at])
        found.append(code)
    power = np.cumprod(np.full(max(1, int(size.max(initial=1))), 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat((letters + np.uint64(1)) * power[position - np.repeat(end - size, size)], end - size)
    owner.append(np.arange(len(words)))
    found.append(whole)
    owners, codes = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    codes = codes[order] * np.uint64(0xBF58476D1CE4E5B9)
    return (codes >> np.uint64(46)).astype(np.int64) % BUCKETS, np.searchsorted(owners[order], np.arange(len(words)))


def segments(words: int) -> np.ndarray:
    """First words of the segments of a text: every ``SEGMENT`` words, a short rest goes with the last."""
    return np.arange(0, max(1, words - SEGMENT // 3), SEGMENT)


class SubwordClassifier:
    """Bucket vectors times the softmax's difference of classes, and the line that turns the highest segment into a score."""

    def __init__(self, bucket_score: np.ndarray, slope: float, bias: float):
        self.bucket_score, self.slope, self.bias = bucket_score.astype(np.float32), slope, bias
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.bucket_score, self.slope, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 65_536):
            part = words[lo : lo + 65_536]
            buckets, begin = subwords(part)
            count = np.diff(np.append(begin, len(buckets)))
            self.known.update(zip(part, (np.add.reduceat(self.bucket_score[buckets], begin) / count).tolist(), strict=True))

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The largest mean over the segments of each text; 0 for a text without words."""
        split = [_words(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {w for words in split for w in words}
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        out = np.zeros(len(split))
        for i, words in enumerate(split):
            if words:
                ends = [*segments(len(words)).tolist(), len(words)]
                out[i] = max(sum(map(get, sorted(set(words[a:b])))) / (b - a + PRIOR) for a, b in zip(ends, ends[1:], strict=False))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(texts) + self.bias, -60, 60)))


def _sums(values: np.ndarray, index: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each span of places from begin on: the sum of weight times the rows of values that index names."""
    out = np.zeros((len(begin), values.shape[1]), np.float32)
    ends = np.append(begin[1:], len(index))
    for lo in range(0, len(begin), 4096):
        hi = min(lo + 4096, len(begin))
        a, b = begin[lo], ends[hi - 1]
        full = ends[lo:hi] > begin[lo:hi]
        if b > a:
            out[lo:hi][full] = np.add.reduceat(values[index[a:b]] * weight[a:b, None], begin[lo:hi][full] - a, axis=0)
    return out


class _Sparse:
    """A sparse matrix by row, and by column, to multiply dense ones with."""

    def __init__(self, row: np.ndarray, column: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        """row: in order. Indices have 32 bits: the driver holds them twice."""
        row, column = row.astype(np.int32), column.astype(np.int32)
        self.by_row = column, weight, np.searchsorted(row, np.arange(shape[0], dtype=np.int32))
        order = np.argsort(column, kind="stable").astype(np.int32)
        self.by_column = row[order], weight[order], np.searchsorted(column[order], np.arange(shape[1], dtype=np.int32))

    def __matmul__(self, values: np.ndarray) -> np.ndarray:
        return _sums(values, *self.by_row)

    def back(self, values: np.ndarray) -> np.ndarray:
        return _sums(values, *self.by_column)


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic regression of y on x, by damped Newton steps, the slope pulled slightly to 0."""
    middle, scale = float(x.mean()), float(x.std()) or 1.0
    features = np.stack([(x - middle) / scale, np.ones_like(x)], 1)
    pull = np.array([1e-3, 1e-9]) * weight.sum()
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda w: weight @ np.logaddexp(0, -sign * (features @ w)) + pull @ (w * w) / 2
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        gradient = features.T @ (weight * (p - y)) + pull * w
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag(pull)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


def gradients(bags: _Sparse, subs: _Sparse, hidden: np.ndarray, logits: np.ndarray, softmax: np.ndarray, onehot: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted cross entropy by subword vectors, softmax and offset together; hidden and logits are the forward pass."""
    p = np.exp(logits - logits.max(1, keepdims=True))
    error = (p / p.sum(1, keepdims=True) - onehot) * weight
    return [subs.back(bags.back(error @ softmax.T)), hidden.T @ error, error.sum(0)]


def train(texts: list[str], toxic: list[int], share: float, dimensions: int = 4, steps: int = 40, rate: float = 0.5, decay: float = 1e-3, floor: float = 0.03, seed: int = 0) -> SubwordClassifier:
    """Fit subword vectors and the softmax together, by Adam on the segments of three quarters of the texts.

    A segment has its text's label; as most of a long toxic text is clean, half-way through the weight of each
    toxic text moves to those of its segments that look toxic by then. Vectors start from the shrunken log odds of
    their subwords in one dimension and near 0 in the others, and decay towards that start. The other texts then
    give the line from a text's highest segment to its score, weighted to ``share``, the share of toxic documents
    among all labelled ones. Without texts of both classes every score is ``share``.
    """
    labels = np.array(toxic, np.int64)
    odds = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    nothing = SubwordClassifier(np.zeros(BUCKETS), 0.0, odds)
    split = [_words(t) for t in texts]
    inner = np.ones(len(labels), bool)
    for k in (0, 1):  # of either class every fourth is held back
        inner[np.flatnonzero(labels == k)[3::4]] = False
    if len(np.unique(labels[inner])) < 2 or len(np.unique(labels[~inner])) < 2 or not any(split):
        return nothing
    words = sorted({w for s, i in zip(split, inner, strict=True) if i for w in s})
    if not words:
        return nothing
    number = {w: i for i, w in enumerate(words)}
    row, column, target, document = [], [], [], []
    for s, label, i in zip(split, labels, inner, strict=True):
        if i and s:
            own = np.array([number[w] for w in s], np.int64)
            row.append(np.repeat(np.arange(len(begin := segments(len(s)))), np.diff(np.append(begin, len(s)))) + len(target))
            column.append(own)
            target += [label] * len(begin)
            document += [len(column) - 1] * len(begin)
    row, column, y = np.concatenate(row), np.concatenate(column), np.array(target)
    size = np.bincount(row)
    row, column = np.divmod(np.unique(row * len(words) + column), len(words))
    bags = _Sparse(row, column, (1 / (size[row] + PRIOR)).astype(np.float32), (len(y), len(words)))

    parts = [subwords(words[lo : lo + 16_384]) for lo in range(0, len(words), 16_384)]
    bucket = np.concatenate([b.astype(np.int32) for b, _ in parts])
    count = np.concatenate([np.diff(np.append(begin, len(b))) for b, begin in parts])
    del parts
    owner = np.repeat(np.arange(len(words), dtype=np.int32), count)
    # in how many segments of either class a subword is, once for each word
    classes = [np.bincount(column[y[row] == k], minlength=len(words)) for k in (0, 1)]
    clean, bad = (np.bincount(bucket, c[owner], BUCKETS) for c in classes)
    kept = np.flatnonzero(clean + bad)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    held = place[bucket] >= 0
    subs = _Sparse(owner[held], place[bucket[held]], (1 / count).astype(np.float32)[owner[held]], (len(words), len(kept)))
    del bucket, owner, held
    totals = [max(1, int((y == k).sum())) for k in (0, 1)]
    shrink = SHRINK / len(y)
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.01, (len(kept), dimensions)).astype(np.float32)
    start[:, 0] = np.log((bad[kept] / totals[1] + shrink) / (clean[kept] / totals[0] + shrink))
    vectors = start.copy()
    softmax = rng.normal(0, 0.1, (dimensions, 2)).astype(np.float32)
    softmax[0] = -5, 5
    offset = np.array([1, -1], np.float32)
    onehot = np.stack([1 - y, y], 1).astype(np.float32)
    weight = np.where(y > 0, 0.5 / totals[1], 0.5 / totals[0]).astype(np.float32)[:, None]
    parameters = [vectors, softmax, offset]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    document = np.array(document)
    starts, sizes = np.unique(document, return_index=True, return_counts=True)[1:]
    for step in range(1, steps + 1):
        hidden = bags @ (subs @ vectors)
        logits = hidden @ softmax + offset
        if step == steps // 2 + 1:  # from here on a toxic text's weight lies on the segments that look toxic
            odds_of = np.where(y > 0, logits[:, 1] - logits[:, 0], 0)
            part = np.exp((odds_of - np.maximum.reduceat(odds_of, starts)[document]) / 2)
            part *= (np.minimum(sizes, MOST_WEIGHT) / np.add.reduceat(part, starts))[document]
            weight = np.where(y > 0, 0.5 * part / part[y > 0].sum(), 0.5 / totals[0]).astype(np.float32)[:, None]
        found = gradients(bags, subs, hidden, logits, softmax, onehot, weight)
        found[0] += decay / len(kept) * (vectors - start)
        for x, g, m, v in zip(parameters, found, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            # subwords with little evidence move in proportion to it, not by a full step
            scale = np.sqrt(v / (1 - 0.98**step))
            x -= rate * (m / (1 - 0.9**step)) / (scale + floor * scale.max() + 1e-12)
    score = np.zeros(BUCKETS)
    score[kept] = vectors @ (softmax[:, 1] - softmax[:, 0])
    model = SubwordClassifier(score, 1.0, 0.0)
    outer = labels[~inner]
    x = model.highest([t for t, i in zip(texts, inner, strict=True) if not i])
    weight = np.where(outer > 0, share / max(1, outer.sum()), (1 - share) / max(1, (1 - outer).sum())) * len(outer)
    slope, bias = _line(x, outer, weight)
    return SubwordClassifier(score, max(0.0, slope), bias if slope > 0 else odds)


def fit_toxicity(documents: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> SubwordClassifier:
    """Train on at most ``most`` whole texts of each class, of any length, those with the least hash of doc_id.

    So many documents come to the driver; all labels count for the share of toxic documents. A bound on the hash,
    from the size of a class, leaves few labels to rank, so no task gets all of a class. Labels other than 0 and 1
    and null ids are left out, as are documents without text. An empty table, or one class only, gives a model that
    scores every text alike. Of rows that repeat an id and a label, the least text is learned from, so an id that
    many rows share brings one text to the driver. Other columns are ignored.
    """
    labels = own(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    place = F.xxhash64("doc_id").cast("double") / float(1 << 64) + 0.5
    limit = lambda k: (2.5 * most + 100) / max(1, counts.get(k, 0))
    few = labels.where(place <= F.when(F.col("toxic") == 1, limit(1)).otherwise(limit(0))).distinct()
    by_hash = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    texts = own(documents, "doc_id", "text").where(F.col("text").isNotNull())
    # more labels than needed, as some have no text; written, so that ids are ranked without their texts
    once = stored(texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    chosen = once.select("doc_id", "toxic").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= most)
    sample = once.join(F.broadcast(chosen), ["doc_id", "toxic"]).toArrow().to_pandas().sort_values(["toxic", "nth"])
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train(sample["text"].tolist(), sample["toxic"].tolist(), share)


def score_toxicity(documents: DataFrame, model: SubwordClassifier, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text. Returns the columns in ``keep`` (default: doc_id), then score and predicted.

    Words are runs of letters, lower-cased. The vectors of each segment's words are averaged, a word's being the
    mean of its subwords'; as the softmax is linear, a word counts by one number, which workers keep at hand. A
    text is as toxic as its most toxic segment, so that long texts don't dilute it; a word counts once a segment,
    so that one repeated throughout doesn't stand for all.
    Texts that are null or have no words have mean 0, as one of unknown words has: their score is 1 / (1 + exp(-bias)).
    An empty table gives no rows; repeated rows are scored alike; columns named score or predicted in ``keep`` are
    replaced, in any case, all others come through unchanged. A map over rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    inner, passed, names = shielded(documents, ("text",), ("score", "predicted"), ["doc_id"] if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                score = classifier.scores(part.column(part.num_columns - 1).to_pylist())
                new = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*passed, "score", "predicted"])

    read = inner.select(*passed, F.col("text").alias("scored"))
    made = schema(inner.select(*passed), score="double", predicted="int")
    return read.mapInArrow(run, made).toDF(*names, "score", "predicted")


def op4_score_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score_toxicity(docs.select("doc_id", held_out, "text"), fit_toxicity(docs, labels), keep=["doc_id", "held_out"])
