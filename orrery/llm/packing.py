"""Packing documents into sequences: Martello-Toth reduction, then best-fit, over the histogram of sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own, schema, shielded, table
from .ranks import rank_in_group

CAPACITY = 4096
END = 1
#: Words whose ids a worker keeps at hand.
CACHE = 400_000
#: Texts that the word cache can take: printable ASCII, ASCII white space, letters of Latin-1.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x09-\x0d\x20]+")
#: Tells a tokenizer that splits so from others: cases, numbers, contractions, white space, marks, accents.
_PROBE = "It's DON'T we'll 12,305.7 x_y  two\t tabs\n\nEnd!! (É über ñandú)-ß a1b2 ''s 'LL"


#: Of this worker process, by path: words stay known from task to task.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Ids(dict):
    """Ids of words. Words met after ``CACHE`` others are encoded each time: the frequent ones come early."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        if len(self) < CACHE:
            self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts from a byte-level tokenizer.

    If the tokenizer lower-cases and splits a probe as ``_SPLIT`` does, plain texts are split here and words looked
    up; any other text, any that spells a special token, and all texts of other tokenizers go to the tokenizer as
    they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = _SPLIT.findall(_PROBE.lower())
        alike = self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        letters = _byte_letters()
        try:
            self.splits = alike == [t.id for w in words for t in self.tokenizer.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]
        except Exception:  # a model of another kind knows no such pieces
            self.splits = False
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Ids(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, without special tokens of the tokenizer's own."""
        if not self.splits or _PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _SPLIT.findall(text.lower())))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Ids of whole texts, then ``end``; longer ones are cut into pieces of ``capacity`` ids.

    ``path`` names the tokenizer's file on the executors; by default each looks it up in its own installation.
    Returns doc_id, piece (from 0), start (the document's ids before it), length and ids (binary, little-endian
    unsigned 32-bit). Null and empty texts have the single id ``end``. Rows are cut each by itself, so repeated rows and
    null ids give pieces of their own; an empty table gives none. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path()
        if file not in _TOKENIZERS:
            _TOKENIZERS[file] = WordTokenizer(file)
        tokenizer = _TOKENIZERS[file]
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, piece, start, ids = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = tokenizer.encode(text or "") + last
                    for k, at in enumerate(range(0, len(raw), capacity * 4)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        ids.append(raw[at : at + capacity * 4])
                new = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *new], ["doc_id", "piece", "start", "length", "ids"])

    read = own(documents, "doc_id", "text")
    return read.mapInArrow(run, schema(read.select("doc_id"), piece="int", start="long", length="long", ids="binary"))


@dataclass
class Plan:
    """Where the pieces of each length go. ``runs``: (length, first rank, number, per sequence, first sequence, offset)."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0


class Packer:
    """Bin packing of a multiset of lengths, given as a histogram; work and plan depend on its width only.

    Items of equal length are alike, so a decision is made for as many bins at a time as allow it.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in histogram.items():
            self.left[length] = count
        self.next = np.zeros(capacity + 1, np.int64)
        self.plan = Plan(capacity)

    def place(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        """``count`` items, ``each`` in a sequence, from ``sequence`` on, the first in each at ``offset``."""
        self.plan.runs.append((length, int(self.next[length]), count, each, sequence, offset))
        self.next[length] += count
        self.left[length] -= count

    def fits(self, room: int, skip: tuple[int, ...] = ()) -> int:
        """The largest length left of at most ``room``, beyond the items in ``skip``; 0 if none."""
        for length in np.flatnonzero(self.left[: room + 1])[::-1]:
            if self.left[length] > skip.count(int(length)):
                return int(length)
        return 0

    def smallest(self, number: int, skip: tuple[int, ...]) -> int:
        """Sum of the ``number`` smallest items left beyond ``skip``; capacity + 1 if there are fewer."""
        total = 0
        for length in np.flatnonzero(self.left):
            take = min(number, int(self.left[length]) - skip.count(int(length)))
            total += take * int(length)
            number -= take
            if number <= 0:
                return total
        return self.plan.capacity + 1

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """Partners of an item of length j, the largest left, that dominate every other set it could share a bin with.

        A set dominates another if the other's items can be parted among its own by size: exchanging them never
        needs another bin. An exact fit by one item dominates all; where no two others fit beside j, the largest
        that fits does; where no three fit, one item does if no pair is larger than it, and so does a pair that
        is at least as large, item by item, as all other pairs.
        """
        room = self.plan.capacity - j
        one = self.fits(room, (j,))
        if not one:
            return ()
        if one == room or self.smallest(2, (j,)) > room:
            return (one,)
        if self.smallest(3, (j,)) > room:
            second = self.fits(room - one, (j, one))
            # pairs hold no item above ``one`` and, as two fit, are at most ``room`` together
            if second and one + second == room and second == self.fits(room - self.smallest(1, (j,)), (j, one)):
                return (one, second)
            if not second:
                most = self.best_pair(room, j)
                if most <= one:
                    return (one,)
        return None

    def best_pair(self, room: int, j: int) -> int:
        """Largest sum of at most ``room`` of two items left beside j."""
        best = 0
        for length in np.flatnonzero(self.left[: room + 1]):
            if self.left[length] <= (length == j):
                continue
            other = self.fits(room - int(length), (j, int(length)))
            if other:
                best = max(best, int(length) + other)
        return best

    def reduce(self) -> None:
        """Martello-Toth reduction: from the largest length down, fix the dominating sets for good."""
        for j in range(self.plan.capacity, 0, -1):
            while self.left[j]:
                partners = self.dominating(j)
                if partners is None:
                    break
                need = {x: (j, *partners).count(x) for x in {j, *partners}}
                bins = min(int(self.left[x]) // k for x, k in need.items())
                if not bins:
                    break
                # the same set dominates for as long as its items last
                offset = 0
                for x, k in sorted(need.items(), reverse=True):
                    self.place(x, bins * k, k, self.plan.sequences, offset)
                    offset += x * k
                self.plan.sequences += bins
                self.plan.reduced += bins

    def best_fit(self) -> None:
        """Best-fit decreasing. Open bins are ranges of sequences with equal room: room -> [(first, number)]."""
        open_: dict[int, list[tuple[int, int]]] = {}
        capacity = self.plan.capacity
        for s in range(capacity, 0, -1):
            rooms = sorted(r for r in open_ if r >= s)
            k = 0
            while self.left[s]:
                if k < len(rooms):
                    room = rooms[k]
                    if not open_.get(room):
                        open_.pop(room, None)
                        k += 1
                        continue
                    first, number = open_[room].pop()
                else:
                    room, first, number = capacity, self.plan.sequences, -(-int(self.left[s]) // (capacity // s))
                    self.plan.sequences += number
                each = room // s
                full = min(number, int(self.left[s]) // each)
                if full:
                    self.place(s, full * each, each, first, capacity - room)
                    open_.setdefault(room - each * s, []).append((first, full))
                rest = int(self.left[s])
                if full < number:
                    if rest:
                        self.place(s, rest, rest, first + full, capacity - room)
                        open_.setdefault(room - rest * s, []).append((first + full, 1))
                        full += 1
                    if full < number:
                        open_.setdefault(room, []).append((first + full, number - full))
            open_.pop(0, None)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    packer = Packer(histogram, capacity)
    packer.reduce()
    packer.best_fit()
    return packer.plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (doc_id, piece, length, ...) a sequence_id and its offset there.

    The plan is made on the driver from the histogram of lengths, which has at most ``capacity`` entries
    whatever the number of pieces; it names runs of ranks among the pieces of a length. Those ranks are made by
    two-level prefix sums, so no task gathers all pieces of a length.

    Returns the input's columns, then sequence_id and offset (columns of these names are replaced, in any case). Sequences are filled without gaps from 0. Pieces
    of equal length are exchangeable, so ties among repeated rows don't matter. An empty table gives no rows.
    """
    made = {"sequence_id": "long", "offset": "long"}
    inner, passed, names = shielded(pieces, ("doc_id", "piece", "length"), tuple(made))
    held = checkpointed(inner.select(*passed))
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}
    plan = plan_sequences(histogram, capacity)
    runs = np.array(plan.runs or [(0,) * 6], np.int64)
    # runs of a length are in order of rank: one sorted key finds a piece's run
    key = runs[:, 0] << 48 | runs[:, 1]
    order = np.argsort(key, kind="stable")
    shared = pieces.sparkSession.sparkContext.broadcast((key[order], runs[order]))

    at_length = passed.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(batch.num_columns - 1).to_numpy() - 1
            run = rows[np.searchsorted(keys, length << 48 | rank, "right") - 1] if len(rank) else rows[:0]
            at = rank - run[:, 1]
            sequence = run[:, 4] + at // np.maximum(run[:, 3], 1)
            offset = run[:, 5] + at % np.maximum(run[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*passed, *made])

    keyed = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4096)).cast("int")).withColumn("coarse", F.lit(0))
    ranked = rank_in_group(keyed, "length", "coarse", "bucket", ["doc_id", "piece"], "rank").select(*passed, "rank")
    return ranked.mapInArrow(place, schema(held, **made)).toDF(*names, *made)


def op9_pack_sequences(spark, sf_dir):
    pieces = tokenize_pieces(table(spark, sf_dir, "documents"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
