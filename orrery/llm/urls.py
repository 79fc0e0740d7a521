"""URL filters: a bit-parallel automaton that runs all wildcard rules over a URL at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, shielded, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def rule_globs(rules: Sequence[tuple[str, str]]) -> list[str]:
    """The glob of each (verdict, host/path) rule over a canonical URL: a dot, the host, then the path.

    ``*`` stands for any run within the host (no slash), ``**`` for any run at all; the dot in front makes a
    rule's host match itself and its subdomains only.
    """
    return [f"*.{rule}**" for _, rule in rules]


class GlobAutomaton:
    """All globs as one multiword Shift-And automaton.

    A glob of k literal bytes has k + 1 state bits, packed one glob after the other into 64-bit words. On a byte
    c, ``enter[c]`` holds the states that c leads into from the state before, ``stay[c]`` those that a wildcard
    keeps on c. One step is ``state = ((state << 1) & enter[c]) | (state & stay[c])`` with the shift carried over
    words, for any number of globs.
    """

    def __init__(self, globs: Sequence[str]):
        bits = 0
        entering: list[tuple[int, int]] = []
        staying: list[tuple[int, bool]] = []
        first, final = [], []
        for glob in globs:
            raw = glob.encode()
            first.append(bits)
            at = 0
            while at < len(raw):
                if raw[at] == 42:
                    anywhere = raw[at : at + 2] == b"**"
                    staying.append((bits, anywhere))
                    at += 1 + anywhere
                else:
                    bits += 1
                    entering.append((raw[at], bits))
                    at += 1
            final.append(bits)
            bits += 1
        words = max(1, -(-bits // 64))
        one = lambda bit: (bit // 64, np.uint64(1 << bit % 64))
        self.enter, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        for byte, bit in entering:
            word, mask = one(bit)
            self.enter[byte, word] |= mask
        for bit, anywhere in staying:
            word, mask = one(bit)
            self.stay[np.arange(256) != (-1 if anywhere else 47), word] |= mask
        for bit in first:
            word, mask = one(bit)
            self.start[word] |= mask
        self.final = [one(bit) for bit in final]

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row for each text, a boolean for each glob."""
        n, words = len(texts), len(self.start)
        length = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-length, kind="stable")
        begin = np.zeros(n + 1, np.int64)
        np.cumsum(length, out=begin[1:])
        joined = np.frombuffer(b"".join(texts), np.uint8)
        state = np.repeat(self.start[None], n, axis=0)  # in order of falling length: those still running are in front
        running, at = n, 0
        starts, lengths = begin[:-1][order], length[order]
        while True:
            running = int(np.searchsorted(-lengths[:running], -at, side="left"))
            if not running:
                break
            now = state[:running]
            byte = joined[starts[:running] + at]
            shifted = now << np.uint64(1)
            if words > 1:
                shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (shifted & self.enter[byte]) | (now & self.stay[byte])
            at += 1
        out = np.zeros((n, len(self.final)), bool)
        for k, (word, mask) in enumerate(self.final):
            out[order, k] = (state[:, word] & mask) != 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(bytes.maketrans(_UPPER, _LOWER)).decode(), slash + path


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Judge every ``url`` by the longest rule (verdict, host/path) that fits it.

    A rule fits its host and all subdomains if the url's path starts with the rule's path, which begins with a
    slash. Of equally long rules the earlier wins. Where none fits, the verdict is ``default`` and rule is null.
    Host runs from the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there
    to ``?``, ``#`` or the end. Null urls and urls without ``://`` have empty host and path and fit no rule.

    Returns the input's columns, then host, path, rule, verdict (columns of these names are replaced, in any case, all others
    come through unchanged), a row for each input row; an empty table gives none. A map over the rows: no shuffle, and memory is that of one Arrow batch.
    """
    automaton = GlobAutomaton(rule_globs(rules))
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    made = dict.fromkeys(("host", "path", "rule", "verdict"), "string")
    inner, passed, names = shielded(pages, ("url",), tuple(made))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, verdicts = [r for _, r in rules], [v for v, _ in rules]
        for batch in batches:
            parts = [canonical(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            fits = automaton.match([f".{h}{p}".encode() for h, p in parts])
            best = np.full(len(parts), -1)
            for k in reversed(ranked):
                best[fits[:, k]] = k
            new = [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())]
            new.append(pa.array([texts[k] if k >= 0 else None for k in best], pa.string()))
            new.append(pa.array([verdicts[k] if k >= 0 else default for k in best], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "host", "path", "rule", "verdict"])

    kept = inner.select(*passed)
    return inner.select(*passed, F.col("url").alias("judged")).mapInArrow(judge, schema(kept, **made)).toDF(*names, *made)


def op8_filter_urls(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
m AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
      FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
