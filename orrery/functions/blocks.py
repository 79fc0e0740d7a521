"""Matching braces and splitting arguments: what patterns can't tell, as Arrow-backed functions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types are objects, not text: workers import this module without a session to parse one.
BLOCK = T.ArrayType(
    T.StructType(
        [
            T.StructField("head", T.StringType()),
            *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "start_line", "end_line")),
            T.StructField("text", T.StringType()),
        ]
    )
)
#: Braces, and what they don't count in: quotes with escapes, comments to the end of the line or of the block.
_AWARE = re.compile(r"""[{}]|'[^'\\]*(?:\\.[^'\\]*)*(?:'|\\?\Z)|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|`[^`\\]*(?:\\.[^`\\]*)*(?:`|\\?\Z)|//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)
_PLAIN = re.compile("[{}]")


class Braces:
    """All pairs of braces of a text, found in one pass with a stack, and the number of line ends before any place.

    aware: braces inside quotes and comments don't count; otherwise every brace does. A brace that such a pass finds
    inside a quote or comment may still be asked for; the text is then read once more from there, which answers
    for all braces that this reading sees, so a text is read about once for each way in which its quotes can be taken.
    """

    def __init__(self, text: str, aware: bool):
        self.text, self.token = text, _AWARE if aware else _PLAIN
        self.ends: dict[int, int] = {}
        self._read(0)
        self.breaks: list[int] | None = None

    def _read(self, begin: int) -> None:
        stack, ends = [], self.ends
        for m in self.token.finditer(self.text, begin):
            at = m.start()
            brace = self.text[at]
            if brace == "{":
                if begin and at in ends and not stack:
                    break  # from here on an earlier reading was the same
                stack.append(at)
            elif brace == "}" and stack:
                ends.setdefault(stack.pop(), at + 1)
                if begin and not stack:
                    break  # what was asked for is known
        for at in stack:
            ends.setdefault(at, -1)

    def end(self, opening: int) -> int:
        """Place after the brace that closes the one at ``opening``; -1 if none does."""
        if opening not in self.ends:
            self._read(opening)
        return self.ends[opening]

    def line(self, at: int) -> int:
        """The line of a place, from 1."""
        if self.breaks is None:
            self.breaks = [m.start() for m in re.finditer("\n", self.text)]
        return bisect_left(self.breaks, at) + 1


def match_brace(text: str, opening: int, aware: bool) -> int:
    """Place after the brace that closes the one at ``opening``; -1 if none does."""
    return Braces(text, aware).end(opening)


def blocks(pattern: str, aware: bool = True, first_only: bool = False):
    """A column function: for each match of the (Python) pattern in a text, the match and the text to the end of
    the braces that open after it. Matches without closed braces are left out. Lines count from 1. A text is read
    once for all its matches."""
    head = re.compile(pattern)

    @F.pandas_udf(BLOCK)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for text in series:
                rows, braces = [], None
                for m in head.finditer(text or ""):
                    braces = braces or Braces(text, aware)
                    opening = text.find("{", max(m.start(), m.end() - 1))
                    end = braces.end(opening) if opening >= 0 else -1
                    if end >= 0:
                        rows.append((m.group(0).strip(), m.start(), end, braces.line(m.start()), braces.line(end), text[m.start() : end]))
                        if first_only:
                            break
                out.append([dict(zip(("head", "start", "end", "start_line", "end_line", "text"), r, strict=True)) for r in rows])
            yield pd.Series(out)

    return run


def split_arguments(raw: str) -> list[str]:
    """Arguments between commas that are in no quotes or parentheses, without outer quotes; empty ones go."""
    out, current, quote, depth = [], "", "", 0
    for ch in raw + ",":
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")" and depth:
            depth -= 1
        elif ch == "," and not depth:
            part = current.strip()
            if part:
                out.append(part[1:-1] if len(part) > 1 and part[0] == part[-1] and part[0] in "'\"" else part)
            current = ""
            continue
        current += ch
    tail = current[:-1].strip()  # unclosed quotes or parentheses swallow the last comma
    return [*out, tail] if tail else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def js_arguments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: split_arguments(t or ""))
