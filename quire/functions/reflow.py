"""Greedy line wrapping with CJK widths. Sequential within a paragraph, so it runs in Arrow batches.

A line is a slice of its paragraph: wrapping looks for where lines begin and end, and never builds them up. Widths
are 32-bit floats that were added character by character; a token holds characters of one width only, so its width
is looked up by its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = "一-鿿㐀-䶿豈-﫿　-〿＀-￯"
# fixed values: Unicode's white space but for U+3000, which counts as CJK
_SPACE = " \t\n\v\f\r\x1c\x1d\x1e\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
_TOKEN = re.compile(rf"(?P<cjk>[{_CJK}])|(?P<space>[{_SPACE}]+)|[^{_SPACE}{_CJK}]+")
_PARTS = re.compile(rf"(?P<cjk>[{_CJK}]+)|(?P<space>[{_SPACE}]+)|[^{_SPACE}{_CJK}]+")


class _Widths:
    """Widths of 0, 1, 2 ... characters of one kind, each the one before plus a character, in 32-bit floats."""

    def __init__(self, one: float):
        self.one = np.float32(one)
        self.upto = np.zeros(1, np.float32)

    def of(self, n: int) -> np.float32:
        if n >= len(self.upto):
            more = np.full(max(n, 64) + 1, self.one, np.float32)
            more[0] = 0
            self.upto = np.add.accumulate(more, dtype=np.float32)
        return self.upto[n]

    def fitting(self, room: np.float32, most: int) -> int:
        """How many of ``most`` characters are no wider than ``room``."""
        self.of(most)
        return int(np.searchsorted(self.upto[: most + 1], room, side="right")) - 1


class Wrapper:
    """Characters are code points, so none is ever cut in two."""

    def __init__(self, width: int, other: float, space: float):
        if width <= 0 or other <= 0 or space <= 0:
            raise ValueError("width and ratios must be positive")
        self.limit = np.float32(width)
        self.cjk, self.space, self.other = _Widths(1), _Widths(space), _Widths(other)

    def _kind(self, m: re.Match[str]) -> _Widths:
        return self.cjk if m["cjk"] else self.space if m["space"] else self.other

    def measure(self, text: str) -> np.float32:
        """Width of a text from its first character to its last."""
        total = np.float32(0)
        for m in _PARTS.finditer(text):
            for _ in range(len(m[0])) if total else ():
                total = np.float32(total + self._kind(m).one)
            total = total or self._kind(m).of(len(m[0]))
        return total

    def bounds(self, paragraph: str) -> list[tuple[int, int]]:
        """(begin, end) of each line, white space at its end included; empty if nothing but white space is there."""
        lines: list[tuple[int, int]] = []
        begin = end = -1
        used = np.float32(0)

        def close() -> None:
            nonlocal begin, used
            if begin >= 0:
                lines.append((begin, end))
            begin, used = -1, np.float32(0)

        def extend(at: int, to: int, size: np.float32) -> None:
            nonlocal begin, end, used
            begin, end, used = at if begin < 0 else begin, to, np.float32(used + size)

        for m in _TOKEN.finditer(paragraph):
            at, to = m.span()
            kind = self._kind(m)
            size = kind.of(to - at)
            # U+3000 is as wide as a CJK character and white space all the same
            if m["space"] or m[0] == "\u3000":
                if begin >= 0 and used + size > self.limit:
                    close()
                elif begin >= 0:
                    extend(at, to, size)
                continue
            whole = size <= self.limit
            # a token that fits on a line starts a new one rather than be cut; a wider one fills up line after line
            while at < to:
                if used + (size if whole else kind.one) > self.limit:
                    close()
                n = to - at if whole else max(1, kind.fitting(np.float32(self.limit - used), to - at))
                extend(at, at + n, kind.of(n))
                at += n
        close()
        return lines

    def wrap(self, paragraph: str) -> list[str]:
        return [paragraph[a:z].rstrip(_SPACE + "\u3000") for a, z in self.bounds(paragraph)] or [""]


def _wrapped(f) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda x: None if x is None else f(x))

    return run


def reflow(text: Column, width: int, other_ratio: float = 0.55, space_ratio: float = 0.3) -> Column:
    """A paragraph's lines of at most ``width`` CJK characters. Null gives null, an empty paragraph one empty line."""
    return _wrapped(Wrapper(width, other_ratio, space_ratio).wrap)(text)


def reflow_document(paragraphs: Column, width: int, other_ratio: float = 0.55, space_ratio: float = 0.3) -> Column:
    """Lines of an array of paragraphs, with an empty line between two paragraphs."""
    wrap = Wrapper(width, other_ratio, space_ratio).wrap
    return _wrapped(lambda ps: [line for i, p in enumerate(ps) for line in ([""] if i else []) + wrap(p or "")])(paragraphs)


def line_width(usable: Column, char_width: Column) -> Column:
    """Characters that fit: truncated quotient, at least 10; 30 where the character width is not positive."""
    return F.when(char_width <= 0, F.lit(30)).otherwise(F.greatest((usable / char_width).cast("int"), F.lit(10)))
