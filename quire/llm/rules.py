"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass. On a bounded sample every rule's cost and its share of rejections are
measured; the cascade then runs the rules in order of rejections per cost and stops at the first that rejects. The
order changes how long that takes and never which documents are kept.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample

#: Documents on which costs and rejections are measured.
SAMPLE_ROWS = 2000
_SYMBOLS = b"#*$%&|<>"
_DELIMITERS = b" \t\n\v\f\r"


class Document:
    """A text and what several rules share; parts are worked out when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "replace")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self._lines = None

    @property
    def lines(self) -> list[bytes]:
        if self._lines is None:
            self._lines = [x for x in self.raw.split(b"\n") if x.strip(_DELIMITERS)]
        return self._lines

    def word_chars(self) -> int:
        """Code points in words: bytes that start one, less delimiters."""
        return len(self.raw.decode("utf-8")) - sum(self.raw.count(d) for d in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))

    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def n_repeat_words(self) -> int:
        """Words that lie in a three-word window which the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        covered, last = 0, -1
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, last)
                last = i + 3
        return covered


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


Rule = Callable[[Document], bool]


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols() > d.n_words


def _word_length(d: Document) -> bool:
    return not 2 * d.n_words <= d.word_chars() <= 25 * d.n_words


def _dup_lines(d: Document) -> bool:
    # a line or two that return in a short text are a refrain and no junk
    return len(d.lines) >= 10 and 10 * d.n_dup_lines() > 3 * len(d.lines)


def _few_letters(d: Document) -> bool:
    return 10 * sum(1 for w in d.words if w.translate(None, b"0123456789.,;:!?'\"()-#*$%&|<>_=+/\\@[]{}~^`")) < 7 * d.n_words


def _shouting(d: Document) -> bool:
    return 2 * sum(1 for w in d.words if len(w) > 1 and w == w.upper() and w != w.lower()) > d.n_words


def _one_word(d: Document) -> bool:
    return 10 * max(Counter(d.words).values(), default=0) > 4 * d.n_words


#: Name and test of each rule; a test is true if it rejects.
RULES: dict[str, Rule] = {
    "symbols": _symbols,
    "word_length": _word_length,
    "dup_lines": _dup_lines,
    "few_letters": _few_letters,
    "shouting": _shouting,
    "one_word": _one_word,
}


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measure(texts: list[str | None], rules: dict[str, Rule] | None = None) -> list[Measured]:
    """Mean seconds and share of rejections of each rule over a sample, in cascade order; ties keep the given order."""
    found = []
    for name, rule in (rules or RULES).items():
        docs = [Document(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(map(rule, docs))
        n = max(1, len(docs))
        found.append(Measured(name, (time.perf_counter() - began) / n, rejected / n))
    return sorted(found, key=lambda m: -m.worth)


def passes(d: Document, order: list[str], rules: dict[str, Rule] | None = None) -> bool:
    rules = rules or RULES
    return not any(rules[name](d) for name in order)


def plan(docs: DataFrame) -> list[str]:
    """Names of the rules in the order of the cascade, from a bounded sample measured by one task."""
    sample = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("_text")), "doc_id", SAMPLE_ROWS, docs.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for b in batches for t in b["_text"]]
        if texts:
            found = measure(texts)
            yield pd.DataFrame({
                "name": [m.name for m in found], "seconds": [m.seconds * len(texts) for m in found],
                "rejected": [m.rejected * len(texts) for m in found],
            })

    parts = sample.select("_text").mapInPandas(run, "name string, seconds double, rejected double")
    rows = parts.groupBy("name").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    worth = {r.name: r.r / max(r.s, 1e-9) for r in rows}
    return sorted(RULES, key=lambda name: -worth.get(name, 0.0))


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def verdicts(order: list[str], text: Column) -> Column:
    """struct of the base counts, base_failed and kept."""

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                d = Document(t)
                repeat = d.n_repeat_words()
                failed = base_failed(d.n_words, repeat)
                rows.append((d.n_words, d.word_chars(), d.n_symbols(), d.n_dup_lines(), repeat, failed, not failed and passes(d, order)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return run(text.cast("string"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails. Repeated rows get a row each; an empty table gives an empty result; other
    columns are ignored.
    """
    found = docs.select("doc_id", verdicts(plan(docs), F.col("text")).alias("v"))
    return found.select("doc_id", "v.*")
