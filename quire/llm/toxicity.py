"""Toxicity: a learned lexicon, matched through Levenshtein automata, weighed by context windows.

The lexicon holds words, and stems of words (written with a final *), that labelled toxic documents use far more
often than clean ones: of all that do, the few that cover the toxic documents. A stem counts for a document that has
it twice or more, as any stem turns up once by chance. The lexicon is kept as a trie, in which the end of a stem loops
on any letter. The trie is intersected with the Levenshtein automaton of each term's length (no error up to 4 letters,
one up to 8, two beyond; for stems none up to 5 letters, one beyond) and the product is made deterministic as words
are read, so a misspelled term costs one table lookup a letter. Digits and signs between letters are read as letters
of a misspelled word ("idi0t"). Each hit is weighed by the words around it: quotation marks, reporting verbs and talk
about words speak for quotation, address in the second person for abuse. A logistic model turns a document's sums
into a score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, cut_lineage, fold

#: Labelled documents that the fit may use; a hashed sample beyond that.
FIT_ROWS = 12000
THRESHOLD = 0.7
#: Lengths of the stems that are counted.
STEMS = (4, 5, 6, 7)
WINDOW = 5
#: Words of a text that a stem has to stand at the beginning of.
STEM_WORDS = 2
_WORD = re.compile(r"[^\W\d_]+")
_MIXED_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!*|]{1,2}[^\W\d_]+)*")
_QUOTES = frozenset("\"'“”„«»‘’‹›`")
_REPORT = frozenset(
    "said says say called calls quote quoted quotes wrote term word words phrase slur slurs insult insults "
    "sagte nannte zitat wort begriff dit mot terme citation dijo palabra cita término".split()
)
_ADDRESS = frozenset("you your youre u ur du dich dein ihr tu te toi ton vous tú usted eres tus".split())


class LexiconAutomaton:
    """The trie of the terms, intersected with Levenshtein automata and made deterministic step by step."""

    #: Cached steps; the cache starts anew beyond.
    MOST_STEPS = 400_000

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        self.budget = [0]
        #: End of a stem to the node that loops; of its own, so that longer terms get nothing from the loop.
        self.loops: dict[int, int] = {}
        for term in sorted(terms):
            node, errors = 0, self.errors_for(term)
            self.budget[0] = max(self.budget[0], errors)
            for ch in term.removesuffix("*"):
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][ch] = nxt
                    self.children.append({})
                    self.budget.append(0)
                node = nxt
                self.budget[node] = max(self.budget[node], errors)
            if term.endswith("*"):
                self.loops[node] = node = len(self.children)
                self.children.append({})
                self.budget.append(errors)
            self.term_at[node] = term
        self.looping = frozenset(self.loops.values())
        self._reset()

    @staticmethod
    def errors_for(term: str) -> int:
        if term.endswith("*"):
            return int(len(term) > 6)
        return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.cached = 0
        self.start = self._state(self._closure({0: 0}))

    def _closure(self, at: dict[int, int]) -> frozenset:
        """Adds what skipping letters of a term reaches; keeps the fewest errors for each node."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and at.get(child, 99) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
            loop = self.loops.get(node)
            if loop is not None and e <= self.budget[loop] and at.get(loop, 99) > e:
                at[loop] = e
        return frozenset(at.items())

    def _state(self, members: frozenset) -> int:
        found = self.ids.get(members)
        if found is None:
            found = self.ids[members] = len(self.sets)
            self.sets.append(members)
            self.steps.append({})
            ends = [(e, self.term_at[n]) for n, e in members if n in self.term_at and e <= self.errors_for(self.term_at[n])]
            best = min(ends, default=None)
            self.accepts.append(best and (best[1], best[0]))
        return found

    def _step(self, state: int, ch: str) -> int:
        at: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, child in self.children[node].items():
                cost = e if c == ch else e + 1
                if cost <= self.budget[child] and at.get(child, 99) > cost:
                    at[child] = cost
            if node in self.looping:
                at[node] = min(at.get(node, 99), e)
            elif e + 1 <= self.budget[node] and at.get(node, 99) > e + 1:
                at[node] = e + 1
        nxt = self._state(self._closure(at)) if at else -1
        self.steps[state][ch] = nxt
        self.cached += 1
        return nxt

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, errors) of the closest term within its error bound; ties go to the first by name."""
        if self.cached > self.MOST_STEPS:
            self._reset()
        state, steps = self.start, self.steps
        for ch in word:
            nxt = steps[state].get(ch)
            if nxt is None:
                nxt = self._step(state, ch)
            if nxt < 0:
                return None
            state = nxt
        return self.accepts[state]


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    #: Words near a term that clean documents are known to use: no hits.
    clean: frozenset[str]
    weights: list[float]
    #: Whether digits and signs between letters belong to a word.
    mixed: bool = False
    _automaton: LexiconAutomaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "clean": self.clean, "weights": self.weights, "mixed": self.mixed, "_automaton": None}

    @property
    def words(self) -> re.Pattern[str]:
        return _MIXED_WORD if self.mixed else _WORD

    def hit(self, word: str) -> tuple[str, int] | None:
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        found = self._automaton.match(word)
        if found and found[1] and word in self.clean:
            return None
        return found

    def near(self, text: str | None) -> list[str]:
        """Words of a text that look like a misspelled term."""
        return [w for w in set(self.words.findall((text or "").lower())) if (h := self.hit(w)) and h[1]]

    def features(self, text: str | None) -> list[float]:
        """Sums over the hits of a text: exact, misspelled, different words, abuse less quotation, the largest, density."""
        low = (text or "").lower()
        hits = {}
        for w in set(self.words.findall(low)):
            found = self.hit(w)
            if found:
                hits[w] = found
        if not hits:
            return [0.0] * 6
        exact = fuzzy = abuse = quoted = top = 0.0
        spans = list(self.words.finditer(low))
        for i, m in enumerate(spans):
            found = hits.get(m.group())
            if not found:
                continue
            term, errors = found
            near = {s.group() for s in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
            in_quotes = low[m.start() - 1 : m.start()] in _QUOTES and low[m.end() : m.end() + 1] in _QUOTES and m.start() > 0
            weight = self.terms[term] * 0.6**errors
            weight *= 0.3 if in_quotes else 0.5 if near & _REPORT else 1.0
            weight *= 1.3 if near & _ADDRESS else 1.0
            if in_quotes or near & _REPORT:
                quoted += weight
            else:
                abuse += weight
            if errors or term.endswith("*"):
                fuzzy += weight
            else:
                exact += weight
            top = max(top, weight)
        return [
            math.log1p(exact), math.log1p(fuzzy), math.log1p(len(hits)), math.log1p(abuse) - math.log1p(quoted), top,
            100.0 * (exact + fuzzy) / (len(spans) + 100.0),
        ]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _keys(text: str | None) -> set[str]:
    """Words of a text, and the stems that enough of its words begin with."""
    words = Counter(_WORD.findall((text or "").lower()))
    stems: Counter[str] = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    return {w for w in words if len(w) > 2} | {f"{s}*" for s, n in stems.items() if n >= STEM_WORDS}


def key_counts(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(word, n): texts (column _text) with each word or stem, or with those of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def out():
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])
            seen.clear()

        for b in batches:
            for text in b.column(0):
                keys = _keys(text.as_py())
                seen.update(keys if wanted is None else keys & wanted)
                if len(seen) > 300_000:
                    yield from out()
        yield from out()

    return texts.select("_text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cover(documents: list[list[str]], times: int, least: int) -> list[str]:
    """Few terms that cover the documents ``times`` times each: always the one that covers most, ties by name.

    A stem has to cover more than a word does, and a short stem more than a long one.
    """

    def worth(gain: int, term: str) -> tuple[float, str]:
        return -gain * (0.88 + 0.01 * len(term) if term.endswith("*") else 1.0), term

    holders: dict[str, list[int]] = {}
    for i, terms in enumerate(documents):
        for t in terms:
            holders.setdefault(t, []).append(i)
    need = [times] * len(documents)
    heap = [worth(len(h), t) for t, h in holders.items()]
    heapq.heapify(heap)
    picked = []
    while heap:
        _, term = heapq.heappop(heap)
        gain = sum(1 for i in holders[term] if need[i])
        if gain < least:
            continue
        if heap and worth(gain, term) > heap[0]:
            heapq.heappush(heap, worth(gain, term))
            continue
        picked.append(term)
        for i in holders[term]:
            need[i] = max(0, need[i] - 1)
    return picked


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def per_text(f, kind: str):
    """An Arrow-batched function of one text column."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return run


def fit(labelled: DataFrame) -> ToxicityModel:
    """Fits on rows (_text, _label: 0 or 1), which the caller bounds; nothing else bounds the lexicon."""
    labelled = cut_lineage(labelled.select("_text", "_label"))
    toxic, clean = labelled.where("_label = 1"), labelled.where("_label = 0")
    n1, n0 = toxic.count(), clean.count()
    if not n1:
        return ToxicityModel({}, frozenset(), [math.log(0.5 / (n0 + 1.0))] + [0.0] * 6)
    support = max(2, math.ceil(0.004 * n1))
    ones = key_counts(toxic).where(F.col("n") >= support).collect()
    wanted = frozenset(r.word for r in ones)
    zeros = {r.word: r.n for r in key_counts(clean, wanted).collect()}
    odds = {r.word: math.log((r.n + 0.5) / (n1 + 1.0)) - math.log((zeros.get(r.word, 0) + 0.5) / (n0 + 1.0)) for r in ones}
    strong = frozenset(w for w, x in odds.items() if x > 2.5)
    held = per_text(lambda t: sorted(_keys(t) & strong), "array<string>")
    picked = cover([r.k for r in toxic.select(held("_text").alias("k")).collect()], 3, support)
    terms = {w: min(6.0, odds[w]) for w in picked}
    # words that clean documents use and that look like a misspelled term
    probe = ToxicityModel(terms, frozenset(), [], mixed=True)
    near = per_text(probe.near, "array<string>")
    common = clean.select(F.explode(near("_text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    # a word of one clean document alone would be new if that document were; so the weights are fitted without it
    probe.clean = frozenset(r.word for r in common if r.n > 1)
    feats = per_text(probe.features, "array<double>")
    rows = labelled.select(feats("_text").alias("x"), "_label").collect()
    model = ToxicityModel(terms, frozenset(r.word for r in common), [], mixed=True)
    x, y = np.array([r.x for r in rows]), np.array([r._label for r in rows], dtype=float)
    model.weights = [float(v) for v in fit_logistic(x, y)]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int = 3, held: int = 1, most: int = FIT_ROWS) -> DataFrame:
    """(_text, _label) of labelled documents outside the held-out fold, at most about ``most`` of them."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = known.where(fold("doc_id", folds) != held).select(F.col("doc_id").alias("_lid"), "_label")
    known = bounded_sample(known, "_lid", most, known.count())
    # the sample's bound is the broadcast's
    return docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")).join(
        F.broadcast(known), F.col("_id") == F.col("_lid")
    )


def score(model: ToxicityModel, text: Column) -> Column:
    """The score of a text, 0 to 1. A null or empty text gets the score of a text without hits."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.score)

    return run(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Repeated rows and equal texts score alike; a document labelled twice counts as toxic if either label says so;
    null labels are none. A null text counts as empty, null ids are kept, very long texts are read whole. Without
    labels every score is low. An empty table gives an empty result; other columns are ignored.
    """
    model = fit(training_rows(docs, labels, "toxic"))
    return docs.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
