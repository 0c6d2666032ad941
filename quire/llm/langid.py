"""Language ID by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1, derived from its code point alone. A trigram is the product
(binding) of its letters' vectors, each rotated by its place; a document is the sum (bundle) of its trigrams, and a
language's prototype is the sum of its training documents. Documents and prototypes are compared by cosine after
what all languages share is taken off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, fold

DIMENSIONS = 1024
#: Labelled documents that prototypes are learned from; a hashed sample beyond that.
FIT_ROWS = 12000
UNDETERMINED = "und"
#: Letters, and numerals that are none (fractions, Roman numerals), which ``_words`` parts.
_LETTERS = re.compile(r"[^\W\d_]+")
_MASK = (1 << 21) - 1
_TOGETHER = 64
#: Different trigrams that are bound at a time.
SLICE = 4096


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """int8 rows of +1 and -1, one for each code point, by a counter-based hash."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
        x = (x + np.uint64(0x51ED2701)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def _words(text: str | None) -> str:
    """Runs of letters (Unicode categories L*) in lower case, parted by one space."""
    words = " ".join(_LETTERS.findall((text or "").lower()))
    if words.replace(" ", "").isalpha():
        return words
    return " ".join("".join(c if c.isalpha() else " " for c in words).split())


def trigram_codes(text: str | None) -> np.ndarray:
    """Trigrams over lower-case letters, words parted by one space; empty without letters."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    p = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return (p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector for each text, and whether it has letters.

    Counts are kept for the trigrams that are there, and a slice of the different trigrams is bound and bundled at a
    time, so memory is bounded by the slice and the texts' own length.
    """
    # each text's own trigrams and counts; long texts shrink here
    held = [np.unique(trigram_codes(t), return_counts=True) for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    sizes = np.array([len(c) for c, _ in held])
    if not sizes.sum():
        return out, sizes > 0
    codes, counts = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
    row = np.repeat(np.arange(len(texts)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, counts, row = codes[order], counts[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    for lo in range(0, len(first), SLICE):
        begin, end = first[lo], first[lo + SLICE] if lo + SLICE < len(first) else len(codes)
        seen = codes[first[lo : lo + SLICE]]
        at = np.searchsorted(seen, codes[begin:end])
        part = np.bincount(row[begin:end] * len(seen) + at, counts[begin:end], minlength=len(texts) * len(seen))
        letters = np.stack([(seen >> np.uint64(s)) & np.uint64(_MASK) for s in (42, 21, 0)])
        points, index = np.unique(letters, return_inverse=True)
        index, vectors = index.reshape(letters.shape), letter_vectors(points)
        bound = np.roll(vectors, 2, axis=1)[index[0]] * np.roll(vectors, 1, axis=1)[index[1]] * vectors[index[2]]
        out += part.reshape(len(texts), -1).astype(np.float32) @ bound.astype(np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-9), sizes > 0


@dataclass
class LanguageModel:
    names: list[str]
    common: np.ndarray
    prototypes: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo in range(0, len(texts), _TOGETHER):
            vectors, lettered = bundles(texts[lo : lo + _TOGETHER])
            vectors = vectors - self.common
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            cosines = vectors @ self.prototypes.T
            best = cosines.argmax(axis=1)
            for i in range(len(best)):
                names.append(self.names[best[i]] if lettered[i] else UNDETERMINED)
                scores.append(float(np.clip(cosines[i, best[i]], 0, 1)) if lettered[i] else 0.0)
        return names, scores


def fit(labelled: DataFrame) -> LanguageModel | None:
    """Prototypes from rows (_text, _lang); sums of each task meet in one sum per language. None without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=object)
            for lo in range(0, len(texts), _TOGETHER):
                vectors, lettered = bundles(texts[lo : lo + _TOGETHER])
                here = langs[lo : lo + _TOGETHER]
                for name in set(here[lettered]):
                    mine = vectors[lettered & (here == name)].sum(axis=0, dtype=np.float64)
                    sums[name] = sums.get(name, 0) + mine
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "sum"]
        )

    parts = labelled.select("_text", "_lang").mapInArrow(run, "lang string, sum array<double>")
    flat = parts.select("lang", F.posexplode("sum").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = flat.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    rows = sorted(rows.collect(), key=lambda r: r.lang)
    if not rows:
        return None
    p = np.array([r.v for r in rows])
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    common = p.mean(axis=0) if len(p) > 1 else np.zeros(p.shape[1])
    p = p - common
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    return LanguageModel([r.lang for r in rows], common.astype(np.float32), p.astype(np.float32))


def predict(model: LanguageModel | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if model is None:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)})
            else:
                names, scores = model.predict(texts.tolist())
                yield pd.DataFrame({"lang_pred": pd.Series(names, dtype="object"), "score": pd.Series(scores, dtype="float64")})

    return run(text.cast("string"))


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows with a language outside the held-out fold. A text that is null or has no letters is ``und``
    with score 0, and so is every text if nothing can be learned. Ties go to the first language by name. Null ids are
    kept, repeated rows get a row each, very long texts are read whole. An empty table gives an empty result; other
    columns are ignored.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2))
    known = bounded_sample(known, "doc_id", FIT_ROWS, known.count())
    model = fit(known.select(F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang")))
    found = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), predict(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
