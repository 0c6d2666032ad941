"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents, the unlabelled set is a sample of the whole table, and a
non-negative unbiased risk is minimised: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)). No labelled negative is used,
neither as an example nor for the class prior pi, which is estimated from positives and unlabelled rows alone: a
classifier that tells one from the other is fitted on one half of both, and on the other half the share of unlabelled
rows among its top scores, over the share of positives there, bounds the prior from above; the least bound is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, fold
from quire.llm.toxicity import per_text, training_rows

#: Bounds on the trusted positives' labelled rows and on the unlabelled sample.
FIT_ROWS = 8000
UNLABELLED_ROWS = 8000
THRESHOLD = 0.5

_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[[*range(ord("a"), ord("z") + 1)]] = 0
_CLASS[[*range(ord("A"), ord("Z") + 1)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[[*range(128, 256)]] = 5
_N_CLASSES = 7


def features(text: str | None) -> np.ndarray:
    """Shares and logs of what the whole text is made of."""
    t = text or ""
    raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    by = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    kinds = np.bincount(_CLASS, weights=by, minlength=_N_CLASSES) / n
    words = t.split()
    k = max(1, len(words))
    lines = [x for x in t.split("\n") if x.strip()]
    grams = max(1, len(words) - 2)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    plain = sum(1 for w in words if w[-1:].isalpha())
    seen = len(set(words))
    runs = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return np.array([
        *kinds,
        # logs, as a few in a hundred words already tell
        *(math.log1p(100 * x) for x in (
            by[ord("!")] / k, by[ord("|")] / k, (by[ord("#")] + by[ord("*")] + by[ord("%")] + by[ord("&")] + by[ord("$")]) / k,
            (by[ord("<")] + by[ord(">")] + by[ord("{")] + by[ord("}")]) / n, upper / k, runs / k,
            1 - len(set(zip(words, words[1:], words[2:]))) / grams if len(words) > 2 else 0.0,
            1 - len(set(lines)) / max(1, len(lines)),
        )),
        by[ord(".")] / k, by[ord(",")] / k, plain / k, seen / k ** 0.9,
        math.log1p(len(words)), math.log1p(n / k), math.log1p(k / max(1, len(lines))), float(not words),
    ])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, clipped, and their squares; a leading one."""
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.column_stack([np.ones(len(z)), z, z * z - 1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.08, ridge: float = 1e-3) -> QualityModel:
    """Minimises the non-negative risk of a logistic model by Adam; where the negative part falls under 0, it is undone."""
    model = QualityModel(unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3, np.zeros(1 + 2 * unlabelled.shape[1]), prior)
    p, u, w = model.design(positive), model.design(unlabelled), model.weights
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        # logistic losses: -log s for the positive label, -log(1 - s) for the negative
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g_positive = -prior * (p.T @ (1 - sp)) / len(p)
        grad = g_positive + g_negative if negative >= 0 else -g_negative
        grad = grad + ridge * np.r_[0, w[1:]]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    model.weights = w
    return model


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk of logistic weights over design rows, without the ridge."""
    log_p, log_u = np.logaddexp(0, positive @ w), np.logaddexp(0, unlabelled @ w)
    # log(1 + e^z) is the loss of the negative label, and that less z of the positive
    return prior * float((log_p - positive @ w).mean()) + max(0.0, float(log_u.mean()) - prior * float(log_p.mean()))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, by the best bin of held-out scores (features given).

    The shares are known up to chance, so each bound is raised by what chance allows for its bin before the least is
    taken. Between one unlabelled row's worth and 1.
    """
    fit_p, test_p, fit_u, test_u = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if not len(test_p) or not len(test_u):
        return 0.5
    model = fit_nnpu(fit_p, fit_u, 0.5)
    p, u = np.sort(-model.score(test_p)), np.sort(-model.score(test_u))
    upto_p = np.arange(1, len(p) + 1) / len(p)
    upto_u = np.searchsorted(u, p, side="right") / len(u)
    chance = math.sqrt(math.log(4 / slack) / 2) * (1 / math.sqrt(len(p)) + 1 / math.sqrt(len(u)))
    best = int(np.argmin((upto_u + chance) / upto_p))
    return float(min(1.0, max(1.0 / len(u), upto_u[best] / upto_p[best])))


def _features(text: str) -> Column:
    return per_text(lambda t: features(t).tolist(), "array<double>")(text)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """None if no training document is labelled good."""
    rows = training_rows(docs, labels, "quality", most=FIT_ROWS).where("_label = 1").select(_features("_text").alias("x")).collect()
    positive = np.array([r.x for r in rows])
    if not len(positive):
        return None
    web = docs.where(fold("doc_id", 3) != 1).select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    web = bounded_sample(web, "_id", UNLABELLED_ROWS, web.count(), seed=23)
    unlabelled = np.array([r.x for r in web.select(_features("_text").alias("x")).collect()])
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(model: QualityModel | None, text: Column) -> Column:
    """The score of a text, 0 to 1; 0.5 without a model. Null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None or not len(texts):
                yield pd.Series([0.5] * len(texts), dtype="float64")
            else:
                yield pd.Series(model.score(np.array([features(t) for t in texts])))

    return run(text.cast("string"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Equal texts score alike. A document labelled twice counts as good if either label says so; null labels are none.
    A null text counts as empty, null ids are kept, very long texts are read whole. Without a good label every score
    is 0.5. An empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs, labels)
    return docs.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
