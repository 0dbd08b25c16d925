"""Toxicity by a second-order factorization machine over hashed terms.

A text is the set of its lower-case letter runs, each hashed into a space of ``SPACE`` terms. All terms of a few labelled documents
are kept, whatever their own association with the label, and get a weight and a short vector each:
pairs of terms (an insult and a group it is aimed at) count for more or less than their sum, also where
neither says anything alone. Proximal steps shrink weights, and whole vectors, to nothing where the data do not hold
them up. Scoring needs only the fitted terms: two sums over vectors give all pairwise products.

Defined results: null text is empty; a text with no fitted term scores the intercept's probability;
without labels of both kinds every score is the share of positive labels (0.5 with no labels at all); no documents, no
rows; a very long text counts each term once, as any other; null and repeated ids are scored as they come, and only rows
with an id are learned from; columns named score and predicted are replaced, others kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm.labelled import fitted, training_rows

WORDS = re.compile(r"[^\W\d_]+")
#: Terms are hashed into this many, which bounds the model; words that share a hash share a weight.
SPACE = 1 << 20
#: Fitting reads about this many labelled rows, whatever the size of the corpus.
FIT_ROWS = 16_000
FACTORS = 4
#: Words a worker keeps the slots of; each takes some 150 bytes in every worker.
CACHE_WORDS = 100_000
EPOCHS, SECOND_EPOCHS = 10, 60
BATCH = 256
WEIGHT_STEP, VECTOR_STEP = 0.3, 0.05
#: Proximal shrinkage a step, in units of a document's gradient.
WEIGHT_SHRINK, VECTOR_SHRINK, SECOND_SHRINK = 4e-3, 5e-3, 0.05


def term_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE


def term_hashes(text: str) -> list[int]:
    return list({term_hash(w) for w in set(WORDS.findall(text.lower()))})


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted uint32 hashes
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function of ``n`` texts, from (row, term slot) pairs."""
        linear = np.bincount(rows, weights=self.weights[slots], minlength=n)
        v = self.vectors[slots]
        total = np.stack([np.bincount(rows, weights=v[:, k], minlength=n) for k in range(v.shape[1])], axis=1)
        squares = np.bincount(rows, weights=(v**2).sum(axis=1), minlength=n)
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)


def _slots(terms: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    flat = np.concatenate([np.asarray(h, dtype=np.uint32) for h in hashes]) if len(hashes) else np.zeros(0, np.uint32)
    at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
    ok = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
    return rows[ok], at[ok]


def fit(hashes: list[np.ndarray], y: np.ndarray, seed: int = 7) -> FactorizationMachine:
    n, positive = len(y), float(y.sum())
    share = (positive + 0.5) / (n + 1)
    empty = FactorizationMachine(np.zeros(0, np.uint32), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    if not n or positive in (0, n):
        return empty
    rows = np.repeat(np.arange(n), [len(h) for h in hashes])
    terms, slot, seen = np.unique(np.concatenate([np.asarray(h, np.uint32) for h in hashes]), return_inverse=True, return_counts=True)
    top = np.flatnonzero(seen >= min(3, max(2, n // 200)))
    chosen = terms[top]
    if not len(chosen):
        return empty
    # a weight is shrunk less where the term's own association with the label is beyond what the largest of so many noise terms reaches
    expected = seen * positive / n
    z = (np.bincount(slot, weights=y[rows], minlength=len(terms)) - expected) / np.sqrt(np.maximum(expected * (1 - positive / n), 1e-9))
    ease = np.minimum(1, 2 * np.log(len(terms) + 1) / np.maximum(z[top] ** 2, 1e-9)) ** 2
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(chosen, empty.bias, np.zeros(len(chosen)), rng.normal(0, 0.1, (len(chosen), FACTORS)))
    more = max(1, 4000 // n)  # few rows are gone over more often
    m = _descend(m, hashes, y, rng, EPOCHS * more, ease, 1.0)
    held = (m.weights != 0) | (m.vectors != 0).any(axis=1)
    m = FactorizationMachine(m.terms[held], m.bias, m.weights[held], m.vectors[held])
    return _descend(m, hashes, y, rng, SECOND_EPOCHS, ease[held], SECOND_SHRINK)  # with what is left, and less shrinkage


def _descend(m: FactorizationMachine, hashes: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int, ease: np.ndarray, shrink: float) -> FactorizationMachine:
    """Proximal stochastic steps, scaled by each term's past gradients."""
    n, k = len(y), len(m.terms)
    r, s = _slots(m.terms, hashes)
    first = np.searchsorted(r, np.arange(n + 1))
    gw, gv, gb = np.full(k, 1e-8), np.full(k, 1e-8), 1e-8
    weights, vectors, bias = m.weights.copy(), m.vectors.copy(), m.bias
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for lo in range(0, n, BATCH):
            docs = shuffled[lo : lo + BATCH]
            size = first[docs + 1] - first[docs]
            ends = np.cumsum(size)
            slots = s[np.repeat(first[docs] - (ends - size), size) + np.arange(ends[-1])]
            local = np.repeat(np.arange(len(docs)), size)
            v = vectors[slots]
            total = np.stack([np.bincount(local, weights=v[:, f], minlength=len(docs)) for f in range(FACTORS)], axis=1)
            pairs = 0.5 * ((total**2).sum(axis=1) - np.bincount(local, weights=(v * v).sum(axis=1), minlength=len(docs)))
            margin = bias + np.bincount(local, weights=weights[slots], minlength=len(docs)) + pairs
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[docs]) / len(docs)
            near, at = np.unique(slots, return_inverse=True)
            dw = np.bincount(at, weights=err[local])
            push = err[local, None] * (total[local] - v)
            dv = np.stack([np.bincount(at, weights=push[:, f]) for f in range(FACTORS)], axis=1)
            gw[near] += dw**2
            gv[near] += (dv**2).sum(axis=1)
            gb += err.sum() ** 2
            step = WEIGHT_STEP / np.sqrt(gw[near])
            w = weights[near] - step * dw
            weights[near] = np.sign(w) * np.maximum(np.abs(w) - step * shrink * WEIGHT_SHRINK * ease[near], 0)
            step = VECTOR_STEP / np.sqrt(gv[near])
            x = vectors[near] - step[:, None] * dv
            norm = np.linalg.norm(x, axis=1)
            vectors[near] = x * np.maximum(1 - step * shrink * VECTOR_SHRINK / np.maximum(norm, 1e-12), 0)[:, None]
            bias -= 0.1 * err.sum() / np.sqrt(gb)
    return FactorizationMachine(m.terms, float(bias), weights, vectors)


def fit_on(docs: DataFrame, labels: DataFrame, used: Column, label: str = "toxic", rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on about ``rows`` labelled documents; their term hashes meet in one task."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"h": [np.sort(np.array(term_hashes(t), dtype=np.int32)) for t in f["text"]], "y": f["y"]})

    return fitted(training_rows(docs, labels, label, used, rows).mapInPandas(hashed, "h array<int>, y int"), "h", fit)


class _TermSlots(dict):
    """word -> slot of its term, or -1; bounded."""

    def __init__(self, terms: np.ndarray):
        super().__init__()
        self.known = {int(h): i for i, h in enumerate(terms)}

    def __missing__(self, word: str) -> int:
        at = self.known.get(term_hash(word), -1)
        if len(self) < CACHE_WORDS:
            self[word] = at
        return at


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with score and predicted, in place of columns of those names; the model has at most ``SPACE`` terms."""
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    made: dict = {}

    @F.pandas_udf(schema)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = made.setdefault("slots", _TermSlots(model.terms))
        for t in texts:
            found = [sorted({i for i in map(find.__getitem__, WORDS.findall(x.lower())) if i >= 0}) for x in t]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            slots = np.fromiter((i for x in found for i in x), dtype=np.int64, count=len(rows))
            p = 1 / (1 + np.exp(-np.clip(model.margin(rows, slots, len(found)), -30, 30)))
            yield pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    got = docs.select(F.struct("*").alias("row"), scored(F.coalesce(F.col("text"), F.lit(""))).alias("made"))
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "predicted")], "made.score", "made.predicted")


def keep(docs: DataFrame, model: FactorizationMachine, predicted: int) -> DataFrame:
    """The rows of ``docs`` that the model predicts so; columns as they were."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return score(rows, model).filter(F.col("predicted") == predicted).select("row.*")
