"""Document quality: random-indexing word vectors, pooled, into a two-layer network with calibrated probabilities.

Every token has a sparse index vector of +1 and -1 drawn from its hash. A token's word vector is its
own index vector plus the mean of those of its neighbours in the fitting sample (a count of
co-occurrence, never held as a matrix). Tokens are words and runs of marks; marks for capitals and
for a word that repeats its predecessor are tokens of their own. A document is the mean of its word
vectors, plus that mean's length. A small network is fitted by Adam; a temperature, chosen on rows
that the weights never saw, makes its outputs probabilities.

Defined results: null text is empty; a text without tokens is the zero vector; without labels of both
kinds every score is the share of positive labels (0.5 with no labels at all); no documents, no rows; a very long text is
pooled over all its words; null and repeated ids are scored as they come, and only rows with an id are learned from; columns
named score and predicted are replaced, others kept.
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

TOKENS = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 16
DIM = 64
NONZERO = 8
WINDOW = 2
HIDDEN = 32
#: Fitting reads about this many labelled rows, whatever the size of the corpus.
FIT_ROWS = 8_000
EPOCHS = 60
REPEAT, CAPITALS = 0, 1
CACHE_TOKENS = 100_000  # some 150 bytes each, in every worker


class TokenBuckets(dict):
    """token -> bucket (words in capitals are lower-cased and marked by a sign bit)."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        b = 2 + zlib.crc32(low.encode("utf-8", "surrogatepass")) % (BUCKETS - 2)
        if len(token) > 1 and token.isupper():
            b += BUCKETS
        if len(self) < CACHE_TOKENS:
            self[token] = b
        return b


def buckets(text: str, known: TokenBuckets) -> np.ndarray:
    """The text's tokens as buckets, in order, with the marks for capitals and repeats at the end."""
    raw = np.array(list(map(known.__getitem__, TOKENS.findall(text))), dtype=np.int32)
    word = raw & (BUCKETS - 1)
    repeats = int((word[1:] == word[:-1]).sum())
    capitals = int((raw >= BUCKETS).sum())
    return np.concatenate([word, np.full(repeats, REPEAT, np.int32), np.full(capitals, CAPITALS, np.int32)])


def index_vectors(seed: int = 11) -> np.ndarray:
    """BUCKETS x DIM, ``NONZERO`` entries of +1 or -1 in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    place = rng.integers(0, DIM, (BUCKETS, NONZERO))
    sign = rng.choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, NONZERO))
    np.add.at(out, (np.arange(BUCKETS)[:, None], place), sign)
    return out


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Each bucket's index vector plus the mean index vector of its neighbours within ``WINDOW``."""
    index = index_vectors()
    context = np.zeros_like(index)
    seen = np.zeros(BUCKETS, dtype=np.float32)

    def add(at: np.ndarray, other: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at, other = at[order], other[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        if len(first):
            context[at[first]] += np.add.reduceat(index[other], first, axis=0)
            seen[at[first]] += np.diff(np.append(first, len(at)))

    for flat, owner in _stretches(texts):
        for k in range(1, WINDOW + 1):
            same = owner[:-k] == owner[k:]
            a, b = flat[:-k][same], flat[k:][same]
            add(a, b)
            add(b, a)
    return index + context / np.maximum(seen, 1)[:, None]


def _stretches(texts: list[np.ndarray], size: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, owner) of whole texts, about ``size`` tokens at a time."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= size):
            held += len(texts[hi])
            hi += 1
        yield np.concatenate(texts[lo:hi]), np.repeat(np.arange(lo, hi), [len(t) for t in texts[lo:hi]])
        lo = hi


@dataclass
class QualityModel:
    vectors: np.ndarray | None
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, t: np.ndarray) -> np.ndarray:
        return pool(self.vectors, t)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -30, 30)))


def pool(vectors: np.ndarray, t: np.ndarray) -> np.ndarray:
    if not len(t):
        return np.zeros(DIM + 1)
    mean = np.zeros(DIM)
    for lo in range(0, len(t), 8192):
        mean += vectors[t[lo : lo + 8192]].sum(axis=0, dtype=np.float64)
    mean /= len(t)
    return np.append(mean, np.linalg.norm(mean))


def fit(texts: list[np.ndarray], y: np.ndarray, seed: int = 5) -> QualityModel:
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        z = np.zeros(DIM + 1)
        return QualityModel(None, z, z + 1, np.zeros((DIM + 1, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    vectors = word_vectors(texts)
    x = np.array([pool(vectors, t) for t in texts])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart = max(1, len(y) // 5)
    check, train = order[:apart], order[apart:]
    centre, spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    m = QualityModel(vectors, centre, spread, rng.normal(0, (DIM + 1) ** -0.5, (DIM + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(share / (1 - share))), 1.0)
    state = [np.zeros_like(p) for p in (m.w1, m.b1, m.w2, np.zeros(1)) for _ in range(2)]
    xs, step = (x - centre) / spread, 0
    for _ in range(EPOCHS):
        for lo in range(0, len(train), 128):
            rows = rng.permutation(train)[:128] if len(train) <= 128 else train[lo : lo + 128]
            h = np.tanh(xs[rows] @ m.w1 + m.b1)
            p = 1 / (1 + np.exp(-np.clip(h @ m.w2 + m.b2, -30, 30)))
            err = (p - y[rows]) / len(rows)
            back = np.outer(err, m.w2) * (1 - h**2)
            grads = [xs[rows].T @ back + 1e-4 * m.w1, back.sum(axis=0), h.T @ err + 1e-4 * m.w2, np.array([err.sum()])]
            step += 1
            deltas = []
            for k, g in enumerate(grads):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g**2
                deltas.append(0.003 * state[2 * k] / (1 - 0.9**step) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8))
            m.w1, m.b1, m.w2, m.b2 = m.w1 - deltas[0], m.b1 - deltas[1], m.w2 - deltas[2], m.b2 - float(deltas[3][0])
        train = rng.permutation(train)
    z = m.margin(x[check])
    grid = np.geomspace(0.25, 8, 60)
    loss = [np.logaddexp(0, -np.where(y[check] == 1, z, -z) / t).mean() for t in grid]
    m.temperature = float(grid[int(np.argmin(loss))])
    return m


def fit_on(docs: DataFrame, labels: DataFrame, used: Column, label: str = "quality", rows: int = FIT_ROWS) -> QualityModel:
    """Fit on about ``rows`` labelled documents; their buckets meet in one task."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TokenBuckets()
        for f in frames:
            yield pd.DataFrame({"t": [buckets(t, known) for t in f["text"]], "y": f["y"]})

    return fitted(training_rows(docs, labels, label, used, rows).mapInPandas(split, "t array<int>, y int"), "t", fit)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score and predicted, in place of columns of those names. The broadcast model is 16 MB, a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    @F.pandas_udf(schema)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, known = shared.value, TokenBuckets()
        for t in texts:
            x = np.array([m.pooled(buckets(s, known)) if m.vectors is not None else np.zeros(DIM + 1) for s in t]).reshape(len(t), DIM + 1)
            p = m.probability(x)
            yield pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    got = docs.select(F.struct("*").alias("row"), scored(F.coalesce(F.col("text"), F.lit(""))).alias("made"))
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "predicted")], "made.score", "made.predicted")


def keep(docs: DataFrame, model: QualityModel, predicted: int) -> DataFrame:
    """The rows of ``docs`` that the model predicts so; columns as they were."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return score(rows, model).filter(F.col("predicted") == predicted).select("row.*")
