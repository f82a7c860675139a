"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Every word has a sparse random index vector that its hash fixes. Over a bounded labelled sample, frequent
words gather the index vectors of their neighbours; index and centred context together are the word's
vector. Words that the sample doesn't have keep their index vector. A document is the mean of its words'
vectors with the shares of letter cases and of repeated words; a network with one hidden layer gives a
logit, and a temperature fitted on rows kept apart makes its probability honest.

Bounds, all parameters: ``rows`` labelled texts to learn from, ``words`` words with a context vector.
Scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, labelled_sample

DIM, NONZERO, BUCKETS, WINDOW = 128, 8, 4096, 2
TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
SHAPES = 6  # lower, title, upper, mixed, digits, symbols


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """Sparse ternary unit vectors, fixed by the keys alone."""
    out = np.zeros((len(keys), DIM), np.float32)
    with np.errstate(over="ignore"):
        for i in range(NONZERO):
            h = (keys + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            np.add.at(out, (np.arange(len(keys)), (h % np.uint64(DIM)).astype(int)), np.where(h >> np.uint64(63), 1, -1) / np.sqrt(NONZERO))
    return out


class Rows(dict):
    """Token -> 8 * row of its word's vector + its shape. Words without a row of their own share hashed rows."""

    def __init__(self, words: list[str]):
        self.words = {w: i for i, w in enumerate(words)}

    def __missing__(self, token: str) -> int:
        low = token.lower()
        row = self.words.get(low)
        if row is None:
            row = len(self.words) + xxhash.xxh3_64_intdigest(low.encode()) % BUCKETS
        shape = 5 if not token[0].isalnum() else 4 if token[0].isdigit() else 0 if token == low else 2 if len(token) > 1 and token.isupper() else 1 if token[1:] == low[1:] else 3
        if len(self) >= 400_000:
            self.clear()
        self[token] = x = 8 * row + shape
        return x

    def of(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text or "")
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def pooled(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The document's vector; all zero for an empty text."""
    out = np.zeros(DIM + SHAPES + 4, np.float32)
    if n := len(x):
        ids = x >> 3
        total = np.zeros(DIM)
        for i in range(0, n, 4096):
            total += vectors[ids[i : i + 4096]].sum(0)
        out[:DIM] = total / n
        out[DIM : DIM + SHAPES] = np.bincount(x & 7, minlength=SHAPES) / n
        out[DIM + SHAPES :] = np.linalg.norm(out[:DIM]), 1 - len(np.unique(ids)) / n, (ids[1:] == ids[:-1]).mean() if n > 1 else 0, np.log1p(n) / 10
    return out


@dataclass
class QualityModel:
    words: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float | None = None  # the answer for all where the sample has one class only

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2).ravel()

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000, words: int = 20_000, hidden: int = 32, epochs: int = 40, label: str = "quality", scratch: Scratch | None = None) -> QualityModel:
    """Learns from at most ``rows`` labelled texts; rows with crc32(id) mod 4 = 2 are never read."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    sample = labelled_sample(docs, labels, label, scratch, rows=rows, name="sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for t in b["_text"].to_pylist():
                n.update({x.lower() for x in TOKEN.findall(t or "")})
            yield pa.RecordBatch.from_pydict({"word": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

    counts = sample.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 5")
    vocabulary = [r[0] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]
    keys = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in vocabulary] + [i * 7919 + 1 for i in range(BUCKETS)], np.uint64)
    own = index_vectors(keys)
    shared = spark.sparkContext.broadcast((vocabulary, own))
    size = len(vocabulary)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, own = shared.value
        rows_of, total = Rows(vocabulary), np.zeros((size, DIM), np.float32)
        for b in batches:
            for t in b["_text"].to_pylist():
                ids = rows_of.of(t) >> 3
                for a in range(0, len(ids), 4096):
                    near = np.r_[ids[max(0, a - WINDOW) : a + 4096 + WINDOW]]
                    vec, out = own[near], np.zeros((len(near), DIM), np.float32)
                    for k in range(1, WINDOW + 1):
                        out[k:] += vec[:-k]
                        out[:-k] += vec[k:]
                    off = min(a, WINDOW)
                    here, out = near[off : off + 4096], out[off : off + 4096]
                    here, out = here[known := here < size], out[known]
                    order = np.argsort(here, kind="stable")
                    if len(order):
                        first = np.flatnonzero(np.r_[True, np.diff(here[order]) > 0])
                        total[here[order][first]] += np.add.reduceat(out[order], first)
        for i in range(0, size, 1000):
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int64()), "sums": pa.array([total[i : i + 1000].tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"][:1], "sums": [sum(np.frombuffer(x, np.float32) for x in pdf["sums"]).tobytes()]})

    vectors = own.copy()
    if size:
        # at most 16 partial sums, of a size that words and DIM bound
        parts = sample.select("_text").repartition(16).mapInArrow(contexts, "at long, sums binary").groupBy("at").applyInPandas(add, "at long, sums binary").collect()
        context = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(parts)]).reshape(-1, DIM)
        context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        context -= context.mean(0)
        vectors[:size] += context
    shared = spark.sparkContext.broadcast((vocabulary, vectors))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vectors = shared.value
        rows_of = Rows(vocabulary)
        for b in batches:
            x = [pooled(rows_of.of(t), vectors).tobytes() for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.binary()), "y": b["_label"], "part": b["_part"]})

    got = sample.mapInArrow(features, "x binary, y int, part int").toPandas().sort_values(["part", "x", "y"])
    scratch.drop("sample")
    width = DIM + SHAPES + 4
    x = np.frombuffer(b"".join(map(bytes, got["x"])), np.float32).reshape(-1, width).astype(np.float64)
    y, apart = (got["y"].to_numpy() == 1).astype(float), got["part"].to_numpy() < 2
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(width), np.ones(width))
    fit = ~apart if len(set(y[~apart])) > 1 else np.ones(len(y), bool)
    if len(set(y[fit])) < 2:
        return QualityModel(vocabulary, vectors, mean, scale, [], 1.0, prior=float(y.mean()) if len(y) else 0.5)
    layers = _train((x[fit] - mean) / scale, y[fit], hidden, epochs)
    model = QualityModel(vocabulary, vectors, mean, scale, layers, 1.0)
    if len(set(y[apart])) > 1:
        model.temperature = _temperature(model.logits(x[apart]), y[apart])
    return model


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    """Adam on the log loss, from a fixed seed."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            xb, yb = x[order[i : i + 256]], y[order[i : i + 256], None]
            h = np.tanh(xb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yb) / len(xb)
            dh = d @ p[2].T * (1 - h * h)
            step += 1
            for k, g in enumerate((xb.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def quality_score(model: QualityModel, docs: DataFrame, text_col: str = "text") -> Column:
    """The probability (0 to 1) that a text is good, as a column of ``docs``; null and empty texts get one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        rows_of = Rows(model.words)
        for s in batches:
            x = [pooled(rows_of.of(t), model.vectors) for t in s]
            yield pd.Series(model.probability(np.stack(x).astype(np.float64)) if x else [], dtype="float64")

    return score(F.col(text_col))
