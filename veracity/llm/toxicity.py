"""Toxicity: cumulative-link ordinal regression on sparse word features.

Severity grades come from the labels alone: 0 (not toxic), 1 (toxic) and 2 (toxic, and of poor quality too, as the quality label
marks it). Without a quality label there are grades 0 and 1 only, and the upper threshold stays out of reach.

Words count whole and by their first five, six and seven letters, which unites the inflected and compound
forms of a stem. P(grade <= k) = logistic(threshold_k - w.x): one weight a word, shared by all ordered thresholds. Features are
1 + log(count) of the chosen words; a text holds those it has and no others. Learnt from a bounded labelled sample (``rows``
texts, ``words`` words, both parameters; rows with crc32(id) mod 4 = 2 never); scoring reads every whole text in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
STEMS = (5, 6, 7)


def forms(word: str) -> list[str]:
    """The word and its stems, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Places(dict):
    """Word -> places of its chosen forms among the features; most words have none."""

    def __init__(self, chosen: list[str]):
        self.at = {w: i for i, w in enumerate(chosen)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        self[word] = x = tuple(self.at[f] for f in forms(word) if f in self.at)
        return x


@dataclass
class OrdinalModel:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, total: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text, by its sum of weights."""
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds, -40, 40)))


@dataclass
class Sparse:
    """Rows of few entries each: row, column and value of all of them."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    columns: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows) if len(self.row) else np.zeros(self.rows)

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.columns) if len(self.row) else np.zeros(self.columns)


def features(text: str | None, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """(columns, 1 + log(count)) of the chosen words and stems that the text has, by column."""
    n = Counter(i for own in map(places.__getitem__, WORD.findall((text or "").lower())) for i in own)
    at = sorted(n)
    return np.array(at, np.int64), 1 + np.log(np.array([n[i] for i in at], np.float64))


def matrix(found: list[tuple[np.ndarray, np.ndarray]], columns: int) -> Sparse:
    size = [len(c) for c, _ in found]
    none = [np.zeros(0)]
    return Sparse(np.repeat(np.arange(len(found)), size), np.concatenate([c for c, _ in found] or none).astype(np.int64), np.concatenate([v for _, v in found] or none), len(found), columns)


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int, *, decay: float = 3e-5, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the likelihood; thresholds are a first one and log gaps."""
    k, n = grades - 1, x.rows
    above = np.array([(grade >= g + 1).mean() for g in range(k)]).clip(1e-3, 1 - 1e-3)
    # a grade that no row has keeps a high threshold
    start = np.maximum.accumulate(np.log((1 - above) / above))
    p = np.r_[np.zeros(x.columns), start[0], np.log(np.maximum(np.diff(start), 0.1))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    row = np.arange(n)
    for step in range(1, steps + 1):
        w, first, gaps = p[: x.columns], p[x.columns], np.exp(p[x.columns + 1 :])
        theta = first + np.r_[0, np.cumsum(gaps)]
        cdf = np.c_[np.zeros(n), 1 / (1 + np.exp(-np.clip(theta - x.times(w)[:, None], -40, 40))), np.ones(n)]
        slope = cdf * (1 - cdf)
        like = np.maximum(cdf[row, grade + 1] - cdf[row, grade], 1e-12)
        up, down = slope[row, grade + 1] / like, slope[row, grade] / like
        g_theta = np.array([((grade == j) * -up + (grade == j + 1) * down).mean() for j in range(k)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.r_[x.transposed_times(up - down) / n + decay * w, tail[0], tail[1:] * gaps]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[: x.columns], p[x.columns] + np.r_[0, np.cumsum(np.exp(p[x.columns + 1 :]))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000, words: int = 20_000, chi2: float = 6.63, seen: int = 5, label: str = "toxic", quality: str = "quality", scratch: Scratch | None = None) -> OrdinalModel:
    """Chooses words (in ``seen`` texts of the sample at least, signed chi-squared from ``chi2`` on, the ``words`` greatest; ties by
    the word) and fits the regression. A document labelled twice has its graver grade. Without two classes in the sample, or
    without a word that goes with either, the model has thresholds only and gives every text the sample's toxic share."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    poor = F.coalesce(F.col(quality) == 0, F.lit(False)) if quality in labels.columns else F.lit(False)
    # null labels stay null and are left out
    graded = labels.select("doc_id", F.when(F.col(label) == 1, 1 + poor.cast("int")).otherwise(F.col(label) * 0).alias("_grade"))
    sample = labelled_sample(docs, graded, "_grade", scratch, rows=rows, name="sample").dropDuplicates(["_text", "_label"])  # copies would make chance words look telling

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for t, y in zip(b["_text"].to_pylist(), b["_label"].to_pylist(), strict=True):
                n[int(y > 0)].update({f for w in set(WORD.findall((t or "").lower())) for f in forms(w)})
            every = n[0] | n[1]
            yield pa.RecordBatch.from_pydict({"word": pa.array(every, pa.string()), "clean": pa.array((n[0][w] for w in every), pa.int64()), "toxic": pa.array((n[1][w] for w in every), pa.int64())})

    sizes = {r[0]: r[1] for r in sample.groupBy((F.col("_label") > 0).cast("int")).count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = min(max(toxic / max(1, clean + toxic), 1e-6), 1 - 1e-6)
        return OrdinalModel([], np.zeros(0), np.array([np.log((1 - share) / share), 40.0]))
    counts = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(clean + toxic)
    cross = b * (clean - a) - a * (toxic - b)
    score = n * cross * cross / ((a + b) * (n - a - b) * clean * toxic)
    chosen = counts.where((F.col("a") + F.col("b") >= seen) & (F.col("a") + F.col("b") < n)).select("word", score.alias("s"))
    found = chosen.where(F.col("s") >= chi2).orderBy(F.desc("s"), "word").limit(words).collect()
    vocabulary = [r["word"] for r in found]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(vocabulary)
        for b in batches:
            found = [features(t, places) for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"at": pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary()), "x": pa.array([v.tobytes() for _, v in found], pa.binary()), "y": b["_label"]})

    got = sample.mapInArrow(rows_of, "at binary, x binary, y int").toPandas().sort_values(["at", "x", "y"])
    scratch.drop("sample")
    found = [(np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(v)) for c, v in zip(got["at"], got["x"], strict=True)]
    weights, thresholds = fit_ordinal(matrix(found, len(vocabulary)), got["y"].to_numpy(), 3)
    return OrdinalModel(vocabulary, weights, thresholds)


def severity(model: OrdinalModel, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, severity (expected grade, 0 to 2), p_toxic, grade (likeliest), toxic (p_toxic >= 0.5).

    A null text is an empty one and scores as a text without any of the words. Rows are independent; other
    columns are not read. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        places = Places(model.words)
        for b in batches:
            x = matrix([features(t, places) for t in b["_text"].to_pylist()], len(model.words))
            above = model.above(x.times(model.weights))
            each = -np.diff(np.c_[np.ones(b.num_rows), above, np.zeros(b.num_rows)], axis=1)
            yield pa.RecordBatch.from_pydict({id_col: b["_id"], "severity": pa.array(above.sum(1)), "p_toxic": pa.array(above[:, 0]), "grade": pa.array(each.argmax(1).astype(np.int32)), "toxic": pa.array(above[:, 0] >= 0.5)})

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(score, f"`{id_col}` {own.schema['_id'].dataType.simpleString()}, severity double, p_toxic double, grade int, toxic boolean")
