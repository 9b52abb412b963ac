"""Operator 7, quality classifier: naive Bayes support vectors.

A text is the set of its n-grams, hashed into a fixed number of features: triples of characters, pairs of
words, and triples of word shapes (case, marks at the end, whether the word repeats the one before). Each
indicator is scaled by the log ratio of its counts in the two classes; a linear hinge-loss model is then
fitted on the scaled indicators by dual coordinate descent.

The classifier is fitted in one task on at most about ``bound`` labelled rows, chosen by a hash of their id;
every row is scored. Nothing is shuffled to score.

Defined results: NULL text is the empty text, which has no features and scores by the bias alone. NULL ids
and labels are not learned from; a document with several labels takes their mean, 1 from 0.5 on. Without
rows of both classes all weights are 0 and the score is the (smoothed) share of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from contest_panel.llm.common import filter_texts, map_texts

FEATURES = 1 << 18
BOUND = 6_000
_MASK = np.uint32(FEATURES - 1)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found = [_mix(points[:-2] * np.uint32(2654435761) + points[1:-1] * np.uint32(2246822519) + points[2:] * np.uint32(3266489917))]
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start):
        # A word's hash is the sum of its characters, each times a power for its place in the word.
        inside = np.arange(len(points)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(points)]))
        power = _POWERS[inside % len(_POWERS)]
        signed = np.where(blank, np.uint32(0), points * power)
        word = np.add.reduceat(signed, start, dtype=np.uint32)
        found.append(_mix(word[:-1] * np.uint32(40503) + word[1:] * np.uint32(668265263) + np.uint32(1)))
        last = points[end - 1]
        marks = np.where((last < 128) & ~_ALNUM[np.minimum(last, 127)], last, 0)
        head = points[start]
        upper = (head >= 65) & (head <= 90)
        long_enough = end - start > 1
        second = points[np.minimum(start + 1, len(points) - 1)]
        loud = long_enough & (second >= 65) & (second <= 90)
        again = np.r_[False, word[1:] == word[:-1]]
        shape = (marks * np.uint32(8) + upper * np.uint32(4) + loud * np.uint32(2) + again * np.uint32(1)).astype(np.uint32)
        padded = np.r_[np.uint32(7777), shape, np.uint32(7777)].astype(np.uint32)
        found.append(_mix(padded[:-2] * np.uint32(97) + padded[1:-1] * np.uint32(1597334677) + padded[2:] * np.uint32(374761393) + np.uint32(2)))
    return np.unique(np.concatenate(found))


_ALNUM = np.array([chr(i).isalnum() for i in range(128)])
_POWERS = np.cumprod(np.full(64, 16777619, np.uint32), dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    return (h ^ (h >> np.uint32(13))) & _MASK


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per feature, already times the log-count ratio
    bias: float

    def margin(self, text: str) -> float:
        return float(self.weights[features(text)].sum()) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(2 * np.array([self.margin(t) for t in texts]), -40, 40)))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss on scaled indicators with a bias column."""
    sign = np.where(labels == 1, 1.0, -1.0)
    share = float((labels == 1).mean())
    upper = np.where(labels == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
    norms = np.array([float(np.square(ratio[r]).sum()) + 1.0 for r in rows])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at = rows[i]
            scale = ratio[at]
            gradient = sign[i] * (float(weights[at] @ scale) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[at] += step * scale
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step) * norms[i])
        if moved < 1e-3:
            break
    return weights, bias


def fit_rows(texts: list[str], labels: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 0) -> Model:
    rows = [features(t) for t in texts]
    good = int((labels == 1).sum())
    if not good or good == len(rows):
        return Model(np.zeros(FEATURES), math.log((good + 1) / (len(rows) - good + 1)))
    counts = np.ones((2, FEATURES))
    for row, label in zip(rows, labels):
        counts[int(label == 1), row] += 1
    share = counts / counts.sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio /= max(1e-9, math.sqrt(float(np.mean([np.square(ratio[r]).sum() for r in rows]))))
    weights, bias = descend(rows, labels, ratio, cost, epochs, seed)
    return Model((weights * ratio), bias)


def fit(frame: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = BOUND) -> Model:
    """Fit on rows of ``frame`` labelled in ``labels``; counts the labels, then fits in one task (two actions)."""
    votes = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    )
    share = min(1.0, bound / max(1, votes.count()))
    chosen = votes.filter(F.pmod(F.xxhash64("__key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    few = frame.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__key")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = sorted((k, label, t) for b in batches for k, label, t in zip(*(b.column(i).to_pylist() for i in range(3))))
        model = fit_rows([t for _, _, t in found], np.array([label for _, label, _ in found], dtype=int))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias]})

    row = few.select("__key", "__label", "__text").repartition(1).mapInArrow(work, "weights binary, bias double").head()
    if row is None:
        return Model(np.zeros(FEATURES, np.float32), 0.0)
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def classify(frame: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``frame``: key, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` (1 from 0.5 on)."""
    kept = frame.sparkSession.sparkContext.broadcast(model)

    def work(slices: Iterator) -> Iterator[dict]:
        m = kept.value
        for batch, texts in slices:
            score = m.scores(texts)
            yield {"key": batch.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    kind = frame.schema[key].dataType.simpleString()
    return map_texts(frame, {"key": key}, text, f"key {kind}, score double, predicted int", work).withColumnRenamed("key", key)


def keep(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``frame`` that the model predicts to have label 1, with all columns."""
    kept = frame.sparkSession.sparkContext.broadcast(model)
    return filter_texts(frame, text, lambda texts: (kept.value.scores(texts) >= 0.5, {}))
