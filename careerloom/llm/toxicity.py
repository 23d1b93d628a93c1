"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

A text is the set of hashed n-grams of its characters (A-Z in lower case). The
ratio of a bucket compares how often toxic and other training texts have it;
logistic regression is fitted on the set's indicator values times the ratios,
so a rare but telling n-gram starts with its full weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from careerloom.llm.common import fitted, labelled_sample, rows_of, scored

BITS = 18
SIZES = (3, 4, 5)
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32


def buckets(text: str | None, bits: int = BITS, step: int = 1 << 20) -> np.ndarray:
    """Distinct buckets of the character n-grams of a text; long texts are hashed piece by piece."""
    if not text:
        return np.empty(0, np.int32)
    seen = []
    for start in range(0, len(text), step):
        part = text[start : start + step + max(SIZES) - 1]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
        h = np.zeros(len(c), np.uint32)
        for k in range(max(SIZES)):
            n = len(c) - k
            if n <= 0:
                break
            h = (h[:n] + c[k : k + n] + np.uint32(1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 in SIZES:
                seen.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32))
    return np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int32)


class Model:
    """Weights per bucket (ratios already multiplied in), the bias, and the classes' rate."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        at = buckets(text)
        z = self.bias + float(self.weights[at].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _calibrated(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back sums, by Newton steps."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    centre, width = z.mean(), z.std() or 1.0
    x = np.column_stack([(z - centre) / width, np.ones(len(z))])
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        t -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * t)
    return float(t[0] / width), float(t[1] - t[0] * centre / width)


def train(
    rows: list[np.ndarray],
    labels: np.ndarray,
    bits: int = BITS,
    smooth: float = 0.5,
    least: float = 5.0,
    epochs: int = 6,
    rate: float = 0.1,
    held_back: float = 0.25,
    seed: int = 7,
) -> Model:
    """Ratios and logistic regression over the given bucket sets; without both labels a constant.

    Ratios of buckets within ``least`` standard deviations of chance become zero.
    The last ``held_back`` share of the rows only calibrates the scores.
    """
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    kept = len(rows) - int(len(rows) * held_back)
    if y[:kept].min() == y[:kept].max():
        kept = len(rows)
    counts = np.full((2, 1 << bits), smooth)
    for at, label in zip(rows[:kept], labels):
        counts[int(label), at] += 1
    texts = np.array([[kept - y[:kept].sum()], [y[:kept].sum()]]) + 2 * smooth
    ratio = np.log(counts[1] / texts[1]) - np.log(counts[0] / texts[0])
    # How far a bucket's toxic texts are from their share of all its texts, in standard deviations.
    having, share = counts.sum(axis=0) - 2 * smooth, y[:kept].mean()
    apart = (counts[1] - smooth - having * share) / np.sqrt(np.maximum(having, 1) * share * (1 - share))
    ratio[np.abs(apart) < least] = 0
    rows = [at[ratio[at] != 0] for at in rows]
    w, squares = np.ones(1 << bits), np.full(1 << bits, 1e-6)
    bias, bias_squares = float(np.log(texts[1, 0] / texts[0, 0])), 1e-6
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(kept):
            at = rows[i]
            x = ratio[at]
            error = 1 / (1 + np.exp(-np.clip(bias + float(x @ w[at]), -30, 30))) - y[i]
            g = error * x
            squares[at] += g * g
            w[at] -= rate * g / np.sqrt(squares[at])
            bias_squares += error * error
            bias -= rate * error / np.sqrt(bias_squares)
    weights = ratio * w
    sums = np.array([bias + weights[at].sum() for at in rows[kept:]])
    slope, shift = _calibrated(sums, y[kept:])
    return Model((weights * slope).astype(np.float32), bias * slope + shift)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 6000) -> Model:
    """Fits on at most ``max_rows`` labelled rows, taken by the hash of their ids."""
    return fitted(labelled_sample(docs, labels, label_col, max_rows), buckets, train)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, whole texts. Null, empty and very short texts get the bias alone."""
    return scored(rows_of(docs, id_col, text_col), id_col, text_col, model)
