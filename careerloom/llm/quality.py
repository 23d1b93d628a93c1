"""Quality: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader updates.

The n-grams are single words and pairs of neighbours, over the words and over
their shapes (letters folded to a or A, digits to 0, runs to one sign). A pair
of equal neighbours is one n-gram whatever the word. A text is the vector of
square roots of its n-grams' shares, a sparse row of length one; its score is a
sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from careerloom.llm.common import batches_of, fitted, labelled_sample, rows_of, scored

BITS = 18
_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if b >= 128 or 97 <= b <= 122 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Codes(dict):
    """Word -> (hash of the word, hash of its shape) in one integer; bounded by starting over."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        shape = word.translate(_SHAPE)
        runs = _RUN.sub(rb"\1", shape)
        code = zlib.crc32(word.lower()) << 31 | zlib.crc32(runs) >> 1
        if len(word) <= 64:
            self[word] = code
        return code


_codes = _Codes()
_SAME = np.uint32(0x5BD1E995)


def _mixed(a: np.ndarray, b: np.ndarray | int, kind: int, bits: int) -> np.ndarray:
    h = (a * np.uint32(0x9E3779B1)) ^ (b + np.uint32(kind * 0x7FEB352D & 0xFFFFFFFF))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values; both empty for a text without words."""
    words = text.encode("utf-8", "replace").split() if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    codes = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
    word, shape = (codes >> 31).astype(np.uint32), (codes & 0x7FFFFFFF).astype(np.uint32)
    pairs = np.where(word[1:] == word[:-1], _SAME, _mixed(word[:-1], word[1:], 2, 32))
    grams = [
        _mixed(word, np.uint32(0), 1, bits),
        _mixed(pairs, np.uint32(0), 2, bits),
        _mixed(shape, np.uint32(0), 3, bits),
        _mixed(shape[:-1], shape[1:], 4, bits),
    ]
    at, n = np.unique(np.concatenate(grams), return_counts=True)
    return at.astype(np.int32), np.sqrt(n / n.sum()).astype(np.float32)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        at, x = features(text)
        z = self.bias + float(self.weights[at] @ x)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    bits: int = BITS,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    epochs: int = 3,
    seed: int = 11,
) -> Model:
    """One weight per bucket, per-coordinate rates, rows in a fixed shuffled order; the last slot is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i][0], 1 << bits)
            x = np.append(rows[i][1], 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000) -> Model:
    """Fits on at most ``max_rows`` labelled rows, taken by the hash of their ids; none gives score 0.5."""
    return fitted(labelled_sample(docs, labels, label_col, max_rows), features, train)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, whole texts. A text without words gets the bias alone."""
    return scored(rows_of(docs, id_col, text_col), id_col, text_col, model)


def keep(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([shared.value.score(t.as_py()) >= least for t in text], pa.bool_()))

    return batches_of(docs, run, docs.schema)
