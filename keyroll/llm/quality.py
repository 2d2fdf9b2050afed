"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Features of a text are hashed n-grams of two views of its words: the words
themselves (one and two in a row) and their shapes (letters, digits and marks,
with a sign for a word equal to the one before). Each view's counts are divided
by their number, so a score is a sparse dot product of frequencies.

Training reads a bounded sample of labelled rows (``SAMPLE``) in ``SHARDS``
parts; each part runs follow-the-regularised-leader updates (L1 keeps the
weights sparse) and the parts' weights are averaged. The weights are an array
of ``2 ** BITS`` numbers whatever the input, so they can be broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.llm.common import sized, store
from keyroll.llm.shingles import mixed, word_hashes_as_written

BITS = 18
SAMPLE = 12_000
SHARDS = 4
EPOCHS = 4
# Follow-the-regularised-leader: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 0.1, 1e-4, 1e-4
# Frequencies are small numbers; the common factor of all features.
GAIN = 8.0
PREDICT = 0.3

_SIZE = 1 << BITS
_K = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """'Hello,' -> 'Aa,', 'ABC!!' -> 'A!', '12:30' -> '9:9'."""
    def letters(m: re.Match) -> str:
        t = m[0]
        return "A" if t.isupper() else "a" if t.islower() else "Aa"
    out = _DIGIT.sub("9", _UPPER.sub(letters, word))
    return re.sub(r"([^\w])\1+", r"\1", out)[:12]


class _ShapeHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(shape(word.decode()))
        return value


_SHAPES = _ShapeHash()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; none for a text without words."""
    words, h = word_hashes_as_written(text or "")
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.float64)
    s = np.fromiter(map(_SHAPES.__getitem__, words), dtype=np.uint64, count=n)
    same = np.zeros(n, dtype=np.uint64)
    same[1:] = h[1:] == h[:-1]
    s = s + same * np.uint64(0xC2B2AE3D27D4EB4F)
    views = [h, h[:-1] * _K + h[1:], s * _K + np.uint64(1), (s[:-1] * _K + s[1:]) * _K + np.uint64(2)]
    views = [v for v in views if len(v)]
    index = mixed(np.concatenate(views)) & np.uint64(_SIZE - 1)
    value = np.concatenate([np.full(len(v), GAIN / len(v)) for v in views])
    return index.astype(np.int64), value


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """Follow-the-regularised-leader with per-feature rates; feature ``_SIZE``
    is the constant term."""

    def __init__(self):
        self.z, self.n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, where = np.unique(index, return_inverse=True)
        value = np.bincount(where, weights=value, minlength=len(index))
        index, value = np.append(index, _SIZE), np.append(value, 1.0)
        w = self.weights(index)
        g = (_sigmoid(float(w @ value)) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1):
    ``2 ** BITS`` and the constant. About ``sample`` labels are used, those with
    the smallest hashes, so they can be sent to the documents; a doc_id counts
    once. Without labelled documents all weights are 0."""
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = labels.count()
    limit = int(min(1.0, sample / max(total, 1)) * (1 << 31))
    order = F.expr("shiftrightunsigned(xxhash64(doc_id), 33)")
    chosen = store(labels.withColumn("o", order).filter(F.col("o") < limit if total > sample else F.lit(True)), "labels")
    rows = docs.select("doc_id", "text").join(sized(chosen), "doc_id").groupBy("doc_id", "o", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumn("shard", (F.col("o") % SHARDS).cast("int"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl()
        part = part.sort_values(["o", "doc_id"])
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(part)):
                model.update(*features(part["text"].iloc[i]), int(part["label"].iloc[i]))
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        return pd.DataFrame({"i": kept, "w": w[kept]})

    parts = rows.groupBy("shard").applyInPandas(fit, "i long, w double")
    out = np.zeros(_SIZE + 1)
    for r in parts.groupBy("i").agg((F.sum("w") / SHARDS).alias("w")).collect():  # at most 2 ** BITS + 1 rows
        out[r["i"]] = r["w"]
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``score`` of every row, whole texts. A null text is empty;
    a text without words gets the score of the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = []
            for t in batch.column(1):
                index, value = features(t.as_py())
                scores.append(_sigmoid(float(w[index] @ value) + w[_SIZE]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")
