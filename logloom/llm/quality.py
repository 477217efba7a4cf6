"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import bounded_sample, held_out, read, with_columns

BITS = 18
_WORDS = re.compile(r"\S+").findall
_SLICE = 1 << 18


class _Word(dict):
    """Hash (upper bits) and shape (lower 8 bits) of words; forgotten when there are too many.

    The shape tells a word's length class and whether it has letters, digits, other characters, a final stop or comma.
    """

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        low = word.lower()
        shape = min(len(low), 15) // 2 | any(map(str.isalpha, low)) << 3 | any(map(str.isdigit, low)) << 4 | (not low.strip(".,;:!?").isalnum()) << 5 | (low[-1] in ".!?") << 6 | (low[-1] == ",") << 7
        made = self[word] = xxhash.xxh64_intdigest(low) & ~0xFF | shape
        return made


_word = _Word()


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def indicators(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text: words, word pairs, and one to three word shapes with a flag for a repeat of the word before."""
    words = _WORDS(text) if text else []
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, len(words), _SLICE):
        codes = np.fromiter(map(_word.__getitem__, words[max(0, at - 2) : at + _SLICE]), np.uint64)
        h, shape = codes >> np.uint64(8), codes & np.uint64(0xFF)
        shape[1:] |= (h[1:] == h[:-1]).astype(np.uint64) << np.uint64(8)
        seen[_mix(h, 1)] = True
        seen[_mix(shape, 2)] = True
        seen[_mix(h[1:] * np.uint64(31) ^ h[:-1], 3)] = True
        pair = shape[1:] << np.uint64(9) | shape[:-1]
        seen[_mix(pair, 4)] = True
        seen[_mix(pair[1:] << np.uint64(9) | shape[:-2], 5)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class QualityModel:
    """Weight of each n-gram in a row of unit length, and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = indicators(text)
        margin = self.bias + (self.weight[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1.0 / (1.0 + np.exp(-margin)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 2) -> tuple[np.ndarray, float]:
    """Minimise |w|^2/2 + sum cost_i * hinge(y_i, w.x_i), one dual variable at a time; x_i is scale at the row's n-grams over the row's
    root of length, and a constant 1. Returns the weights (with the scale in them) and the bias."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    value = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([v @ v + 1.0 for v in value])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (value[i] @ w[rows[i]] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * value[i]
                bias += step
                alpha[i] = new
    return w * scale, bias


def train(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0) -> QualityModel:
    """Log-count ratios of the n-grams, then the linear model on the indicators that they scale. One class only: its share is the score's bias."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(rows) or len(set(y)) < 2:
        return QualityModel(np.zeros(1 << BITS), 0.0 if not len(rows) else float(4 * y[0]))
    count = {s: np.full(1 << BITS, smoothing) for s in (1.0, -1.0)}
    for r, s in zip(rows, y, strict=True):
        count[s][r] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    share = {s: len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    return QualityModel(*dual_coordinate_descent(rows, y, ratio, np.array([cost * share[s] for s in y])))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_train: int = 8_000, max_train_chars: int = 64_000_000) -> QualityModel:
    """Learn from a bounded sample: about max_train labelled rows, chosen by a hash of the key, fewer where their texts would pass
    max_train_chars together. Null keys, texts and labels teach nothing; of a key's several labels the greatest counts."""
    known = bounded_sample(labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y")), F.col("k"), max_train, 2)
    few = F.broadcast(known)  # about max_train rows at most
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(few, "k")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars > max_train_chars:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(22), "k"), F.lit(2**32)) < int(max_train_chars / chars * 2**32))

    def features(batches):
        for batch in batches:
            found = [indicators(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["k", "found", "y"])

    got = rows.select("k", "t", F.col("y").cast("int").alias("y")).mapInArrow(features, f"k {docs.schema[key].dataType.simpleString()}, found binary, y int").toArrow().to_pandas().sort_values("k", kind="stable")
    return train([np.frombuffer(b, np.int32) for b in got.found], got.y.to_numpy())


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to every row, by its whole text; null and empty texts get the bias's score.

    Repeated rows get the same score; extra columns pass; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        made = np.array([shared.value.score(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))], np.float64)
        return [made, (made >= 0.5).astype(np.int32)]

    return with_columns(docs, "score double, predicted int", run)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    labels = read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1))
    return score(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
