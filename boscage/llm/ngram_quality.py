"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL.

A text's features are its words and pairs of neighbouring words (runs of non-blank bytes, case
kept), hashed into ``2**bits`` places; a pair's hash comes from the difference of its words'
hashes, so a repeated word is one feature whatever the word. Values are log(1 + count), scaled to
length 1. Follow-the-regularised-leader (proximal) passes over a bounded sample of labelled rows;
scores are sparse dot products with the weights through the logistic function.

Defined cases: a null or empty text has no features and scores by the bias alone; a null doc_id
gets held_out false and never trains; repeated rows are scored alike; with no usable label, or
labels of one class only, the bias is that class's smoothed log-odds; further columns of the input
are ignored. A model is 2**bits float32 weights, whatever the input's size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold, map_batches, mix, one_row, utf8, word_hashes

BITS = 18
#: Labelled rows that a model is fitted on, at most. (Its penalties and rate were chosen by
#: cross-validation inside the training rows, tests/llm/tune_classifiers.py.)
TRAIN_ROWS = 6000
EPOCHS = 10


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and values of a text."""
    words = word_hashes(utf8(text))[0]
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    pairs = mix(words[1:] - words[:-1])
    idx, n = np.unique(np.concatenate([words, pairs]) >> np.uint64(64 - bits), return_counts=True)
    v = np.log1p(n).astype(np.float32)
    return idx.astype(np.int64), v / np.sqrt(float(v @ v))


@dataclass
class Ftrl:
    """Weights by coordinate; the last place is the bias."""

    weights: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.08, l2: float = 0.05, seed: int = 7) -> Ftrl:
        size = (1 << bits) + 1
        positive = sum(labels)
        prior = float(np.log((positive + 1.0) / (len(labels) - positive + 1.0)))
        if positive in (0, len(labels)):
            w = np.zeros(size, np.float32)
            w[-1] = prior
            return cls(w)
        z, n = np.zeros(size), np.zeros(size)

        def weight(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                idx, val = rows[k]
                idx, val = np.append(idx, size - 1), np.append(val, 1.0)
                w = weight(idx)
                p = 1.0 / (1.0 + np.exp(-np.clip(float(w @ val), -35, 35)))
                g = (p - labels[k]) * val
                sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
                z[idx] += g - sigma * w
                n[idx] += g * g
        return cls(weight(np.arange(size)).astype(np.float32))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        x = float(self.weights[idx] @ val) + float(self.weights[-1]) if len(idx) else float(self.weights[-1])
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, w=self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Ftrl:
        return cls(np.load(io.BytesIO(data))["w"])


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, rows: int = TRAIN_ROWS, seed: int = 11) -> Ftrl:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held))
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label"))
    chosen = bounded_sample(usable, rows, seed)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def fit(cols: dict[str, list]) -> bytes:
        order = sorted(range(len(cols["doc_id"])), key=lambda k: (cols["doc_id"][k], cols["text"][k] or ""))
        return Ftrl.fit([features(cols["text"][k]) for k in order], [cols["_label"][k] for k in order]).to_bytes()

    return Ftrl.from_bytes(one_row(sample, fit))


def score(docs: DataFrame, model: Ftrl, parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, without a shuffle."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        m = Ftrl(weights.value)
        for b in batches:
            s = [m.score(*features(t)) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "held_out": b["_held"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("_held"))
    return map_batches(src, ["doc_id", "text", "_held"], run, schema)
