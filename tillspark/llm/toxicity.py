"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are the distinct hashes of its words, word pairs and pairs one or two
words apart. FTRL-proximal learns with a rate for each coordinate, and its L1 term leaves most
weights at exactly zero; what is broadcast is the list of the others. Fitting takes a bounded
sample of labelled rows (``per_class`` documents of each class); scoring covers every whole
text, batch by batch.

Defined results: a null or empty text has no features and scores by the bias alone; ids may be
null or repeated; empty tables give empty results; without labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import in_order, labelled_sample

BITS = 20
PER_CLASS = 4000
THRESHOLD = 0.7
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_~`"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers below 2 ** BITS, ascending."""
    words = [w.strip(_EDGES) for w in (text or "").lower().encode("utf-8", "replace").split()]
    h = np.fromiter((zlib.crc32(w) for w in words if w), dtype=np.uint64)
    if not len(h):
        return np.empty(0, dtype=np.int32)
    found = [h * _MIX[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            found.append((h[:-gap] * _MIX[1]) ^ (h[gap:] * _MIX[1 + gap]))
    mixed = np.concatenate(found)
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[0]
    return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class SparseModel:
    """Non-zero weights only; at most as many as the sample has features."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.index] = self.weight
        return w


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 8) -> SparseModel:
    """FTRL-proximal over (features, label) pairs, one example at a time, in a fixed shuffle."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs if rows else 0):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return SparseModel(at.astype(np.int32), w.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, per_class: int = PER_CLASS) -> SparseModel:
    """Fit on at most ``per_class`` documents of each class; only their features reach the driver."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "h": pdf["h"], "at": [features(t).tobytes() for t in pdf["text"]]})

    sample = labelled_sample(docs, labels, label, per_class, usable).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = in_order(sample.mapInPandas(extract, "doc_id long, y int, h long, at binary").collect())
    return fit([(np.frombuffer(r["at"], dtype=np.int32), r["y"]) for r in rows])


def score(docs: DataFrame, model: SparseModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = shared.value.dense(), shared.value.bias
        for batch in texts:
            raw = np.array([w[features(t)].sum(dtype=np.float64) + bias for t in batch], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -35, 35))))

    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*columns, scored(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
