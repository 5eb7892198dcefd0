"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of 50 words. Every passage is encoded: shares of character
classes, word lengths, repetition and a signed hashed bag of words pass through a learned tanh
layer. Gated attention, tanh(V h) * sigmoid(U h), weights the passages, and a logistic layer
scores the weighted passage representation. All layers are learned together from document
labels alone, on a bounded sample (``per_class`` documents of each class).

Defined results: a null or wordless text is one passage without features; ids may be null or
repeated; empty tables give empty results; without labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import in_order, labelled_sample

PASSAGE_WORDS, BAG, HIDDEN = 50, 32, 16
PER_CLASS = 600
#: Passages that are scored at once.
TOGETHER = 20_000
THRESHOLD = 0.7

#: Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 punctuation, 6 space, 7 newline, 8 beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~=+_/\\", b".,;:!?'\"()-", b" \t\v\f\r", b"\n"), 1):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 8
N_FEATURES = 8 + 6 + BAG


def passages(text: str | None) -> np.ndarray:
    """One row of N_FEATURES for each passage of the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    n = len(words)
    starts = np.arange(0, n, PASSAGE_WORDS)
    size = np.diff(np.append(starts, n))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=n)
    kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    # Bytes belong to the passage whose first word starts at or before them.
    blank = (kinds == 6) | (kinds == 7)
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[starts]
    first[0] = 0
    n_bytes = np.diff(np.append(first, len(raw)))
    of_class = np.stack([np.add.reduceat(kinds == k, first) for k in (1, 2, 3, 4, 5, 7, 8, 0)], axis=1) / n_bytes[:, None]
    again = np.concatenate(([0.0], hashes[1:] == hashes[:-1]))
    sums = lambda x: np.add.reduceat(x, starts)
    mean_len = sums(lengths) / size
    # Distinct words of a passage: sort each one's hashes; the padding of the last is unlike all of them.
    grid = np.full(len(starts) * PASSAGE_WORDS, -1, dtype=np.int64)
    grid[:n] = hashes
    grid.resize((len(starts), PASSAGE_WORDS))
    distinct = (np.diff(np.sort(grid, axis=1), axis=1) != 0).sum(axis=1) + 1 - (size < PASSAGE_WORDS)
    bag = np.zeros((len(starts), BAG))
    np.add.at(bag, (np.repeat(np.arange(len(starts)), size), hashes % BAG), np.where(hashes & 0x8000, 1.0, -1.0))
    shape = np.stack([mean_len / 8, sums(lengths == 1) / size, sums(lengths > 15) / size, sums(again) / size, distinct / size, np.minimum(1, size / PASSAGE_WORDS)], axis=1)
    return np.concatenate([of_class, shape, bag / np.sqrt(size)[:, None]], axis=1).astype(np.float32)


class AttentionMIL:
    """The network; ``parts`` are its arrays, small and of fixed size whatever the corpus."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        make = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.std = mean, std
        self.parts = {"W": make(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": make(HIDDEN, HIDDEN), "U": make(HIDDEN, HIDDEN), "a": make(HIDDEN), "c": np.zeros(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.parts
        x = np.clip((x - self.mean) / self.std, -6, 6)
        size = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), size)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        w = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(w[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -35, 35)))
        return score, (x, bag, h, t, g, w, z)

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, l2: float) -> dict[str, np.ndarray]:
        p = self.parts
        score, (x, bag, h, t, g, w, z) = self.forward(x, starts)
        miss = (score - y) / len(y)
        dz = miss[:, None] * p["c"]
        dw = (dz[bag] * h).sum(axis=1)
        ds = w * (dw - np.add.reduceat(w * dw, starts)[bag])
        dtg = ds[:, None] * p["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (w[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        out = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ miss, "d": np.array([miss.sum()])}
        return {k: v + (l2 * p[k] if k not in "bd" else 0) for k, v in out.items()}


def fit(bags: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.03, l2: float = 1e-4) -> AttentionMIL:
    """Adam over all bags at once."""
    if not bags:
        return AttentionMIL(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    x = np.concatenate([b for b, _ in bags]).astype(np.float64)
    y = np.array([v for _, v in bags], dtype=np.float64)
    starts = np.cumsum([0, *(len(b) for b, _ in bags[:-1])])
    model = AttentionMIL(x.mean(axis=0), x.std(axis=0) + 1e-3)
    m = {k: np.zeros_like(v) for k, v in model.parts.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.parts.items()}
    for i in range(1, steps + 1):
        for k, g in model.gradient(x, starts, y, l2).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.999 * v2[k] + 0.001 * g * g
            model.parts[k] = model.parts[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.999**i)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, per_class: int = PER_CLASS) -> AttentionMIL:
    """Fit on at most ``per_class`` documents of each class; only their passages' features reach the driver."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "h": pdf["h"], "x": [passages(t).tobytes() for t in pdf["text"]]})

    sample = labelled_sample(docs, labels, label, per_class, usable).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = in_order(sample.mapInPandas(extract, "doc_id long, y int, h long, x binary").collect())
    return fit([(np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES), r["y"]) for r in rows])


def _bags(texts: pd.Series) -> Iterator[list[np.ndarray]]:
    """The passages of whole texts, for as many texts at once as have ``TOGETHER`` passages."""
    some, size = [], 0
    for text in texts:
        some.append(passages(text))
        size += len(some[-1])
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def score(docs: DataFrame, model: AttentionMIL, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def together(bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return shared.value.forward(np.concatenate(bags), starts)[0]

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.concatenate([np.empty(0), *map(together, _bags(batch))]))

    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*columns, scored(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
