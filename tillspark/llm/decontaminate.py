"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words, lower-cased and without punctuation at their ends. The CGK embedding of a
string walks along it: step j outputs the symbol under the pointer and moves on if a random bit
of that symbol and step is set. Two strings at a small edit distance walk together again after
an edit, so their outputs differ in few places. A repetition samples some output places; its
key is what stands there. Equal keys make a candidate.

Windows have the size of the benchmark items: items are put into classes by length, and the
windows of a class are as long as its shortest items allow. A class's items are embedded at
every window of theirs, the corpus only at every ``stride``-th word, so each passage holds
several windows that line up with an item's, each with ``repeats`` chances. Walks stop at the
first sampled place whose partial key no item has, so few windows are walked to the end. The
tests measure the recall at a quarter of the words edited for every length of 1 to 64 words.

A candidate is verified exactly: the word edit distance between the item and the closest
stretch of the document around the window, by dynamic programming. A document is contaminated
by an item if that is at most a quarter of the item's words (similarity 0.75).

Nothing is shuffled. The items' keys go to the executors in blocks of at most ``BLOCK_WORDS``
words, one pass over the corpus for each block, so what is broadcast has a fixed bound.

Defined results: null, empty and wordless texts and items match nothing; repeated rows give
repeated matches; ids may be null; empty tables give empty results; other columns are not used.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EDITS = 0.25
BLOCK_WORDS = 500_000
#: Shortest item of a class, window and stride in words, sampled places of the embedding, repeats.
CLASSES = ((40, 12, 4, 5, 6), (24, 8, 3, 4, 6), (14, 6, 2, 4, 6), (9, 5, 1, 4, 6), (5, 4, 1, 3, 10), (1, 1, 1, 1, 6))
CHUNK_WORDS = 200_000
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_~`"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words, none of them zero; zero is what pads a text."""
    words = [w for x in (text or "").lower().encode("utf-8", "replace").split() if (w := x.strip(_EDGES))]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) | np.uint64(1)


def places(repeat: int, window: int, sampled: int) -> np.ndarray:
    """The sampled places of one repetition, one in each equal part of the 2 * window steps that a walk needs on average."""
    draw = np.random.default_rng(1000 * repeat + window).random(sampled)
    return ((np.arange(sampled) + draw) * 2 * window / sampled).astype(np.int64)


def partial_keys(h: np.ndarray, starts: np.ndarray, repeat: int, window: int, sampled: int, known: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Walk from every start; the keys after each sampled place. With ``known`` tables of such
    keys, walks that leave them are given up; returns the starts that are left."""
    at, offset = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    key, keys, step = np.zeros(len(starts), dtype=np.uint64), [], 0
    for n, place in enumerate(places(repeat, window, sampled)):
        while step < place:
            # Word hashes are random bits: another one for each step, and another order for each repetition.
            move = (h[at + offset] >> np.uint64((11 * repeat + step) % 60 + 2)) & np.uint64(1)
            # A walk that has left its window stays on the padding after it.
            offset = np.minimum(offset + move.astype(np.int64), window)
            step += 1
        symbol = np.where(offset < window, h[at + np.minimum(offset, window - 1)], np.uint64(0))
        key = (key ^ symbol) * _MULT
        key ^= key >> np.uint64(31)
        keys.append(key)
        if known is not None:
            stay = known[n][(key >> np.uint64(65 - len(known[n]).bit_length())).astype(np.int64)]
            at, offset, key = at[stay], offset[stay], key[stay]
            keys = [key]
    return at, keys


@dataclass
class ItemClass:
    """Items of similar length, with a table of keys for each repetition."""

    window: int
    stride: int
    sampled: int
    repeats: int
    items: list[tuple[int, np.ndarray]]

    def __post_init__(self):
        self.words = [Counter(h.tolist()) for _, h in self.items]
        joined, self.origin, starts, at = [], [], [], 0
        for n, (_, h) in enumerate(self.items):
            for start in range(len(h) - self.window + 1):
                self.origin.append((n, start))
                starts.append(at + start)
            joined += [h, np.zeros(self.window, dtype=np.uint64)]
            at += len(h) + self.window
        joined, starts = np.concatenate(joined), np.array(starts, dtype=np.int64)
        # Eight places for each key keep walks short that no item has begun.
        self.bits = max(16, (8 * len(starts)).bit_length())
        self.tables, self.entries = [], []
        for r in range(self.repeats):
            _, keys = partial_keys(joined, starts, r, self.window, self.sampled)
            tables = []
            for key in keys:
                table = np.zeros(1 << self.bits, dtype=bool)
                table[(key >> np.uint64(64 - self.bits)).astype(np.int64)] = True
                tables.append(table)
            self.tables.append(tables)
            order = np.argsort(keys[-1], kind="stable")
            self.entries.append((keys[-1][order], order))


def classes_of(items: list[tuple[int, np.ndarray]]) -> list[ItemClass]:
    by = defaultdict(list)
    for item, h in items:
        for k, (least, *_rest) in enumerate(CLASSES):
            if len(h) >= least:
                by[k].append((item, h))
                break
    return [ItemClass(*CLASSES[k][1:], of) for k, of in sorted(by.items())]


def closest(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits between ``item`` and any part of ``stretch``, and that part's start and stop."""
    n = len(stretch)
    column = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, dtype=np.int64), column.copy()
    for i, word in enumerate(item.tolist(), 1):
        swap = cost[:-1] + (stretch != np.uint64(word))
        drop = cost[1:] + 1
        best = np.where(swap <= drop, swap, drop)
        from_ = np.where(swap <= drop, begin[:-1], begin[1:])
        best, from_ = np.concatenate(([i], best)), np.concatenate(([0], from_))
        # Words only in the stretch: the least of best[k] + (j - k), with the start it came from.
        lead = (best - column) * (n + 2) + np.arange(n + 1)
        k = np.minimum.accumulate(lead) % (n + 2)
        cost, begin = best[k] + column - k, from_[k]
    stop = int(cost.argmin())
    return int(cost[stop]), int(begin[stop]), stop


def allowed(n_words: int) -> int:
    return int(MAX_EDITS * n_words)


def matches(docs: list[np.ndarray], classes: list[ItemClass]) -> list[tuple[int, int, int, int, int, int]]:
    """(document number, item, edits, item words, first word, stop word) for every contaminated pair."""
    pad = max([1, *(c.window for c in classes)])
    gap = np.zeros(pad, dtype=np.uint64)
    joined = np.concatenate([x for h in docs for x in (h, gap)] or [gap])
    sizes = np.array([len(h) for h in docs], dtype=np.int64)
    starts = np.cumsum(sizes + pad) - (sizes + pad)
    best: dict[tuple[int, int], tuple] = {}
    tried: set[tuple[int, int, int]] = set()
    for c in classes:
        counts = np.maximum(0, -(-(sizes - c.window + 1) // c.stride))
        owner = np.repeat(np.arange(len(docs)), counts)
        first = np.cumsum(counts) - counts
        windows = starts[owner] + (np.arange(len(owner)) - first[owner]) * c.stride
        for r in range(c.repeats):
            at, keys = partial_keys(joined, windows, r, c.window, c.sampled, c.tables[r])
            table, order = c.entries[r]
            lo, hi = np.searchsorted(table, keys[-1], side="left"), np.searchsorted(table, keys[-1], side="right")
            for k in np.flatnonzero(hi > lo):
                doc = int(np.searchsorted(starts, at[k], side="right") - 1)
                for entry in order[lo[k] : hi[k]].tolist():
                    n, shift = c.origin[entry]
                    item, h = c.items[n]
                    place = int(at[k] - starts[doc]) - shift
                    # Places that differ by a word or two lead to the same stretch.
                    if (doc, item, place // 4) in tried:
                        continue
                    tried.add((doc, item, place // 4))
                    slack = allowed(len(h)) + 4
                    lo_word, hi_word = max(0, place - slack), min(int(sizes[doc]), place + len(h) + slack)
                    stretch = docs[doc][lo_word:hi_word]
                    # Every edit takes at most one word of the item away.
                    here = set(stretch.tolist())
                    if sum(k for w, k in c.words[n].items() if w in here) < len(h) - allowed(len(h)):
                        continue
                    edits, a, b = closest(h, stretch)
                    found = (edits, len(h), lo_word + a, lo_word + b)
                    if edits <= allowed(len(h)) and found < best.get((doc, item), (1 << 60,)):
                        best[doc, item] = found
    return [(doc, item, *found) for (doc, item), found in sorted(best.items())]


_prepared: dict[str, list[ItemClass]] = {}


def _classes(shared: Broadcast) -> list[ItemClass]:
    """The classes of a block of items, made once in each Python worker; a worker keeps those of one block."""
    name, block = shared.value
    if name not in _prepared:
        _prepared.clear()
        _prepared[name] = classes_of(block)
    return _prepared[name]


def _in_chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Words of whole texts, as many texts at once as have CHUNK_WORDS words, and the number of the first."""
    some, first, size = [], 0, 0
    for k, text in enumerate(texts):
        some.append(words_of(text))
        size += len(some[-1])
        if size >= CHUNK_WORDS:
            yield first, some
            some, first, size = [], k + 1, 0
    if some:
        yield first, some


MATCH = "doc_id long, item_id long, edits int, item_words int, start_word long, stop_word long"


def _blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of at most BLOCK_WORDS words; a longer item is a block of its own."""
    some, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null").toLocalIterator():
        h = words_of(row["t"])
        if not len(h):
            continue
        if some and size + len(h) > BLOCK_WORDS:
            yield some
            some, size = [], 0
        some.append((row["i"], h))
        size += len(h)
    if some:
        yield some


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row for each document and benchmark item that it contains: the edits and the words from start to stop."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(benchmark, text, item_id):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = pdf["doc_id"].astype("Int64")
                for first, some in _in_chunks(pdf["text"]):
                    found = matches(some, _classes(shared))
                    if found:
                        out = pd.DataFrame([f[1:] for f in found], columns=["item_id", "edits", "item_words", "start_word", "stop_word"])
                        out.insert(0, "doc_id", ids.iloc[[first + f[0] for f in found]].array)
                        yield out

        part = plain.mapInPandas(search, MATCH)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else plain.where("false").select("doc_id").selectExpr("doc_id", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in MATCH.split(", ")[1:]])


def _leaks(shared: Broadcast) -> Callable[[Column], Column]:
    """Whether a text contains an item of the block."""

    @F.pandas_udf("boolean")
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            hit = np.zeros(len(batch), dtype=bool)
            for first, some in _in_chunks(batch):
                hit[[first + f[0] for f in matches(some, _classes(shared))]] = True
            yield pd.Series(hit)

    return leaks


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that contain a benchmark item.

    Rows are judged where they are, by their text alone: nothing is shuffled, ids do not matter,
    and only texts cross to Python.
    """
    for block in _blocks(benchmark, text, item_id):
        docs = docs.where(~_leaks(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)))(F.col(text)))
    return docs
