"""Quality rules: simple counts, then content and boilerplate lines told apart by a linear-chain CRF.

Every line with a word gets a vector of shape features. A conditional random field over the
sequence (one weight per state and feature, one per pair of neighbouring states) is learned
from labelled documents: lines of good documents are mostly content, lines of bad ones mostly
boilerplate; which ones are not is found by decoding and learning again.
Viterbi decoding marks the lines of every whole text, and a document is kept if its content
lines hold at least ``MIN_CONTENT`` of the characters of all its lines. Fitting takes a bounded
sample (``per_class`` documents of each class); with no labels the prior weights stand.

Defined results: a null, empty or wordless text has no words and fails the base rules. Ids may
be null or repeated, empty tables give empty results, and other columns pass through; a column
that has the name of an added one is replaced, unless a prefix gives the added ones other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import in_order, labelled_sample

PER_CLASS = 400
#: Bytes of text that a class brings to the fit at most, lines in a piece of a sequence, and the lean towards a document's label.
MAX_BYTES, PIECE, TRUST = 2 << 20, 128, 2.0
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: States of a line.
BOILERPLATE, CONTENT = 0, 1

FEATURES = ("bias", "symbols", "many symbols", "capitals", "digits", "short", "long", "same word again", "ends a sentence", "seen above", "few distinct words", "long words", "short words", "bars", "exclamations")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    size, n = len(line), len(words)
    symbols = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) / size
    text = line.decode("utf-8", "replace")
    upper = sum(map(str.isupper, text)) if text != text.lower() else 0
    digits = sum(map(line.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    mean = sum(map(len, words)) / n
    return [
        1.0, symbols > 0.02, symbols > 0.08, upper > 0.5 * size, digits > 0.1, n < 5, n > 40, again > 0.2,
        words[-1][-1:] in (b".", b"!", b"?", b":"), seen, n >= 8 and len(set(words)) < 0.5 * n, mean > 12, mean < 2.5,
        line.count(b"|") / size > 0.02, line.count(b"!") / size > 0.05,
    ]


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and characters of each line that has a word, over the whole text."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        if words := line.split():
            rows.append(line_features(line, words, line in seen))
            sizes.append(sum(map(len, words)))
            seen.add(line)
    return np.array(rows, dtype=np.float32).reshape(-1, len(FEATURES)), np.array(sizes, dtype=np.int64)


def _prior() -> np.ndarray:
    """Weights of state CONTENT before any label is seen; BOILERPLATE has their opposites."""
    w = dict.fromkeys(FEATURES, 0.0)
    w |= {"bias": 0.7, "symbols": -0.5, "many symbols": -1.0, "capitals": -1.0, "same word again": -1.0, "ends a sentence": 0.3, "seen above": -0.5, "few distinct words": -0.5, "bars": -0.5, "exclamations": -0.5}
    return np.array(list(w.values()))


@dataclass
class LineCRF:
    """emit: state x feature; move: state x next state."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray, lean: np.ndarray | float = 0.0) -> list[int]:
        """The most probable sequence of states (Viterbi); ties go to the lower state. ``lean`` is added to each line's scores."""
        (m00, m01), (m10, m11) = self.move.tolist()
        scores = (x @ self.emit.T + lean).tolist()
        if not scores:
            return []
        a, b = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            from0, from1 = b + m10 > a + m00, b + m11 > a + m01
            a, b = e0 + (b + m10 if from0 else a + m00), e1 + (b + m11 if from1 else a + m01)
            back.append((from0, from1))
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = int(step[state])
            states.append(state)
        return states[::-1]


def untaught() -> LineCRF:
    return LineCRF(np.stack([-_prior(), _prior()]) / 2, np.array([[0.3, -0.3], [-0.3, 0.3]]))


class Lattice:
    """Sequences by time step, the longest first: step t holds line t of every sequence that has one.

    Nothing is padded, so the size is that of the lines, and a step is one vector operation.
    """

    def __init__(self, sequences: list[tuple[np.ndarray, np.ndarray]]):
        sequences = sorted(sequences, key=lambda s: -len(s[0]))
        size = np.array([len(x) for x, _ in sequences])
        self.active = np.array([(size > t).sum() for t in range(size[0])])
        self.offset = np.cumsum(self.active) - self.active
        owner = np.repeat(np.arange(len(size)), size)
        t = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        at = self.offset[t] + owner
        self.x = np.empty((len(owner), sequences[0][0].shape[1]), dtype=np.float32)
        self.x[at] = np.concatenate([x for x, _ in sequences])
        self.y = np.empty(len(owner), dtype=np.int64)
        self.y[at] = np.concatenate([y for _, y in sequences])
        self.owner = np.empty(len(owner), dtype=np.int64)
        self.owner[at] = owner
        self.last = self.offset[size - 1] + np.arange(len(size))
        # Lines with one before them, and that one.
        self.later = np.arange(self.active[0], len(owner))
        self.before = np.concatenate([self.offset[k - 1] + np.arange(self.active[k]) for k in range(1, len(self.active))] or [np.empty(0, dtype=np.int64)])

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each state meets each feature, and each next state, as labelled."""
        move = np.bincount(2 * self.y[self.before] + self.y[self.later], minlength=4).reshape(2, 2)
        return np.stack([self.x[self.y == s].sum(axis=0, dtype=np.float64) for s in (0, 1)]), move.astype(float)

    def expected(self, crf: LineCRF) -> tuple[np.ndarray, np.ndarray, float]:
        """The same as the model expects it, by forward and backward sums, and the log of its total."""
        e = self.x @ crf.emit.T
        ahead, behind = e.copy(), np.zeros_like(e)
        move = crf.move
        for t in range(1, len(self.active)):
            now, old = slice(self.offset[t], self.offset[t] + self.active[t]), slice(self.offset[t - 1], self.offset[t - 1] + self.active[t])
            ahead[now] += np.logaddexp(ahead[old, :1] + move[0], ahead[old, 1:] + move[1])
        for t in range(len(self.active) - 1, 0, -1):
            now, old = slice(self.offset[t], self.offset[t] + self.active[t]), slice(self.offset[t - 1], self.offset[t - 1] + self.active[t])
            come = e[now] + behind[now]
            behind[old] = np.logaddexp(come[:, :1] + move[:, 0], come[:, 1:] + move[:, 1])
        z = np.logaddexp(ahead[self.last, 0], ahead[self.last, 1])
        p = np.exp(ahead + behind - z[self.owner, None])
        come = (e + behind)[self.later] - z[self.owner[self.later], None]
        pair = np.exp(ahead[self.before][:, :, None] + move + come[:, None, :])
        return p.T @ self.x, pair.sum(axis=0), float(z.sum())


def _fitted(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int, rate: float, l2: float) -> LineCRF:
    """Maximum likelihood of labelled lines by Adam, with a Gaussian prior around the prior weights."""
    crf, prior = untaught(), untaught().emit
    pieces = [(x[k : k + PIECE], y[k : k + PIECE]) for x, y in sequences for k in range(0, len(x), PIECE)]
    lattice = Lattice(pieces)
    want_emit, want_move = lattice.wanted()
    total = len(lattice.y)
    params = [crf.emit, crf.move]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        emit, move, _ = lattice.expected(crf)
        grads = [(emit - want_emit) / total + l2 * (crf.emit - prior), (move - want_move) / total + l2 * crf.move]
        for k, (param, g) in enumerate(zip(params, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            param -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return crf


def fit(sequences: list[tuple[np.ndarray, int]], steps: int = 120, rate: float = 0.1, l2: float = 0.02, rounds: int = 2, trust: float = TRUST) -> LineCRF:
    """Lines take their document's label first; then the model that this gives decodes them with a
    lean of ``trust`` towards that label, and learns from the states it finds, changes of state included.

    Sequences are cut into pieces of ``PIECE`` lines for learning, so the longest text is a few steps.
    """
    labelled = [(x, np.full(len(x), y)) for x, y in sequences if len(x)]
    crf = untaught()
    for k in range(rounds if labelled else 0):
        crf = _fitted(labelled, steps, rate, l2)
        if k + 1 < rounds:
            labelled = [(x, np.array(crf.decode(x, trust * np.eye(2)[y]))) for x, y in sequences if len(x)]
    return crf


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, per_class: int = PER_CLASS) -> LineCRF:
    """Fit on at most ``per_class`` documents of each class; only line features reach the driver."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "h": pdf["h"], "x": [lines_of(t)[0].astype(bool).tobytes() for t in pdf["text"]]})

    sample = labelled_sample(docs, labels, label, per_class, usable, MAX_BYTES).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = in_order(sample.mapInPandas(extract, "doc_id long, y int, h long, x binary").collect())
    return fit([(np.frombuffer(r["x"], dtype=bool).reshape(-1, len(FEATURES)).astype(np.float32), r["y"]) for r in rows])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of eight words that occur twice or more in the text, the first included.

    Windows get exact names by doubling: of words, of two, four and eight of them.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    name = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    step = 1
    while step < window:
        pairs = name[: len(name) - step] * (name.max() + 1) + name[step:]
        name = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    often = np.bincount(name)[name] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += often
    edge[window : window + n] -= often
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    at = np.frombuffer(raw, dtype=np.uint8)
    chars = int(((at & 0xC0) != 0x80).sum() - _SPACE[at].sum())
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and x.strip()]
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed


def content_share(text: str | None, crf: LineCRF) -> float:
    x, size = lines_of(text)
    if not len(x):
        return 0.0
    states = np.array(crf.decode(x))
    return float(size[states == CONTENT].sum() / size.sum())


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, crf: LineCRF, text: str = "text", min_content: float = MIN_CONTENT, prefix: str = "") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``content_share`` and ``kept``, each under its name after ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = [x.split()[0] for x in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                base = counts(t)
                share = content_share(t, shared.value)
                rows.append((*base, share, not base[-1] and share >= min_content))
            yield pd.DataFrame(rows, columns=names)

    columns = [c for c in docs.columns if c not in [prefix + n for n in names]]
    out = docs.select(*columns, judged(F.col(text)).alias("_ll_judged"))
    return out.select(*columns, *[F.col(f"_ll_judged.{n}").alias(prefix + n) for n in names])
