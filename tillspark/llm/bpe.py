"""BPE encoding and decoding with a public vocabulary, by an index of pair occurrences.

The words of a batch that are not cached yet are laid out as one list of symbols. An index
maps every pair that has a merge to all its positions. The lowest active rank is applied at
all its positions, left to right; each merge only touches its two neighbours' entries. When a
merge makes a pair of a lower rank, the rest of its word waits until that rank has been
applied, so each word comes out as if it were merged alone, lowest rank and leftmost first.

Defined results: a null or empty text has no tokens and decodes to an empty text; other
columns pass through; repeated rows and empty tables need no special case.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words after which a Python worker's cache starts a new generation; the last two are kept.
CACHE_WORDS = 100_000


#: Lower-case ASCII and Latin texts, whose letters, digits and spaces the faster engine knows too.
_LATIN = re.compile("[\x00-\x7f\u00df-\u00f6\u00f8-\u024f]*")
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u024f]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


class WordBPE:
    """A lower-casing BPE vocabulary whose words end in a suffix, as a tokenizers JSON file has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        #: Rank and new symbol of each pair.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pairs: dict[int, tuple[int, int, int]] | None = None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: Ids as bytes of each word seen lately, and of those seen before; used ones move on.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Words after normalisation; lower-casing looks at single characters only."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (_LATIN_WORDS if _LATIN.fullmatch(text) else self.words).findall(text)

    def _symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        return [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word; all words are merged together through one pair index."""
        sym: list[int] = []
        owner: list[int] = []
        first: list[int] = []
        for k, word in enumerate(words):
            first.append(len(sym))
            letters = self._symbols(word)
            sym += letters
            owner += [k] * len(letters)
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for k, at in enumerate(first):
            before[at] = -1
            after[(first[k + 1] if k + 1 < len(first) else n) - 1] = -1
        merge = self.merges.get
        if self.pairs is None:
            self.pairs = {rank: (*pair, new) for pair, (rank, new) in self.merges.items()}
        pair_of = self.pairs
        index: dict[int, list[int]] = {}
        for p, found in enumerate(map(merge, zip(sym, sym[1:]))):
            if found is not None and after[p] >= 0:
                rank = found[0]
                if rank in index:
                    index[rank].append(p)
                else:
                    index[rank] = [p]
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            left, right, new = pair_of[rank]
            waiting: set[int] = set()
            positions.sort()
            for p in positions:
                q = after[p]
                if sym[p] != left or q < 0 or sym[q] != right:
                    continue
                if waiting and owner[p] in waiting:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank].append(p)
                    continue
                sym[p], sym[q] = new, -1
                after[p] = r = after[q]
                o = before[p]
                if r >= 0:
                    before[r] = p
                    if (found := merge((new, sym[r]))) is not None:
                        if found[0] in index:
                            index[found[0]].append(p)
                        else:
                            index[found[0]] = [p]
                            heapq.heappush(active, found[0])
                        if found[0] < rank:
                            waiting.add(owner[p])
                if o >= 0 and (found := merge((sym[o], new))) is not None:
                    if found[0] in index:
                        index[found[0]].append(o)
                    else:
                        index[found[0]] = [o]
                        heapq.heappush(active, found[0])
                    if found[0] < rank:
                        waiting.add(owner[p])
        out: list[list[int]] = [[] for _ in words]
        for s, k in zip(sym, owner, strict=True):
            if s >= 0:
                out[k].append(s)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; special strings in a text are their own tokens."""
        docs = []
        for text in texts:
            parts = self.specials.split(text or "") if self.specials and "<|" in (text or "") else [text or ""]
            docs.append([w for p in parts if p for w in ([p] if p in self.special else self.split(p))] if len(parts) > 1 else self.split(parts[0]))
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        cache, older, special = self.cache, self.older, self.special
        fresh = []
        for w in set(chain.from_iterable(docs)).difference(cache):
            if (known := older.get(w)) is not None:
                cache[w] = known
            elif w in special:
                cache[w] = np.array([special[w]], dtype=np.int32).tobytes()
            else:
                fresh.append(w)
        for at in range(0, len(fresh), 10_000):
            some = fresh[at : at + 10_000]
            cache.update(zip(some, [np.array(ids, dtype=np.int32).tobytes() for ids in self.merge_words(some)], strict=True))
        look = cache.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), dtype=np.int32) for words in docs]

    def decode_batch(self, rows: list[list[int]]) -> list[str]:
        """Tokens joined by spaces, as a vocabulary file without a decoder has it."""
        look = self.names.__getitem__
        return [" ".join(map(look, ids)) for ids in rows]


_loaded: dict[str, WordBPE] = {}


def vocabulary(path: str) -> WordBPE:
    """One instance a Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _chunks(texts: pd.Series, most: int = 1 << 20) -> Iterator[list]:
    """Some texts at a time, by their length; a longer text is a chunk of its own."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t) if t is not None else 0
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of every whole text; ``path`` names the vocabulary file on the executors."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for batch in batches:
            for some in _chunks(batch):
                yield pd.Series(bpe.encode_batch(some), dtype="object")

    return docs.select(*[c for c in docs.columns if c != ids], encoded(F.col(text)).alias(ids))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, len(batch), 200):
                yield pd.Series(bpe.decode_batch([[] if x is None else x.tolist() for x in batch.iloc[at : at + 200]]), dtype="object")

    return docs.select(*[c for c in docs.columns if c != text], decoded(F.col(ids)).alias(text))
