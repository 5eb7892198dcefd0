"""Repeated 100-byte strings over the whole corpus, by a distributed difference cover.

A difference cover modulo 57 has eight residues such that for any two positions some offset
below 57 puts both on a residue of the cover. Suffixes are sampled at those positions only
(14 % of them), which is what the algorithm's triples do modulo 3.

1. Sampled suffixes are sorted by their first 44 bytes (100 - 57 + 1, what any 100-byte string
   holds after a sample among its first 57 positions); equal tuples get equal names. Wherever a
   100-byte string repeats, one offset below 57 is sampled in both places, with equal names: a
   position with no repeated name at the samples that follow within 57 bytes is settled here.
2. On what is left the order is refined: samples are sorted by their surroundings of 156 bytes,
   which hold every 100-byte string around the sample's tuple. All but the first of equal
   neighbours settle 57 positions at once. Along a long repeat both places are sampled together
   once in 57 bytes, so this empties its inside.
3. The remaining suffixes, at the edges of repeats and in first occurrences, are merged: sorted
   by a short name of their 100 bytes, which drops those that meet nobody, and the few that are
   left by the 100 bytes themselves; adjacent prefixes are compared byte by byte.

The order only has to bring equal strings together, so names are polynomial fingerprints over
a random table of byte values, sorted as numbers. In steps 1 and 3 a short name (32 bits inside
its bucket, with some million names at any size of the corpus) is a filter: a wrong match costs
work and changes nothing. Step 2 decides by 64 bits inside a bucket that an independent
fingerprint picks: with n samples and n / 2 ** 21 buckets a wrong match has a chance of about
n * 2 ** -44 in 2 ** 22 (below 1e-6 for 30 GB).

Texts are packed into chunks of consecutive documents. Every round sends the sorted, distinct
names of a chunk, dealt to buckets, and gets one bit for each back; a string that fills a third
of the corpus is one name in each chunk. Buckets are sized by a count of what is sent, so none
outgrows a task. Each round leaves only the stretches that are still open.

Defined results: null and empty texts have no bytes, nothing removed and the digest of nothing.
Repeated rows and rows of one id are one after the other in the order of their text, so a copy
with the same id counts as later; rows without an id come first. Empty tables give empty
results; other columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

LENGTH = 100
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
TUPLE = LENGTH - PERIOD + 1
AROUND = LENGTH + PERIOD - 1
CHUNK_BYTES = 4 << 20
#: Bytes of names that a bucket may hold, on average.
BUCKET_BYTES = 8 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_VALUES = np.random.default_rng(57).integers(1, 2**63, (2, 256), dtype=np.uint64)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

CHUNKS = "chunk long, part int, ids binary, has_id binary, sizes binary, body binary"
KEY = ["chunk", "part"]


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of consecutive documents, known by their place: the range partition and a count in it."""
    some, size, part = [], 0, 0
    chunk = TaskContext.get().partitionId()

    def packed() -> pd.DataFrame:
        ids = np.array([0 if i is None else i for i, _ in some], dtype=np.int64)
        has = np.array([i is not None for i, _ in some], dtype=bool)
        sizes = np.array([len(b) for _, b in some], dtype=np.int64)
        return pd.DataFrame([(chunk, part, ids.tobytes(), has.tobytes(), sizes.tobytes(), b"".join(b for _, b in some))], columns=["chunk", "part", "ids", "has_id", "sizes", "body"])

    for pdf in batches:
        for doc, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"], strict=True):
            body = (text or "").encode("utf-8", "replace")
            if some and size + len(body) > CHUNK_BYTES:
                yield packed()
                some, size, part = [], 0, part + 1
            some.append((None if doc is None else int(doc), body))
            size += len(body)
    if some:
        yield packed()


_powers_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; those for a usual chunk are kept."""
    known = _powers_known.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if len(known) <= CHUNK_BYTES + 1:
            _powers_known[base] = known
    return known[:n]


class Hashes:
    """Fingerprints of the strings of a body, from sums over its prefixes."""

    def __init__(self, body: bytes, family: int = 0):
        at, base = np.frombuffer(body, dtype=np.uint8), _BASES[family]
        self.sums = np.zeros(len(at) + 1, dtype=np.uint64)
        np.multiply(_VALUES[family][at], _powers(base, len(at)), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        self.back = _powers(pow(base, -1, 1 << 64), len(at) + 1)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def samples(sizes: np.ndarray) -> np.ndarray:
    """Positions on the cover, counted within each document, whose tuple ends inside the document."""
    if not sizes.sum():
        return np.empty(0, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return np.flatnonzero(_IN_COVER[within % PERIOD] & (within + TUPLE <= np.repeat(sizes, sizes)))


# What a row sends in a round: 64 bits that deal each string to a bucket, and its name there.
Sent = tuple[np.ndarray, np.ndarray]


def short_names(prints: np.ndarray) -> Sent:
    return prints, prints.astype(np.uint32)


def _dealt(deal: np.ndarray, buckets: int) -> np.ndarray:
    return ((deal >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct(sent: Sent, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, name), ascending: the bucket and first index of each, and where each string is among them."""
    bucket, names = _dealt(sent[0], buckets), sent[1]
    if names.dtype == np.uint32:
        names = bucket << np.uint64(32) | names
        order = np.argsort(names)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.diff(names[order]) != 0
    else:
        order = np.lexsort((names, bucket))
        b, n = bucket[order], names[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    return bucket[first], first, inverse


def _messages(row, sent: Sent, buckets: int, repeated: bool) -> Iterator[tuple]:
    """A chunk's distinct names, one row for each bucket; with ``repeated``, a bit for those it repeats itself."""
    if sent[1].dtype == np.uint32:  # which string a short name stands for is not asked
        keys, counts = np.unique(_dealt(sent[0], buckets) << np.uint64(32) | sent[1], return_counts=True)
        bucket, names, again = keys >> np.uint64(32), keys.astype(np.uint32), counts > 1
    else:
        bucket, first, inverse = _distinct(sent, buckets)
        names, again = sent[1][first], np.bincount(inverse, minlength=len(first)) > 1
    dealt, cuts = np.unique(bucket, return_index=True)
    for a, b in zip(cuts, [*cuts[1:], len(bucket)][: len(dealt)], strict=True):
        yield row.chunk, row.part, int(bucket[a]), names[a:b].tobytes(), np.packbits(again[a:b]).tobytes() if repeated else b""


def _answers(dtype: str, repeated: bool):
    """For each chunk's names of a bucket, a bit: repeated anywhere, or seen in an earlier chunk."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(KEY, kind="stable")
        names = [np.frombuffer(x, dtype=dtype) for x in pdf["names"]]
        sizes = [len(x) for x in names]
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")  # equal names stay in the order of chunks
        same = every[order[1:]] == every[order[:-1]]
        bits = np.zeros(len(every), dtype=bool)
        bits[order[1:]] = same
        if repeated:
            bits[order[:-1]] |= same
            bits |= np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool) for x, n in zip(pdf["again"], sizes, strict=True)])
        ends = np.cumsum(sizes)
        return pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "bucket": pdf["bucket"], "n": sizes, "bits": [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]})

    return answer


NAMES = "chunk long, part int, bucket int, names binary, again binary"
ANSWER = "chunk long, part int, bucket int, n int, bits binary"


class Round:
    """One sort over the corpus: what each row sends, the names' type, and what a bit means."""

    def __init__(self, send: Callable[[object], Sent], dtype: str, repeated: bool, strings: int):
        self.send, self.dtype, self.repeated = send, dtype, repeated
        self.buckets = int(max(64, strings * np.dtype(dtype).itemsize // BUCKET_BYTES + 1))

    def answers(self, rows: DataFrame) -> DataFrame:
        """(chunk, part, bits): the answers to what each row sends."""

        def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    found = list(_messages(row, self.send(row), self.buckets, self.repeated))
                    if found:
                        yield pd.DataFrame(found, columns=["chunk", "part", "bucket", "names", "again"])

        answers = rows.mapInPandas(sent, NAMES).groupBy("bucket").applyInPandas(_answers(self.dtype, self.repeated), ANSWER)
        # As many rows a chunk as there are buckets.
        return answers.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("bits"))

    def flags(self, row) -> np.ndarray:
        """For each string that the row sends, whether its bit is set or, without ``repeated``, the chunk itself has it earlier."""
        sent = self.send(row)
        _, first, inverse = _distinct(sent, self.buckets)
        if not len(first):
            return np.empty(0, dtype=bool)
        found = np.concatenate([np.unpackbits(np.frombuffer(b["bits"], dtype=np.uint8), count=b["n"]) for b in row.bits]).astype(bool)[inverse]
        return found if self.repeated else found | (first[inverse] != np.arange(len(inverse)))


# A row of stretches holds the parts of a chunk where repeats are still possible, one after the
# other: starts in the chunk's body, sizes, starts in their documents, bytes, and the count of strings.
STRETCHES = "chunk long, part int, at binary, sizes binary, offset binary, body binary, n long"
SPANS = "first binary, stop binary"


def _stretches(body: bytes, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Runs of positions that stay, with all bytes of their strings: starts, sizes and bytes."""
    step = np.diff(np.concatenate(([0], alive.astype(np.int8), [0])))
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = b - a + LENGTH - 1
    return a, size, b"".join(body[x : x + n] for x, n in zip(a.tolist(), size.tolist(), strict=True))


def _covered(total: int, marked: np.ndarray, before: int, after: int) -> np.ndarray:
    """Positions from ``before`` ahead of a marked one up to ``after`` behind it."""
    edge = np.bincount(np.maximum(marked - before, 0), minlength=total + 1) - np.bincount(marked + after + 1, minlength=total + 1)
    return np.cumsum(edge)[:-1] > 0


def _sampled(row) -> Sent:
    return short_names(Hashes(row.body).of(samples(np.frombuffer(row.sizes, dtype=np.int64)), TUPLE))


def _possible(row, flags: np.ndarray) -> tuple | None:
    """Stretches of a chunk: a string may repeat only if some sample inside it has a name that does."""
    sizes = np.frombuffer(row.sizes, dtype=np.int64)
    total, starts = len(row.body), np.cumsum(sizes) - sizes
    alive = _covered(total, samples(sizes)[flags], LENGTH - TUPLE, 0) & (np.arange(total) + LENGTH <= np.repeat(starts + sizes, sizes))
    # Runs end with their documents, as the last positions of each are not alive.
    at, size, body = _stretches(row.body, alive)
    # The document of a stretch is the last that starts at or before it; an empty one starts where the next does.
    offset = at - starts[np.searchsorted(starts, at, side="right") - 1]
    return (row.chunk, row.part, at.tobytes(), size.tobytes(), offset.tobytes(), body, int(alive.sum())) if len(at) else None


class _Within:
    """A row of stretches by byte: the place in its stretch, the stretch's size and its start in the chunk."""

    def __init__(self, row):
        sizes = np.frombuffer(row.sizes, dtype=np.int64)
        self.here = np.arange(len(row.body)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.size = np.repeat(sizes, sizes)
        self.at = np.repeat(np.frombuffer(row.at, dtype=np.int64), sizes)
        self.sizes = sizes

    def starts(self) -> np.ndarray:
        """Whether a string of LENGTH bytes starts here."""
        return self.here + LENGTH <= self.size

    def spans(self, gone: np.ndarray) -> tuple[bytes, bytes]:
        """The bytes of the strings that start at ``gone``, as maximal runs in the chunk."""
        where = np.flatnonzero(gone)
        if not len(where):
            return b"", b""
        place = self.at[where] + self.here[where]
        fresh = np.concatenate(([True], place[1:] > place[:-1] + LENGTH))
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(place) - 1)
        return place[fresh].tobytes(), (place[last] + LENGTH).tobytes()

    def left(self, row, alive: np.ndarray) -> tuple:
        """The stretches of the positions that stay."""
        cut, size, body = _stretches(row.body, alive)
        return (self.at[cut] + self.here[cut]).tobytes(), size.tobytes(), body, int(alive.sum())


def _surrounded(row, w: _Within) -> np.ndarray:
    """Samples with all of their surroundings in the stretch; the cover counts positions in documents."""
    on = _IN_COVER[(w.here + np.repeat(np.frombuffer(row.offset, dtype=np.int64), w.sizes)) % PERIOD]
    return np.flatnonzero(on & (w.here >= PERIOD - 1) & (w.here + LENGTH <= w.size))


def _around(row) -> Sent:
    starts = _surrounded(row, _Within(row)) - (PERIOD - 1)
    return Hashes(row.body, 1).of(starts, AROUND), Hashes(row.body).of(starts, AROUND)


def _inside(row, flags: np.ndarray) -> tuple:
    """Spans around samples whose surroundings occur earlier, and the stretches that stay open."""
    w = _Within(row)
    gone = _covered(len(row.body), _surrounded(row, w)[flags], PERIOD - 1, 0)
    return (row.chunk, row.part, *w.spans(gone), *w.left(row, ~gone & w.starts()))


def _open_prints(row) -> np.ndarray:
    return Hashes(row.body).of(np.flatnonzero(_Within(row).starts()), LENGTH)


def _open(row) -> Sent:
    return short_names(_open_prints(row))


def _open_bytes(row) -> Sent:
    starts = np.flatnonzero(_Within(row).starts())
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(row.body, dtype=np.uint8), LENGTH)[starts]
    return Hashes(row.body).of(starts, LENGTH), np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()


def _company(row, flags: np.ndarray) -> tuple | None:
    """The stretches of positions whose short name is not alone."""
    w = _Within(row)
    alive = w.starts()
    alive[alive] = flags
    return (row.chunk, row.part, *w.left(row, alive)) if alive.any() else None


def _edges(row, flags: np.ndarray) -> tuple | None:
    """Spans of the strings that occur earlier, byte for byte."""
    w = _Within(row)
    gone = w.starts()
    gone[gone] = flags
    return (row.chunk, row.part, *w.spans(gone)) if gone.any() else None


def _each(step: Round, make: Callable, schema: str):
    """``make(row, flags)`` for every row that brings its answers, without those that give nothing."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                # A row that sent nothing has no answers.
                out = make(row, step.flags(row) if row.bits is not None else np.empty(0, dtype=bool))
                if out is not None:
                    yield pd.DataFrame([out], columns=names)

    return rows


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"


def _merged(firsts: list[bytes | None], stops: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of several lists as maximal runs."""
    first, stop = (np.concatenate([np.frombuffer(x or b"", dtype=np.int64) for x in side]) for side in (firsts, stops))
    order = np.lexsort((stop, first))
    first, stop = first[order], np.maximum.accumulate(stop[order])
    fresh = np.concatenate(([True], first[1:] > stop[:-1])) if len(first) else np.empty(0, dtype=bool)
    return first[fresh], stop[np.append(np.flatnonzero(fresh)[1:] - 1, len(first) - 1)] if len(first) else stop


def _results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            ids, has = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.has_id, dtype=bool)
            sizes = np.frombuffer(row.sizes, dtype=np.int64)
            first, stop = _merged([row.first, row.first2], [row.stop, row.stop2])
            ends = np.cumsum(sizes)
            # A span may run on into the next document only if both touch: cut it there.
            rows = []
            lo = np.searchsorted(stop, ends - sizes, side="right")
            hi = np.searchsorted(first, ends, side="left")
            for k, (doc, known, size, end) in enumerate(zip(ids.tolist(), has.tolist(), sizes.tolist(), ends.tolist(), strict=True)):
                begin = end - size
                cut = [(max(int(first[j]), begin) - begin, min(int(stop[j]), end) - begin) for j in range(lo[k], hi[k])] if size else []
                kept, at = [], begin
                for a, b in cut:
                    kept.append(row.body[at : begin + a])
                    at = begin + b
                kept.append(row.body[at:end])
                rows.append((doc if known else None, size, sum(b - a for a, b in cut), len(cut), [{"start": a, "stop": b} for a, b in cut], b"".join(kept)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and the kept bytes of every row of ``docs``.

    With ``digest`` the kept bytes are given as the hexadecimal ``kept_sha256`` instead.
    """
    made: list[DataFrame] = []

    def table(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    def after(rows: DataFrame, step: Round, make: Callable, schema: str, name: str, how: str = "inner") -> DataFrame:
        """What ``make`` leaves of ``rows`` once the answers of ``step`` are known."""
        bits = table(step.answers(rows), f"{name}-bits")
        return table(rows.join(bits, KEY, how).mapInPandas(_each(step, make, schema), schema), name)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)]
    ordered = plain.repartitionByRange(int(max(8, total // (16 << 20) + 1)), *order).sortWithinPartitions(*order, "text")
    chunks = table(ordered.mapInPandas(_pack, CHUNKS), "suffix-chunks")
    strings = lambda df: df.agg(F.sum("n")).head()[0] or 0

    key = "chunk long, part int"
    open_ = f"{key}, at binary, sizes binary, body binary, n long"
    first = Round(_sampled, "u4", True, total * len(COVER) // PERIOD)
    possible = after(chunks.select(*KEY, "sizes", "body"), first, _possible, STRETCHES, "suffix-possible")
    around = Round(_around, "u8", False, strings(possible) * len(COVER) // PERIOD)
    inside = after(possible, around, _inside, f"{key}, {SPANS}, at binary, sizes binary, body binary, n long", "suffix-inside", "left")
    rest = inside.select(*KEY, "at", "sizes", "body", "n").where("n > 0")
    meet = after(rest, Round(_open, "u4", True, strings(rest)), _company, open_, "suffix-meet")
    edges = after(meet, Round(_open_bytes, f"S{LENGTH}", False, strings(meet)), _edges, f"{key}, {SPANS}", "suffix-edges")

    spans = inside.select(*KEY, "first", "stop").join(edges.select(*KEY, F.col("first").alias("first2"), F.col("stop").alias("stop2")), KEY, "left")
    out = chunks.join(spans, KEY, "left").mapInPandas(_digests if digest else _results, DIGEST if digest else RESULT)
    result = written(out, "suffix-result")
    drop(*made)
    return result


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for out in _results(batches):
        out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
        yield out.drop(columns=["spans", "kept"])
