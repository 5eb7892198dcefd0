"""URL rules looked up in cascades of Bloom filters, JVM-side and without a join.

A rule is a host and a path prefix that ends in ``/``, written ``example.net/en/``. It fits
its host and every subdomain. A url therefore has few candidate keys: each suffix of its host
with each prefix of its path, no deeper than the deepest rule. These keys, over the whole
corpus, are the key universe. Level 0 of a cascade encodes the listed keys; level 1 the
unlisted keys of the universe that level 0 lets through; level 2 the listed keys that level 1
lets through; and so on until nothing is let through wrongly. Over that universe the first
level that rejects a key says exactly whether it is listed.

Sizes: level 0 takes about 1.44 * log2(universe / listed) bits for each listed key, so that
as many keys come through as are listed; later levels take a few bits a key. A cascade thus
grows with the list and only by the logarithm with the corpus. What the driver packs and
ships is checked against ``max_filter_bytes``; beyond that the keys are split by hash into
segments, each with a cascade of its own, and the urls are judged segment by segment.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and
the default verdict; repeated rows are judged alike; other columns pass through untouched, and
one that has the name of an added column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop, written

#: Bytes that one filter may have.
MAX_FILTER_BYTES = 16 << 20

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def candidate_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All rule strings that would fit: longest first, ties in text order.

    ``labels`` and ``depth`` are the largest found in the rules, so that no rule is missed.
    """
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    # "/a/b/c" splits to ["", a, b, c]: the first n pieces and a slash are a prefix if n < size.
    prefixes = F.when(
        F.startswith(path, F.lit("/")),
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(depth))),
            lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.transform(
        F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))),
        lambda s: s["k"],
    )


@dataclass
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether every probed bit is set. The filter is bound once; each probe reads one byte of it."""

        def probed(bits: Column) -> Column:
            found = F.lit(True)
            for j in range(self.hashes):
                at = F.pmod(F.xxhash64(key, F.lit(self.seed + j)), F.lit(self.size))
                byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
                found = found & (F.getbit(byte, (at % 8).cast("int")) == 1)
            return found

        return F.exists(F.array(F.lit(bytearray(self.bits))), probed)


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Exact membership for every key of the universe."""
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.holds(key) & ~found
        return found

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def key_table(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """A short list as a table with the column ``key``."""
    values = F.array(*map(F.lit, keys)).cast("array<string>")
    return spark.range(1).select(F.explode(values).alias("key"))


#: 64-bit words of a filter that one row brings to the driver.
_BLOCK = 1024


def bits_for(n: int, rate: float) -> tuple[int, int]:
    """Hashes and bits of a filter of ``n`` keys that lets through ``rate`` of the others."""
    hashes = max(1, math.ceil(-math.log2(rate)))
    return hashes, max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)


def _level(keys: DataFrame, n: int, rate: float, seed: int, max_bytes: int) -> Level:
    """A Bloom filter of ``n`` keys: bits are OR-ed into words by an aggregation, and words packed into blocks.

    The driver gets one row of 8 KiB for each block.
    """
    hashes, size = bits_for(n, rate)
    if size // 8 > max_bytes:
        raise ValueError(f"a filter of {size // 8} bytes is over the bound of {max_bytes}: use more segments")
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed + j)), F.lit(size)) for j in range(hashes)]))
    marks = keys.select(at.alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits")
    )
    every = marks.unionByName(keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    of_block = F.array_sort(F.collect_list(F.struct("word", "bits")))
    text = F.array_join(F.transform(of_block, lambda w: F.lpad(F.hex(w["bits"]), 16, "0")), "")
    blocks = words.groupBy(F.floor(F.col("word") / _BLOCK).alias("block")).agg(F.unhex(text).alias("body")).collect()
    packed = b"".join(np.frombuffer(r["body"], dtype=">u8").astype("<u8").tobytes() for r in sorted(blocks, key=lambda r: r["block"]))
    return Level(packed, size, hashes, seed)


@dataclass
class Listed:
    """Keys of a list, as a table and counted, and the kind of key of the universe that they are."""

    keys: DataFrame
    n: int
    kind: int


def build_cascades(lists: list[Listed], universe: DataFrame, max_filter_bytes: int) -> list[Cascade]:
    """A cascade for each list, exact over the keys (``kind``, ``key``) of the universe and the list.

    The universe is read twice, whatever the number of lists: to be counted, and for the keys that
    the first level of any list lets through.
    """
    n_all = {r["kind"]: r["n"] for r in universe.groupBy("kind").agg(F.approx_count_distinct("key").alias("n")).collect()}
    rates = [min(0.5, max(1e-12, x.n / max(1, n_all.get(x.kind, 0)))) for x in lists]
    cascades = [Cascade([_level(x.keys, x.n, rate, 0, max_filter_bytes)] if x.n else []) for x, rate in zip(lists, rates, strict=True)]
    lets_through = lambda i: (F.col("kind") == lists[i].kind) & cascades[i].levels[0].holds(F.col("key"))
    some = [i for i, x in enumerate(lists) if x.n]
    if not some:
        return cascades
    # About as many unlisted keys as listed ones come through a first level.
    through = written(universe.where(reduce(or_, map(lets_through, some))).distinct(), "bloom-through")
    for i in some:
        wrong = written(through.where(lets_through(i)).select("key").join(lists[i].keys, "key", "left_anti"), "bloom-wrong")
        inside, outside, made = lists[i].keys, wrong, [wrong]
        while n := outside.count():
            level = _level(outside, n, 0.5, 1000 * len(cascades[i].levels), max_filter_bytes)
            cascades[i].levels.append(level)
            # What the new level lets through of the other side is what the next one encodes.
            missed = written(inside.where(level.holds(F.col("key"))), "bloom-missed")
            made.append(missed)
            inside, outside = outside, missed
        drop(*made)
    drop(through)
    return cascades


def build_cascade(listed: DataFrame, universe: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """A cascade for the ``key`` column of ``listed``, exact over ``universe`` and ``listed``."""
    keys = listed.select("key").where("key is not null").distinct()
    return build_cascades([Listed(keys, keys.count(), 0)], universe.select(F.lit(0).alias("kind"), "key"), max_filter_bytes)[0]


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]],
    blocked_hosts: DataFrame,
    max_filter_bytes: int = MAX_FILTER_BYTES,
    segments: int | None = None,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages`` (which has a ``url``).

    rules: (verdict, rule) pairs; the longest rule that fits decides, a block among equals.
    blocked_hosts: one column ``key`` with host names; where no rule fits, a url whose host or
    parent domain is among them is blocked and any other allowed. A list whose first level might
    be over ``max_filter_bytes`` is split by hash into as many ``segments`` as that takes.
    """
    spark = pages.sparkSession
    rules = list(rules)
    if bad := [r for _, r in rules if "/" not in r or not r.endswith("/")]:
        raise ValueError(f"rules need a host and a path that ends in a slash: {bad}")
    labels = max([1, *(r.split("/")[0].count(".") + 1 for _, r in rules)])
    depth = max([1, *(r.count("/") for _, r in rules)])
    blocked_hosts = written(blocked_hosts.select("key").where("key is not null").distinct(), "blocked-hosts")
    n_hosts, host_labels = blocked_hosts.agg(F.count("key"), F.max(F.size(F.split("key", r"\.")))).head()
    host_labels = host_labels or 1

    host, path = host_and_path(F.col("url"))
    seen = pages.select(host.alias("host"), path.alias("path"))
    of_kind = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    path_keys = candidate_keys(F.col("host"), F.col("path"), labels, depth)
    host_keys = candidate_keys(F.col("host"), F.lit("/"), host_labels, 1)
    universe = seen.select(F.explode(F.concat(of_kind(0, path_keys), of_kind(1, host_keys))).alias("k")).select("k.*")

    if segments is None:  # 40 hashes are the most that a first level has
        segments = max(1, math.ceil(max(n_hosts, len(rules)) * 40 / math.log(2) / 8 / max_filter_bytes))
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(segments))
    of_verdict = lambda verdict: sorted({r for v, r in rules if v == verdict})
    tables = [(key_table(spark, r), len(r), 0) for r in (of_verdict("block"), of_verdict("allow"))]
    tables.append((blocked_hosts.select(F.concat("key", F.lit("/")).alias("key")), n_hosts, 1))
    lists = []
    for keys, n, kind in tables:
        if segments > 1:
            counted = {r["part"]: r["n"] for r in keys.groupBy(part(F.col("key")).alias("part")).agg(F.count("key").alias("n")).collect()}
        lists.append([Listed(keys, n, kind)] if segments == 1 else [Listed(keys.where(part(F.col("key")) == i), counted.get(i, 0), kind) for i in range(segments)])
    built = iter(build_cascades([x for of in lists for x in of], universe, max_filter_bytes))
    cascades = [[next(built) for _ in of] for of in lists]

    def member(of: list[Cascade], key: Column) -> Column:
        if segments == 1:
            return of[0].holds(key)
        found = F.lit(False)
        for i, cascade in enumerate(of):
            found = F.when(part(key) == i, cascade.holds(key)).otherwise(found)
        return found

    blocks, allows, in_list = (partial(member, of) for of in cascades)
    fits = F.get(F.filter(path_keys, lambda k: blocks(k) | allows(k)), F.lit(0))
    return (
        pages.drop("host", "path", "rule", "verdict")
        .withColumns({"host": host, "path": path})
        .withColumn("rule", fits)
        .withColumn(
            "verdict",
            F.when(F.col("rule").isNull(), F.when(F.exists(host_keys, in_list), "block").otherwise("allow"))
            .when(blocks(F.col("rule")), "block")
            .otherwise("allow"),
        )
    )
