"""Captured pages: matching lines to boxes, evidence lines and reference items.

These folds depend on order, so each has a plain function over one page or text and a column or
table form that runs it in Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fuzzy import one_to_one

# Least ratio and number of evidence lines; longest overlap of two pages in lines.
RELEVANT, MOST_LINES, MOST_OVERLAP = 0.65, 3, 25


def alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def name_uuid(namespace: str, name: Column) -> Column:
    """The deterministic UUID (version 5) of a name."""
    space = uuid.UUID(namespace)

    @F.pandas_udf("string")
    def made(names: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else str(uuid.uuid5(space, n)) for n in names], dtype="object")

    return made(name)


def evidence_lines(lines: Sequence[str], item: str, least: float = RELEVANT, most: int = MOST_LINES) -> list[tuple[int, float]]:
    """Positions of the lines most like an item, best first, ties in order."""
    scored = [(i, alike(item.lower(), line.lower())) for i, line in enumerate(lines)]
    return sorted((s for s in scored if s[1] >= least), key=lambda s: (-s[1], s[0]))[:most]


def with_evidence_lines(df: DataFrame, item: str, lines: str) -> DataFrame:
    """I28 over a table: ``evidence`` holds positions and ratios for each row's item and lines."""

    @F.pandas_udf("array<struct<line: int, ratio: double>>")
    def found(items: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"line": i, "ratio": r} for i, r in evidence_lines(x, n)] if n is not None and x is not None else [] for n, x in zip(items, texts, strict=True)])

    return df.withColumn("evidence", found(F.col(item), F.col(lines)))


def boxes_for_lines(lines: Sequence[str], detected: Sequence[str], least: float = 0.5) -> dict[int, int]:
    """Each line in turn takes the unused detected line that is most like it."""
    free, out = dict(enumerate(detected)), {}
    for i, line in enumerate(lines):
        best = max(free, key=lambda j: (alike(line, free[j]), -j), default=None)
        if best is not None and alike(line, free[best]) >= least:
            out[i] = best
            del free[best]
    return out


def overlap(upper: Sequence[str], lower: Sequence[str], least: float = 0.85, most: int = MOST_OVERLAP) -> int:
    """How many lines at the end of one page come again at the start of the next, the most that fit."""
    for n in range(min(len(upper), len(lower), most), 0, -1):
        if all(alike(a, b) >= least for a, b in zip(upper[-n:], lower[:n], strict=True)):
            return n
    return 0


def joined_pages(pages: Sequence[Sequence[str]]) -> list[str]:
    """The lines of all pages, overlaps once."""
    out: list[str] = []
    for page in pages:
        out += page[overlap(out, page) :]
    return out


def completeness(pages: Sequence[Sequence[str]], reconciled: bool) -> str:
    """Complete, or possible_page_gap where pages do not overlap and the sums do not fit."""
    gaps = any(overlap(a, b) == 0 for a, b in zip(pages, pages[1:], strict=False))
    return "possible_page_gap" if gaps and not reconciled else "complete"


def scan_completeness(pages: DataFrame, key: str, order: str, lines: str, reconciled: str) -> DataFrame:
    """I19/I20 over a table of pages: joined text and status of each document; a document's pages are one group."""
    grouped = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, lines))).alias("pages"), F.bool_and(reconciled).alias("fits"))

    @F.pandas_udf("text string, status string")
    def judged(sets: pd.Series, fits: pd.Series) -> pd.DataFrame:
        rows = []
        for of, fit in zip(sets, fits, strict=True):
            texts = [list(p[lines]) for p in of]
            rows.append(("\n".join(joined_pages(texts)), completeness(texts, bool(fit))))
        return pd.DataFrame(rows, columns=["text", "status"])

    return grouped.select(key, judged("pages", "fits").alias("r")).select(key, "r.*")


def supplement(primary: str, others: Sequence[str], wanted: Sequence[str] = ("subtotal", "tax", "total", "visa", "mastercard", "debit")) -> str:
    """I32: summary and payment lines that only other readings have are added at the end, each kind once."""
    low, extra = primary.lower(), []
    for word in wanted:
        if word not in low:
            line = next((x for text in others for x in text.split("\n") if word in x.lower()), None)
            if line is not None and line not in extra:
                extra.append(line)
    return "\n".join([primary, *extra])


def match_items(expected: Sequence[tuple[Sequence[str], object]], actual: Sequence[tuple[str, object]]) -> dict[int, int]:
    """Expected items (aliases, amount) one to one with actual ones (name, amount)."""
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    edges = {i: [j for j, (name, amount) in enumerate(actual) if amount == want and plain(name) in {plain(a) for a in aliases}] for i, (aliases, want) in enumerate(expected)}
    return one_to_one(edges)


def matched_items(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """D27 over tables (key, name, amount): items of each case that are found, expected and given.

    A case's items are one group; names compare without case and punctuation.
    """

    def matched(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pairs = match_items([([n], m) for n, m in zip(a["name"], a["amount"], strict=True)], list(zip(b["name"], b["amount"], strict=True)))
        return pd.DataFrame({key: [k[0]], "expected": [len(a)], "given": [len(b)], "matched": [len(pairs)]})

    kind = expected.schema[key].dataType.simpleString()
    return expected.groupBy(key).cogroup(actual.groupBy(key)).applyInPandas(matched, f"{key} {kind}, expected long, given long, matched long")


def cached_or_missing(queries: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Answers that have not run out, and the queries that need a new one.

    Answers are good for 90 days, empty ones for an hour.
    """
    until = F.col("fetched_at") + F.when(F.col("result").isNotNull(), F.expr("INTERVAL 90 DAYS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    fresh = cache.where(until > now)
    return queries.join(fresh, "query"), queries.select("query").distinct().join(fresh.select("query"), "query", "left_anti")


