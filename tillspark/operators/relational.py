"""Filters, projections, top rows, pages and set operations (operators B, C1-C8, F and G)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_has_key(payload: Column, key: str) -> Column:
    """Whether a JSON object has ``key``, even with a null value; false for null payloads."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def active_rows(df: DataFrame, payload: str = "raw_payload", markers: Sequence[str] = ("duplicate_merge", "receipt_deleted")) -> DataFrame:
    """Rows without a soft-delete marker."""
    return df.where(~reduce(or_, [json_has_key(F.col(payload), m) for m in markers]))


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """One condition for each argument that is given; None asks for nothing."""
    given = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(and_, given)) if given else df


def like_escaped(text: str) -> str:
    """A literal for LIKE with backslash escapes."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains(c: Column, text: str, escaped: bool = True) -> Column:
    """Case-insensitive contains; unescaped keeps ``%`` and ``_`` as wildcards."""
    return c.ilike(f"%{like_escaped(text) if escaped else text}%")


def ilike_any(c: Column, patterns: Sequence[str]) -> Column:
    """B12."""
    return reduce(or_, [c.ilike(p) for p in patterns], F.lit(False))


def search(df: DataFrame, items: DataFrame, query: str, fields: Sequence[str], key: str, item_key: str, item_name: str) -> DataFrame:
    """Every word must occur in the joined fields or in the name of one of the row's items.

    One pass over the items for all words, reduced to a flag for each word before the join.
    """
    words = query.split()
    if not words:
        return df
    flags = items.groupBy(F.col(item_key).alias("_key")).agg(*[F.bool_or(contains(F.col(item_name), w)).alias(f"_w{i}") for i, w in enumerate(words)])
    text = F.concat_ws(" ", *fields)
    hit = reduce(and_, [contains(text, w) | F.coalesce(f"_w{i}", F.lit(False)) for i, w in enumerate(words)])
    return df.join(flags, F.col(key) == F.col("_key"), "left").where(hit).select(*df.columns)


def in_month(c: Column, month: str) -> Column:
    """Half-open month range, ``month`` as yyyy-mm."""
    start = F.to_date(F.lit(f"{month}-01"))
    return (c >= start) & (c < F.add_months(start, 1))


def month_of_path(path: Column) -> Column:
    """The yyyy-mm folder of a path, or null."""
    found = F.regexp_extract(path, r"(?:^|/)(\d{4}-(?:0[1-9]|1[0-2]))/", 1)
    return F.when(found != "", found)


def requires_review(*flags: Column, status: Column) -> Column:
    """Any flag set, nulls as unset, or a status other than complete."""
    return reduce(or_, [F.coalesce(f, F.lit(False)) for f in flags], status != "complete")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. ``order`` must name a total order.

    Planned with a group limit before the shuffle, so a hot key sends one row from each task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unique_or_null(c: Column) -> Column:
    """The value if the group has exactly one distinct one."""
    return F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))


def page(df: DataFrame, sort: str, descending: bool, allowed: Sequence[str], tie: str, limit: int, offset: int = 0) -> DataFrame:
    """one page in a whitelisted order, nulls last, ties by id."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500 and offset not negative")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(key, F.col(tie)).offset(offset).limit(limit)


def union_missing(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """G1: all of ``first`` and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: side, n and the columns. One aggregation, no sort of whole tables."""
    sided = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    counts = sided.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return counts.select(F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"), *a.columns)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets."""
    return row_differences(a, b).isEmpty()
