"""Merging new rows into tables without a table format (operators L). Each result is a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], protected: Column | None = None, keep_if_set: Sequence[str] = ()) -> DataFrame:
    """L1: incoming rows replace current ones with their key; others are added.

    ``protected`` rows of ``current`` stay as they are; ``keep_if_set`` columns keep a value that
    they have. One full outer join on the key; incoming keys must be unique.
    """
    columns = current.columns
    rest = [c for c in columns if c not in keys]
    old = current.select(*keys, F.struct(*rest).alias("_old"), (protected if protected is not None else F.lit(False)).alias("_protected"))
    new = incoming.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, list(keys), "full")
    stays = F.col("_new").isNull() | F.coalesce("_protected", F.lit(False))
    merged = [F.when(stays, F.col(f"_old.{c}")).otherwise(F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in keep_if_set else F.col(f"_new.{c}")).alias(c) for c in rest]
    return both.select(*keys, *merged).select(*columns)


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L2."""
    return current.unionByName(incoming.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """L3: all children of the parents that come in are replaced."""
    return current.join(incoming.select(parent).distinct(), parent, "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """L4: each row that breaks a check, with the check's name; nulls pass, as SQL checks do."""
    names = F.array_compact(F.array(*[F.when(~rule, name) for name, rule in rules.items()]))
    return df.withColumn("violation", F.explode(names))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """L4: children without a parent."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def version_token(*columns: Column) -> Column:
    """A digest of a row's state, for optimistic checks before a change is applied."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def plan_work(candidates: DataFrame, states: DataFrame, key: str, max_attempts: int = 3) -> DataFrame:
    """Done, retry, exhausted or pending for each candidate by its stored state."""
    known = states.select(key, "status", "attempts")
    plan = F.when(F.col("status") == "complete", "skip").when(F.col("attempts") >= max_attempts, "exhausted").when(F.col("status") == "failed", "retry").otherwise("pending")
    return candidates.join(known, key, "left").withColumn("plan", plan)


def retry_delay(attempts: Column) -> Column:
    """A10: seconds before the next try, doubling from one minute to an hour."""
    return F.least(F.lit(3600), F.lit(60) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6)))).cast("long")


def next_state(states: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The state after a batch of events: attempts go up with each start, the last event decides."""
    order = F.struct("occurred_at", "id")
    fold = events.groupBy(key).agg(F.count_if(F.col("status") == "active").alias("_starts"), F.max_by("status", order).alias("_status"), F.max("occurred_at").alias("_at"))
    joined = states.join(fold, key, "full")
    return joined.select(
        key,
        F.coalesce("_status", "status").alias("status"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("_starts", F.lit(0))).cast("long").alias("attempts"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )


def propagate_deletion(expenses: DataFrame, evidence: DataFrame) -> DataFrame:
    """A purchase is deleted if it has evidence and all of it is."""
    flags = evidence.groupBy("expense_pk").agg(F.bool_and("deleted").alias("_deleted"))
    return expenses.join(flags, F.col("id") == F.col("expense_pk"), "left").drop("expense_pk").withColumn("deleted", F.coalesce("_deleted", F.lit(False))).drop("_deleted")


def changed(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose values differ, before and after."""
    a = before.select(key, F.struct(*columns).alias("before"))
    b = after.select(key, F.struct(*columns).alias("after"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))
