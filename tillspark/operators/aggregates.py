"""Aggregations and windows (operators D and E)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import active_rows, unique_or_null

MONEY = "decimal(14,2)"


def category_spend(expenses: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Spend by day, category and group over active purchases; no category is Uncategorized."""
    active = active_rows(expenses).select("id", "order_date")
    lines = items.select("expense_pk", "category", "line_total").join(active, F.col("expense_pk") == F.col("id"))
    named = lines.join(categories, "category", "left")
    return named.groupBy(
        "order_date", F.coalesce("category", F.lit("Uncategorized")).alias("category"), F.coalesce("group_name", F.lit("Uncategorized")).alias("group_name")
    ).agg(
        F.sum("line_total").cast("decimal(24,2)").alias("amount"),
        F.count("line_total").alias("item_count"),
        F.count_distinct("expense_pk").alias("expense_count"),
    )


def expense_category_splits(items: DataFrame, categories: DataFrame) -> DataFrame:
    """By purchase and category; lines without a known category drop out."""
    return (
        items.join(categories, "category")
        .groupBy("expense_pk", "category")
        .agg(
            F.round(F.sum(F.coalesce("line_total", F.lit(0).cast(MONEY))), 2).cast("decimal(24,2)").alias("amount"),
            F.count(F.lit(1)).alias("item_count"),
            F.bool_or("category_requires_review").alias("requires_review"),
        )
    )


def ordered_list(value: Column, order: Sequence[Column]) -> Column:
    """The values of a group in an order; equal places follow the value."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"])


def last_value_by(value: Column, order: Sequence[Column]) -> Column:
    """The last value that is not null; nothing is gathered, unlike with a list."""
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))


def attempt_timeline(events: DataFrame) -> DataFrame:
    """One row a request and attempt: first activity, last event, first failure, last status and seconds."""
    order = [F.col("occurred_at"), F.col("id")]
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("occurred_at")))
    return events.groupBy("request_id", "attempt").agg(
        at("active").alias("started_at"),
        F.max("occurred_at").alias("last_event_at"),
        at("failed").alias("failed_at"),
        F.max_by("status", F.struct(*order)).alias("last_status"),
        last_value_by(F.when(F.col("status") == "results_published", F.col("seconds")), order).alias("published_seconds"),
        F.count(F.lit(1)).alias("events"),
    )


def status_histogram(events: DataFrame) -> DataFrame:
    """Every request once, by its latest event, in buckets that add up to the total."""
    newest = events.groupBy("request_id").agg(F.max_by("status", F.struct("attempt", F.when(F.col("status") == "queued", 0).otherwise(1), "occurred_at", "id")).alias("status"))
    is_in = lambda *s: F.count_if(F.col("status").isin(*s))
    return newest.agg(
        F.count(F.lit(1)).alias("total"),
        is_in("queued", "retried").alias("waiting"),
        is_in("active", "heartbeat").alias("running"),
        is_in("results_published").alias("completed"),
        is_in("failed").alias("failed"),
        F.count_if(~F.col("status").isin("queued", "retried", "active", "heartbeat", "results_published", "failed")).alias("unknown"),
    )


def reconciliation_sums(items: DataFrame, key: str = "expense_pk", amount: str = "line_total") -> DataFrame:
    """Sums that are null as soon as one amount of the group is null."""
    whole = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c))
    return items.groupBy(key).agg(
        whole(amount).cast("decimal(24,2)").alias("item_sum"),
        F.when(F.count_if(F.col(amount).isNull() & F.col("category").isNotNull()) == 0, F.sum(F.when(F.col("category").isNotNull(), F.col(amount)))).cast("decimal(24,2)").alias("categorized_sum"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col(amount).isNull() & F.col("category").isNotNull()).alias("categorized_missing"),
    )


def allocation_check(allocations: DataFrame, transactions: DataFrame) -> DataFrame:
    """Whether allocations add up to their transaction and share its sign."""
    sums = allocations.groupBy("transaction_id").agg(F.sum("amount").alias("allocated"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    t = transactions.select(F.col("id").alias("transaction_id"), F.col("amount").alias("transaction_amount"))
    return t.join(sums, "transaction_id").select(
        "transaction_id",
        F.col("allocated").cast("decimal(24,2)").alias("allocated"),
        (F.col("allocated") == F.col("transaction_amount")).alias("balanced"),
        F.when(F.col("transaction_amount") >= 0, F.col("lo") > 0).otherwise(F.col("hi") < 0).alias("same_sign"),
    )


def category_matrix(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Purchase by category with a total; the columns are given, so no pass finds them."""
    cells = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("line_total"))), F.lit(0)).cast("decimal(24,2)").alias(c) for c in columns]
    return items.groupBy("expense_pk").agg(*cells, F.coalesce(F.sum("line_total"), F.lit(0)).cast("decimal(24,2)").alias("total"))


def detail_with_subtotals(items: DataFrame) -> DataFrame:
    """Item amounts and a subtotal row after each purchase, as grouping sets."""
    both = items.select("expense_pk", "item_id", "line_total").rollup("expense_pk", "item_id").agg(F.sum("line_total").cast("decimal(24,2)").alias("amount"), F.grouping_id().alias("level"))
    return both.where("level < 2").select("expense_pk", F.when(F.col("level") == 0, F.col("item_id")).alias("item_id"), (F.col("level") == 1).alias("is_subtotal"), "amount")


def independent_support(observations: DataFrame, keys: Sequence[str], value: str, engine: str, least: int = 2) -> DataFrame:
    """Values that at least two engines saw."""
    return observations.groupBy(*keys, value).agg(F.count_distinct(engine).alias("engines")).where(F.col("engines") >= least)


def time_weighted(samples: DataFrame, key: str, at: str, value: str, max_gap_seconds: int) -> DataFrame:
    """Averages weighted by the time until the next sample, a gap counting at most so long."""
    order = Window.partitionBy(key).orderBy(at, value)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.lead(at).over(order)) - micros(F.col(at))
    gap = F.when(gap > max_gap_seconds * 1_000_000, max_gap_seconds * 1_000_000).otherwise(gap)
    weighed = samples.withColumn("_w", gap).where("_w > 0")
    return weighed.groupBy(key).agg(
        F.sum("_w").alias("micros"), (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).cast("double").alias("mean"), F.count(F.lit(1)).alias("samples")
    )


def duration_buckets(df: DataFrame, seconds: str, by: Sequence[str]) -> DataFrame:
    """Counts up to 2, 5, 8 and more seconds, with the longest and the sum."""
    s = F.col(seconds)
    return df.groupBy(*by).agg(
        F.count_if(s <= 2).alias("upto_2"),
        F.count_if((s > 2) & (s <= 5)).alias("upto_5"),
        F.count_if((s > 5) & (s <= 8)).alias("upto_8"),
        F.count_if(s > 8).alias("over_8"),
        F.max(s).alias("longest"),
        F.sum(s).cast("decimal(24,2)").alias("total"),
    )


def fill_from_single(df: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """Gaps take the table's one distinct value, else the default. One value is joined back."""
    one = df.agg(unique_or_null(F.col(column)).alias("_one"))
    filled = F.coalesce(F.col(column), F.col("_one"), F.lit(default))
    return df.join(F.broadcast(one)).withColumn(column, filled).drop("_one")


def collapse_lines(items: DataFrame) -> DataFrame:
    """Equal lines of a purchase as one, with summed quantity and amount."""
    return items.groupBy("expense_pk", F.lower("item_name").alias("item_key"), "category", "category_source").agg(
        F.min("item_name").alias("item_name"), F.sum("qty").cast("decimal(24,3)").alias("qty"), F.sum("line_total").cast("decimal(24,2)").alias("line_total")
    )


def parse_quality_notes(expenses: DataFrame, items: DataFrame, tolerance: int = 5) -> DataFrame:
    """Purchases whose items differ from the total by more than the tolerance."""
    sums = items.groupBy("expense_pk").agg(F.sum("line_total").alias("item_sum"))
    gap = F.col("item_sum") - F.col("total")
    joined = expenses.select("id", "total").join(sums, F.col("id") == F.col("expense_pk"))
    return joined.where(F.abs(gap) > tolerance).select("id", F.col("item_sum").cast("decimal(24,2)").alias("item_sum"), gap.cast("decimal(24,2)").alias("difference"))


def penny_allocation(items: DataFrame, totals: DataFrame, key: str = "expense_pk", amount: str = "line_total", tie: str = "item_id") -> DataFrame:
    """The total of each purchase spread over its lines in proportion, exact to the cent.

    Shares are rounded half away from zero; what is left over goes to the largest line (nulls
    first, then the smallest id). Purchases without a total or with items of sum zero get nulls.
    """
    group = Window.partitionBy(key)
    ranked = group.orderBy(F.col(amount).desc_nulls_first(), F.col(tie))
    lines = items.join(totals.select(F.col("id").alias(key), "total"), key)
    share = F.round(F.col(amount) * F.col("total") / F.expr("nullif(_items, 0)"), 2).cast(MONEY)
    lines = lines.withColumns({"_items": F.sum(amount).over(group).cast(MONEY), "_rank": F.row_number().over(ranked)})
    lines = lines.withColumn("_share", share).withColumn("_shares", F.sum("_share").over(group))
    allocated = F.when(F.col("_rank") == 1, F.col("_share") + F.col("total") - F.col("_shares")).otherwise(F.col("_share"))
    return lines.withColumn("allocated", allocated.cast(MONEY)).withColumnRenamed("_rank", "line_rank").drop("_items", "_share", "_shares")


def allocated_by_category(allocated: DataFrame) -> DataFrame:
    """Allocation summed by category. ``receipt_total`` equals the category's amount, as in the report it serves."""
    sums = allocated.groupBy("expense_pk", "category").agg(F.sum("allocated").cast("decimal(24,2)").alias("category_amount"))
    return sums.withColumn("receipt_total", F.col("category_amount"))


def share_of_total(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Each row with its group's total."""
    return df.withColumn("group_total", F.sum(amount).over(Window.partitionBy(key)))


def best_and_margin(scored: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """The best candidate of each key and its lead over the second; ties by id.

    Ranks up to two are kept by a group limit before the shuffle, so a group sends two rows a task.
    """
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(candidate))
    top = scored.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2")
    first = lambda c: F.max(F.when(F.col("_rank") == 1, F.col(c)))
    second = F.max(F.when(F.col("_rank") == 2, F.col(score)))
    return top.groupBy(key).agg(first(candidate).alias("best"), first(score).alias("best_score"), (first(score) - F.coalesce(second, F.lit(0))).alias("margin"))


def carry_forward(keys: Sequence[str], order: Sequence[Column], heading: Column, reset: Column | None = None) -> Column:
    """The last heading above a row on its page; a reset row clears it."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = heading if reset is None else F.when(reset, F.lit("")).otherwise(heading)
    return F.nullif(F.last(marked, ignorenulls=True).over(window), F.lit(""))


def attach_to_preceding(keys: Sequence[str], order: Sequence[Column], item_line: Column) -> Column:
    """The nearest item line strictly above a row."""
    return F.last(item_line, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def goal_progress(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """The newest balance of each active account, kept if there is none, with its goal percentage."""
    newest = balances.groupBy("account_id").agg(F.max_by("balance", F.struct("balance_date", "balance_id")).alias("balance"), F.max("balance_date").alias("balance_date"))
    percent = F.when((F.col("goal_amount") > 0) & F.col("balance").isNotNull(), F.round(F.col("balance") * 100 / F.col("goal_amount"), 2).cast("decimal(14,2)"))
    return accounts.where("is_active").join(newest, "account_id", "left").withColumn("goal_percent", percent)
