"""Pages and lists over receipts, links, transactions and rules (operators F4-F9), and admission and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import contains, first_by, in_month, json_has_key, month_of_path, page

# What a processing page may be sorted by.
PROCESSING_SORTS = ("source_reference", "status", "attempts", "last_attempted_at", "completed_at", "updated_at")
RECEIPT_SORTS = ("transaction_datetime", "merchant", "total", "processing_status", "source_reference")


def archived(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.source_archived"), F.lit("false")) == "true"


def pending_duplicates(links: DataFrame, evidence: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """links that wait for a decision, with both pieces of evidence, none of them archived; the best score first."""
    live = evidence.where(~archived(F.col("raw_payload")))
    side = lambda p: live.select(F.col("id").alias(f"{p}_evidence_id"), *[F.col(c).alias(f"{p}_{n}") for c, n in (("source_reference", "source"), ("merchant", "merchant"), ("total", "total"), ("expense_pk", "expense"))])
    waiting = links.where(F.col("resolution_status") == "pending")
    return page(waiting.join(side("left"), "left_evidence_id").join(side("right"), "right_evidence_id"), "score", True, ["score"], "id", limit, offset)


def transaction_page(transactions: DataFrame, accounts: DataFrame, allocations: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """bank rows, the newest first, with their account and whether they are allocated.

    The page is cut before the joins, so they see ``offset + limit`` rows at most.
    """
    rows = transactions.orderBy(F.desc("transaction_date"), F.desc("id")).offset(offset).limit(limit)
    counts = allocations.join(rows.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi").groupBy(F.col("transaction_id").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(accounts.select(F.col("id").alias("_a"), "nickname"), F.col("account_id") == F.col("_a"), "left").join(counts, F.col("id") == F.col("_t"), "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return out.select(F.col("id").alias("transaction_id"), "transaction_date", "amount", "currency", "description", "card_last4", "nickname", n.alias("allocation_count"), F.when(n > 0, "confirmed allocations").otherwise("unallocated").alias("outcome"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The primary evidence of each file, else the one with the smallest id."""
    return first_by(evidence, ["source_sha256"], [F.desc("is_primary_source"), F.col("id")])


def processing_status(files: DataFrame, states: DataFrame, evidence: DataFrame, month: str | None = None) -> DataFrame:
    """the state of every file that is not archived; electronic ones count as imported. ``month`` is yyyy-mm or unassigned."""
    primary = first_evidence(evidence).select("source_sha256", "evidence_type", "created_at")
    out = files.where(~F.col("source_archived")).join(states, "source_sha256", "left").join(primary, "source_sha256", "left")
    electronic = F.col("evidence_type") == "electronic"
    out = out.select(
        "source_sha256",
        "source_reference",
        F.coalesce("status", F.when(electronic, "imported").otherwise("not_started")).alias("status"),
        F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"),
        F.coalesce("completed_at", F.when(electronic, F.col("created_at"))).alias("completed_at"),
        "last_attempted_at",
        month_of_path(F.col("source_reference")).alias("source_month"),
    )
    if month is None:
        return out
    return out.where(F.col("source_month").isNull() if month == "unassigned" else F.col("source_month") == month)


def processing_page(status: DataFrame, sort: str = "last_attempted_at", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """one page of :func:`processing_status` with the count of all its rows; an unknown sort falls back to the last attempt."""
    sort = sort if sort in PROCESSING_SORTS else "last_attempted_at"
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    total = status.agg(F.count(F.lit(1)).alias("total_count"))
    return status.orderBy(key, "source_reference", "source_sha256").offset(offset).limit(limit).join(F.broadcast(total))


def receipt_list(files: DataFrame, evidence: DataFrame, states: DataFrame, items: DataFrame, query: str = "", month: str | None = None, include_archived: bool = False) -> DataFrame:
    """files with their primary evidence and state. Each word of ``query`` may match another field or an item's name;
    archived, deleted and merged ones are left out unless asked for."""
    out = files.join(states.select("source_sha256", "status"), "source_sha256", "left")
    primary = first_evidence(evidence).select("source_sha256", F.col("id").alias("evidence_id"), "expense_pk", "evidence_type", "merchant", "transaction_datetime", "total", "raw_payload", "extraction_status")
    out = out.join(primary, "source_sha256", "left").withColumn("processing_status", F.coalesce("status", F.when(F.col("evidence_type") == "electronic", "imported")))
    payload = F.col("raw_payload")
    if not include_archived:
        out = out.where(~F.col("source_archived") & ~archived(payload) & ~json_has_key(payload, "receipt_deleted") & ~json_has_key(payload, "duplicate_merge"))
    if month:
        out = out.where(in_month(F.col("transaction_datetime"), month))
    words = query.split()
    if words:
        named = items.groupBy(F.col("expense_pk").alias("_e")).agg(*[F.bool_or(contains(F.col("item_name"), w.removeprefix("$"))).alias(f"_w{i}") for i, w in enumerate(words)])
        out = out.join(named, F.col("expense_pk") == F.col("_e"), "left")
        text = F.concat_ws(" ", F.col("expense_pk").cast("string"), "source_reference", "merchant", F.col("transaction_datetime").cast("string"), F.col("total").cast("string"), "status", "extraction_status")
        for i, w in enumerate(words):
            out = out.where(contains(text, w.removeprefix("$")) | F.coalesce(f"_w{i}", F.lit(False)))
    return out.select("source_sha256", "source_reference", "processing_status", "evidence_id", "expense_pk", "merchant", "transaction_datetime", "total", "extraction_status")


def receipt_page(receipts: DataFrame, sort: str = "transaction_datetime", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """one page with the count of all rows."""
    sort = sort if sort in RECEIPT_SORTS else "transaction_datetime"
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    total = receipts.agg(F.count(F.lit(1)).alias("total_count"))
    return receipts.orderBy(key, F.desc("source_reference")).offset(offset).limit(limit).join(F.broadcast(total))


def rule_list(rules: DataFrame, search: str | None = None, limit: int = 500) -> DataFrame:
    """active rules first, then by priority, text and id; ``search`` in any of their texts, its wildcards as they are."""
    if search:
        hit = F.lit(False)
        for c in ("match_text", "merchant", "source", "category_name"):
            hit = hit | F.coalesce(contains(F.col(c), search, escaped=False), F.lit(False))
        rules = rules.where(hit)
    return rules.orderBy(F.desc("is_active"), "priority", F.lower("match_text"), "id").limit(limit)


def admitted(requests: DataFrame, receipts: DataFrame, running: DataFrame) -> DataFrame:
    """Whether a receipt may be processed again, and why not; a request that is running already is answered as it was.

    requests: request_id, source_sha256; receipts: source_sha256, raw_payload, source_archived;
    running: source_sha256, running_id.
    """
    out = requests.join(receipts, "source_sha256", "left").join(running, "source_sha256", "left")
    payload = F.col("raw_payload")
    verdict = (
        F.when(F.col("running_id").eqNullSafe(F.col("request_id")), "same_request")
        .when(F.col("source_archived").isNull(), "unknown")
        .when(F.col("source_archived") | archived(payload), "archived")
        .when(json_has_key(payload, "receipt_deleted"), "deleted")
        .when(json_has_key(payload, "duplicate_merge"), "duplicate")
        .when(F.col("running_id").isNotNull(), "in_flight")
        .otherwise("admitted")
    )
    return out.select("request_id", "source_sha256", verdict.alias("verdict"))


def audited(audit: DataFrame, changes: DataFrame, actor: str, action: str, columns: Sequence[str]) -> DataFrame:
    """The audit with an entry for each change (key, before, after) that really changes something; nothing in it is replaced."""
    entry = changes.where(~F.col("before").eqNullSafe(F.col("after")))
    entry = entry.select(F.col(columns[0]), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.to_json("before").alias("before"), F.to_json("after").alias("after"))
    return audit.unionByName(entry)
