"""Scores and decisions over candidate rows (operators I), as column arithmetic."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .aggregates import best_and_margin
from .relational import unique_or_null

# What can be the case with a pair, its points and the reason's name, strongest first, in the order of the reasons; thresholds.
FACTS = {
    "id": ((45, "identifier_match"),),
    "merchant": ((15, "merchant_match"),),
    "time": ((15, "time_within_5m"), (8, "same_day")),
    "total": ((20, "total_exact"), (10, "total_within_5pct")),
    "card": ((10, "card_match"),),
    "items": ((25, "items_near_exact"), (18, "items_strong_overlap"), (10, "items_partial_overlap")),
}
ALIKE = (0.90, 0.70, 0.50)
EXACT, PROBABLE, REVIEW = 90, 70, 50


def jaccard(a: Column, b: Column) -> Column:
    """H8: share of common elements; null where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    # A union is only built where something is shared, and neither where both are equal; it is empty only if both are.
    return F.when((F.size(a) > 0) & (a == b), F.lit(1.0)).when(shared > 0, shared / F.size(F.array_union(a, b))).when((F.size(a) > 0) | (F.size(b) > 0), F.when(shared == 0, F.lit(0.0)))


def normalized_id(c: Column) -> Column:
    """H2: letters and digits only, upper case; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", "")), F.lit(""))


def _ids(columns: Sequence[str], side: str = "") -> Column:
    """A side's normalised identifiers: its id and, if there is one, its order id."""
    return F.array_compact(F.array(*[normalized_id(F.col(f"{side}{c}")) for c in ("id", "order") if f"{side}{c}" in columns]))


def duplicate_sides(df: DataFrame) -> DataFrame:
    """I1's sides with what is compared prepared once a row, where there are more pairs than rows.

    ids and shop are normalised, items in order; cents (rounded down), n_items and the bits of
    the items' hashes are what :func:`may_be_alike` looks at.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    bits = F.aggregate("items", F.lit(0).cast("long"), lambda seen, x: seen.bitwiseOR(bit(x)))
    df = df.withColumn("items", F.sort_array(F.array_distinct("items")))
    return df.withColumns({"ids": _ids(df.columns), "shop": normalized_id(F.col("merchant")), "cents": F.floor(F.col("total") * 100), "n_items": F.size("items"), "bits": bits})


def may_be_alike() -> Column:
    """What a pair of :func:`duplicate_sides` without a common identifier has if it scores for review.

    Without an equal total, an equal card or half of the items in common no score comes to more than 40 and nothing
    is correlated. A bit that one side lacks stands for an item it lacks, so the bits bound the common items from above.
    """
    left, right = F.col("left_bits"), F.col("right_bits")
    own = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    common = F.least(F.col("left_n_items") - own(left, right), F.col("right_n_items") - own(right, left))
    return (F.abs(F.col("left_cents") - F.col("right_cents")) <= 1) | (F.col("left_card") == F.col("right_card")) | ((common > 0) & (3 * common >= F.col("left_n_items") + F.col("right_n_items")))


def _verdicts() -> Column:
    """Score, disposition and reasons of each combination of facts: a constant, so that no pair puts its own together.

    A fact's level is 0 if it is not the case, else its place in :data:`FACTS`; the last fact's level counts fastest.
    """
    rows = []
    for levels in product(*[range(len(f) + 1) for f in FACTS.values()]):
        at = dict(zip(FACTS, levels, strict=True))
        held = [FACTS[name][n - 1] for name, n in at.items() if n]
        score, correlated = sum(p for p, _ in held), at["merchant"] == at["time"] == 1 and at["items"] > 0
        disposition = "exact_duplicate" if score >= EXACT else "probable_duplicate" if score >= PROBABLE else "needs_review" if score >= REVIEW or correlated else "distinct"
        rows.append({"score": score, "disposition": disposition, "reasons": [r for _, r in held] + ["merchant_time_item_correlation"] * correlated})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<score: int, disposition: string, reasons: array<string>>>")


def duplicate_score(pairs: DataFrame) -> DataFrame:
    """Score, reasons and disposition of pairs with columns left_* and right_*; ``same_id`` as well.

    Sides have id, merchant, at (timestamp), total (decimal), card and items (array of strings);
    with an order id, too, it counts as an identifier like the id. Those of
    :func:`duplicate_sides` have ids and shop instead of order and merchant.
    """
    both = lambda c: (F.col(f"left_{c}"), F.col(f"right_{c}"))
    ids = lambda side: F.col(f"{side}_ids") if f"{side}_ids" in pairs.columns else _ids(pairs.columns, f"{side}_")
    shops = both("shop") if "left_shop" in pairs.columns else tuple(map(normalized_id, both("merchant")))
    a, b = both("at")
    seconds = F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp")))
    x, y = both("total")
    apart = F.abs(x - y)
    near = apart <= F.greatest(F.abs(x), F.abs(y), F.lit("0.01").cast("decimal(3,2)")) * F.lit("0.05").cast("decimal(3,2)")
    level = lambda *held: reduce(lambda c, h: c.when(h[1], h[0]), enumerate(held[1:], 2), F.when(held[0], 1)).otherwise(0)
    alike = F.col("_alike")
    levels = {
        "id": level(F.arrays_overlap(ids("left"), ids("right"))), "merchant": level(shops[0] == shops[1]), "time": level(seconds <= 300, F.to_date(a) == F.to_date(b)),
        "total": level(apart <= 0.01, near), "card": level(F.col("left_card") == F.col("right_card")), "items": level(*[alike >= least for least in ALIKE]),
    }
    found = reduce(lambda n, name: n * (len(FACTS[name]) + 1) + levels[name], FACTS, F.lit(0))
    pairs = pairs.withColumn("_alike", F.coalesce(jaccard(*both("items")), F.lit(0.0)))
    # Exploded: a filter on what follows from it would else be pushed into the join, with a copy of all this for each mention.
    pairs = pairs.select("*", F.explode(F.array(found)).alias("_found"))
    verdict = F.element_at(_verdicts(), F.col("_found") + 1)
    without_id = prod(len(f) + 1 for name, f in FACTS.items() if name != "id")
    scored = pairs.withColumns({"same_id": F.col("_found") >= without_id, "score": verdict["score"], "reasons": verdict["reasons"], "disposition": verdict["disposition"], "item_similarity": F.round(alike, 4)})
    return scored.drop("_alike", "_found")


def evidence_match(pairs: DataFrame, key: str, candidate: str) -> DataFrame:
    """I4: the best candidate of each key by weighted agreement, in decimals.

    pairs: same_id, same_total, same_merchant, same_card (booleans, null is no), seconds_apart
    and same_day. Matched from 0.80 with a lead of 0.10, ambiguous from 0.45, else new.
    """
    d = lambda v: F.lit(v).cast("decimal(4,2)")
    part = lambda flag, v: F.when(F.col(flag), d(v)).otherwise(d("0"))
    time = F.when(F.col("seconds_apart") <= 120, d("0.20")).when(F.col("same_day"), d("0.05")).otherwise(d("0"))
    score = part("same_id", "0.30") + part("same_total", "0.25") + part("same_merchant", "0.15") + part("same_card", "0.10") + time
    best = best_and_margin(pairs.withColumn("_score", score.cast("decimal(6,2)")), key, candidate, "_score")
    outcome = F.when((F.col("best_score") >= d("0.80")) & (F.col("margin") >= d("0.10")), "matched").when(F.col("best_score") >= d("0.45"), "ambiguous").otherwise("new")
    return best.withColumn("outcome", outcome).withColumn("matched", F.when(F.col("outcome") == "matched", F.col("best")))


def reconcile_purchase(purchases: DataFrame, sums: DataFrame, splits: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Three checks of a purchase: items against the subtotal, the receipt equation, category splits against categorised items.

    purchases: id, subtotal, taxes, fees, tip, discounts, total, equation_complete; sums as
    :func:`reconciliation_sums` gives them; splits: expense_pk, split_sum. A sum that a missing
    amount makes null is not checkable; a purchase without items or splits has sums of zero.
    """
    t, zero = F.lit(tolerance).cast("decimal(14,2)"), F.lit(0).cast("decimal(24,2)")
    paid = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(14,2)"))
    known = F.col("lines").isNotNull()
    items = F.when(known, F.col("item_sum")).otherwise(zero)
    categorized = F.when(known & (F.col("categorized_missing") > 0), F.lit(None).cast("decimal(24,2)")).otherwise(F.coalesce("categorized_sum", zero))
    due = F.when(F.col("equation_complete"), F.col("subtotal") + paid("taxes") + paid("fees") + paid("tip") - paid("discounts"))
    joined = purchases.join(sums, F.col("id") == F.col("expense_pk"), "left").drop("expense_pk").join(splits, F.col("id") == F.col("expense_pk"), "left")
    checks = {"subtotal": (F.col("subtotal"), items), "total": (due, F.col("total")), "splits": (categorized, F.coalesce("split_sum", zero))}
    columns = []
    for name, (expected, actual) in checks.items():
        gap = (actual - expected).cast("decimal(24,2)")
        columns += [F.when(gap.isNull(), "not_checkable").when(F.abs(gap) <= t, "pass").otherwise("fail").alias(f"{name}_status"), gap.alias(f"{name}_variance")]
    return joined.select("id", *columns)


# The rules of a complete purchase and of a complete line.
PURCHASE_RULES = ("missing_source", "missing_order_id", "missing_store_name", "missing_transaction_date", "missing_expense_total", "missing_items")
LINE_RULES = ("invalid_item_id", "item_missing_name", "item_missing_line_total")


def required_fields(expenses: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each missing field of a purchase or of one of its lines.

    A purchase needs a date or a time of payment, where it has that column, and at least one line.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    undated = F.col("order_date").isNull()
    if "transaction_datetime" in expenses.columns:
        undated = undated & F.col("transaction_datetime").isNull()
    has = items.select(F.col("expense_pk").alias("_pk")).distinct()
    broken = (blank("source"), blank("order_id"), blank("store_name"), undated, F.col("total").isNull(), F.col("_pk").isNull())
    head = F.array_compact(F.array(*[F.when(b, rule) for b, rule in zip(broken, PURCHASE_RULES, strict=True)]))
    wrong = (F.col("item_id") <= 0, blank("item_name"), F.col("line_total").isNull())
    line = F.array_compact(F.array(*[F.when(b, rule) for b, rule in zip(wrong, LINE_RULES, strict=True)]))
    top = expenses.join(has, F.col("id") == F.col("_pk"), "left").select(F.col("id").alias("expense_pk"), F.lit(None).cast("long").alias("item_id"), F.explode(head).alias("rule"))
    below = items.select("expense_pk", F.col("item_id").cast("long").alias("item_id"), F.explode(line).alias("rule"))
    return top.unionByName(below)


def quality_status(expenses: DataFrame, violations: DataFrame) -> DataFrame:
    """Rules in text order and their number for each purchase, pass without any."""
    rules = violations.groupBy("expense_pk").agg(F.array_sort(F.collect_list("rule")).alias("rules"), F.count(F.lit(1)).alias("violations"))
    joined = expenses.select("id").join(rules, F.col("id") == F.col("expense_pk"), "left")
    return joined.select(
        "id",
        F.coalesce("rules", F.array().cast("array<string>")).alias("rules"),
        F.coalesce("violations", F.lit(0).cast("long")).alias("violations"),
        F.when(F.col("violations") > 0, "fail").otherwise("pass").alias("status"),
    )


def assess_allocation(df: DataFrame) -> DataFrame:
    """Ordered reasons why subtotal, tax and total of a purchase do not fit its items."""
    cent = F.lit("0.01").cast("decimal(3,2)")
    off = lambda a, b: F.abs(a - b) > cent
    equation = F.col("subtotal") + F.coalesce("tax", F.lit(0)) + F.coalesce("charges", F.lit(0)) - F.coalesce("discount", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("item_sum").isNull(), "items_missing"),
            F.when(F.col("subtotal").isNull() | F.col("total").isNull(), "header_missing"),
            F.when(off(F.col("item_sum"), F.col("subtotal")), "items_do_not_match_subtotal"),
            F.when(off(equation, F.col("total")), "header_does_not_add_up"),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("reconciled", F.size("reasons") == 0)


def display_status(status: Column, reconciled: Column) -> Column:
    """Complete shows as review where the allocation does not reconcile."""
    return F.when((status == "complete") & ~reconciled, "review").otherwise(status)


# Order of trust among item sources.
SOURCE_PRIORITY = {"costco_e_receipt": 0, "instacart": 1, "manual": 2, "scanned": 3}


def choose_source(candidates: DataFrame, key: str) -> DataFrame:
    """The item source of each purchase.

    Reliable ones (confidence 0.80 and more) first, then the source's place, confidence, number of
    items and the lowest id; a maximum over structs, without sorting groups.
    """
    place = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    rank = F.struct((F.col("confidence") >= 0.80).alias("a"), (-F.coalesce(F.try_element_at(place, F.col("source")), F.lit(99))).alias("b"), F.col("confidence").alias("c"), F.col("item_count").alias("d"), (-F.col("candidate_id")).alias("e"))
    return candidates.groupBy(key).agg(F.max_by(F.struct("candidate_id", "source", "confidence"), rank).alias("s"), F.count(F.lit(1)).alias("candidates")).select(key, "s.*", "candidates")


def cad_amounts(transactions_with_rates: DataFrame) -> DataFrame:
    """The amount in CAD and how it was converted; rates as :func:`as_of` found them."""
    status = (
        F.when(F.col("currency") == "CAD", "native_cad")
        .when(F.col("currency") != "USD", "unsupported_currency")
        .when(F.col("rate").isNull(), "missing_rate")
        .when(F.col("rate_date") == F.col("transaction_date"), "daily_rate")
        .otherwise("prior_business_day_rate")
    )
    cad = F.when(F.col("currency") == "CAD", F.col("amount")).when(F.col("currency") == "USD", F.round(F.col("amount") * F.col("rate"), 2))
    return transactions_with_rates.withColumn("conversion_status", status).withColumn("cad_amount", cad.cast("decimal(14,2)"))


def total_difference(subtotal: Column, tax: Column, charges: Column, tip: Column, discount: Column, total: Column) -> Column:
    """H37."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(subtotal) + zero(tax) + zero(charges) + zero(tip) - zero(discount) - total


def enrich(df: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill gaps only, with a flag for each filled column."""
    other = found.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(other, F.col(key) == F.col("_key"), "left")
    flags = [(F.col(c).isNull() & F.col(f"_new_{c}").isNotNull()).alias(f"{c}_filled") for c in columns]
    return joined.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns], *flags)


def value_if_agreed(observations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D21 over a table: one row a key, null where the observations differ."""
    return observations.groupBy(*keys).agg(unique_or_null(F.col(value)).alias(value), F.count(F.lit(1)).alias("observations"))


def canonical_category(df: DataFrame, asked: str, categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """H5: the category that a text names, as written, but for case and punctuation, or by an alias; null if none.

    categories: category; aliases: alias (normalised), category. Distinct texts are looked up.
    """
    norm = lambda c: normalize(F.col(c))
    exact = categories.select(F.trim("category").alias("_x"), F.col("category").alias("_exact"))
    loose = categories.groupBy(norm("category").alias("_n")).agg(F.min("category").alias("_loose"))
    known = aliases.select(F.col("alias").alias("_l"), F.col("category").alias("_alias"))
    texts = df.select(F.col(asked).alias("_asked")).distinct()
    found = texts.join(exact, F.trim("_asked") == F.col("_x"), "left").join(loose, norm("_asked") == F.col("_n"), "left").join(known, norm("_asked") == F.col("_l"), "left")
    found = found.select("_asked", F.coalesce("_exact", "_loose", "_alias").alias("category"))
    return df.join(found, F.col(asked).eqNullSafe(F.col("_asked")), "left").drop("_asked")


def derived_quantities(items: DataFrame) -> DataFrame:
    """Number of units, weight and refund prices of order lines.

    items: name, quantity (text), weight_unit, weight_qty, unit_price, total_price and
    original_total_price (doubles, null if unknown). Adds unit_qty (not for weighed lines: the
    number in the quantity, else total by unit price, whole if within 0.02), weight, and for lines
    named as refunded a negative line_total, of the price before discounts if known, with unit_value.
    """
    by_price = F.when(F.col("unit_price") > 0, F.col("total_price") / F.col("unit_price"))
    written = F.nullif(F.regexp_extract(F.coalesce("quantity", F.lit("")), r"\d+(\.\d+)?", 0), F.lit("")).cast("double")
    weighed = F.coalesce("weight_unit", F.lit("")) != ""
    whole = F.when(F.abs(by_price - F.round(by_price)) < 0.02, F.round(by_price)).otherwise(F.round(by_price, 3))
    units = F.when(~weighed, F.coalesce(written, F.when(by_price > 0, whole)))
    weight = F.when(F.col("weight_qty") > 0, F.round("weight_qty", 3)).when(weighed, F.round(by_price, 3))
    count = F.when(F.coalesce("quantity", F.lit("")).rlike(r"^\d+$") & (F.col("quantity").try_cast("int") > 0), F.col("quantity").try_cast("int")).otherwise(1)
    refund = F.when(F.col("original_total_price") > 0, -F.col("original_total_price")).when(F.col("total_price") != 0, -F.abs("total_price")).when(F.col("unit_price") != 0, -F.abs("unit_price") * count)
    refunded = F.coalesce(F.col("name").rlike(r"(?i)\brefunded\b"), F.lit(False)) & refund.isNotNull()
    return items.withColumns({"unit_qty": units, "weight": weight, "line_total": F.when(refunded, refund).otherwise(F.col("total_price")), "unit_value": F.when(refunded, refund / count).otherwise(F.col("unit_price"))})
