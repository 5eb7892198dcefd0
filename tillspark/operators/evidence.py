"""Corroboration of captured values and the flow of work (operators C12-C25, D13-D28, E5-E12, I2-I35)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import occurrence
from .relational import first_by, unique_or_null


def evidence_candidates(evidence: DataFrame, expenses: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Pairs with an equal date and totals at most a cent apart; a date or total that the
    evidence lacks does not restrict. Totals are blocked by cents, each looking one to either side.

    evidence: evidence_id, date, total; expenses: expense_id, date, total. Evidence that knows
    neither has no candidates, as it would pair with everything.
    """
    e = expenses.select(F.col("expense_id"), F.col("date").alias("x_date"), F.col("total").alias("x_total"), F.round(F.col("total") * 100).cast("long").alias("_cents"))
    near = evidence.where("total is not null").withColumn("_c", F.explode(F.array(*[F.round(F.col("total") * 100).cast("long") + i for i in (-1, 0, 1)])))
    by_total = near.join(e, F.col("_c") == F.col("_cents")).where("date is null or date = x_date")
    by_date = evidence.where("total is null and date is not null").join(e, F.col("date") == F.col("x_date"))
    pairs = by_total.select("evidence_id", "expense_id").unionByName(by_date.select("evidence_id", "expense_id")).distinct()
    return pairs if rejected is None else pairs.join(rejected, ["evidence_id", "expense_id"], "left_anti")


def alias_join(names: DataFrame, aliases: DataFrame, text: str, max_aliases: int = 10_000) -> DataFrame:
    """The merchant whose alias stands as whole words in a normalised text; the longest
    alias, then its name, decides. Aliases are a counted configuration table."""
    aliases = aliases.select("alias_name", "merchant_name").limit(max_aliases + 1)
    if aliases.count() > max_aliases:
        raise ValueError(f"more than {max_aliases} aliases")
    distinct = names.select(text).distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hits = distinct.join(F.broadcast(aliases), F.contains(padded(F.col(text)), padded(F.col("alias_name"))))
    best = hits.groupBy(F.col(text).alias("_text")).agg(F.min_by("merchant_name", F.struct(-F.length("alias_name"), F.col("alias_name"))).alias("merchant_name"))
    return names.join(best, F.col(text) == F.col("_text"), "left").drop("_text")


def printed_identity(orders: DataFrame, receipts: DataFrame) -> DataFrame:
    """The receipt of the same total within the printed minute whose text holds the order's identity; null unless exactly one."""
    r = receipts.select("receipt_id", F.col("total").alias("r_total"), F.col("at").alias("r_at"), "text")
    minute = F.date_trunc("minute", "at")
    hit = orders.join(r, F.col("total") == F.col("r_total")).where((F.date_trunc("minute", "r_at") == minute) & F.contains("text", F.col("identity")))
    found = hit.groupBy("order_id").agg(unique_or_null(F.col("receipt_id")).alias("receipt_id"))
    return orders.select("order_id").join(found, "order_id", "left")


def reviewed_without_partner(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column], reviewed: Column) -> DataFrame:
    """Reviewed rows that an incoming multiset does not cover; any of them blocks a refresh."""
    have = existing.withColumn("_r", reviewed)
    numbered = occurrence(have, keys, [F.col("_r").desc(), *order], "_n")
    new = occurrence(incoming, keys, order, "_n").select(*keys, "_n")
    return numbered.where("_r").join(new, [*keys, "_n"], "left_anti").drop("_n", "_r")


def outcome_summary(matches: DataFrame) -> DataFrame:
    """D13."""
    return matches.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("matched", "ambiguous", "unmatched")], F.count(F.lit(1)).alias("total"))


def reason_histogram(df: DataFrame, reasons: str) -> DataFrame:
    """D14."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def consensus(lines: DataFrame, key: str, line: Column, engine: str) -> DataFrame:
    """Normalised lines with the engines that read them; the most read spelling stands for them."""
    spelled = lines.select(key, line.alias("norm"), F.col("line").alias("spelling"), engine).groupBy(key, "norm", "spelling").agg(F.collect_set(engine).alias("engines"), F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(key, "norm").agg(
        F.max_by("spelling", F.struct("n", "spelling")).alias("spelling"), F.size(F.array_distinct(F.flatten(F.collect_list("engines")))).alias("engines"), F.sum("n").alias("readings")
    )


def coverage(consensus_lines: DataFrame, passes: DataFrame, key: str, engine: str) -> DataFrame:
    """D28 for equal normalised lines: the share of consensus lines that each pass has."""
    total = consensus_lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"))
    have = passes.select(key, engine, "norm").distinct().join(consensus_lines.select(key, "norm"), [key, "norm"], "left_semi")
    hits = have.groupBy(key, engine).agg(F.count(F.lit(1)).alias("covered"))
    return hits.join(total, key).withColumn("share", F.round(F.col("covered") / F.col("lines"), 6))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Winner, difference and agreement of two models' answers (choice, score)."""
    left = a.select(key, F.col("choice").alias("a_choice"), F.col("score").alias("a_score"))
    right = b.select(key, F.col("choice").alias("b_choice"), F.col("score").alias("b_score"))
    winner = F.when(F.col("a_score") > F.col("b_score"), "a").when(F.col("a_score") < F.col("b_score"), "b").otherwise("tie")
    return left.join(right, key).select(key, winner.alias("winner"), (F.col("a_score") - F.col("b_score")).alias("delta"), F.col("a_choice").eqNullSafe(F.col("b_choice")).alias("agree"))


def field_scores(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Expected, given and right values of each field; an expected null is not asked for."""
    a = actual.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    j = expected.join(a, F.col(key) == F.col("_k"), "left")
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("e"), F.col(f"_a_{f}").isNotNull().alias("g"), F.coalesce(F.col(f).cast("string") == F.col(f"_a_{f}").cast("string"), F.lit(False)).alias("r")) for f in fields]
    x = j.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return x.groupBy("field").agg(F.count_if("e").alias("expected"), F.count_if("g").alias("given"), F.count_if(F.col("e") & F.col("r")).alias("right"))


def with_total_count(df: DataFrame, limit: int, order: Sequence[Column]) -> DataFrame:
    """E5: the first rows and the number of all; a scalar joined on, not a window over one partition."""
    n = df.agg(F.count(F.lit(1)).alias("total_count"))
    return df.orderBy(*order).limit(limit).join(F.broadcast(n))


def interleave(df: DataFrame, group: str, order: Sequence[Column], text: str, budget: int) -> DataFrame:
    """The first of each group, then the second of each, and so on, while the texts fit the budget; each text once.

    A text that does not fit is skipped and costs nothing. No later text of its length fits
    either, so of each length only as many first rows as the budget holds are looked at, in one pass.
    """
    one = first_by(df, [text], [F.col(group), *order])
    ranked = one.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sized = ranked.withColumn("_size", F.coalesce(F.length(text), F.lit(0))).where(F.col("_size") <= budget)
    nth = F.row_number().over(Window.partitionBy("_size").orderBy("_n", group, text))
    # An empty and a null text cost nothing.
    small = sized.withColumn("_nth", nth).where((F.col("_nth") <= max(budget, 2)) & (F.col("_nth") * F.col("_size") <= budget)).drop("_nth")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for pdf in batches:
            keep = []
            for size in pdf["_size"]:
                keep.append(used + size <= budget)
                used += size if keep[-1] else 0
            yield pdf[keep]

    return small.repartition(1).sortWithinPartitions("_n", group, text).mapInPandas(fit, small.schema).drop("_n", "_size")


def indent_levels(lines: DataFrame, page: str, x: str, width: str, least: float) -> DataFrame:
    """Levels of indentation: a gap of ``least`` page widths to the next smaller indent opens a level."""
    order = Window.partitionBy(page).orderBy(x)
    distinct = lines.select(page, x, width).distinct()
    opens = F.coalesce(F.col(x) - F.lag(x).over(order) >= F.col(width) * least, F.lit(False)).cast("int")
    level = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    levels = distinct.withColumn("_opens", opens).select(page, x, width, level.alias("level"))
    return lines.join(levels, [page, x, width])


def best_row(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row with the greatest rank tuple; negate what should be small. No sorting of groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select(*keys, "_r.*")


def corroborated(readings: DataFrame, keys: Sequence[str], value: str, engine: str, least: int = 2) -> DataFrame:
    """The one value that at least two engines read; null if there is none or more than one."""
    support = readings.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_distinct(engine).alias("engines"))
    good = support.where(F.col("engines") >= least).groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(value), F.count(F.lit(1)).alias("supported"))
    return readings.select(*keys).distinct().join(good, list(keys), "left").withColumn("supported", F.coalesce("supported", F.lit(0).cast("long")))


def review_outcome(reviews: DataFrame, key: str) -> DataFrame:
    """Reviews (family, choice, cited) reconciled: at least two families, one choice, citations everywhere."""
    g = reviews.groupBy(key).agg(
        F.count_distinct("family").alias("families"), F.count_distinct("choice").alias("choices"), unique_or_null(F.col("choice")).alias("choice"), F.bool_and(F.coalesce("cited", F.lit(False))).alias("cited")
    )
    reasons = F.array_compact(F.array(F.when(F.col("families") < 2, "too_few_families"), F.when(F.col("choices") > 1, "disagreement"), F.when(F.col("choices") == 0, "no_choice"), F.when(~F.col("cited"), "missing_citation")))
    return g.withColumn("reasons", reasons).withColumn("accepted", F.when(F.size("reasons") == 0, F.col("choice"))).select(key, "accepted", "reasons")


def candidate_choice(candidates: DataFrame, key: str, threshold: float = 0.85, rival: float = 0.02) -> DataFrame:
    """The best search candidate; to review if another one comes within ``rival`` of it."""
    top = Window.partitionBy(key).orderBy(F.desc("score"), "url")
    two = candidates.withColumn("_n", F.row_number().over(top)).where("_n <= 2")
    g = two.groupBy(key).agg(F.max_by("url", -F.col("_n")).alias("url"), F.max("score").alias("score"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("second"))
    status = F.when(F.col("score") < threshold, "rejected").when(F.coalesce(F.col("score") - F.col("second") < rival, F.lit(False)), "review").otherwise("accepted")
    return g.select(key, "url", "score", status.alias("status"))


def publishable(latest_events: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates whose newest event does not reserve or queue them."""
    return candidates.join(latest_events.where(F.col("status").isin("reserved", "queued")).select(key), key, "left_anti")


def batch_state(events: DataFrame, planned: DataFrame, now: Column) -> DataFrame:
    """State of each batch: planned minus seen is unconfirmed; done, stalled (90 s of silence), running or waiting."""
    seen = events.groupBy("batch_id").agg(F.count_distinct("request_id").alias("seen"), F.count_if(F.col("status").isin("results_published", "failed")).alias("finished"), F.max("at").alias("last_at"))
    j = planned.join(seen, "batch_id", "left").select("batch_id", "planned", F.coalesce("seen", F.lit(0).cast("long")).alias("seen"), F.coalesce("finished", F.lit(0).cast("long")).alias("finished"), "last_at")
    quiet = F.unix_timestamp(now) - F.unix_timestamp("last_at") > 90
    state = F.when(F.col("finished") >= F.col("planned"), "done").when(F.col("seen") == 0, "waiting").when(quiet, "stalled").otherwise("running")
    return j.select("batch_id", (F.col("planned") - F.col("seen")).alias("unconfirmed"), state.alias("state"))


def override_category(items: DataFrame, norm: Column, pattern: str, category: str, match: str) -> DataFrame:
    """A rule applied to matching items; what a person set stays."""
    hit = (norm == pattern) if match == "exact" else F.contains(norm, F.lit(pattern))
    apply = hit & (F.col("category_source") != "manual")
    return items.withColumns({"category": F.when(apply, category).otherwise(F.col("category")), "category_source": F.when(apply, "rule").otherwise(F.col("category_source")), "changed": apply})


def candidate_pool(candidates: DataFrame, key: str, most: int = 8) -> DataFrame:
    """One best row for each url, then up to ``most`` cards with the best of each reading first."""
    per_url = best_row(candidates, [key, "url"], [F.col("score"), F.col("reading")])
    diverse = F.row_number().over(Window.partitionBy(key, "reading").orderBy(F.desc("score"), "url"))
    order = Window.partitionBy(key).orderBy("_d", F.desc("score"), "url")
    return per_url.withColumn("_d", diverse).withColumn("card", F.row_number().over(order)).where(F.col("card") <= most).drop("_d")


# Fixed value: why a pair below the score is shown.
SAME_TIME_AND_TOTAL = "low_score_same_time_total_requires_human_review"


def duplicate_capture(scored: DataFrame, resolved: DataFrame | Column, others: DataFrame | None = None, dealt: Sequence[str] = ()) -> DataFrame:
    """Scored pairs (left, right) to show, and whether the left one is linked by itself.

    Not those resolved before: a table of pairs, or a condition on a scored pair. Distinct pairs of
    the same time and total are shown for review. A link needs an exact score by an identifier of
    six digits or more at a precise time, and no second such pair of the same document. scored:
    left_pk, right_pk, left_id, left_at, same_id, score, disposition, reasons.

    Only pairs with a common identifier are counted by document. ``others`` are more pairs, all
    without one, that pass through. ``dealt``: columns that scored is dealt by and that follow from
    left_pk; with them no pair is shuffled.
    """
    has = lambda reason: F.array_contains("reasons", reason)
    distinct = F.col("disposition") == "distinct"

    def shown(pairs: DataFrame) -> DataFrame:
        worth = ~distinct | (has("time_within_5m") & has("total_exact"))
        if isinstance(resolved, DataFrame):
            return pairs.where(worth).join(resolved, ["left_pk", "right_pk"], "left_anti")
        # One predicate, not two: pushed down alone, the one on left_pk would make the sides differ, so that each is built and shuffled apart.
        return pairs.where(F.least(worth, ~F.coalesce(resolved, F.lit(False))))

    def told(pairs: DataFrame, link: Column) -> DataFrame:
        reasons = F.when(distinct, F.array_append("reasons", SAME_TIME_AND_TOTAL)).otherwise(F.col("reasons"))
        return pairs.select("left_pk", "right_pk", "score", F.when(distinct, "needs_review").otherwise(F.col("disposition")).alias("disposition"), reasons.alias("reasons"), link.alias("auto_link"))

    precise = F.date_format("left_at", "HH:mm:ss") != "00:00:00"
    strong = F.length(F.regexp_replace(F.coalesce("left_id", F.lit("")), r"\D", "")) >= 6
    exact = F.coalesce(F.col("same_id") & (F.col("disposition") == "exact_duplicate") & precise & strong, F.lit(False))
    counted = shown(scored).select(*dealt, "left_pk", "right_pk", "score", "disposition", "reasons", exact.alias("_exact"))
    alone = F.count_if("_exact").over(Window.partitionBy(*dealt, "left_pk")) == 1
    out = told(counted, F.col("_exact") & alone)
    return out if others is None else out.unionByName(told(shown(others), F.lit(False)))
