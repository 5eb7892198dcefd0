"""Order-sensitive matching (H7, C20, C21, I3, I8): sequence ratios and alignments."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import best_and_margin
from ..operators.joins import rule_join
from .text import ngrams, normalize


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if None in pair:
            out.append(0.0)
            continue
        if pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def ratio(a: Column | str, b: Column | str) -> Column:
    """H7: twice the matching characters over all characters; not symmetric, and 0 for null."""

    @F.pandas_udf("double")
    def sequence_ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return _ratios(x, y)

    return sequence_ratio(a, b)


def sure_alignment(weights: dict[tuple[int, int], float], n: int, m: int, tolerance: float = 1e-8) -> dict[int, int]:
    """C20: edges (left, right) that are in every heaviest order-preserving matching.

    Best weights of all prefixes and suffixes tell which edges are in some best matching; an
    edge is in every one if the best weight without it is smaller.
    """

    def best(skip: tuple[int, int] | None) -> float:
        row = [0.0] * (m + 1)
        for i in range(n):
            new = [0.0]
            for j in range(m):
                take = row[j] + weights[i, j] if (i, j) in weights and (i, j) != skip else 0.0
                new.append(max(row[j + 1], new[j], take))
            row = new
        return row[m]

    ahead = [[0.0] * (m + 1) for _ in range(n + 1)]
    behind = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            ahead[i + 1][j + 1] = max(ahead[i][j + 1], ahead[i + 1][j], ahead[i][j] + weights.get((i, j), 0.0))
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            behind[i][j] = max(behind[i + 1][j], behind[i][j + 1], behind[i + 1][j + 1] + weights.get((i, j), 0.0))
    total = ahead[n][m]
    on_best = [e for e, w in weights.items() if w > 0 and abs(ahead[e[0]][e[1]] + w + behind[e[0] + 1][e[1] + 1] - total) <= tolerance]
    return {i: j for i, j in sorted(on_best) if best((i, j)) < total - tolerance}


def one_to_one(edges: dict[int, list[int]]) -> dict[int, int]:
    """A largest matching of left to right numbers, by augmenting paths, lowest numbers first."""
    taken: dict[int, int] = {}
    for start in sorted(edges):
        path: list[tuple[int, Iterator[int]]] = [(start, iter(sorted(edges[start])))]
        seen: set[int] = set()
        chosen: list[int] = []
        while path:
            _, options = path[-1]
            right = next((r for r in options if r not in seen), None)
            if right is None:
                path.pop()
                if chosen:
                    chosen.pop()
                continue
            seen.add(right)
            chosen.append(right)
            if right not in taken:
                for (left, _), r in zip(path, chosen, strict=True):
                    taken[r] = left
                break
            path.append((taken[right], iter(sorted(edges[taken[right]]))))
    return {left: right for right, left in sorted(taken.items(), key=lambda x: x[1])}


def match_transactions(candidates: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """The purchase that a bank row stands for; ``best`` only where it is matched.

    With ``transactions`` (transaction_id) those without any candidate come out as unmatched, too.
    candidates: transaction_id, expense_id, days (apart), merchant_text, store_name, card and
    account (booleans, null is unknown), identifier (boolean); amounts are equal already. Text
    ratios are computed once for each distinct pair of names.
    """
    names = candidates.select("merchant_text", "store_name").distinct()
    names = names.select("merchant_text", "store_name", ratio(normalize("merchant_text"), normalize("store_name")).alias("alike"))
    names = names.select(F.col("merchant_text").alias("_m"), F.col("store_name").alias("_s"), "alike")
    scored = candidates.join(names, F.col("merchant_text").eqNullSafe(F.col("_m")) & F.col("store_name").eqNullSafe(F.col("_s")))
    points = lambda c, p: F.when(c, p).otherwise(0)
    score = (
        F.lit(45)
        + F.when(F.col("days") == 0, 20).when(F.col("days") <= 1, 10).when(F.col("days") <= 3, 5).otherwise(0)
        + F.when(F.col("alike") >= 0.90, 20).when(F.col("alike") >= 0.75, 10).when(F.col("alike") >= 0.55, 5).otherwise(0)
        + points(F.col("card"), 10)
        + points(F.col("account"), 10)
        + points(F.col("identifier"), 30)
    )
    best = best_and_margin(scored.withColumn("score", score), "transaction_id", "expense_id", "score")
    has_rival = F.col("margin") <= 10
    outcome = F.when(F.col("best_score") < 80, "unmatched").when(has_rival & (F.col("margin") < F.col("best_score")), "ambiguous").otherwise("matched")
    out = best.withColumn("outcome", outcome).withColumn("best", F.when(F.col("outcome") == "matched", F.col("best")))
    if transactions is not None:
        out = transactions.select("transaction_id").join(out, "transaction_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unmatched")))
    return out


def _affine_ratios(pieces: pd.Series, keywords: pd.Series, least: float) -> pd.Series:
    """Ratios less 0.18 for pairs without a common prefix, word or part; 0 where no score reaches ``least``."""
    out = []
    for a, b in zip(pieces, keywords, strict=True):
        m = SequenceMatcher(None, a, b)
        # Both are upper bounds of the ratio.
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            out.append(0.0)
            continue
        x, y = a.split(), b.split()
        near = a in b or b in a or not set(x).isdisjoint(y) or not {w[:3] for w in x if len(w) >= 3}.isdisjoint(w[:3] for w in y if len(w) >= 3)
        out.append(m.ratio() - (0.0 if near else 0.18))
    return pd.Series(out, dtype="float64")


def fuzzy_keyword(items: DataFrame, keywords: DataFrame, text: str, threshold: float = 0.75, gap: float = 0.08) -> DataFrame:
    """I8: the category of the keyword most like a word, two or three words or all of each distinct text.

    keywords: keyword, category; a configuration table, so it is broadcast. Single words are
    compared only with single keywords of the same first letter. A second category within
    ``gap`` leaves none. Each distinct piece is compared once, and not where the score could
    neither win nor be within ``gap`` of a winner.
    """

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return _affine_ratios(x, y, threshold - gap - 1e-9)

    distinct = items.select(text).distinct()
    norm = normalize(text)
    grams = F.array_distinct(F.concat(F.split(norm, " "), ngrams(norm, 2), ngrams(norm, 3), F.array(norm)))
    pieces = distinct.select(text, F.explode(grams).alias("piece")).where("piece <> ''")
    words = F.broadcast(keywords.select(normalize("keyword").alias("keyword"), "category").where("keyword <> ''").distinct())
    several = F.contains("piece", F.lit(" ")) | F.contains("keyword", F.lit(" "))
    pairs = pieces.select("piece").distinct().join(words, several | (F.substring("piece", 1, 1) == F.substring("keyword", 1, 1)))
    scored = pairs.withColumn("alike", alike("piece", "keyword")).where("alike > 0").groupBy("piece", "category").agg(F.max("alike").alias("alike"))
    by_category = pieces.join(scored, "piece").groupBy(text, "category").agg(F.max("alike").alias("alike"))
    best = best_and_margin(by_category, text, "category", "alike").where((F.col("best_score") >= threshold) & (F.col("margin") >= gap))
    return best.select(text, F.col("best").alias("category"), F.col("best_score").alias("confidence"))


def categorize(items: DataFrame, learned: DataFrame, rules: DataFrame, keywords: DataFrame, text: str = "item_name", verified: DataFrame | None = None) -> DataFrame:
    """Verified override, rule, learned mapping, keyword and fuzzy keyword in this order; else unresolved, never a default.

    verified and learned: description, category. Works on distinct names and joins the decisions back.
    """
    names = items.select(text).distinct().withColumn("norm", normalize(text))
    learned = learned.groupBy(normalize("description").alias("norm")).agg(F.min("category").alias("learned"))
    sure = learned.select("norm", F.lit(None).cast("string").alias("verified")).limit(0) if verified is None else verified.groupBy(normalize("description").alias("norm")).agg(F.min("category").alias("verified"))
    ruled = rule_join(names.join(learned, "norm", "left").join(sure, "norm", "left"), rules, "norm")
    plain = F.broadcast(keywords.select("keyword", F.col("category").alias("kw_category"), "position"))
    hits = names.join(plain, F.contains(F.concat(F.lit(" "), "norm", F.lit(" ")), F.concat(F.lit(" "), "keyword", F.lit(" ")))).groupBy("norm").agg(F.min_by("kw_category", F.struct("position", "keyword")).alias("kw"))
    near = fuzzy_keyword(names.withColumnRenamed(text, "_raw"), keywords, "norm").select("norm", F.col("category").alias("near"))
    out = ruled.join(hits, "norm", "left").join(near, "norm", "left")
    decided = F.coalesce("verified", "rule_category", "learned", "kw", "near")
    how = F.when(F.col("norm") == "", "unresolved").when(F.col("verified").isNotNull(), "verified_override").when(F.col("rule_category").isNotNull(), "runtime_rule").when(F.col("learned").isNotNull(), "learned_mapping").when(F.col("kw").isNotNull(), "rule").when(F.col("near").isNotNull(), "fuzzy_rule").otherwise("unresolved")
    confidence = F.when(how.isin("verified_override", "learned_mapping", "runtime_rule"), 1.0).when(how == "rule", 0.95).when(how == "fuzzy_rule", 0.80)
    decisions = out.select(F.col(text).alias("_name"), F.when(how != "unresolved", decided).alias("decided"), how.alias("provenance"), confidence.alias("confidence"))
    return items.join(decisions, F.col(text).eqNullSafe(F.col("_name")), "left").drop("_name")


# Names that the older rules decide by themselves, and their default.
LEGACY_EXACT = (("protein bar", "Groceries"), ("enviro fee", "Groceries"), ("crest", "Indoor Supplies"))
LEGACY_DEFAULT = "Groceries"


def legacy_category(items: DataFrame, verified: DataFrame, rules: DataFrame, keywords: DataFrame, text: str = "item_name") -> DataFrame:
    """The older cascade, which always gives a category: verified, fixed names, rule, keyword, fuzzy keyword, default."""
    none = verified.limit(0)
    out = categorize(items, none, rules, keywords, text, verified)
    fixed, lower = F.lit(None).cast("string"), F.lower(F.col(text))
    for piece, category in reversed(LEGACY_EXACT):
        fixed = F.when(F.contains(lower, F.lit(piece)), category).otherwise(fixed)
    sure = F.col("provenance") == "verified_override"
    names = {"verified_override": "verified_cache", "runtime_rule": "mapping_rule", "rule": "exact", "fuzzy_rule": "fuzzy"}
    how = F.lit("default")
    for ours, theirs in names.items():
        how = F.when(F.col("provenance") == ours, theirs).otherwise(how)
    return out.withColumns({"decided": F.when(sure, F.col("decided")).otherwise(F.coalesce(fixed, "decided", F.lit(LEGACY_DEFAULT))), "provenance": F.when(~sure & fixed.isNotNull(), "exact").otherwise(how)}).drop("confidence")


def ordered_matches(groups: DataFrame, key: str, left: str, right: str, least: float = 0.6) -> DataFrame:
    """C20 over a table: for each group's two arrays of lines, the sure pairs of positions."""

    @F.pandas_udf("array<struct<left: int, right: int>>")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            w = {(i, j): r for i, p in enumerate(x) for j, q in enumerate(y) if (r := SequenceMatcher(None, p, q).ratio()) >= least}
            out.append([{"left": i, "right": j} for i, j in sure_alignment(w, len(x), len(y)).items()])
        return pd.Series(out)

    return groups.select(key, F.explode(matched(left, right)).alias("m")).select(key, "m.left", "m.right")


def similarity(a: Column, b: Column) -> Column:
    return ratio(normalize(a), normalize(b))
