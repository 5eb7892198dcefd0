"""Pairs of purchases are far more than purchases: no join looks them up again and nothing makes them distinct."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tillspark.operators import decisions, evidence, joins
from tillspark.plans import registry

from .test_queries import SF


@pytest.mark.parametrize("name", ["i1_duplicate_score", "i2_duplicate_capture"])
def test_pairs_meet_no_further_join(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join [left_pk" not in plan and "Join [right_pk" not in plan and "keys=[left_" not in plan


def test_each_pair_is_made_once(spark):
    df = spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, 7, None), (4, 8, "a"), (5, None, "b"), (6, None, "b")], "id int, x int, y string")
    out = joins.pairs_within(df, "id", [["x"], ["y"]]).collect()
    assert sorted((r["left_id"], r["right_id"]) for r in out) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (5, 6)]


def test_resolved_pairs_by_table_and_by_condition(spark):
    at, why = datetime.datetime(2026, 5, 1, 9, 30), ["identifier_match"]
    rows = [(1, 2, "123456", at, True, 95, "exact_duplicate", why), (1, 3, "123456", at, True, 95, "exact_duplicate", why), (4, 5, "123456", at, True, 50, "needs_review", why)]
    scored = spark.createDataFrame(rows, "left_pk int, right_pk int, left_id string, left_at timestamp, same_id boolean, score int, disposition string, reasons array<string>")
    shown = lambda resolved: {(r["left_pk"], r["right_pk"]): r["auto_link"] for r in evidence.duplicate_capture(scored, resolved).collect()}
    done = F.col("right_pk") == 3
    assert shown(done) == shown(scored.where(done).select("left_pk", "right_pk")) == {(1, 2): True, (4, 5): False}
    assert shown(F.lit(False)) == {(1, 2): False, (1, 3): False, (4, 5): False}


def test_sides_are_built_and_shuffled_once_and_no_pair_crosses_again(spark):
    df = registry.QUERIES["i2_duplicate_capture"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Two blocks; each has its sides shuffled once for left and right, and the purchases' items are grouped once for both.
    assert plan.count("ReusedExchange") >= 3
    ran = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert not [line for line in ran if "left_" in line or "right_" in line]


def test_what_leaves_pairs_out_before_they_are_scored_leaves_out_none_to_show(spark):
    """Against all pairs of the same rows: every disposition, totals a cent apart, nulls, shared and unlike items."""
    at = datetime.datetime(2026, 5, 1, 9, 30)
    goods = ["tea", "milk", "eggs", "rice", "soap", "oil", "salt", "corn", "fish"]
    rows = []
    for i in range(240):
        total = None if i % 23 == 0 else decimal.Decimal(1000 + i % 7 + 40 * (i % 5)) / 100
        items = [goods[j] for j in range(9) if (i * 2654435761 >> (j + 7)) & 3 == 0]
        rows.append((i, f"{i}00000", "shop" if i % 11 else None, at + datetime.timedelta(minutes=i % 13), at.date(), total, None if i % 6 == 0 else str(i % 9), items))
    df = spark.createDataFrame(rows, "pk int, id string, merchant string, at timestamp, day date, total decimal(14,2), card string, items array<string>")
    all_of, some = (joins.pairs_by_block(df, "pk", [["day", "merchant"]], decisions.duplicate_sides, [only])[0] for only in (None, decisions.may_be_alike()))
    shown = [sorted(tuple(r) for r in evidence.duplicate_capture(decisions.duplicate_score(pairs), F.lit(False)).collect()) for pairs in (all_of, some)]
    assert shown[0] == shown[1] and {r[3] for r in shown[0]} == {"needs_review", "probable_duplicate"}
    assert len(shown[0]) < some.count() < all_of.count()


def test_each_combination_of_facts_is_scored_as_by_hand(spark):
    rows = spark.range(1).select(F.explode(decisions._verdicts()).alias("v")).select("v.*").collect()
    assert len(rows) == 2 * 2 * 3 * 3 * 2 * 4
    points = {name: p for levels in decisions.FACTS.values() for p, name in levels}
    for r in rows:
        tied = {"merchant_match", "time_within_5m"} <= set(r["reasons"]) and any(x.startswith("items_") for x in r["reasons"])
        assert r["score"] == sum(points.get(x, 0) for x in r["reasons"]) and ("merchant_time_item_correlation" in r["reasons"]) == tied
        if not {"identifier_match", "total_exact", "card_match"} & set(r["reasons"]) and not any(x.startswith("items_") for x in r["reasons"]):
            assert r["disposition"] == "distinct"  # may_be_alike leaves such pairs out
        assert r["disposition"] == ("exact_duplicate" if r["score"] >= 90 else "probable_duplicate" if r["score"] >= 70 else "needs_review" if r["score"] >= 50 or tied else "distinct")


def test_a_link_is_counted_where_the_pairs_lie(spark):
    """Pairs dealt by what follows from the left document give what an unordered table of them gives."""
    at, why = datetime.datetime(2026, 5, 1, 9, 30), ["identifier_match"]
    rows = [(1, 2, "123456", at, True, 95, "exact_duplicate", why), (1, 3, "123456", at, True, 95, "exact_duplicate", why), (4, 5, "654321", at, True, 95, "exact_duplicate", why), (4, 6, "654321", at, True, 50, "needs_review", why)]
    schema = "left_pk int, right_pk int, left_id string, left_at timestamp, same_id boolean, score int, disposition string, reasons array<string>"
    same, others = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 9, "123456", at, False, 60, "needs_review", ["x"]), (7, 8, None, at, False, 10, "distinct", ["x"])], schema)
    out = {(r["left_pk"], r["right_pk"]): r["auto_link"] for r in evidence.duplicate_capture(same.repartition(2, "left_id"), F.lit(False), others, ["left_id"]).collect()}
    assert out == {(1, 2): False, (1, 3): False, (4, 5): True, (4, 6): False, (1, 9): False}


def test_rows_that_are_not_alone_in_a_block(spark):
    df = spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, 7, None), (4, 7, None), (5, 8, "a"), (6, None, "b"), (7, None, "b")], "id int, x int, y string")
    assert sorted(r["id"] for r in joins.not_alone(df, ["x", "y"]).collect()) == [1, 2]
