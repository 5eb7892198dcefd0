import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillspark.functions import fuzzy
from tillspark.sources import bank, storage


def test_exports_by_a_field_map(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('When,What,Out,In,No\n2024-02-01,"Shop 12345678, north","1,204.50",,x9876\n02/30/2024,bad day,1.00,,\n2024-02-03,pay,,20.00,\n2024-02-04,both,1.00,2.00,\n2024-02-05,,3.00,,\n')
    fields = {"date": "When", "description": "What", "debit": "Out", "credit": "In", "card": "No"}
    rows = [(r["posted"], r["description"], r["amount"], r["card_last4"], r["error"]) for r in bank.read_by_fields(spark, str(tmp_path / "in"), fields).collect()]
    assert rows[0] == (datetime.date(2024, 2, 1), "Shop ****5678, north", Decimal("1204.50"), "9876", None)
    assert [r[4] for r in rows] == [None, "date", None, "amount", "description"] and rows[2][2] == Decimal("-20.00")
    with pytest.raises(ValueError, match="Date"):
        bank.read_by_fields(spark, str(tmp_path / "in"), {"date": "Date"})


def test_exports_and_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", None), (2, "x" * 5000, 1.5)], "id int, text string, value double")
    for form in ("json", "csv"):
        storage.export(df, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).orderBy("id").select("id", "text", "value").collect() == df.collect()
    assert spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError, match="xlsx"):
        storage.export(df, str(tmp_path / "x"), "xlsx")
    assert sorted(len(t) for t in storage.rows_one_by_one(df.repartition(2), "text")) == [5, 5000]


def test_files_settle_and_come_again(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    found = spark.createDataFrame([("new", 1, at(0), "a"), ("hot", 1, at(9), "a"), ("same", 1, at(0), "a"), ("grown", 2, at(0), "b"), ("failed", 1, at(0), "a"), ("waits", 1, at(0), "a")], "reference string, bytes long, modified_at timestamp, sha256 string")
    seen = spark.createDataFrame([(n, 1, "a", n in ("failed", "waits"), at(5) if n == "failed" else at(30)) for n in ("same", "grown", "failed", "waits")], "reference string, bytes long, sha256 string, failed boolean, not_before timestamp")
    now = F.lit(at(9)).cast("timestamp")
    assert {r["reference"] for r in storage.settled(seen, found, now).collect()} == {"new", "grown", "failed"}


def test_cascade_order(spark):
    items = spark.createDataFrame([("Blue Bolt",), ("Red Ring",), ("Ring!",), ("",), ("quux",)], "item_name string")
    two = "description string, category string"
    rules = spark.createDataFrame([(1, "contains", "ring", None, None, "Ruled", 1, 1)], "rule_id int, match_type string, match_text string, source string, merchant string, category string, priority int, position int")
    keywords = spark.createDataFrame([("bolt", "Keyword", 1)], "keyword string, category string, position int")
    out = fuzzy.categorize(items, spark.createDataFrame([("red ring", "Learned"), ("blue bolt", "Learned")], two), rules, keywords, verified=spark.createDataFrame([("ring", "Sure")], two))
    assert {r["item_name"]: (r["decided"], r["provenance"]) for r in out.collect()} == {"Blue Bolt": ("Learned", "learned_mapping"), "Red Ring": ("Ruled", "runtime_rule"), "Ring!": ("Sure", "verified_override"), "": (None, "unresolved"), "quux": (None, "unresolved")}


def test_older_cascade_always_decides(spark):
    items = spark.createDataFrame([("Crest paste",), ("Protein Bars",), ("Red Ring",), ("Bolt",), ("quux",), ("gold",)], "item_name string")
    rules = spark.createDataFrame([(1, "contains", "ring", None, None, "Ruled", 1, 1)], "rule_id int, match_type string, match_text string, source string, merchant string, category string, priority int, position int")
    keywords = spark.createDataFrame([("bolt", "Keyword", 1)], "keyword string, category string, position int")
    verified = spark.createDataFrame([("gold", "Sure")], "description string, category string")
    out = {r["item_name"]: (r["decided"], r["provenance"]) for r in fuzzy.legacy_category(items, verified, rules, keywords).collect()}
    assert out == {"Crest paste": ("Indoor Supplies", "exact"), "Protein Bars": ("Groceries", "exact"), "Red Ring": ("Ruled", "mapping_rule"), "Bolt": ("Keyword", "exact"), "quux": ("Groceries", "default"), "gold": ("Sure", "verified_cache")}
