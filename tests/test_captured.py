import datetime
import uuid

from pyspark.sql import functions as F

from tillspark.functions import captured as c


def test_lines_boxes_and_pages():
    assert [i for i, _ in c.evidence_lines(["GRK YOGURT", "MILK", "GREEK YOGURT 12"], "Greek Yogurt")] == [0, 2]
    assert c.boxes_for_lines(["milk 2%", "eggs"], ["egqs", "milk 2", "noise"]) == {0: 1, 1: 0}
    assert c.overlap(["a", "total 1", "thanks"], ["total 1", "thanks", "b"]) == 2
    assert c.joined_pages([["a", "b"], ["b", "c"], ["x"]]) == ["a", "b", "c", "x"]
    assert c.completeness([["a"], ["b"]], False) == "possible_page_gap" and c.completeness([["a"], ["b"]], True) == "complete"


def test_supplement_adds_what_is_missing_once():
    assert c.supplement("A 1.00\nTOTAL 1.00", ["Subtotal 1.00\nTotal 9", "SUBTOTAL 2.00\nVISA"]) == "A 1.00\nTOTAL 1.00\nSubtotal 1.00\nVISA"


def test_items_match_one_to_one(spark):
    assert c.match_items([(["Milk"], 1), (["MILK!", "cow"], 1)], [("milk", 1), ("Cow", 1)]) == {0: 0, 1: 1}
    a = spark.createDataFrame([(1, "Milk", 1.0), (1, "Milk", 1.0), (2, "Eggs", 2.0)], "k int, name string, amount double")
    b = spark.createDataFrame([(1, "milk", 1.0), (2, "Eggs", 3.0)], a.schema)
    assert {r["k"]: (r["expected"], r["given"], r["matched"]) for r in c.matched_items(a, b, "k").collect()} == {1: (2, 1, 1), 2: (1, 1, 0)}


def test_tables(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    df = spark.createDataFrame([("x", ["x", "y"]), (None, None)], "name string, lines array<string>")
    out = c.with_evidence_lines(df.withColumn("id", c.name_uuid(ns, F.col("name"))), "name", "lines").collect()
    assert out[0]["id"] == str(uuid.uuid5(uuid.UUID(ns), "x")) and out[0]["evidence"][0]["line"] == 0 and out[1]["id"] is None and out[1]["evidence"] == []
    pages = spark.createDataFrame([(1, 2, ["b", "c"], False), (1, 1, ["a", "b"], False), (2, 1, ["q"], True)], "k int, page int, lines array<string>, fits boolean")
    assert {r["k"]: (r["text"], r["status"]) for r in c.scan_completeness(pages, "k", "page", "lines", "fits").collect()} == {1: ("a\nb\nc", "complete"), 2: ("q", "complete")}


def test_cache_runs_out(spark):
    at = datetime.datetime(2026, 1, 1)
    cache = spark.createDataFrame([("old", "r", at), ("empty", None, at), ("new", "r", at + datetime.timedelta(days=60))], "query string, result string, fetched_at timestamp")
    queries = spark.createDataFrame([("old",), ("empty",), ("new",), ("none",)], "query string")
    hit, miss = c.cached_or_missing(queries, cache, F.lit("2026-04-15 00:00:00").cast("timestamp"))
    assert [r["query"] for r in hit.collect()] == ["new"] and sorted(r["query"] for r in miss.collect()) == ["empty", "none", "old"]
