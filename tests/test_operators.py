import datetime
import random
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tillspark.functions import fuzzy, receipt_text, text
from tillspark.operators import aggregates, decisions, graph, joins, relational, state
from tillspark.sources import bank, storage
from tillspark.streaming import events

D = Decimal
day = datetime.date


def test_json_key_with_null_value_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"duplicate_merge": null}'), (4, '{"receipt_deleted": {}}')], "id int, raw_payload string")
    assert [r["id"] for r in relational.active_rows(df).orderBy("id").collect()] == [1, 2]


def test_as_of_at_the_edges_of_the_tolerance(spark):
    left = spark.createDataFrame([(i, day(2026, 3, 10) + datetime.timedelta(days=i)) for i in (-1, 0, 7, 8)], "id int, d date")
    right = spark.createDataFrame([(day(2026, 3, 10), 1.5), (None, 9.9)], "r date, rate double")
    assert {r["id"]: r["rate"] for r in joins.as_of(left, right, "d", "r", 7).collect()} == {-1: None, 0: 1.5, 7: 1.5, 8: None}


def test_effective_dates_and_two_owners(spark):
    cards = spark.createDataFrame([("1234", 10, day(2026, 1, 1), day(2026, 6, 30)), ("1234", 20, day(2026, 7, 1), None), ("9", 1, day(2026, 1, 1), None), ("9", 2, day(2026, 5, 1), None)], "card string, account int, f date, t date")
    left = spark.createDataFrame([(1, "1234", day(2026, 6, 30)), (2, "1234", day(2026, 8, 20)), (3, "9", day(2026, 6, 1)), (4, "0", day(2026, 1, 1))], "id int, card string, d date")
    out = {r["id"]: (r["account"], r["matches"]) for r in joins.effective_dated(left, cards, ["card"], "d", "f", "t", "account").collect()}
    assert out == {1: (10, 1), 2: (20, 1), 3: (None, 2), 4: (None, 0)}


def test_penny_allocation_is_exact_and_survives_zero_and_refunds(spark):
    items = spark.createDataFrame([(1, 1, D("1.00")), (1, 2, D("1.00")), (1, 3, D("1.00")), (2, 1, D("0.00")), (3, 1, D("-5.00")), (3, 2, D("2.00")), (4, 1, D("7.00"))], "expense_pk int, item_id int, line_total decimal(14,2)")
    totals = spark.createDataFrame([(1, D("1.00")), (2, D("3.00")), (3, D("-3.39")), (4, D("7.91"))], "id int, total decimal(14,2)")
    out = {(r["expense_pk"], r["item_id"]): r["allocated"] for r in aggregates.penny_allocation(items, totals).collect()}
    assert out[1, 1] == D("0.34") and out[1, 2] == out[1, 3] == D("0.33")
    assert out[2, 1] is None and out[3, 1] + out[3, 2] == D("-3.39") and out[4, 1] == D("7.91")


def test_duplicate_scores(spark):
    at = datetime.datetime(2026, 8, 10, 14, 30)
    items = ["rye bread|2", "pears|1", "salt|1"]
    rows = [
        (1, "Till 88/4", "TILL884", "Corner Shop", "corner-shop", at, at, D("61.05"), D("61.05"), "9001", "9001", items, items),
        (2, "A1", "B2", "Bakery", "BAKERY", at, at + datetime.timedelta(seconds=300), D("100.00"), D("104.99"), None, "1", items, items[:2]),
        (3, None, None, "X", "Y", at, at + datetime.timedelta(seconds=301), D("1.00"), D("1.02"), "1", "2", [], []),
    ]
    names = "id int, left_id string, right_id string, left_merchant string, right_merchant string, left_at timestamp, right_at timestamp, left_total decimal(12,2), right_total decimal(12,2), left_card string, right_card string, left_items array<string>, right_items array<string>"
    out = {r["id"]: r for r in decisions.duplicate_score(spark.createDataFrame(rows, names)).collect()}
    assert out[1]["disposition"] == "exact_duplicate" and {"identifier_match", "items_near_exact"} <= set(out[1]["reasons"])
    assert out[2]["score"] == 15 + 15 + 10 + 10 and out[2]["disposition"] == "needs_review"
    assert out[3]["score"] == 18 and out[3]["reasons"] == ["same_day", "total_within_5pct"] and out[3]["disposition"] == "distinct"


def test_allocation_reasons_and_status(spark):
    rows = [(1, D("21.24"), D("21.24"), D("1.06"), D("26.30"), D("5.00"), D("1.00")), (2, D("20.00"), D("21.24"), None, D("21.26"), None, None), (3, None, None, None, D("1"), None, None)]
    df = spark.createDataFrame(rows, "id int, item_sum decimal(12,2), subtotal decimal(12,2), tax decimal(12,2), total decimal(12,2), charges decimal(12,2), discount decimal(12,2)")
    out = decisions.assess_allocation(df).withColumn("shown", decisions.display_status(F.lit("complete"), F.col("reconciled")))
    got = {r["id"]: (r["reasons"], r["shown"]) for r in out.collect()}
    assert got == {1: ([], "complete"), 2: (["items_do_not_match_subtotal", "header_does_not_add_up"], "review"), 3: (["items_missing", "header_missing"], "review")}


def heaviest(weights, n, m):
    edges = list(weights)
    best, sets = 0.0, [()]
    for k in range(1, min(n, m) + 1):
        for chosen in combinations(edges, k):
            s = sorted(chosen)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(s, s[1:], strict=False)):
                w = sum(weights[e] for e in s)
                if w > best + 1e-8:
                    best, sets = w, [s]
                elif abs(w - best) <= 1e-8:
                    sets.append(s)
    return dict(sorted(set.intersection(*map(set, sets)))) if best else {}


def test_sure_alignment_matches_enumeration():
    r = random.Random(5)
    for _ in range(200):
        n, m = r.randrange(1, 4), r.randrange(1, 4)
        weights = {(i, j): r.choice([0.5, 1.0]) for i in range(n) for j in range(m) if r.random() < 0.7}
        assert fuzzy.sure_alignment(weights, n, m) == heaviest(weights, n, m)


def test_one_to_one_is_a_largest_matching():
    r = random.Random(6)
    for _ in range(200):
        edges = {i: [j for j in range(4) if r.random() < 0.5] for i in range(4)}
        got = fuzzy.one_to_one(edges)
        assert all(j in edges[i] for i, j in got.items()) and len(set(got.values())) == len(got)
        pairs = [(i, j) for i in edges for j in edges[i]]
        largest = max((k for k in range(5) if any(len({a for a, _ in c}) == len({b for _, b in c}) == k for c in combinations(pairs, k))), default=0)
        assert len(got) == largest


def test_sequence_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), (None, "x")], "a string, b string")
    out = df.select(fuzzy.ratio("a", "b").alias("x"), fuzzy.ratio("b", "a").alias("y")).collect()
    assert [tuple(r) for r in out] == [(0.25, 0.5), (0.0, 0.0)]


def test_transaction_matching(spark):
    rows = [(1, 10, 0, "Costco Wholesale", "Costco Wholesale", True, True, False), (2, 10, 0, "Shop", "Shop", True, False, False), (2, 11, 0, "Shop", "Shop", True, False, False), (3, 12, 6, "Abc", "xyz", None, None, False)]
    df = spark.createDataFrame(rows, "transaction_id int, expense_id int, days int, merchant_text string, store_name string, card boolean, account boolean, identifier boolean")
    assert {r["transaction_id"]: r["outcome"] for r in fuzzy.match_transactions(df).collect()} == {1: "matched", 2: "ambiguous", 3: "unmatched"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Total $1,234.50 was 9.99-", "Oct", "TRANSFER TO 123456789012", "1.230", "08/31/2026"), (None, None, "1234567", "NaN", "31/08/2026")], "a string, b string, c string, d string, e string")
    out = df.select(text.money(F.col("a")), text.redact(F.col("c")), text.cents(F.col("d")), text.any_date(F.col("e"))).collect()
    assert tuple(out[0]) == (D("-9.99"), "TRANSFER TO ****9012", D("1.23"), day(2026, 8, 31))
    assert tuple(out[1]) == (None, "1234567", None, day(2026, 8, 31))


def test_receipt_fields():
    body = "SHOP 12\n555-123-4567\n1234567 MILK 5.94\nEGGS 8.99\nTPD EGGS 1.00-\nSUBTOTAL 13.93\nHST 0.40\nTOTAL 14.33\nVISA ****1234 14.33\n2026-08-10 14:30"
    subtotal, tax, total, source, method, last4, at, phone, items = receipt_text.extract(body)
    assert (subtotal, tax, total, source, method, last4, at, phone) == (D("13.93"), D("0.40"), D("14.33"), "printed", "visa", "1234", "2026-08-10T14:30", "555-123-4567")
    assert [(i["name"], i["code"], i["amount"]) for i in items] == [("MILK", "1234567", D("5.94")), ("EGGS", None, D("7.99"))]
    assert receipt_text.extract("Subtotal 1.00\ntax 0.13")[2:4] == (D("1.13"), "recovered")
    assert receipt_text.one_moment("2026-01-01 and 2026-01-02") is None and receipt_text.extract(None)[8] == []


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('﻿2026-03-12,"MARKET, MAIN",12.34,,1234********5678\n2026-03-12,"MARKET, MAIN",12.34,,1234********5678\n2026-03-13,REFUND,,20.00,1234********5678\n')
    return tmp_path


def test_bank_exports(spark, folder):
    first = bank.with_fingerprints(bank.read_exports(spark, f"file://{folder}/a", bank.CARD), "card-1")
    rows = [(r["line"], r["posted"], r["description"], r["amount"], r["card_last4"]) for r in first.orderBy("line").collect()]
    assert rows == [(1, day(2026, 3, 12), "MARKET, MAIN", D("12.34"), "5678"), (2, day(2026, 3, 12), "MARKET, MAIN", D("12.34"), "5678"), (3, day(2026, 3, 13), "REFUND", D("-20.00"), "5678")]
    none = spark.createDataFrame([], "fingerprint string")
    imported = storage.stored(bank.import_rows(none, first), "imported")
    assert imported.count() == 3 and bank.import_rows(imported, first).count() == 0
    (folder / "a" / "2.csv").write_text("2026-03-12,\"MARKET, MAIN\",12.34,,1234********5678\n2026-03-14,NEW,1.00,,1234********5678\n")
    both = bank.with_fingerprints(bank.read_exports(spark, f"file://{folder}/a", bank.CARD), "card-1")
    assert bank.import_rows(imported, both).count() == 1
    (folder / "a" / "3.csv").write_text("2026-03-12,X,1.00,2.00,\n")
    with pytest.raises(ValueError, match="nothing imported"):
        bank.import_rows(none, bank.with_fingerprints(bank.read_exports(spark, f"file://{folder}/a", bank.CARD), "card-1"))


def test_deposit_layouts():
    rows = list(bank.parse('Unique ID,Date,Description,Amount,Balance\n1,"Oct 31, 2026",INTEREST,$0.25,$25.25\n2,"Nov 1, 2026",FEE 123456789,-$5.00,x\n', bank.HEADERED_DEPOSIT))
    assert [r[1:4] for r in rows] == [(day(2026, 10, 31), "INTEREST", D("-0.25")), (day(2026, 11, 1), "FEE ****6789", D("5.00"))]
    assert list(bank.parse("2026-05-11,TRANSFER,TRANSFER TO 123456789012,-25.00\n", bank.SHORT_DEPOSIT))[0][2:4] == ("TRANSFER TO ****9012", D("25.00"))
    assert list(bank.parse("bad\n", bank.CARD))[0][5] == "1 columns"


def test_exchange_rates(spark):
    body = '{"observations":[{"d":"2026-03-12","FXUSDCAD":{"v":"1.3654"}},{"d":"2026-03-13","FXUSDCAD":{"v":""}},{"d":"2026-03-14","FXUSDCAD":{"v":"NaN"}},{"d":"2026-03-15","FXUSDCAD":{"v":"-1"}},{"d":"2026-03-16","FXUSDCAD":{"v":"1000"}},{"d":"2026-03-17","FXUSDCAD":{"v":"1.1"}},{"d":"2026-03-17","FXUSDCAD":{"v":"1.2"}}]}'
    out = bank.exchange_rates(spark.createDataFrame([(body,)], "json string")).collect()
    assert [(r["rate_date"], r["rate"]) for r in out] == [(day(2026, 3, 12), D("1.3654000000"))]


def test_files_and_versions(spark, folder):
    found = {r["reference"]: r["bytes"] for r in storage.discover(spark, f"file://{folder}", "*.csv").collect()}
    assert list(found) == ["a/1.csv"]
    t = storage.VersionedTable(spark, f"file://{folder}/table")
    assert t.current() is None
    assert [t.publish(spark.range(n)) for n in (1, 2, 3)] == [1, 2, 3]
    assert t.current().count() == 3 and t.versions() == [2, 3]


def test_upsert_keeps_protected_and_set_values(spark):
    cur = spark.createDataFrame([(1, "a", "x", True), (2, "b", None, False), (3, "c", "z", False)], "id int, v string, w string, locked boolean")
    new = spark.createDataFrame([(1, "A", "X", False), (2, "B", "Y", False), (3, "C", "Z", False), (4, "D", "W", False)], cur.schema)
    out = {r["id"]: (r["v"], r["w"]) for r in state.upsert(cur, new, ["id"], F.col("locked"), ["w"]).collect()}
    assert out == {1: ("a", "x"), 2: ("B", "Y"), 3: ("C", "z"), 4: ("D", "W")}


def test_replay_changes_nothing(spark):
    cur = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], cur.schema)
    once = state.insert_ignore(cur, new, ["id"])
    assert relational.same_rows(once, state.insert_ignore(once, new, ["id"]))


def test_reach_ends_on_cycles_and_stops(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k"), ("c", "d", "k"), ("d", "e", "k"), ("a", "z", "other")], "source string, target string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in graph.reach(start, edges, ["k"]).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert {r["id"] for r in graph.reach(start, edges, ["k"], stop=spark.createDataFrame([("d",)], "id string")).collect()} == set("abcd")
    assert {r["id"] for r in graph.closure(spark.createDataFrame([("c",)], "id string"), edges, ["other"], ["k"]).collect()} == set("abcde")


def test_merged_nodes(spark):
    nodes = spark.createDataFrame([("n", "K", "first", {"a": "1"}, 1), ("n", "K", "second", {"a": "2", "b": "3"}, 2)], "id string, kind string, label string, properties map<string,string>, sequence long")
    r = graph.merge_nodes(nodes).head()
    assert (r["label"], r["properties"]) == ("first", {"a": "2", "b": "3"})


def test_routes(spark):
    df = spark.createDataFrame([(1, True, False, 1), (2, False, False, 2), (3, False, False, 3), (4, False, True, 1), (5, None, None, 1)], "id int, ok boolean, never boolean, attempt int")
    out = events.route(df, F.col("ok"), F.col("never"))
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in out.items()} == {"good": [1], "retry": [2, 5], "dead": [3, 4]}


def test_stateful_attempts_agree_with_the_batch(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(i % 5, i, at + datetime.timedelta(seconds=10 * i), ["active", "heartbeat", "results_published", "failed"][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id long, id long, at timestamp, status string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/log")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    got = events.run_available(events.track_attempts(stream), "append", "attempts")
    last = {r["request_id"]: (r["state"], r["starts"]) for r in got.where("state <> 'stale'").groupBy("request_id").agg(F.max_by("state", F.struct("starts", "last_at")).alias("state"), F.max("starts").alias("starts")).collect()}
    want = {r["request_id"]: r["starts"] for r in events.attempt_states(df, F.lit("2026-01-01 01:00:00").cast("timestamp")).collect()}
    assert {k: v[1] for k, v in last.items()} == want


def test_pass_waits_for_its_run(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    runs = spark.createDataFrame([(i, at + datetime.timedelta(seconds=i)) for i in range(5)], "run_id long, run_at timestamp")
    passes = spark.createDataFrame([(i % 6, i, at) for i in range(12)], "run_id long, pass_id long, pass_at timestamp")
    for name, df in (("runs", runs), ("passes", passes)):
        df.write.parquet(f"file://{tmp_path}/{name}")
    stream = lambda n, df: spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/{n}")
    out = events.run_available(events.passes_after_runs(stream("runs", runs), stream("passes", passes)), "append", "joined")
    assert sorted(r["pass_id"] for r in out.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80
