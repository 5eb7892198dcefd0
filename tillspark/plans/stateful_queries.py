"""Registered queries of the state, fuzzy, graph, text and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as fz
from ..functions import receipt_text as rt
from ..operators import graph as gr
from ..operators import joins as jo
from ..operators import state as st
from ..sources import bindings as bi
from ..streaming import events as ev

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{bi.ALL_SQL}\n{sql}"
        return f

    return register


_NEW = "incoming AS (SELECT id, total + 1 AS total, source FROM expenses WHERE id % 3 = 0 UNION ALL SELECT id + 900000000, total, source FROM expenses WHERE id % 7 = 0)"


def _current_and_incoming(s, d):
    e = bi.expenses(s, d).select("id", "total", "source")
    changed = e.where("id % 3 = 0").select("id", (F.col("total") + 1).cast("decimal(14,2)").alias("total"), "source")
    added = e.where("id % 7 = 0").select((F.col("id") + 900000000).alias("id"), "total", "source")
    return e.where("id % 2 = 0"), changed.unionByName(added)


@query(
    "l1_upsert",
    f""", {_NEW}, cur AS (SELECT id, total, source FROM expenses WHERE id % 2 = 0)
    SELECT coalesce(c.id, i.id) AS id, CAST(CASE WHEN i.id IS NULL OR (c.id IS NOT NULL AND c.source = 'instacart') THEN c.total ELSE i.total END AS DECIMAL(14,2)) AS total,
      CASE WHEN i.id IS NULL OR (c.id IS NOT NULL AND c.source = 'instacart') THEN c.source ELSE i.source END AS source FROM cur c FULL JOIN incoming i ON c.id = i.id""",
)
def l1(s, d):
    current, incoming = _current_and_incoming(s, d)
    return st.upsert(current, incoming, ["id"], protected=F.col("source") == "instacart")


@query("l2_insert_ignore", f", {_NEW} SELECT id, total, source FROM expenses WHERE id % 2 = 0 UNION ALL SELECT id, CAST(total AS DECIMAL(14,2)), source FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM expenses e WHERE e.id % 2 = 0 AND e.id = i.id)")
def l2(s, d):
    current, incoming = _current_and_incoming(s, d)
    return st.insert_ignore(current, incoming, ["id"])


@query(
    "l3_replace_children",
    """, inc AS (SELECT expense_pk, item_id, line_total FROM expense_items WHERE expense_pk % 4 = 0 AND line_total > 50000)
    SELECT expense_pk, item_id, line_total FROM expense_items WHERE expense_pk NOT IN (SELECT expense_pk FROM inc) UNION ALL SELECT * FROM inc""",
)
def l3(s, d):
    i = bi.expense_items(s, d).select("expense_pk", "item_id", "line_total")
    return st.replace_children(i, i.where("expense_pk % 4 = 0 and line_total > 50000"), "expense_pk")


@query(
    "l4_constraints",
    """SELECT id, 'total_bounded' AS violation FROM expenses WHERE NOT (total < 400000) UNION ALL SELECT id, 'card_four_digits' FROM expenses WHERE NOT (length(card_last4) = 4 AND card_last4 <> '0007')""",
)
def l4(s, d):
    rules = {"total_bounded": F.col("total") < 400000, "card_four_digits": (F.length("card_last4") == 4) & (F.col("card_last4") != "0007")}
    return st.violations(bi.expenses(s, d), rules).select("id", "violation")


@query(
    "l7_next_state",
    """, f AS (SELECT request_id, count(*) FILTER (WHERE status = 'active') AS starts, arg_max(status, struct_pack(a := occurred_at, b := id)) AS status, max(occurred_at) AS at FROM receipt_events GROUP BY 1)
    SELECT coalesce(c.c_custkey, f.request_id) AS request_id, coalesce(f.status, 'queued') AS status,
      CAST(CASE WHEN c.c_custkey IS NULL THEN 0 ELSE 1 END + coalesce(f.starts, 0) AS BIGINT) AS attempts, f.at AS updated_at FROM customer c FULL JOIN f ON f.request_id = c.c_custkey""",
)
def l7_whole(s, d):
    """Every customer has a state, and every event counts."""
    states = bi.read(s, d, "customer").selectExpr("c_custkey AS request_id", "'queued' AS status", "1L AS attempts", "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at")
    return st.next_state(states, bi.receipt_events(s, d), "request_id")


@query(
    "l9_plan_work",
    """SELECT id, CASE WHEN extraction_status = 'complete' THEN 'skip' WHEN id % 5 >= 3 THEN 'exhausted' WHEN extraction_status = 'unreadable' THEN 'retry' ELSE 'pending' END AS plan,
    CAST(least(3600, 60 * power(2, least(greatest(id % 5 - 1, 0), 6))) AS BIGINT) AS delay FROM expenses""",
)
def l9(s, d):
    e = bi.expenses(s, d)
    states = e.select("id", F.when(F.col("extraction_status") == "unreadable", "failed").otherwise(F.col("extraction_status")).alias("status"), (F.col("id") % 5).alias("attempts"))
    return st.plan_work(e.select("id"), states, "id").select("id", "plan", st.retry_delay(F.col("attempts")).alias("delay"))


@query("l11_changes", "SELECT a.id, a.total AS before_total, CAST(CASE WHEN a.id % 10 = 0 THEN a.total + 1 ELSE a.total END AS DECIMAL(14,2)) AS after_total FROM expenses a WHERE a.id % 10 = 0")
def l11(s, d):
    e = bi.expenses(s, d).select("id", "total")
    after = e.select("id", F.when(F.col("id") % 10 == 0, F.col("total") + 1).otherwise(F.col("total")).cast("decimal(14,2)").alias("total"))
    return st.changed(e, after, "id", ["total"]).select("id", F.col("before.total").alias("before_total"), F.col("after.total").alias("after_total"))


@query("l12_deletion", "SELECT e.id, coalesce(x.deleted, false) AS deleted FROM expenses e LEFT JOIN (SELECT expense_pk, bool_and(tax_code = 'N') AS deleted FROM expense_items GROUP BY 1) x ON x.expense_pk = e.id")
def l12(s, d):
    evidence = bi.expense_items(s, d).select("expense_pk", (F.col("tax_code") == "N").alias("deleted"))
    return st.propagate_deletion(bi.expenses(s, d).select("id"), evidence)


@query("i3_transaction_match")
def i3(s, d):
    t = bi.transactions(s, d).select("id", "amount", F.col("transaction_date").alias("date"), "card_last4", "description", "account_id")
    e = bi.expenses(s, d).select("id", F.col("total").alias("amount"), F.col("order_date").alias("date"), "card_last4", "store_name", "account_id", "order_id")
    c = jo.near_amount_and_date(t, e, 7)
    return fz.match_transactions(
        c.select(
            F.col("id").alias("transaction_id"),
            F.col("r_id").alias("expense_id"),
            F.abs(F.datediff("date", "r_date")).alias("days"),
            F.col("description").alias("merchant_text"),
            F.col("r_store_name").alias("store_name"),
            (F.col("card_last4") == F.col("r_card_last4")).alias("card"),
            (F.col("account_id") == F.col("r_account_id")).alias("account"),
            F.lit(False).alias("identifier"),
        ),
        t.select(F.col("id").alias("transaction_id")),
    )


def _keywords(s):
    rows = [("widget", "Widgets", 1), ("ring", "Jewellery", 2), ("gear", "Machines", 3), ("bolt", "Hardware", 4), ("blue", "Colours", 5)]
    return s.createDataFrame(rows, "keyword string, category string, position int")


@query("i5_category_cascade")
def i5(s, d):
    from .relational_queries import _rules

    learned = s.createDataFrame([("Red Widget", "Learned widgets")], "description string, category string")
    items = bi.expense_items(s, d).select("expense_pk", "item_id", "item_name")
    return fz.categorize(items, learned, _rules(s).where("rule_id > 2"), _keywords(s))


@query("i8_fuzzy_keyword")
def i8(s, d):
    return fz.fuzzy_keyword(bi.expense_items(s, d).select("item_name"), _keywords(s), "item_name")


@query("h7_sequence_ratio")
def h7(s, d):
    names = bi.read(s, d, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a"), F.split("p_name", " ")[0].alias("b"))
    return pairs.select("a", "b", fz.similarity(F.col("a"), F.col("b")).alias("ratio"))


@query("c20_ordered_alignment")
def c20(s, d):
    i = bi.expense_items(s, d)
    names = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "item_name"))), lambda x: x["item_name"])
    lists = i.groupBy("expense_pk").agg(names.alias("a"))
    lists = lists.withColumn("b", F.filter("a", lambda x, k: k % 3 != 1))
    return fz.ordered_matches(lists, "expense_pk", "a", "b")


@query("h12_receipt_fields")
def h12(s, d):
    out = rt.parsed(bi.read(s, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "fields.subtotal", "fields.tax", "fields.total", "fields.payment_method", "fields.card_last4", "fields.transaction_datetime", F.size("fields.items").alias("items"))


@query("h16_repeated_amounts")
def h16(s, d):
    return rt.repeated_amounts(bi.read(s, d, "documents").select("doc_id", "text"), "doc_id")


@query("k2_event_graph_edges", """, t AS (SELECT request_id, attempt, bool_or(status = 'failed') AS failed, bool_or(status = 'active') AS started FROM receipt_events GROUP BY 1, 2),
    r AS (SELECT a.request_id, a.attempt, min(b.attempt) AS later FROM t a JOIN t b ON a.request_id = b.request_id AND b.attempt > a.attempt AND b.started WHERE a.failed GROUP BY 1, 2)
    SELECT 'HAS_ATTEMPT' AS kind, count(*) AS n FROM t UNION ALL SELECT 'OBSERVED', count(*) FROM receipt_events UNION ALL SELECT 'RETRIED_AS', count(*) FROM r""")
def k2(s, d):
    _, edges = gr.event_graph(bi.receipt_events(s, d))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k3_story_reach",
    """, t AS (SELECT DISTINCT request_id, attempt FROM receipt_events WHERE request_id IN (1, 2, 3))
    SELECT 'Request' AS kind, 3 AS n FROM receipt_events WHERE request_id IN (1, 2, 3) HAVING count(*) > 0 UNION ALL SELECT 'Attempt', count(*) FROM t UNION ALL SELECT 'Event', count(*) FROM receipt_events WHERE request_id IN (1, 2, 3)""",
)
def k3(s, d):
    nodes, edges = gr.event_graph(bi.receipt_events(s, d))
    start = s.createDataFrame([(1,), (2,), (3,)], "request_id long").select(gr.node_id("Request", F.col("request_id")).alias("id"))
    found = gr.reach(start, edges, ["HAS_ATTEMPT", "OBSERVED", "RETRIED_AS"])
    return found.join(nodes, "id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("j1_once_each", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def j1(s, d):
    path = f"{d}/events.parquet"
    stream = ev.event_stream(s, path)
    twice = stream.unionByName(ev.event_stream(s, path))
    return ev.run_available(ev.once_each(twice, "event_id", "ts", "60 days").select("event_id", "event_type"), "append", "once").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("j6_latest_status", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, count(*) AS events FROM events GROUP BY 1")
def j6(s, d):
    out = ev.latest_status(ev.event_stream(s, f"{d}/events.parquet"), "user_id", "event_type", ["ts", "event_id"])
    return ev.run_available(out, "complete", "latest")


@query(
    "j7_windowed_rates",
    "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(24,2)) AS total FROM events GROUP BY 1, 2",
)
def j7(s, d):
    out = ev.run_available(ev.windowed_rates(ev.event_stream(s, f"{d}/events.parquet"), late="60 days"), "complete", "rates")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "j7a_alerts",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (WHERE event_type = 'error') > 0.25 * count(*)",
)
def j7a(s, d):
    e = bi.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.alerts(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "j5_attempt_states",
    """, n AS (SELECT request_id, arg_max(status, struct_pack(a := occurred_at, b := id)) AS status, max(occurred_at) AS last_at, count(*) FILTER (WHERE status = 'active') AS starts FROM receipt_events GROUP BY 1)
    SELECT request_id, CASE WHEN status IN ('active', 'heartbeat') THEN CASE WHEN epoch(TIMESTAMP '2024-01-30 23:00:00') - floor(epoch(last_at)) > 90 THEN 'stale' ELSE 'running' END ELSE status END AS state, starts, last_at FROM n""",
)
def j5(s, d):
    log = bi.receipt_events(s, d).select("request_id", "id", F.col("occurred_at").cast("timestamp").alias("at"), "status")
    out = ev.attempt_states(log, F.lit("2024-01-30 23:00:00").cast("timestamp"))
    return out.withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
