"""Registered queries of pages, single functions and workflow steps, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import decisions as de
from ..operators import evidence as evd
from ..operators import graph as gr
from ..operators import pages as pg
from ..operators import relational as re
from ..operators import state as st
from ..sources import bindings as bi
from ..streaming import events as ev
from .evidence_queries import query as _into

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _into(name, sql, QUERIES, ORACLES)


_EVIDENCE = """evidence AS (SELECT id, sha256(CAST(id % 1200 AS VARCHAR)) AS source_sha256, source_reference, store_name AS merchant, total, id AS expense_pk,
    CASE WHEN id % 6 = 0 THEN '{"source_archived": true}' ELSE raw_payload END AS raw_payload, id % 3 = 0 AS is_primary_source, CASE WHEN source = 'costco_e_receipt' THEN 'electronic' ELSE 'image' END AS evidence_type,
    CAST(order_date AS TIMESTAMP) AS created_at, CASE WHEN id % 10 <> 0 THEN CAST(order_date AS TIMESTAMP) END AS transaction_datetime, extraction_status FROM expenses),
  files AS (SELECT source_sha256, min(source_reference) AS source_reference, min(id) % 8 = 1 AS source_archived FROM evidence GROUP BY 1),
  states AS (SELECT DISTINCT sha256(CAST(id % 1200 AS VARCHAR)) AS source_sha256, CASE WHEN id % 1200 % 4 = 0 THEN 'failed' ELSE 'complete' END AS status, id % 1200 % 5 AS attempts,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(id % 1200 AS INT) AS last_attempted_at, CASE WHEN id % 1200 % 4 <> 0 THEN TIMESTAMP '2024-02-01' END AS completed_at FROM expenses WHERE id % 1200 % 3 <> 0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_sha256 ORDER BY is_primary_source DESC, id) AS r FROM evidence) WHERE r = 1)"""


def _evidence(s, d):
    return bi.expenses(s, d).selectExpr(
        "id", "sha2(CAST(CAST(id % 1200 AS STRING) AS BINARY), 256) AS source_sha256", "source_reference", "store_name AS merchant", "total", "id AS expense_pk",
        "CASE WHEN id % 6 = 0 THEN '{\"source_archived\": true}' ELSE raw_payload END AS raw_payload", "id % 3 = 0 AS is_primary_source", "CASE WHEN source = 'costco_e_receipt' THEN 'electronic' ELSE 'image' END AS evidence_type",
        "CAST(order_date AS TIMESTAMP_NTZ) AS created_at", "CASE WHEN id % 10 <> 0 THEN CAST(order_date AS TIMESTAMP_NTZ) END AS transaction_datetime", "extraction_status",
    )


def _files(s, d):
    return _evidence(s, d).groupBy("source_sha256").agg(F.min("source_reference").alias("source_reference"), (F.min("id") % 8 == 1).alias("source_archived"))


def _states(s, d):
    return bi.expenses(s, d).where("id % 1200 % 3 <> 0").selectExpr(
        "sha2(CAST(CAST(id % 1200 AS STRING) AS BINARY), 256) AS source_sha256", "CASE WHEN id % 1200 % 4 = 0 THEN 'failed' ELSE 'complete' END AS status", "id % 1200 % 5 AS attempts",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id % 1200 AS INT)) AS last_attempted_at", "CASE WHEN id % 1200 % 4 <> 0 THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' END AS completed_at",
    ).distinct()


@query(
    "f4_pending_duplicates",
    f""", {_EVIDENCE}, links AS (SELECT id, id AS left_evidence_id, id + 1 AS right_evidence_id, id % 60 + 40 AS score, CASE WHEN id % 3 = 2 THEN 'confirmed' ELSE 'pending' END AS resolution_status FROM expenses)
    SELECT d.*, l.source_reference AS left_source, r.source_reference AS right_source, l.merchant AS left_merchant, r.merchant AS right_merchant, l.total AS left_total, r.total AS right_total, l.expense_pk AS left_expense, r.expense_pk AS right_expense
    FROM links d JOIN evidence l ON l.id = left_evidence_id JOIN evidence r ON r.id = right_evidence_id WHERE resolution_status = 'pending'
      AND coalesce(json_extract_string(l.raw_payload, '$.source_archived'), 'false') <> 'true' AND coalesce(json_extract_string(r.raw_payload, '$.source_archived'), 'false') <> 'true' ORDER BY score DESC, d.id LIMIT 50 OFFSET 10""",
)
def f4(s, d):
    links = bi.expenses(s, d).selectExpr("id", "id AS left_evidence_id", "id + 1 AS right_evidence_id", "id % 60 + 40 AS score", "CASE WHEN id % 3 = 2 THEN 'confirmed' ELSE 'pending' END AS resolution_status")
    return pg.pending_duplicates(links, _evidence(s, d), 50, 10)


@query(
    "f5_transactions_page",
    """, n AS (SELECT expense_pk + 500000000 AS transaction_id, count(*) AS n FROM expense_items WHERE tax_code = 'R' GROUP BY 1)
    SELECT t.id AS transaction_id, transaction_date, amount, currency, description, card_last4, c.c_name AS nickname, coalesce(n.n, 0) AS allocation_count, CASE WHEN n.n > 0 THEN 'confirmed allocations' ELSE 'unallocated' END AS outcome
    FROM transactions t LEFT JOIN customer c ON c.c_custkey = t.account_id LEFT JOIN n ON n.transaction_id = t.id ORDER BY transaction_date DESC, t.id DESC LIMIT 50 OFFSET 25""",
)
def f5(s, d):
    allocations = bi.expense_items(s, d).where("tax_code = 'R'").select((F.col("expense_pk") + 500000000).alias("transaction_id"))
    accounts = bi.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"))
    return pg.transaction_page(bi.transactions(s, d), accounts, allocations, 50, 25)


_PROCESSING = """processing AS (SELECT f.source_sha256, f.source_reference, coalesce(s.status, CASE WHEN b.evidence_type = 'electronic' THEN 'imported' ELSE 'not_started' END) AS status, coalesce(s.attempts, 0) AS attempts,
    coalesce(s.completed_at, CASE WHEN b.evidence_type = 'electronic' THEN b.created_at END) AS completed_at, s.last_attempted_at, nullif(regexp_extract(f.source_reference, '(?:^|/)([0-9]{4}-(?:0[1-9]|1[0-2]))/', 1), '') AS source_month
    FROM files f LEFT JOIN states s USING (source_sha256) LEFT JOIN best b USING (source_sha256) WHERE NOT f.source_archived)"""


@query("f6_processing_status", f", {_EVIDENCE}, {_PROCESSING} SELECT * FROM processing")
def f6(s, d):
    return pg.processing_status(_files(s, d), _states(s, d), _evidence(s, d))


@query("f6_processing_page", f", {_EVIDENCE}, {_PROCESSING} SELECT *, (SELECT count(*) FROM processing) AS total_count FROM processing ORDER BY last_attempted_at DESC NULLS LAST, source_reference, source_sha256 LIMIT 100 OFFSET 20")
def f6_page(s, d):
    return pg.processing_page(pg.processing_status(_files(s, d), _states(s, d), _evidence(s, d)), offset=20)


_RECEIPTS = """receipts AS (SELECT f.source_sha256, f.source_reference, coalesce(s.status, CASE WHEN b.evidence_type = 'electronic' THEN 'imported' END) AS processing_status, b.id AS evidence_id, b.expense_pk, b.merchant, b.transaction_datetime, b.total, b.extraction_status,
    concat_ws(' ', CAST(b.expense_pk AS VARCHAR), f.source_reference, b.merchant, CAST(b.transaction_datetime AS VARCHAR), CAST(b.total AS VARCHAR), s.status, b.extraction_status) AS words
    FROM files f LEFT JOIN states s USING (source_sha256) LEFT JOIN best b USING (source_sha256) WHERE NOT f.source_archived AND coalesce(json_extract_string(b.raw_payload, '$.source_archived'), 'false') <> 'true'
      AND NOT coalesce(list_contains(json_keys(b.raw_payload), 'receipt_deleted'), false) AND NOT coalesce(list_contains(json_keys(b.raw_payload), 'duplicate_merge'), false))"""


@query(
    "f7_receipt_search",
    f""", {_EVIDENCE}, {_RECEIPTS} SELECT r.* EXCLUDE (words) FROM receipts r
    WHERE (words ILIKE '%store 1%' OR EXISTS (SELECT 1 FROM expense_items i WHERE i.expense_pk = r.expense_pk AND item_name ILIKE '%store 1%') OR true)
      AND (words ILIKE '%complete%' OR EXISTS (SELECT 1 FROM expense_items i WHERE i.expense_pk = r.expense_pk AND item_name ILIKE '%complete%'))
      AND (words ILIKE '%widget%' OR EXISTS (SELECT 1 FROM expense_items i WHERE i.expense_pk = r.expense_pk AND item_name ILIKE '%widget%'))""",
)
def f7(s, d):
    return pg.receipt_list(_files(s, d), _evidence(s, d), _states(s, d), bi.expense_items(s, d), "complete widget")


@query("f7_receipt_page", f", {_EVIDENCE}, {_RECEIPTS}, m AS (SELECT * EXCLUDE (words) FROM receipts WHERE transaction_datetime >= TIMESTAMP '1996-03-01' AND transaction_datetime < TIMESTAMP '1996-04-01') SELECT *, (SELECT count(*) FROM m) AS total_count FROM m ORDER BY transaction_datetime DESC NULLS LAST, source_reference DESC LIMIT 50")
def f7_page(s, d):
    return pg.receipt_page(pg.receipt_list(_files(s, d), _evidence(s, d), _states(s, d), bi.expense_items(s, d), month="1996-03"))


@query(
    "f9_rule_list",
    """, rules AS (SELECT p_partkey AS id, p_name AS match_text, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS merchant, NULL::VARCHAR AS source, p_type AS category_name, p_size % 5 AS priority, p_partkey % 4 <> 0 AS is_active FROM part)
    SELECT * FROM rules WHERE match_text ILIKE '%re%' OR merchant ILIKE '%re%' OR source ILIKE '%re%' OR category_name ILIKE '%re%' ORDER BY is_active DESC, priority, lower(match_text), id LIMIT 500""",
)
def f9(s, d):
    rules = bi.read(s, d, "part").selectExpr("p_partkey AS id", "p_name AS match_text", "CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS merchant", "CAST(NULL AS STRING) AS source", "p_type AS category_name", "p_size % 5 AS priority", "p_partkey % 4 <> 0 AS is_active")
    return pg.rule_list(rules, "re")


@query(
    "b18_admission",
    f""", {_EVIDENCE}, req AS (SELECT id AS request_id, source_sha256 FROM best), run AS (SELECT source_sha256, CASE WHEN id % 2 = 0 THEN id ELSE -1 END AS running_id FROM best WHERE id % 5 = 0)
    SELECT q.request_id, q.source_sha256, CASE WHEN run.running_id = q.request_id THEN 'same_request' WHEN f.source_archived OR coalesce(json_extract_string(b.raw_payload, '$.source_archived'), 'false') = 'true' THEN 'archived'
      WHEN coalesce(list_contains(json_keys(b.raw_payload), 'receipt_deleted'), false) THEN 'deleted' WHEN coalesce(list_contains(json_keys(b.raw_payload), 'duplicate_merge'), false) THEN 'duplicate'
      WHEN run.running_id IS NOT NULL THEN 'in_flight' ELSE 'admitted' END AS verdict FROM req q JOIN best b USING (source_sha256) JOIN files f USING (source_sha256) LEFT JOIN run USING (source_sha256)""",
)
def b18(s, d):
    best = pg.first_evidence(_evidence(s, d))
    receipts = best.select("source_sha256", "raw_payload").join(_files(s, d).select("source_sha256", "source_archived"), "source_sha256")
    running = best.where("id % 5 = 0").select("source_sha256", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1).alias("running_id"))
    return pg.admitted(best.select(F.col("id").alias("request_id"), "source_sha256"), receipts, running)


@query("l6_audit", """, c AS (SELECT id, total, CASE WHEN id % 4 = 0 THEN total + 1 ELSE total END AS after FROM expenses) SELECT id, 'reviewer' AS actor, 'correct' AS action, '{"total":' || CAST(total AS VARCHAR) || '}' AS before, '{"total":' || CAST(CAST(after AS DECIMAL(14,2)) AS VARCHAR) || '}' AS after FROM c WHERE id % 4 = 0
    UNION ALL SELECT id, 'import', 'create', NULL, '{}' FROM expenses""")
def l6(s, d):
    e = bi.expenses(s, d)
    after = F.when(F.col("id") % 4 == 0, F.col("total") + 1).otherwise(F.col("total")).cast("decimal(14,2)")
    changes = e.select("id", F.struct("total").alias("before"), F.struct(after.alias("total")).alias("after"))
    audit = e.select("id", F.lit("import").alias("actor"), F.lit("create").alias("action"), F.lit(None).cast("string").alias("before"), F.lit("{}").alias("after"))
    return pg.audited(audit, changes, "reviewer", "correct", ["id"])


@query("b13_optional_parameter", "SELECT id FROM expenses WHERE (NULL IS NULL OR source = NULL) AND ('review' IS NULL OR extraction_status = 'review')")
def b13(s, d):
    return re.optional_filters(bi.expenses(s, d), source=None, extraction_status="review").select("id")


@query("c3_join_using", "SELECT category, group_name, count(*) AS n FROM expense_items JOIN categories USING (category) GROUP BY 1, 2")
def c3(s, d):
    return bi.expense_items(s, d).join(bi.categories(s, d), "category").groupBy("category", "group_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c19_printed_identity",
    """, o AS (SELECT order_id, total, CAST(order_date AS TIMESTAMP) AS at, CASE WHEN id % 3 = 0 THEN 'none' ELSE lpad(CAST(id AS VARCHAR), 9, '0') END AS identity FROM expenses),
    r AS (SELECT id AS receipt_id, total, CAST(order_date AS TIMESTAMP) + INTERVAL 1 SECOND * CAST(id % 70 AS INT) AS at, 'SALE ' || lpad(CAST(id AS VARCHAR), 9, '0') || ' THANK YOU' AS text FROM expenses),
    hit AS (SELECT order_id, CASE WHEN count(DISTINCT receipt_id) = 1 THEN min(receipt_id) END AS receipt_id FROM o JOIN r ON o.total = r.total AND date_trunc('minute', o.at) = date_trunc('minute', r.at) AND contains(text, identity) GROUP BY 1)
    SELECT o.order_id, hit.receipt_id FROM o LEFT JOIN hit USING (order_id)""",
)
def c19(s, d):
    e = bi.expenses(s, d).withColumns({"at": F.col("order_date").cast("timestamp"), "code": F.lpad(F.col("id").cast("string"), 9, "0")})
    orders = e.select("order_id", "total", "at", F.when(F.col("id") % 3 == 0, "none").otherwise(F.col("code")).alias("identity"))
    receipts = e.select(F.col("id").alias("receipt_id"), "total", (F.col("at") + F.make_dt_interval(secs=(F.col("id") % 70).cast("decimal(18,6)"))).alias("at"), F.concat(F.lit("SALE "), "code", F.lit(" THANK YOU")).alias("text"))
    return evd.printed_identity(orders, receipts)


@query("d7_item_sums", "SELECT e.id, coalesce((SELECT sum(line_total) FROM expense_items i WHERE i.expense_pk = e.id AND i.tax_code = 'R'), 0) AS item_sum FROM expenses e")
def d7(s, d):
    sums = bi.expense_items(s, d).where("tax_code = 'R'").groupBy("expense_pk").agg(F.sum("line_total").alias("item_sum"))
    return bi.expenses(s, d).select("id").join(sums, F.col("id") == F.col("expense_pk"), "left").select("id", F.coalesce("item_sum", F.lit(0)).cast("decimal(24,2)").alias("item_sum"))


@query("d13_outcome_summary", "SELECT count(*) FILTER (WHERE o = 'matched') AS matched, count(*) FILTER (WHERE o = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE o = 'unmatched') AS unmatched, count(*) AS total FROM (SELECT CASE WHEN total > 200000 THEN 'matched' WHEN total > 100000 THEN 'ambiguous' ELSE 'unmatched' END AS o FROM expenses)")
def d13(s, d):
    return evd.outcome_summary(bi.expenses(s, d).select(F.when(F.col("total") > 200000, "matched").when(F.col("total") > 100000, "ambiguous").otherwise("unmatched").alias("outcome")))


@query("d18_best_of_group", "SELECT account_id, arg_max(id, struct_pack(a := extraction_status = 'complete', b := extraction_confidence, c := card_last4 IS NOT NULL, d := -id)) AS id FROM expenses GROUP BY 1")
def d18(s, d):
    e = bi.expenses(s, d).select("account_id", "id", "extraction_status", "extraction_confidence", "card_last4")
    return evd.best_row(e, ["account_id"], [F.col("extraction_status") == "complete", F.col("extraction_confidence"), F.col("card_last4").isNotNull(), -F.col("id")]).select("account_id", "id")


@query("d21_unique_or_null", "SELECT account_id, CASE WHEN count(DISTINCT store_name) = 1 THEN min(store_name) END AS store_name, CASE WHEN count(DISTINCT extraction_status) = 1 THEN min(extraction_status) END AS status FROM expenses GROUP BY 1")
def d21(s, d):
    return bi.expenses(s, d).groupBy("account_id").agg(re.unique_or_null(F.col("store_name")).alias("store_name"), re.unique_or_null(F.col("extraction_status")).alias("status"))


@query("d25_window_quantiles", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*) AS n, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1")
def d25(s, d):
    return ev.window_quantiles(bi.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("e2_line_rank", "SELECT expense_pk, item_id, row_number() OVER (PARTITION BY expense_pk ORDER BY line_total DESC NULLS FIRST, item_id) AS line_rank FROM expense_items")
def e2(s, d):
    rank = F.row_number().over(Window.partitionBy("expense_pk").orderBy(F.col("line_total").desc_nulls_first(), "item_id"))
    return bi.expense_items(s, d).select("expense_pk", "item_id", rank.cast("long").alias("line_rank"))


_SHARES = """w AS (SELECT i.expense_pk, i.item_id, i.category, i.line_total, e.total, sum(i.line_total) OVER (PARTITION BY e.id) AS items, row_number() OVER (PARTITION BY e.id ORDER BY i.line_total DESC NULLS FIRST, i.item_id) AS k FROM expense_items i JOIN expenses e ON e.id = i.expense_pk),
  r AS (SELECT *, CAST(round(CAST(line_total AS DECIMAL(14,2)) * CAST(total AS DECIMAL(14,2)) / nullif(CAST(items AS DECIMAL(18,2)), 0), 2) AS DECIMAL(14,2)) AS share FROM w),
  a AS (SELECT *, CASE WHEN k = 1 THEN share + total - sum(share) OVER (PARTITION BY expense_pk) ELSE share END AS allocated FROM r)"""


@query("e4_category_allocation", f", {_SHARES} SELECT expense_pk, category, CAST(sum(allocated) AS DECIMAL(24,2)) AS category_amount, CAST(sum(allocated) AS DECIMAL(24,2)) AS receipt_total FROM a GROUP BY 1, 2")
def e4(s, d):
    return ag.allocated_by_category(ag.penny_allocation(bi.expense_items(s, d), bi.expenses(s, d)))


@query("e7_latest_run", "SELECT request_id, arg_max(id, struct_pack(a := occurred_at, b := id)) AS id FROM receipt_events WHERE status = 'results_published' GROUP BY 1")
def e7(s, d):
    runs = bi.receipt_events(s, d).where("status = 'results_published'").select("request_id", "id", "occurred_at")
    return re.first_by(runs, ["request_id"], [F.desc("occurred_at"), F.desc("id")]).select("request_id", "id")


@query("g5_same_tables", "SELECT CAST(count(*) AS BIGINT) AS differences FROM (SELECT id FROM expenses WHERE id % 10 = 0)")
def g5(s, d):
    e = bi.expenses(s, d).select("id", "total")
    other = e.repartition(3).select("id", F.when(F.col("id") % 10 == 0, F.col("total") + 1).otherwise(F.col("total")).cast("decimal(14,2)").alias("total"))
    return re.row_differences(e, other).groupBy().agg(F.sum(F.when(F.col("side") == "left", F.col("n")).otherwise(0)).alias("differences"))


@query("h2_identity", "SELECT id, nullif(upper(regexp_replace(order_id || '/ a ' || coalesce(card_last4, ''), '[^0-9A-Za-z]', '', 'g')), '') AS norm, trim(regexp_replace(order_id || '  x ' || chr(9) || source, '\\s+', ' ', 'g')) AS squeezed FROM expenses")
def h2(s, d):
    return bi.expenses(s, d).select("id", de.normalized_id(F.concat("order_id", F.lit("/ a "), F.coalesce("card_last4", F.lit("")))).alias("norm"), tx.squeeze(F.concat("order_id", F.lit("  x \t"), "source")).alias("squeezed"))


@query("h4_cents", "SELECT id, CASE WHEN id % 3 = 0 THEN CAST(total AS DECIMAL(14,2)) WHEN id % 3 = 1 THEN NULL ELSE CAST(id AS DECIMAL(14,2)) END AS cents FROM expenses")
def h4(s, d):
    text = F.when(F.col("id") % 3 == 0, F.col("total").cast("string")).when(F.col("id") % 6 == 1, F.lit("NaN")).when(F.col("id") % 3 == 1, F.lit("1.005")).otherwise(F.col("id").cast("string"))
    return bi.expenses(s, d).select("id", tx.cents(text).alias("cents"))


@query("h8_item_jaccard", """, x AS (SELECT expense_pk, list(DISTINCT item_name || '|' || CAST(CAST(qty AS INT) AS VARCHAR)) AS n FROM expense_items GROUP BY 1)
    SELECT a.expense_pk AS a, round(len(list_intersect(a.n, b.n)) / CAST(len(list_distinct(list_concat(a.n, b.n))) AS DOUBLE), 6) AS jaccard FROM x a JOIN x b ON b.expense_pk = a.expense_pk + 1""")
def h8(s, d):
    x = bi.expense_items(s, d).groupBy("expense_pk").agg(F.collect_set(F.concat_ws("|", "item_name", F.col("qty").cast("int").cast("string"))).alias("n"))
    other = x.select((F.col("expense_pk") - 1).alias("expense_pk"), F.col("n").alias("m"))
    return x.join(other, "expense_pk").select(F.col("expense_pk").alias("a"), F.round(de.jaccard(F.col("n"), F.col("m")), 6).alias("jaccard"))


@query("h19_redact", "SELECT id, regexp_replace(description, '[0-9]{4,}([0-9]{4})', '****\\1', 'g') AS redacted FROM transactions")
def h19(s, d):
    return bi.transactions(s, d).select("id", tx.redact(F.col("description")).alias("redacted"))


@query("h21_version_token", """SELECT id, sha256('{"id":' || CAST(id AS VARCHAR) || ',"total":' || CAST(total AS VARCHAR) || ',"card_last4":' || CASE WHEN card_last4 IS NULL THEN 'null' ELSE '"' || card_last4 || '"' END || '}') AS token FROM expenses""")
def h21(s, d):
    return bi.expenses(s, d).select("id", st.version_token(F.col("id"), F.col("total"), F.col("card_last4")).alias("token"))


@query("h22_retailer_domain", "SELECT DISTINCT store_name, CASE WHEN contains(lower(store_name), 'store 1') THEN 'one.example' WHEN contains(lower(store_name), 'store') THEN 'any.example' END AS domain FROM expenses")
def h22(s, d):
    return bi.expenses(s, d).select("store_name", tx.retailer_domain(F.col("store_name"), {"store 1": "one.example", "store": "any.example"}).alias("domain")).distinct()


@query("h27_json_access", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') IS NULL AS absent FROM events")
def h27(s, d):
    return bi.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), (~re.json_has_key(F.col("props"), "absent")).alias("absent"))


@query("h29_round_half_away", "SELECT id, CAST(round(CAST(total / 8 AS DECIMAL(18,4)), 2) AS DECIMAL(14,2)) AS rounded FROM (SELECT id, total - total % 8 + 0.04 * (id % 3) AS total FROM expenses)")
def h29(s, d):
    t = F.col("total") - F.col("total") % 8 + F.lit("0.04").cast("decimal(4,2)") * (F.col("id") % 3).cast("decimal(4,0)")
    return bi.expenses(s, d).select("id", F.round((t / 8).cast("decimal(18,4)"), 2).cast("decimal(14,2)").alias("rounded"))


@query("h31_file_extension", r"SELECT coalesce(nullif(lower(regexp_extract(source_reference, '\.([^./]+)$', 1)), ''), '(none)') AS extension, count(*) AS files FROM expenses GROUP BY 1")
def h31(s, d):
    return bi.expenses(s, d).groupBy(tx.file_extension(F.col("source_reference")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


@query("h34_filename_metadata", "SELECT id, CASE WHEN id % 4 <> 0 THEN order_date END AS printed, CASE WHEN id % 4 <> 0 THEN 'store ' || CAST(id % 9 AS VARCHAR) END AS merchant, CASE WHEN id % 4 <> 0 THEN CAST(CAST(id % 500 AS VARCHAR) || '.' || lpad(CAST(id % 100 AS VARCHAR), 2, '0') AS DECIMAL(14,2)) END AS total FROM expenses")
def h34(s, d):
    name = F.format_string("in/%s_store-%d_%d-%02d.jpg", F.when(F.col("id") % 4 != 0, F.date_format("order_date", "yyyyMMdd")).otherwise("20239999"), F.col("id") % 9, F.col("id") % 500, F.col("id") % 100)
    return bi.expenses(s, d).select("id", tx.filename_metadata(name).alias("f")).select("id", F.col("f.date").alias("printed"), "f.merchant", "f.total")


@query("h5_canonical_category", """SELECT DISTINCT p_type, CASE WHEN p_partkey % 3 = 1 THEN 'Fixed' WHEN p_partkey % 3 = 2 THEN NULL ELSE p_type END AS category, p_partkey % 3 AS k FROM part""")
def h5(s, d):
    part = bi.read(s, d, "part").selectExpr("p_type", "p_partkey % 3 AS k").distinct()
    asked = part.select("p_type", "k", F.when(F.col("k") == 0, F.concat(F.lit(" "), F.regexp_replace(F.lower("p_type"), " ", "--"))).when(F.col("k") == 1, F.lit("Some Alias!")).otherwise(F.lit("nothing known")).alias("asked"))
    known = bi.categories(s, d).select("category")
    aliases = s.createDataFrame([("some alias", "Fixed")], "alias string, category string")
    return de.canonical_category(asked, "asked", known, aliases).select("p_type", "category", "k")


@query("h38_month_or_text", "SELECT id, id % 3 = 0 AS valid_month, id % 2 = 0 AS has_text FROM expenses")
def h38(s, d):
    month = F.when(F.col("id") % 3 == 0, F.date_format("order_date", "yyyy-MM")).when(F.col("id") % 3 == 1, F.lit("2024-13")).otherwise(F.lit("2024-1"))
    text = F.when(F.col("id") % 2 == 0, F.lit(" x")).when(F.col("id") % 4 == 1, F.lit(" \t"))
    return bi.expenses(s, d).select("id", tx.valid_month(month).alias("valid_month"), tx.has_text(text).alias("has_text"))


_ASSESSED = """f AS (SELECT id, extraction_status, CASE WHEN id % 9 = 0 THEN NULL ELSE total END AS item_sum, CASE WHEN id % 5 = 0 THEN total + 1 ELSE total END AS subtotal, CASE WHEN id % 7 = 0 THEN NULL ELSE 2.00 END AS tax, CASE WHEN id % 4 = 0 THEN NULL ELSE total + 2 END AS total FROM expenses),
  r AS (SELECT id, extraction_status, concat_ws('|', CASE WHEN item_sum IS NULL THEN 'items_missing' END, CASE WHEN total IS NULL THEN 'header_missing' END, CASE WHEN abs(item_sum - subtotal) > 0.01 THEN 'items_do_not_match_subtotal' END,
    CASE WHEN abs(subtotal + coalesce(tax, 0) - total) > 0.01 THEN 'header_does_not_add_up' END) AS reasons FROM f)"""


def _assessed(s, d):
    m = lambda c: c.cast("decimal(14,2)")
    i, t = F.col("id"), F.col("total")
    e = bi.expenses(s, d).select("id", "extraction_status", F.when(i % 9 != 0, t).alias("item_sum"), m(F.when(i % 5 == 0, t + 1).otherwise(t)).alias("subtotal"), m(F.when(i % 7 != 0, F.lit(2))).alias("tax"), m(F.when(i % 4 != 0, t + 2)).alias("total"), m(F.lit(None)).alias("charges"), m(F.lit(None)).alias("discount"))
    return de.assess_allocation(e)


@query("i12_allocation_reasons", f", {_ASSESSED} SELECT id, reasons, reasons = '' AS reconciled FROM r")
def i12(s, d):
    return _assessed(s, d).select("id", F.array_join("reasons", "|").alias("reasons"), "reconciled")


@query("i34_display_status", f", {_ASSESSED} SELECT id, CASE WHEN extraction_status = 'complete' AND reasons <> '' THEN 'review' ELSE extraction_status END AS shown FROM r")
def i34(s, d):
    return _assessed(s, d).select("id", de.display_status(F.col("extraction_status"), F.col("reconciled")).alias("shown"))


@query("i14_merge_survivor", "SELECT store_name, order_date, arg_max(id, struct_pack(a := card_last4 IS NOT NULL, b := extraction_confidence, c := -id)) AS id FROM expenses WHERE store_name IS NOT NULL GROUP BY 1, 2")
def i14(s, d):
    e = bi.expenses(s, d).where("store_name is not null").select("store_name", "order_date", "id", "card_last4", "extraction_confidence")
    return evd.best_row(e, ["store_name", "order_date"], [F.col("card_last4").isNotNull(), F.col("extraction_confidence"), -F.col("id")]).select("store_name", "order_date", "id")


@query(
    "j13_log_correlation",
    """, l AS (SELECT *, CASE WHEN status <> 'heartbeat' THEN struct_pack(r := CASE WHEN status = 'active' THEN request_id END) END AS mark FROM receipt_events),
    m AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY request_id % 7, attempt ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS seen FROM l)
    SELECT id, request_id AS request, status FROM m WHERE status <> 'heartbeat' UNION ALL SELECT id, seen.r, 'heartbeat' FROM m WHERE status = 'heartbeat' AND seen.r IS NOT NULL""",
)
def j13(s, d):
    e = bi.receipt_events(s, d)
    log = e.select("id", F.col("occurred_at").alias("at"), (F.col("request_id") % 7).alias("host"), F.col("attempt").alias("reference"), F.when(F.col("status") != "heartbeat", F.col("request_id")).alias("request"), "status")
    return ev.correlate(log).select("id", "request", "status")


@query(
    "j2_retry_or_dead",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'good' WHEN k % 5 = 0 OR k % 4 >= 3 THEN 'dead' ELSE 'retry' END AS fate FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
)
def j2(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    e = bi.read(s, d, "events").select("event_id", "event_type", k.alias("k"), (k % 4).alias("attempt"))
    routed = ev.route(e, F.col("event_type") != "error", F.col("k") % 5 == 0, most=3)
    good, retry, dead = (routed[n].select("event_id", F.lit(n).alias("fate")) for n in ("good", "retry", "dead"))
    return good.unionByName(retry).unionByName(dead)


@query("j14_recover", "SELECT id, request_id, status FROM receipt_events WHERE (request_id, attempt) IN (SELECT (request_id, attempt) FROM receipt_events WHERE status = 'failed' AND seconds > 50) AND status IN ('failed', 'heartbeat') AND (status <> 'failed' OR seconds > 50 OR true)")
def j14(s, d):
    e = bi.receipt_events(s, d).where("status in ('failed', 'heartbeat')")
    dead = e.select("id", "request_id", "status", F.concat_ws("/", F.col("request_id").cast("string"), F.col("attempt").cast("string")).alias("run_id"), F.col("id").alias("pass_id"), F.when(F.col("status") == "failed", "run").otherwise("pass").alias("kind"), F.when(F.col("seconds") > 50, "slow").alias("reason"))
    return ev.recover(dead, "slow").select("id", "request_id", "status")


@query(
    "j7c_alert_rules",
    """, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'view') AS reviews, count(*) FILTER (WHERE event_type = 'signup') AS queued,
        count(*) FILTER (WHERE event_type = 'purchase') AS done, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)
    SELECT window_start, 'failure_ratio' AS alert FROM w WHERE n >= 5 AND failures > 0.25 * n UNION ALL SELECT window_start, 'review_ratio' FROM w WHERE n >= 5 AND reviews > 0.5 * n
    UNION ALL SELECT window_start, 'latency_p95' FROM w WHERE p95 > 90 UNION ALL SELECT window_start, 'queue_growing' FROM w WHERE queued > done + 1 UNION ALL SELECT window_start, 'dead_lettered' FROM w WHERE failures > 0""",
)
def j7c(s, d):
    e = bi.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = lambda k: F.col("event_type") == k
    rules = ev.alert_rules(e, failed=kind("error"), review=kind("view"), queued=kind("signup"), done=kind("purchase"), seconds=F.col("value"), latency=90.0, growth=1)
    return rules.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "k4_provenance_closure",
    """, e AS (SELECT DISTINCT request_id, attempt FROM receipt_events), hit AS (SELECT DISTINCT request_id, attempt FROM receipt_events WHERE seconds > 90)
    SELECT 'Event' AS kind, count(*) AS n FROM receipt_events WHERE seconds > 90 UNION ALL SELECT 'Attempt', count(*) FROM hit UNION ALL SELECT 'Request', count(DISTINCT request_id) FROM hit""",
)
def k4(s, d):
    e = bi.receipt_events(s, d)
    nodes, edges = gr.event_graph(e)
    start = e.where("seconds > 90").select(gr.node_id("Event", F.col("id")).alias("id"))
    return gr.closure(start, edges.where("kind <> 'RETRIED_AS'"), ["HAS_ATTEMPT", "OBSERVED"], []).join(nodes, "id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h25_product_label",
    """, p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Thing ' || CAST(page_id AS VARCHAR) WHEN page_id % 3 = 1 AND (host = 'example.com' OR host LIKE '%.example.com') THEN 'Thing ' || CAST(page_id AS VARCHAR)
      WHEN page_id % 3 = 1 THEN 'Thing ' || CAST(page_id AS VARCHAR) || ' | Example-Shop Inc' ELSE 'Thing | b | other' END AS label FROM p""",
)
def h25(s, d):
    i, host = F.col("page_id"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1), r"^www\.", "")
    thing = F.concat(F.lit("Thing "), i.cast("string"))
    title = F.when(i % 3 == 0, F.concat(F.lit("Buy now shop "), thing, F.lit(" | "), F.upper(host))).when(i % 3 == 1, F.concat(F.lit(" ORDER "), thing, F.lit(" | Example-Shop Inc"))).otherwise("Thing | b | other")
    return bi.read(s, d, "pages").select("page_id", tx.product_label(title, F.col("url"), {"example shop": "example.com"}).alias("label"))


@query(
    "h32_quantities",
    """, i AS (SELECT expense_pk, item_id, CASE WHEN item_id % 11 = 0 THEN 'Refunded ' || item_name ELSE item_name END AS name, CASE WHEN item_id % 3 = 0 THEN CAST(CAST(qty AS INT) AS VARCHAR) END AS quantity, CASE WHEN item_id % 5 = 0 THEN 'kg' END AS weight_unit,
      CAST(line_total AS DOUBLE) AS total, CASE WHEN item_id % 4 <> 0 THEN CAST(line_total AS DOUBLE) / CAST(qty AS DOUBLE) * 1.01e0 END AS unit, CASE WHEN item_id % 22 = 0 THEN CAST(line_total AS DOUBLE) + 1 END AS original FROM expense_items),
    q AS (SELECT *, CASE WHEN unit > 0 THEN total / unit END AS by_price, coalesce(CAST(quantity AS INT), 1) AS n FROM i),
    r AS (SELECT *, CASE WHEN name LIKE 'Refunded %' THEN CASE WHEN original > 0 THEN -original ELSE -abs(total) END END AS refund FROM q)
    SELECT expense_pk, item_id, CASE WHEN weight_unit IS NULL THEN coalesce(CAST(quantity AS DOUBLE), CASE WHEN abs(by_price - round(by_price)) < 0.02 THEN round(by_price) ELSE round(by_price, 3) END) END AS unit_qty,
      CASE WHEN weight_unit IS NOT NULL THEN round(by_price, 3) END AS weight, coalesce(refund, total) AS line_total, coalesce(refund / n, unit) AS unit_value FROM r""",
)
def h32(s, d):
    i = bi.expense_items(s, d).selectExpr(
        "expense_pk", "item_id", "CASE WHEN item_id % 11 = 0 THEN concat('Refunded ', item_name) ELSE item_name END AS name", "CASE WHEN item_id % 3 = 0 THEN CAST(CAST(qty AS INT) AS STRING) END AS quantity", "CASE WHEN item_id % 5 = 0 THEN 'kg' END AS weight_unit",
        "CAST(NULL AS DOUBLE) AS weight_qty", "CAST(line_total AS DOUBLE) AS total_price", "CASE WHEN item_id % 4 <> 0 THEN CAST(line_total AS DOUBLE) / CAST(qty AS DOUBLE) * 1.01e0 END AS unit_price", "CASE WHEN item_id % 22 = 0 THEN CAST(line_total AS DOUBLE) + 1 END AS original_total_price",
    )
    out = de.derived_quantities(i)
    return out.select("expense_pk", "item_id", "unit_qty", "weight", "line_total", "unit_value")
