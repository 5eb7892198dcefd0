"""Domain tables over the star-schema test tables.

Each binding is one projection (or join) of a test table, so that filters and column pruning
still reach the Parquet scan. ``*_SQL`` holds the same binding for an ANSI SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase for each order; some carry soft-delete markers in their payload."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "CASE o_orderkey % 4 WHEN 0 THEN 'instacart' WHEN 1 THEN 'costco_e_receipt' WHEN 2 THEN 'scanned' ELSE 'manual' END AS source",
        "concat('ORD-', CAST(o_orderkey AS STRING)) AS order_id",
        "o_custkey AS account_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        "CASE WHEN o_orderkey % 7 <> 0 THEN concat('Store ', CAST(o_custkey % 40 AS STRING)) END AS store_name",
        "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'review' ELSE 'unreadable' END AS extraction_status",
        "CAST((o_orderkey % 100) / 100.0 AS DECIMAL(5,4)) AS extraction_confidence",
        f"CAST(o_totalprice AS {MONEY}) AS total",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') END AS card_last4",
        "CASE WHEN o_orderkey % 13 = 0 THEN '{\"duplicate_merge\": null}' WHEN o_orderkey % 17 = 0 THEN '{\"receipt_deleted\": {\"by\": 1}}' WHEN o_orderkey % 5 = 0 THEN NULL ELSE '{}' END AS raw_payload",
        "concat('receipts/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7), '/', CAST(o_orderkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' ELSE '' END) AS source_reference",
    )


EXPENSES_SQL = """expenses AS (
  SELECT o_orderkey AS id,
    CASE o_orderkey % 4 WHEN 0 THEN 'instacart' WHEN 1 THEN 'costco_e_receipt' WHEN 2 THEN 'scanned' ELSE 'manual' END AS source,
    'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS order_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'Store ' || CAST(o_custkey % 40 AS VARCHAR) END AS store_name,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'review' ELSE 'unreadable' END AS extraction_status,
    CAST((o_orderkey % 100) / 100.0 AS DECIMAL(5,4)) AS extraction_confidence,
    CAST(o_totalprice AS DECIMAL(14,2)) AS total,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS card_last4,
    CASE WHEN o_orderkey % 13 = 0 THEN '{"duplicate_merge": null}' WHEN o_orderkey % 17 = 0 THEN '{"receipt_deleted": {"by": 1}}'
         WHEN o_orderkey % 5 = 0 THEN NULL ELSE '{}' END AS raw_payload,
    'receipts/' || substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7) || '/' || CAST(o_orderkey AS VARCHAR)
      || CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' ELSE '' END AS source_reference
  FROM orders)"""


def expense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase lines; the id orders equal amounts, and some lines have no category."""
    part = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_type")
    return (
        read(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr(
            "l_orderkey AS expense_pk",
            "l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS item_id",
            "p_name AS item_name",
            "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE p_type END AS category",
            "CAST(l_quantity AS DECIMAL(12,3)) AS qty",
            f"CAST(l_extendedprice AS {MONEY}) AS line_total",
            "CAST(l_tax AS DECIMAL(5,2)) AS tax_rate",
            "l_returnflag AS tax_code",
            "CASE l_partkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'ai' ELSE 'rule' END AS category_source",
            "l_partkey % 9 = 0 AS category_requires_review",
        )
    )


EXPENSE_ITEMS_SQL = """expense_items AS (
  SELECT l_orderkey AS expense_pk, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS item_id, p_name AS item_name,
    CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE p_type END AS category, CAST(l_quantity AS DECIMAL(12,3)) AS qty,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS line_total, CAST(l_tax AS DECIMAL(5,2)) AS tax_rate, l_returnflag AS tax_code,
    CASE l_partkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'ai' ELSE 'rule' END AS category_source,
    l_partkey % 9 = 0 AS category_requires_review
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy: part types under one of two groups. Bounded by the number of part types."""
    kinds = read(spark, sf_dir, "part").selectExpr("p_type AS category").distinct()
    return kinds.selectExpr("category", "CASE WHEN length(category) % 2 = 0 THEN 'Household' ELSE 'Other' END AS group_name")


CATEGORIES_SQL = """categories AS (
  SELECT DISTINCT p_type AS category, CASE WHEN length(p_type) % 2 = 0 THEN 'Household' ELSE 'Other' END AS group_name FROM part)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank rows: one for each order, a few days late, some in another currency."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey + 500000000 AS id",
        "o_custkey AS account_id",
        "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 10 AS INT)) AS transaction_date",
        f"CAST(o_totalprice AS {MONEY}) AS amount",
        "CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'CAD' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'USD' END END AS currency",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') END AS card_last4",
        "concat('STORE ', CAST(o_custkey % 40 AS STRING), ' 0000', CAST(o_orderkey + 10000000 AS STRING)) AS description",
    )


TRANSACTIONS_SQL = """transactions AS (
  SELECT o_orderkey + 500000000 AS id, o_custkey AS account_id,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INT) AS transaction_date, CAST(o_totalprice AS DECIMAL(14,2)) AS amount,
    CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'CAD' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'USD' END END AS currency,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS card_last4,
    'STORE ' || CAST(o_custkey % 40 AS VARCHAR) || ' 0000' || CAST(o_orderkey + 10000000 AS VARCHAR) AS description
  FROM orders)"""


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rate a day on which an order of every ninth customer was placed."""
    return (
        read(spark, sf_dir, "orders")
        .where("o_custkey % 9 = 0")
        .groupBy(F.expr("CAST(o_orderdate AS DATE)").alias("rate_date"))
        .agg(F.expr("CAST(1 + min(o_custkey) % 500 / 1000.0 AS DECIMAL(18,10))").alias("rate"))
    )


EXCHANGE_RATES_SQL = """exchange_rates AS (
  SELECT CAST(o_orderdate AS DATE) AS rate_date, CAST(1 + min(o_custkey) % 500 / 1000.0 AS DECIMAL(18,10)) AS rate
  FROM orders WHERE o_custkey % 9 = 0 GROUP BY 1)"""


def receipt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processing log: users stand for requests, event types for statuses."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "ts AS occurred_at",
        "user_id AS request_id",
        "CAST(get_json_object(props, '$.k') AS BIGINT) % 3 + 1 AS attempt",
        "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'active' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'failed' ELSE 'results_published' END AS status",
        "CAST(value AS DECIMAL(12,2)) AS seconds",
        "props AS payload",
    )


RECEIPT_EVENTS_SQL = """receipt_events AS (
  SELECT event_id AS id, ts AS occurred_at, user_id AS request_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1 AS attempt,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'active' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'failed' ELSE 'results_published' END AS status,
    CAST(value AS DECIMAL(12,2)) AS seconds, props AS payload
  FROM events)"""

ALL_SQL = "WITH " + ",\n".join((EXPENSES_SQL, EXPENSE_ITEMS_SQL, CATEGORIES_SQL, TRANSACTIONS_SQL, EXCHANGE_RATES_SQL, RECEIPT_EVENTS_SQL))
