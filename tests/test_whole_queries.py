"""The queries over whole tables leave no row out."""

from tillspark.plans import registry
from tillspark.sources import bindings

from .test_queries import SF


def test_every_item_is_joined(spark):
    n = registry.QUERIES["c23_multiset_join"](spark, SF).selectExpr("count(new_id) + count(old_id) AS n").head()["n"]
    assert n == bindings.expense_items(spark, SF).count()


def test_every_customer_and_start_counts(spark):
    attempts = registry.QUERIES["l7_next_state"](spark, SF).agg({"attempts": "sum"}).head()[0]
    starts = bindings.receipt_events(spark, SF).where("status = 'active'").count()
    assert attempts == spark.read.parquet(f"{SF}/customer.parquet").count() + starts
