"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of text that a class may bring to a fit, and the share of them that one document may have.
MAX_BYTES, MAX_SHARE = 8 << 20, 1 / 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row (doc_id, y, text) for at most ``per_class`` labelled ids of each class, of ``max_bytes`` of text at most.

    The ids with the smallest hashes are taken, so the sample is the same whatever the
    partitioning and spreads over the corpus. An id with contradictory labels is left out. Of
    rows that share an id the one with the smallest text hash counts, chosen before anything is
    gathered. Documents of over ``MAX_SHARE`` of ``max_bytes`` are not fitted on, and those
    beyond a class's ``max_bytes``, in the order of hashes, are not either.
    The sample of ids is bounded by ``2 * per_class`` rows and therefore broadcast.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    known = known.withColumn("order", F.xxhash64("doc_id"))
    picked = [known.where(F.col("y") == y).orderBy("order", "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_ll_id"), "y", "order")
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= int(max_bytes * MAX_SHARE))
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_ll_id"))
    rows = written(rows.groupBy("doc_id", "y", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("order", "doc_id"))
    fit = rows.select("doc_id", upto.alias("upto")).where(F.col("upto") <= max_bytes).select(F.col("doc_id").alias("_ll_id"))
    return rows.join(F.broadcast(fit), F.col("doc_id") == F.col("_ll_id")).select("doc_id", "y", "text")


def in_order(rows: Iterable) -> list:
    """Collected rows in an order that does not depend on partitioning."""
    return sorted(rows, key=lambda r: (r["h"], r["doc_id"]))
