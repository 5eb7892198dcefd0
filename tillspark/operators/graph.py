"""Provenance graph (operators K): nodes and edges as tables, traversal by frontier joins."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def node_id(kind: str, *keys: Column) -> Column:
    """K1: the content hash that identifies a node."""
    return F.sha2(F.to_json(F.array(F.lit(kind), *[k.cast("string") for k in keys])).cast("binary"), 256)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, source, target).cast("binary"), 256)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """K1: one row an id (id, kind, label, properties, sequence): the first label, the last value of each property."""
    first = nodes.groupBy("id").agg(F.min("kind").alias("kind"), F.min_by("label", F.struct("sequence", "label")).alias("label"))
    values = nodes.select("id", "sequence", F.explode_outer("properties").alias("k", "v")).where("k is not null")
    last = values.groupBy("id", "k").agg(F.max_by("v", F.struct("sequence", "v")).alias("v"))
    maps = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return first.join(maps, "id", "left")


def merge_edges(edges: DataFrame) -> DataFrame:
    """K1: one row for each (source, target, kind)."""
    return edges.select("source", "target", "kind").distinct().withColumn("id", edge_id(F.col("kind"), F.col("source"), F.col("target")))


def event_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2: requests, attempts and events of a processing log, with the edges between them.

    RETRIED_AS links a failed attempt to the next one of its request that was started.
    """
    request, attempt, event = node_id("Request", F.col("request_id")), node_id("Attempt", F.col("request_id"), F.col("attempt")), node_id("Event", F.col("id"))
    none = F.create_map().cast("map<string,string>")
    rows = events.select("id", "request_id", "attempt", "status", "occurred_at", request.alias("r"), attempt.alias("a"), event.alias("e"))
    requests = rows.select(F.col("r").alias("id"), F.lit("Request").alias("kind"), F.concat(F.lit("request "), "request_id").alias("label"), none.alias("properties"), F.lit(0).cast("long").alias("sequence")).dropDuplicates(["id"])
    attempts = rows.select(F.col("a").alias("id"), F.lit("Attempt").alias("kind"), F.concat(F.lit("attempt "), "attempt").alias("label"), F.create_map(F.lit("status"), F.col("status")).alias("properties"), F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("sequence"))
    nodes = rows.select(F.col("e").alias("id"), F.lit("Event").alias("kind"), F.col("status").alias("label"), none.alias("properties"), F.col("id").cast("long").alias("sequence"))
    tries = events.groupBy("request_id", "attempt").agg(F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("status") == "active").alias("started"))
    nxt = tries.where("started").select("request_id", F.col("attempt").alias("later"))
    retried = tries.where("failed").join(nxt, "request_id").where("later > attempt").groupBy("request_id", "attempt").agg(F.min("later").alias("later"))
    edges = (
        rows.select(F.col("r").alias("source"), F.col("a").alias("target"), F.lit("HAS_ATTEMPT").alias("kind"))
        .unionByName(rows.select(F.col("a").alias("source"), F.col("e").alias("target"), F.lit("OBSERVED").alias("kind")))
        .unionByName(retried.select(attempt.alias("source"), node_id("Attempt", F.col("request_id"), F.col("later")).alias("target"), F.lit("RETRIED_AS").alias("kind")))
    )
    return merge_nodes(requests.unionByName(attempts).unionByName(nodes)), merge_edges(edges)


def reach(start: DataFrame, edges: DataFrame, kinds: Sequence[str] | None = None, stop: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """K3/K4: (id, depth) of all that ``start`` (id) reaches along ``kinds``; nodes in ``stop`` are not expanded.

    Each round joins only the new frontier with the edges and drops what is known, so cycles end.
    It ends when nothing new is found; a caller's ``max_depth`` is where it is cut.
    """
    usable = edges.select("source", "target", "kind")
    if kinds is not None:
        usable = usable.where(F.col("kind").isin(list(kinds)))
    usable = stored(usable.select("source", "target").distinct(), "reach-edges")
    seen = stored(start.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        grow = frontier if stop is None else frontier.join(stop.select("id"), "id", "left_anti")
        new = grow.join(usable, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = stored(new.withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = stored(seen.unionByName(frontier), "reach")
    return seen


def closure(start: DataFrame, edges: DataFrame, backward: Sequence[str], forward: Sequence[str]) -> DataFrame:
    """K4: fixpoint backward along provenance and forward along citations."""
    back = edges.where(F.col("kind").isin(list(backward))).select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")
    return reach(start, back.unionByName(edges.where(F.col("kind").isin(list(forward))).select("source", "target", "kind")))


def related(edges: DataFrame, kind: str) -> DataFrame:
    """K6: pairs of sources that share a target; a target's first source stands for all others,
    so a popular one gives a row for each and not all pairs."""
    e = edges.where(F.col("kind") == kind).select("source", "target")
    first = e.groupBy("target").agg(F.min("source").alias("first"))
    return e.join(first, "target").where("source <> first").select("first", F.col("source").alias("related")).distinct()
