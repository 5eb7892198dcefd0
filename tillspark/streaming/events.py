"""Processing-event streams (operators J): the same functions serve batches and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import shared_root


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of event files; the file count bounds a micro-batch. Times become instants, as watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # A file source watches a folder.
        raw = reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    else:
        raw = reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(df: DataFrame, mode: str, name: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over what is there and return its last result, from the shared folder.

    ``each`` replaces the default sink, which keeps every append batch, or the newest complete one.
    """
    spark = df.sparkSession
    root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        # The same batch may come again after a failure: it overwrites what it wrote.
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(each or sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return None if each else spark.read.schema(df.schema).parquet(f"{root}/out")


def once_each(df: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """At-least-once messages once each, forgotten after the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_rates(df: DataFrame, at: str = "ts", by: str = "event_type", size: str = "5 minutes", step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, totals and rates over tumbling or sliding windows."""
    window = F.window(at, size, step) if step else F.window(at, size)
    out = df.withWatermark(at, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(24,2)").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def alerts(df: DataFrame, at: str = "ts", size: str = "1 hour", failure_ratio: float = 0.25, least: int = 5) -> DataFrame:
    """Windows whose share of failures is too high, once enough was seen."""
    out = df.groupBy(F.window(at, size).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return out.where((F.col("n") >= least) & (F.col("failures") > failure_ratio * F.col("n"))).select(F.col("w.start").alias("window_start"), "n", "failures")


def window_quantiles(df: DataFrame, at: str = "ts", value: str = "value", size: str = "1 hour") -> DataFrame:
    """Median, 95th percentile, count, mean and maximum of each window, exact."""
    out = df.groupBy(F.window(at, size).alias("w")).agg(
        F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")
    )
    return out.select(F.col("w.start").alias("window_start"), "p50", "p95", "n", "mean", "most")


def alert_rules(df: DataFrame, failed, review, queued, done, seconds, at: str = "ts", size: str = "1 hour", failure_ratio: float = 0.25, review_ratio: float = 0.5, latency: float = 60.0, growth: int = 0, least: int = 5) -> DataFrame:
    """One row for each window and alert that it raises; :func:`absent_windows` gives those with nothing in them."""
    w = df.groupBy(F.window(at, size).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"), F.count_if(review).alias("reviews"), F.count_if(queued).alias("queued"), F.count_if(done).alias("done"), F.percentile(seconds, 0.95).alias("p95")
    )
    enough = F.col("n") >= least
    raised = {
        "failure_ratio": enough & (F.col("failures") > failure_ratio * F.col("n")),
        "review_ratio": enough & (F.col("reviews") > review_ratio * F.col("n")),
        "latency_p95": F.col("p95") > latency,
        "queue_growing": F.col("queued") > F.col("done") + growth,
        "dead_lettered": F.col("failures") > 0,
    }
    names = F.array_compact(F.array(*[F.when(rule, name) for name, rule in raised.items()]))
    return w.select(F.col("w.start").alias("window_start"), F.explode(names).alias("alert"))


def correlate(log: DataFrame) -> DataFrame:
    """Worker log lines (at, id, host, reference, request, status) in the order of time, late ones too.

    A line with a request tells what a host does with a reference: active on it, or no longer.
    A heartbeat names no request; it counts for the one that its host is active on.
    """
    mark = F.when(F.col("request").isNotNull(), F.struct(F.when(F.col("status") == "active", F.col("request")).alias("r")))
    order = Window.partitionBy("host", "reference").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumn("_active", F.last(mark, ignorenulls=True).over(order)["r"])
    known = F.coalesce("request", "_active")
    return seen.withColumn("request", known).where("request is not null").drop("_active")


def absent_windows(df: DataFrame, first: str, last: str, at: str = "ts", size: str = "1 hour") -> DataFrame:
    """Windows between two instants in which nothing was seen."""
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr(f"INTERVAL {size}"))).alias("window_start"))
    seen = df.groupBy(F.window(at, size).alias("w")).agg(F.lit(1).alias("one")).select(F.col("w.start").alias("window_start"))
    return spine.join(seen, "window_start", "left_anti")


def latest_status(df: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The newest status of each key; an older event never replaces a newer one."""
    return df.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status), F.count(F.lit(1)).alias("events"))


def route(batch: DataFrame, valid, permanent, attempts: str = "attempt", most: int = 3) -> dict[str, DataFrame]:
    """Good messages, those to try again later (one attempt more, a minute on), and dead ones."""
    ok, never = F.coalesce(valid, F.lit(False)), F.coalesce(permanent, F.lit(False))
    again = ~ok & ~never & (F.col(attempts) < most)
    return {
        "good": batch.where(ok),
        "retry": batch.where(again).withColumn(attempts, F.col(attempts) + 1).withColumn("not_before", F.current_timestamp() + F.expr("INTERVAL 60 SECONDS")),
        "dead": batch.where(~ok & ~again),
    }


def passes_after_runs(runs: DataFrame, passes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pass events join their run event; whichever comes first waits within the watermark."""
    r = runs.withWatermark("run_at", late).select(F.col("run_id").alias("r_run_id"), "run_at")
    p = passes.withWatermark("pass_at", late)
    near = F.expr(f"pass_at >= run_at - INTERVAL {late} AND pass_at <= run_at + INTERVAL {late}")
    return p.join(r, (F.col("run_id") == F.col("r_run_id")) & near).drop("r_run_id")


def recover(dead: DataFrame, reason: str) -> DataFrame:
    """Runs that died for a known reason and the passes that hang on them, in replay order."""
    runs = dead.where((F.col("kind") == "run") & (F.col("reason") == reason)).select("run_id")
    return dead.join(runs, "run_id", "left_semi").withColumn("replay_order", F.when(F.col("kind") == "run", 0).otherwise(1)).orderBy("replay_order", "run_id", "pass_id")


ATTEMPT = "request_id long, state string, starts long, last_at timestamp"
_ATTEMPT_STATE = "state string, starts long, last_at timestamp"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, starts, last = state.get if state.exists else ("unknown", 0, None)
    if state.hasTimedOut:
        state.remove()
        status = "stale" if status in ("active", "heartbeat") else status
        yield pd.DataFrame({"request_id": [key[0]], "state": [status], "starts": [starts], "last_at": [last]})
        return
    for pdf in batches:
        starts += int((pdf["status"] == "active").sum())
        newest = pdf.sort_values(["at", "id"]).iloc[-1]
        if last is None or newest["at"] >= last:
            status, last = newest["status"], newest["at"]
    state.update((status, starts, last))
    state.setTimeoutTimestamp(int(last.timestamp() * 1000) + 90_000)
    yield pd.DataFrame({"request_id": [key[0]], "state": [status], "starts": [starts], "last_at": [last]})


def track_attempts(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """The state of each request as events come; 90 seconds without a sign of life make it stale.

    df: request_id, id, at, status. Only the last state of a request is held, not its events.
    """
    watched = df.withWatermark("at", late)
    return watched.groupBy("request_id").applyInPandasWithState(_advance, ATTEMPT, _ATTEMPT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def attempt_states(df: DataFrame, now) -> DataFrame:
    """J5 over a finished log, with ``now`` given: running, stale or the last status."""
    newest = df.groupBy("request_id").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.max("at").alias("last_at"), F.count_if(F.col("status") == "active").alias("starts"))
    silent = F.unix_timestamp(now) - F.unix_timestamp("last_at") > 90
    state = F.when(F.col("status").isin("active", "heartbeat"), F.when(silent, "stale").otherwise("running")).otherwise(F.col("status"))
    return newest.select("request_id", state.alias("state"), "starts", "last_at")
