"""Tables in the folder that all executors share, versioned by directory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names it; else a local folder, for tests in a local session only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tillspark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: the lineage ends here and outlives executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A table whose versions are directories; a new version shows only when it is complete.

    ``current`` follows the greatest version whose marker exists, so readers never see a half
    written one and an older writer cannot replace a newer version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        _, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(root.suffix(f"/{n}/_SUCCESS")))

    def current(self) -> DataFrame | None:
        versions = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def publish(self, df: DataFrame, keep: int = 2) -> int:
        """Write the next version and drop all but the last ``keep``."""
        jvm, root, fs = self._fs()
        versions = self.versions()
        version = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)
        return version


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A2-A4: reference, size and sha256 of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    reference = F.regexp_replace("path", f"^(?:[a-z]+:/*)?/?{root.split('://')[-1].strip('/')}/", "")
    return files.select(reference.alias("reference"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"))


def export(df: DataFrame, path: str, form: str = "json") -> None:
    """A table as JSON lines or as CSV with a header, one folder of part files; nulls keep their fields in JSON."""
    if form == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif form == "csv":
        df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
    else:
        raise ValueError(f"cannot export as {form}")


def rows_one_by_one(df: DataFrame, column: str) -> Iterator[str]:
    """The values of a column of large texts, a partition at a time on the driver, the next one fetched meanwhile."""
    return (row[0] for row in df.select(column).toLocalIterator(prefetchPartitions=True))


def settled(seen: DataFrame, found: DataFrame, now: Column, settle_seconds: int = 60) -> DataFrame:
    """A10: files to read now: still for ``settle_seconds``, and new, changed, or due for another try.

    found: reference, bytes, modified_at, sha256; seen: the same with attempts, failed and not_before.
    """
    old = seen.select("reference", *[F.col(c).alias(f"_{c}") for c in ("bytes", "sha256", "failed", "not_before")])
    still = found.where(F.unix_timestamp("modified_at") + settle_seconds <= F.unix_timestamp(now))
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha256"))
    due = F.coalesce(F.col("_failed") & (F.col("_not_before") <= now), F.lit(False))
    return still.join(old, "reference", "left").where(~F.coalesce(same, F.lit(False)) | due).select(*found.columns)
