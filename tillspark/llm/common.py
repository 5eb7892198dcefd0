"""What the corpus operators share: shared storage, hashes and word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that crosses to a Python worker.
BATCH_BYTES = 8 << 20

_scratch: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none (a test) gets a temporary folder of its own; on a
    cluster such a folder would be another one on each machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tillspark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Texts cross to Python in batches of ``BATCH_BYTES``: a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    The table outlives any executor. It is removed by :func:`drop` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_drop_all, spark)
    _scratch.add(path)
    bounded_batches(spark)
    with _shuffles_end_with_the_write(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove what :func:`written` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _scratch:
            _scratch.discard(path)
            _delete(df.sparkSession, path)


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step go when its table is written: whoever reads it never needs them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:
        return
    for path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone when the driver ends
            return
    _scratch.clear()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
