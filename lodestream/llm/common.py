"""What the corpus operators share: tables, shared scratch space, worker caches."""

from __future__ import annotations

import contextlib
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that go to Python at a time, unless the session has its own number: texts are long.
BATCH_ROWS, BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH) == "10000":  # Spark's default
        spark.conf.set(BATCH, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Tasks to deal data out to: what the cluster sets for this input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir), deleted with the session at the latest."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            base = tempfile.mkdtemp(prefix="lodestream-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/lodestream-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Spark then deletes an execution's shuffle files when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *by: str, **options: str) -> DataFrame:
    """Write once to shared storage (partitioned by `by`) and read back: cuts the lineage, survives lost executors.

    What is written lies there until drop() or the end of the session.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestream_path = path
    return out


@contextlib.contextmanager
def no_broadcasts(spark: SparkSession):
    """What is planned inside joins by sorting, but for hints.

    The driver builds each broadcast's table in its own memory, with a thread
    for it and others to send and remove it, which live on for a minute.
    """
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in held:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drop(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing lazy reads it any more."""
    for df in frames:
        path = getattr(df, "_lodestream_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    m = sys.modules.setdefault("_lodestream_worker", types.ModuleType("_lodestream_worker"))
    return m.__dict__.setdefault("held", {})


def tidy(run):
    """A function for mapInArrow that gives freed memory back when its task ends: workers live on, with other tasks beside them."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def crc_class(col: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
