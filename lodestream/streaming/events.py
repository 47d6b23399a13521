"""Incremental views over an append-only event log.

An extension: the batch operators above define the results; these keep them up
to date as rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """New files of a folder of event rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_states(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key, kept as state: one row per key, whatever the order of arrival."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_l")).select(*keys, "_l.*")


def windowed_means(events: DataFrame, at: str, value: str, key: str, size: str, late: str) -> DataFrame:
    """Mean and count per key and tumbling window; rows later than `late` are left out and their state dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "mean", "n")


def attempts(events: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """How often each step was started."""
    return events.where(F.col(status) == "RUNNING").groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"))


def drain(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its table."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return df.sparkSession.table(name)
