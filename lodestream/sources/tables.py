"""Adapters: the engine's inputs, built from plain tables.

A *series* frame has (series, pos, t, y); a *trajectory* frame has (frame, mol,
bead, type, mass, x, y, z); both are long, so every operator is a grouped or
windowed plan over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one series per event type: pos from 0, t seconds since the first row, y the value."""
    e = read(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    w = W.partitionBy("event_type").orderBy("ts", "event_id")
    start = F.min("ts").over(W.partitionBy("event_type"))
    return e.select(
        F.col("event_type").alias("series"),
        (F.row_number().over(w) - 1).alias("pos"),
        (F.timestamp_diff("MICROSECOND", start, F.col("ts")) / 1e6).alias("t"),
        F.col("value").alias("y"),
    )


SERIES_SQL = """series AS (SELECT event_type AS series, row_number() OVER w - 1 AS pos,
  date_diff('microsecond', min(ts) OVER (PARTITION BY event_type), ts) / 1e6 AS t, value AS y
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
sized AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM series)"""


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a temperature sweep (temperature, volume): one point per size."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("temperature")).agg(F.avg("p_retailprice").alias("volume"))


SWEEP_SQL = "sweep AS (SELECT cast(p_size AS DOUBLE) AS temperature, avg(p_retailprice) AS volume FROM part GROUP BY 1)"


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as stress and strain per return flag."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series"), F.col("l_discount").alias("strain"), (F.col("l_extendedprice") / 1e5).alias("stress"))


STRESS_SQL = "stress AS (SELECT l_returnflag AS series, l_discount AS strain, l_extendedprice / 1e5 AS stress FROM lineitem)"

BOX = 1.0
BEADS = 21
BEADS_PER_MOL = 7


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames of 21 beads in 3 chains: components 0..62 are x, y, z of each bead in turn."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("v"))
    at = F.col("bead") * 3
    return (
        e.select("frame", "v", F.explode(F.sequence(F.lit(0), F.lit(BEADS - 1))).alias("bead"))
        .select(
            "frame",
            F.expr(f"bead div {BEADS_PER_MOL}").alias("mol"),
            "bead",
            (F.col("bead") % 2 + 1).alias("type"),
            (F.col("bead") % 2 + 1).cast("double").alias("mass"),
            F.get("v", at).alias("x"),
            F.get("v", at + 1).alias("y"),
            F.get("v", at + 2).alias("z"),
        )
    )


TRAJ_SQL = f"""traj AS (SELECT vec_id AS frame, bead // {BEADS_PER_MOL} AS mol, bead, bead % 2 + 1 AS type, cast(bead % 2 + 1 AS DOUBLE) AS mass,
  cast(embedding[bead * 3 + 1] AS DOUBLE) AS x, cast(embedding[bead * 3 + 2] AS DOUBLE) AS y, cast(embedding[bead * 3 + 3] AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range({BEADS})) AS bead))"""
