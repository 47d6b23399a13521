"""Intermediate results in the folder that driver and executors share, and the run store."""

from __future__ import annotations

import datetime
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder: its lineage is cut and lost executors don't matter."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lodestream-")
        sc.setCheckpointDir(base)
    return df.checkpoint()


def frame_digest(df: DataFrame) -> str:
    """Identity of a frame's rows, in whatever order: count, sum and parity of row hashes, summed before they are shuffled."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)))
    n, total, parity = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return f"{n}:{total}:{parity}"


CACHE = "cache_key string, created_at timestamp, outputs string"
RUNS = "run string, workflow string, status string, created_at timestamp"
STEPS = "run string, node string, task string, status string, attempts int, cache_key string, error_type string, error string"
EDGES = "run string, child string, parent string"


class RunStore:
    """Runs, steps, edges and cached results as tables under a path; each write appends, the first result of a key counts.

    The driver writes a few rows per run; frames are written by Spark.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        schema = {"cache": CACHE, "runs": RUNS, "steps": STEPS, "edges": EDGES}[name]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(conf).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def load(self, key: str) -> dict | None:
        """The outputs written under a key, or None."""
        row = self.table("cache").where(F.col("cache_key") == key).orderBy("created_at", "outputs").limit(1).collect()
        if not row:
            return None
        out = json.loads(row[0].outputs)
        return {n: self._opened(v) for n, v in out.items()}

    def _opened(self, v):
        if isinstance(v, dict) and "_frame" in v:
            return self.spark.read.parquet(v["_frame"])
        return {k: self._opened(x) for k, x in v.items()} if isinstance(v, dict) else v

    def save(self, key: str, outputs: dict) -> None:
        def closed(v):
            if isinstance(v, DataFrame):
                path = f"{self.path}/frames/{key}/{uuid.uuid4().hex}"
                v.write.parquet(path)
                return {"_frame": path}
            return {k: closed(x) for k, x in v.items()} if isinstance(v, dict) else v

        self._append("cache", [(key, datetime.datetime.now(), json.dumps(closed(outputs), sort_keys=True, default=str))], CACHE)

    def record(self, run: str, workflow: str, status: str, steps: list[tuple], edges: list[tuple]) -> None:
        """steps (node, task, status, attempts, cache_key, error type, error); edges (child, parent)."""
        self._append("steps", [(run, *s) for s in steps], STEPS)
        self._append("edges", [(run, *e) for e in edges], EDGES)
        self._append("runs", [(run, workflow, status, datetime.datetime.now())], RUNS)
