"""Distributed connected components: alternating large-star and small-star rounds; few edges are joined in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, tidy

#: So many edges of long ids are joined in one task: some 100 bytes of its memory each.
ALONE = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of all nodes of edges but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    low = np.array([find(i) for i in range(len(nodes))], np.int64)
    use = low != np.arange(len(nodes))
    return nodes[use], nodes[low[use]]


def joined(edges: DataFrame) -> DataFrame:
    """What components() returns, in one task."""

    def run(batches):
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])

    return edges.coalesce(1).mapInArrow(tidy(run), "u long, v long")


def named(e: DataFrame) -> DataFrame:
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._lodestream_path = e._lodestream_path  # for drop()
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component), component the smallest node reachable.

    Nodes without an edge to another node do not appear. Each round is two
    aggregations and two equi-joins over the edge list, written to shared
    storage; nothing but a row count and a checksum reaches the driver. A hub
    is summarised by min() before the shuffle, and the joins sort both sides:
    adaptive execution can split them, and the driver, which keeps a thread and
    its memory for each broadcast for a minute, builds none. Up to ALONE edges
    need no rounds. Nulls and loops are ignored.
    """
    e = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        seen = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state or seen[0] == 0:
            return named(e)
        if state is None and seen[0] <= ALONE and {t for _, t in e.dtypes} == {"bigint"}:
            new = materialize(joined(e))
            drop(e)
            return named(new)
        state = seen
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            sym.where(F.col("v") > F.col("u")).join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2.hint("merge"), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        new = materialize(small)
        drop(e)
        e = new
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
