"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine, components.

Vectors of one label (and dimension) are hashed by the signs of `bits` random
projections in each of `tables` tables. Vectors that share a bucket in any
table are compared by exact cosine in double precision; a pair counts once, in
the first table where it meets. Equal vectors of a label are one class with a
count, so copies are never compared with each other, and links within a bucket
leave it as counts and a spanning forest. Buckets of more than `block` classes
are dealt out over a grid of cells.

At a cosine of exactly 0.98 a pair meets in some table with probability
1 - (1 - (1 - acos(0.98) / pi) ** bits) ** tables: over 0.9998 for 16 bits and
20 tables, and more for closer pairs.

Defined results: a null label, or a vector that is null, empty, zero or holds
null or non-finite components, links with nothing and is kept; vectors of
different dimensions don't link; rows that repeat a vec_id count as vectors of
their own; a null vec_id takes part as a link partner only by its class and its
row has a null component; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import cells, whole_cells
from .common import materialize, tidy
from .components import components

THRESHOLD = 0.98
BITS = 16
TABLES = 20


def usable():
    """Whether a row (label, v) can link with anything."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) bucket numbers of unit vectors."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
    sign = (x @ planes > 0).reshape(len(x), tables, bits)
    return (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def links(classes: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, block: int = 2048, seed: int = 20) -> DataFrame:
    """classes (rep, label, v, n) -> rows (a, b, n): b null: n vectors link with a; else an edge."""

    def hashed(batches):
        for batch in batches:
            reps, labels, n = batch.column("rep"), batch.column("label"), batch.column("n")
            v = batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate(([0], np.cumsum(size)))
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                sig = signatures(unit / np.linalg.norm(unit, axis=1, keepdims=True), bits, tables, seed)
                take = pa.array(rows)
                # four bytes a component where that loses nothing, and a signature
                slim = x.astype(np.float32)
                blob = pa.array([r.tobytes() for r in (slim if (slim == x).all() else x)], pa.binary())
                sigs = pa.array([r.tobytes() for r in sig.astype(np.int32)], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [reps.take(take), labels.take(take), n.take(take), pa.array(np.full(len(rows), t, np.int32)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(sig[:, t]), blob, sigs],
                        ["rep", "label", "n", "t", "dim", "bucket", "x", "sigs"],
                    )

    rows = classes.select("rep", "label", "n", "v").mapInArrow(tidy(hashed), "rep long, label long, n long, t int, dim int, bucket long, x binary, sigs binary")
    rows = rows.withColumn("key", F.xxhash64("label", "dim", "t", "bucket"))

    def compare(batches):
        for table in whole_cells(batches, 20_000):
            key, ci, cj = (table.column(c).to_numpy() for c in ("key", "ci", "cj"))
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1]))))
            a, b, n = [], [], []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                if e - s > 1:
                    one_cell(table.slice(s, e - s), a, b, n, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    met = cells(rows, "rep", block).select("key", "ci", "cj", "side", "rep", "n", "t", "dim", "label", "x", "sigs")
    return met.mapInArrow(tidy(compare), "a long, b long, n long")


def one_cell(cell: pa.Table, a: list, b: list, n: list, threshold: float) -> None:
    rep, count, side = (cell.column(c).to_numpy() for c in ("rep", "n", "side"))
    t = cell.column("t")[0].as_py()
    grid = cell.column("ci")[0].as_py() != cell.column("cj")[0].as_py()
    dims = cell.column("dim").to_pylist()
    raw = [np.frombuffer(r, np.float32 if len(r) == 4 * d else np.float64) for r, d in zip(cell.column("x").to_pylist(), dims)]
    if len(set(dims)) > 1 or len(cell.column("label").unique()) > 1 or len(cell.column("t").unique()) > 1:
        # a collision of the 64-bit key: take each (label, table, dimension) on its own
        parts = {}
        for i, k in enumerate(zip(cell.column("label").to_pylist(), cell.column("t").to_pylist(), dims)):
            parts.setdefault(k, []).append(i)
        for rows in parts.values():
            if len(rows) > 1:
                one_cell(cell.take(pa.array(rows)), a, b, n, threshold)
        return
    x = np.stack(raw).astype(np.float64)
    sig = np.frombuffer(b"".join(cell.column("sigs").to_pylist()), np.int32).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    m = len(x)
    total = np.zeros(m, np.int64)
    root = list(range(m))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for s in range(0, m, 512):
        cos = (x[s : s + 512] @ x.T) / (norm[s : s + 512, None] * norm[None, :])
        hit = cos >= threshold
        hit &= np.arange(m)[None, :] > np.arange(s, s + len(hit))[:, None]
        if grid:
            hit &= side[s : s + 512, None] != side[None, :]
        i, j = np.nonzero(hit)
        i += s
        if t and len(i):
            new = np.ones(len(i), bool)
            for p in range(0, len(i), 1 << 16):
                q = slice(p, p + (1 << 16))
                new[q] = ~(sig[i[q], :t] == sig[j[q], :t]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(total, i, count[j])
        np.add.at(total, j, count[i])
        for p, q in zip(i.tolist(), j.tolist()):
            u, v = find(p), find(q)
            if u != v:
                root[max(u, v)] = min(u, v)
                a.append(int(rep[p]))
                b.append(int(rep[q]))
                n.append(0)
    for p in np.flatnonzero(total).tolist():
        a.append(int(rep[p]))
        b.append(None)
        n.append(int(total[p]))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", usable())
    classes = materialize(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep is not null"))
    found = materialize(links(classes, threshold, bits, tables))
    comp = components(found.where("b is not null").select("a", "b"))
    partners = found.where("b is null").groupBy("a").agg(F.sum("n").alias("partners"))
    named = (
        classes.join(partners, classes.rep == partners.a, "left")
        .join(comp, classes.rep == comp.node, "left")
        .select("label", "v", F.lit(True).alias("ok"), (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return rows.join(named, ["label", "v", "ok"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
