"""Meeting the rows of a hash bucket without sending a hot bucket to one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions


def cells(rows: DataFrame, ident: str, block: int) -> DataFrame:
    """rows with a long column `key` -> the same with (key, ci, cj, side), dealt out and sorted by cell.

    Keys held by one row only are dropped. A key of more than `block` rows is
    cut into n blocks by the id's hash and its rows are sent to the cells
    (i, j), i <= j, of an n x n grid, so every two rows of a key meet in
    exactly one cell and no task holds more than about 2 x block of them. The
    count per key is combined before its shuffle. Rows often come out of an
    explode, which the optimizer takes for no larger than what it explodes: the
    join is told to sort both sides, lest they be broadcast by the driver.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    nb = F.ceil(F.col("_rows") / F.lit(block)).cast("int")
    b = F.pmod(F.xxhash64(F.col(ident)), nb.cast("bigint")).cast("int")
    met = (
        rows.join(counts.hint("merge"), "key")
        .withColumn("nb", nb)
        .withColumn("b", b)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("ci", F.least("b", "j"))
        .withColumn("cj", F.greatest("b", "j"))
        .withColumn("side", (F.col("b") == F.col("cj")).cast("int"))
        .drop("_rows", "nb", "b", "j")
    )
    return met.repartition(partitions(spark), "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")


def whole_cells(batches, want: int = 200_000):
    """Arrow batches sorted by (key, ci, cj) -> tables that never cut a cell, of about `want` rows."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < want:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k, i, j = (t.column(c).to_numpy() for c in ("key", "ci", "cj"))
        last = np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield t.slice(0, cut)
        held, n = (t.slice(cut).to_batches(), t.num_rows - cut)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
