"""Sharding by vector bin packing over bytes, tokens and rows.

Rows of equal text form a group; a group of more than a bounded part of a
shard is cut into pieces by doc_id. The few groups so large that they bound
the balance are placed first, over all shards at once. The rest is dealt into
blocks by hash, and each block places its groups, largest first, where the
dot product of the group's demand with the shard's residual capacity is
highest; a block's capacities are its share of what the large groups left
free, so blocks are independent and their small errors don't add up.

Law: `bytes`. Sizes come out near equal; tokens and rows are balanced with
them as far as the groups allow.

What is broadcast or collected: one capacity vector per shard, and the large
groups, of which there are at most shards * LARGE per dimension.

Defined results: a null text has size 8, crc 0 and no tokens, and forms a group
of its own with other nulls; rows that repeat a doc_id each get a slot, in an
order fixed by doc_id and then arbitrary; a null doc_id is carried through; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Groups over 1/LARGE of a shard in some dimension are placed before all others.
LARGE = 64
#: Groups over 1/PIECE of a shard are cut into pieces of at most that.
PIECE = 8
#: And of at most about so many rows.
PIECE_ROWS = 1_000_000
#: Groups per block, on average.
BLOCK = 4096


def place(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each row of demand (groups x dimensions), given capacity (shards x dimensions).

    A group goes where the dot product of its demand, in units of the mean
    shard, with the shard's residual capacity is highest.
    """
    unit = np.maximum(capacity.mean(axis=0), 1e-9)
    d = demand / unit
    residual = capacity / unit
    out = np.zeros(len(d), np.int64)
    for i in np.argsort(-d.max(axis=1), kind="stable"):
        s = int(np.argmax(residual @ d[i]))
        out[i] = s
        residual[s] -= d[i]
    return out


def shard(docs: DataFrame, shards: int = 24, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, n_tokens, shard, slot)."""
    spark = docs.sparkSession
    blank = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(blank) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.regexp_count(blank, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_tokens"),
            F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit("null")).alias("g"),
        )
    )
    dims = ["bytes", "tokens", "rows"]
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "n_tokens")], F.count(F.lit(1))).first()
    mean = [max(1.0, t / shards) for t in total]
    share = F.greatest(*[F.col(c) / F.lit(m) for c, m in zip(dims, mean)])
    n_pieces = F.greatest(F.ceil(share * PIECE), F.ceil(F.col("rows") / PIECE_ROWS)).cast("int")
    cut = groups.select("g", n_pieces.alias("n_pieces")).where("n_pieces > 1")
    # at most 3 * shards * PIECE groups are that large, and one for every PIECE_ROWS rows
    dealt = rows.join(F.broadcast(cut), "g", "left").withColumn("piece", F.when(F.col("n_pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("n_pieces").cast("long"))).otherwise(0).cast("int")).drop("n_pieces")
    pieces = dealt.groupBy("g", "piece").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    pieces = materialize(pieces)
    big = share > 1 / LARGE
    head = pieces.where(big).orderBy("g", "piece").toPandas()  # at most 3 * shards * LARGE rows
    capacity = np.tile(np.array([t / shards for t in total], float), (shards, 1))
    first = place(head[dims].to_numpy(float), capacity) if len(head) else np.zeros(0, np.int64)
    left = capacity.copy()
    np.subtract.at(left, first, head[dims].to_numpy(float))
    left = np.maximum(left, 0)
    left_sum = np.maximum(left.sum(axis=0), 1e-9)
    n_blocks = max(1, math.ceil(pieces.count() / block))

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "piece"], ignore_index=True)
        d = pdf[dims].to_numpy(float)
        turn = int(pdf["block"].iloc[0]) % shards  # so that no shard is first in every block
        order = np.roll(np.arange(shards), turn)
        pdf["shard"] = order[place(d, (left / left_sum * d.sum(axis=0))[order])]
        pdf["before"] = pdf.groupby("shard")["rows"].cumsum() - pdf["rows"]
        return pdf[["g", "piece", "block", "shard", "before", "rows"]]

    out = "g string, piece int, block int, shard long, before long, rows long"
    small = pieces.where(~big).withColumn("block", F.pmod(F.xxhash64("g", "piece"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInPandas(pack_block, out)
    head = head.assign(block=-1, shard=first)
    head["before"] = head.groupby("shard")["rows"].cumsum() - head["rows"]
    large = spark.createDataFrame(list(head[["g", "piece", "block", "shard", "before", "rows"]].itertuples(index=False, name=None)), out)
    placed = materialize(small.union(large))
    per = placed.groupBy("shard", "block").agg(F.sum("rows").alias("n"))
    offset = per.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("offset"))
    placed = placed.join(offset, ["shard", "block"]).select("g", "piece", "shard", (F.col("offset") + F.col("before")).alias("base"))
    within = F.row_number().over(W.partitionBy("g", "piece").orderBy("doc_id")) - 1
    return dealt.withColumn("r", within).join(placed, ["g", "piece"]).select("doc_id", "size", "text_crc32", "n_tokens", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("r")).alias("slot"))
