import random
import zlib
from collections import defaultdict

import numpy as np

from lodestream.llm import sharding


def run(spark, rows, **kw):
    return sharding.shard(spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, size int, g string"), **kw).collect()


def check(rows, out, shards):
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 60) + str(i % 900)) for i in range(2000)]
    out = run(spark, rows, shards=6, block=200)
    check(rows, out, 6)
    load = np.zeros(6)
    for r in out:
        load[r.shard] += r.size
    assert load.max() / load.min() < 1.03
    where = defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_hot_group_is_split(spark):
    rows = [(i, "the same text for all of these") for i in range(700)] + [(1000 + i, f"text {i} " * 4) for i in range(700)]
    out = run(spark, rows, shards=6)
    check(rows, out, 6)
    load = np.zeros(6)
    for r in out:
        load[r.shard] += r.size
    assert load.max() / load.min() < 1.15


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None), (2, None), (3, ""), (3, ""), (None, "é"), (4, "x" * 100000)]
    check(rows, run(spark, rows, shards=3), 3)
    assert run(spark, [], shards=3) == []


def test_placement_follows_the_highest_dot_product():
    out = sharding.place(np.array([[10.0, 1.0], [9.0, 1.0], [1.0, 10.0]]), np.array([[20.0, 2.0], [10.0, 12.0]]))
    assert out.tolist()[0] == 0
    assert out.tolist()[2] == 1
