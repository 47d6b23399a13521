import numpy as np
import pytest
import xxhash

from lodestream.llm import simhash


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp):
    """doc_id -> smallest doc_id reachable at distance <= 4."""
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key long")
    return {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, **kw).collect()}


def test_fingerprints_by_definition():
    texts = ["One two THREE four five", "a b c", "", None, "  \t\n", "x " * 500, "É é ß words\x0bhere and\x0cthere again", "w" * 100000]
    assert [int(x) for x in simhash.fingerprint_batch(texts)] == [slow_fingerprint(t) for t in texts]


def test_chain_keys_meet_every_close_pair():
    rng = np.random.default_rng(1)
    keys = simhash.chain_keys()
    for _ in range(5000):
        d = 0
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            d |= 1 << int(b)
        assert any(d & m == 0 for _, m in keys)


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        base = np.random.default_rng(i % 60)
        t = [words[k] for k in base.integers(0, 40, 60)]
        for _ in range(rng.integers(0, 3)):
            t[rng.integers(0, len(t))] = "changed"
        rows.append((i, " ".join(t), "extra", 7))
    rows += [(900, None, None, None), (901, "", None, None), (902, " \n", None, None)]
    got = near(spark, rows)
    fp = {r[0]: slow_fingerprint(r[1]) for r in rows}
    assert {i: g[0] for i, g in got.items()} == fp
    assert {i: g[1] for i, g in got.items()} == slow_components(fp)
    assert got[901][1] == got[902][1] == 900


def test_a_hot_bucket_is_cut_and_loses_no_link(spark):
    rng = np.random.default_rng(3)
    base = 0x123456789ABCDEF0
    fps = {base}
    while len(fps) < 400:
        x = base
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    rows = [(i, simhash.signed(f)) for i, f in enumerate(sorted(fps))]
    from lodestream.llm.components import components

    classes = spark.createDataFrame(rows, "rep long, fp long")
    got = {r.node: r.component for r in components(simhash.links(classes, block=16)).collect()}
    want = slow_components(dict(enumerate(sorted(fps))))
    assert {i: got.get(i, i) for i in want} == want


def test_null_ids_repeats_and_empty_tables(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5), (9, 5)]
    assert near(spark, []) == {}


def test_deduplicate_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(3, "a b c d e", 1), (1, "a b c d e", 2), (2, "completely other words stand in here", 3), (None, "a b c d e", 4)], "doc_id long, text string, _gone int")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}


def test_another_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "rep long, fp long"), distance=5)
