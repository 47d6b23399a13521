import hashlib
import random

import numpy as np
import pytest

from lodestream.llm import suffixes


def slow(docs, length):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    first = {}
    for i, t in sorted(docs):
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], i)
    out = {}
    for i, t in docs:
        gone = [False] * (len(t) + 1)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def run(spark, rows, length=50, gram=20, schema="doc_id long, text string, part string, keys int"):
    df = spark.createDataFrame([(*r, "clash", 1)[: schema.count(",") + 1] for r in rows], schema)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, length, gram).collect()}


@pytest.mark.parametrize("alphabet", [b"ab", b"abc", bytes(range(256)), b"\x00\xff"])
def test_two_stage_order(alphabet):
    rng = random.Random(5)
    for _ in range(40):
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 20))]
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        order = suffixes.two_stage(text, ends, 50)
        place = {int(e) - len(p) + k: p[k:] for p, e in zip(parts, ends) for k in range(len(p))}
        assert sorted(order.tolist()) == sorted(place)
        got = [place[i] for i in order.tolist()]
        assert all(x <= y for x, y in zip(got, got[1:]))


def test_common_prefixes():
    parts = [b"abcabcabc", b"abcabd", b"zz"]
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    order = np.array([0, 10, 17])
    assert suffixes.common_prefixes(text, order, 50).tolist() == [0, 5, 0]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 256, 50, dtype=np.uint8)
    seen = []
    for n in (0, 7, 300):
        t = np.concatenate([rng.integers(0, 256, n, dtype=np.uint8), shared, rng.integers(0, 256, 90, dtype=np.uint8)])
        start, count, key = suffixes.anchor_runs(t, np.array([len(t)]), 50, 20)
        at = np.searchsorted(start, n, side="right") - 1
        assert start[at] <= n < start[at] + count[at]
        seen.append(int(key[at]))
    assert len(set(seen)) == 1


def documents():
    rng = random.Random(7)
    words = ["lorem", "ipsum", "dölor", "sit", "a", "consectetur", "天地", "x"]
    said = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(8)]
    rows = []
    for i in range(60):
        t = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        t.insert(rng.randint(0, 3), rng.choice(said))
        rows.append((i * 3, " ".join(t)))
    rows += [(500, None), (501, ""), (502, "short"), (503, "z" * 400), (504, "y" + "z" * 120), (505, rows[4][1]), (506, rows[4][1])]
    rows.append((507, ("ab" * 30 + "q" * 70) * 3))
    return rows


def test_results_equal_brute_force(spark):
    rows = documents()
    assert run(spark, rows) == slow([(i, (t or "").encode()) for i, t in rows], 50)


def test_very_long_texts_are_cut_with_an_overlap(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(suffixes.BLOCK + 3000))
    rows = [(1, long), (2, "head " + long[suffixes.BLOCK - 200 : suffixes.BLOCK + 300] + " tail")]
    got = run(spark, rows)
    assert got[1][1] == 0
    assert got[2][1:3] == (500, 1) or got[2][1] > 500


def test_null_and_repeated_ids(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until night"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t), (4, "other text " * 9)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    # all texts of document 4 take part
    assert got == [(-1, 71, 0), (3, 71, 0), (3, 71, 0), (4, 71, 71), (4, 99, 0)]


def test_repeated_ids_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i % 25, t) for i, t in documents()] + [(rng.randrange(25), t) for _, t in documents()[:30]]
    want = {}
    for k, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 49):
            if any(j < i and raw[s : s + 50] in (u or "").encode() for j, u in rows):
                gone[s : s + 50] = [True] * 50
        want.setdefault((i, hashlib.sha256(raw).hexdigest()), []).append((len(raw), sum(gone), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()]
    assert sorted(got) == sorted((i, *x) for (i, _), xs in want.items() for x in xs)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_rewritten_rows_keep_their_columns(spark):
    t = "une phrase répétée, assez longue pour dépasser cinquante octets en tout"
    df = spark.createDataFrame([(1, t, "fr", 0, "p"), (2, "Début " + t + " fin", "fr", 0, "p"), (3, None, "fr", 0, None)], "doc_id long, text string, lang string, n_chars long, part string")
    out = suffixes.remove_repeats(df, rewrite=True)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars, r.part) for r in out.collect()}
    assert got == {1: (t, len(t), "p"), 2: ("Début  fin", 10, "p"), 3: (None, None, None)}


def test_batches_of_whole_anchors_change_nothing():
    import numpy as np

    from lodestream.llm import suffixes as sx

    rng = np.random.default_rng(3)
    pieces, anchor = [], []
    for k in range(12):
        shared = rng.bytes(70)
        for _ in range(rng.integers(2, 6)):
            pieces.append(rng.bytes(int(rng.integers(0, 20))) + shared + rng.bytes(int(rng.integers(0, 20))))
            anchor.append(k)
    raw, at = b"".join(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    use, anchor, doc = np.arange(len(pieces)), np.array(anchor), rng.permutation(len(pieces))
    batches = list(sx.batches_of(use, anchor, at, most=150))
    assert len(batches) > 3 and np.concatenate(batches).tolist() == use.tolist()
    assert all(not set(anchor[a]) & set(anchor[b]) for a, b in zip(batches, batches[1:]))
    found = lambda some: [(some[p], w, low) for p, w, low in zip(*(x.tolist() for x in sx.sorted_out([pieces[i] for i in some], doc[some], 50)))]
    whole, cut = sorted(found(use)), sorted(t for b in batches for t in found(b))
    assert any(low < doc[i] for i, _, low in whole) and whole == cut
