import collections
import math
import random
import zlib

import pytest

from lodestream.llm import katz


def slow(docs, train, order=katz.ORDER):
    """doc_id -> (n_tokens, n_known, N, base, score) by the definition, from plain counters."""
    seqs = {i: (t or "").encode().lower().split() + [2] for i, t in docs}
    learned = [seqs[i] for i, _ in docs if train(i)]
    uni = collections.Counter(w for s in learned for w in s)
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    events = lambda s, k: zip(*[([1] * (k - 1) + s)[j:] for j in range(k)])
    after, weight, total, d = {}, {}, {}, {}

    def p(k, g):
        if k == 1:
            return base(g[-1])
        h, w = g[:-1], g[-1]
        if h not in after[k]:
            return p(k - 1, g[1:])
        c = after[k][h].get(w, 0)
        return d[k][min(c, 6)] * c / total[h] if c else weight[h] * p(k - 1, g[1:])

    for k in range(2, order + 1):
        grams = collections.Counter(g for s in learned for g in events(s, k))
        d[k] = katz.discounts([sum(c == r for c in grams.values()) for r in range(1, 7)])
        after[k] = collections.defaultdict(dict)
        for g, c in grams.items():
            after[k][g[:-1]][g[-1]] = c
        after[k] = dict(after[k])
        for h, ws in after[k].items():
            c = sum(ws.values())
            free = sum((1 - d[k][min(x, 6)]) * x for x in ws.values())
            total[h] = c + 1 if free <= 0 else c
            lower = sum(p(k - 1, (*h, w)[1:]) for w in ws)
            weight[h] = (1 / (c + 1) if free <= 0 else free / c) / (1 - lower)
            # exactly normalised over known words and one for all others
            assert math.isclose(sum(d[k][min(x, 6)] * x / total[h] for x in ws.values()) + weight[h] * (1 - lower), 1, rel_tol=1e-9)
            if len(uni) < 100 and len(after[k]) < 2000:
                assert math.isclose(sum(p(k, (*h, w)) for w in [*uni, "unseen"]), 1, rel_tol=1e-9)
    out = {}
    for i, s in seqs.items():
        out[i] = (len(s), sum(uni[w] > 0 for w in s), n, sum(math.log10(base(w)) for w in s), sum(math.log10(p(order, g)) for g in events(s, order)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score_documents(df).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:3] == want[i][:3]
        assert got[i][3:] == pytest.approx(want[i][3:], rel=1e-9)


def held_in(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def test_scores_equal_the_definition(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 80)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Never SEEN words w1"), (503, "long " * 20000)]
    same(run(spark, rows), slow(rows, held_in))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_small_parts_and_other_orders(spark, order):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefgh", weights=[8, 7, 6, 5, 4, 3, 2, 1], k=rng.randint(0, 12)))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = katz.score(df, katz.crc_class("doc_id", 5) != 1, order=order, part=200)
    same({r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()}, slow(rows, held_in, order))


def test_learned_tables_hold_every_gram_once(spark):
    rows = [(i, "a b a c " * (i % 3 + 1)) for i in range(20)]
    m = katz.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), katz.F.lit(True), order=3, part=100)
    want = {}
    for _, t in rows:
        s = t.split() + [2]
        for k in (1, 2, 3):
            for g in zip(*[([1] * (k - 1) + s)[j:] for j in range(k)]):
                want[g] = want.get(g, 0) + 1
    got = collections.Counter((r.k, r["count"]) for r in m.grams().collect())
    assert got == collections.Counter((len(g), c) for g, c in want.items())
    assert m.backoff().count() == len({g[:-1] for g in want if len(g) > 1})


def test_a_corpus_whose_counts_are_all_large(spark):
    rows = [(i, "a b a b") for i in range(30)]
    same(run(spark, rows), slow(rows, held_in))


def test_null_ids_are_scored_only(spark):
    got = run(spark, [(None, "a b"), (2, "a a"), (3, "a b")])
    assert got[None][2] == sum(3 for i in (2, 3) if held_in(i))


def test_no_training_documents_and_empty_table(spark):
    out = next(i for i in range(100) if not held_in(i))
    got = run(spark, [(out, "a b")])
    assert got[out] == (3, 0, 0, 0.0, 0.0)
    assert run(spark, []) == {}


def test_discounts_lie_between_0_and_1():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 40, 20, 12, 8, 6], [1, 2, 3, 4, 5, 6]):
        d = katz.discounts(n)
        assert ((d[1:6] > 0) & (d[1:6] < 1)).all()
        assert d[6] == 1
