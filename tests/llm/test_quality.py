import random
import zlib

import numpy as np

from lodestream.llm import quality


def text(rng, good):
    words = ["the", "of", "and", "running", "water", "city", "house", "small", "people", "garden", "letters"]
    if good:
        return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(rng.randint(2, 12)))
    return rng.choice([lambda: " ".join([rng.choice(words)] * 60), lambda: " | ".join(rng.choice(words).upper() + "!!" for _ in range(50)), lambda: "$$$ " * 40])()


def corpus(n=900):
    rng = random.Random(1)
    return [(i, text(rng, i % 5 != 0), int(i % 5 != 0)) for i in range(n)]


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t, _ in rows], "doc_id long, text string, quality string, x string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 == 0], "doc_id long, quality int")
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(got[i].held_out == held(i) for i in got)
    out = [(got[i].predicted, q) for i, _, q in rows if held(i)]
    assert np.mean([p == q for p, q in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    flipped = spark.createDataFrame([(i, 1 - q if held(i) else q) for i, _, q in rows if i % 2 == 0], "doc_id long, quality int")
    a, b = (dict((r.doc_id, r.score) for r in quality.classify(docs, lab).collect()) for lab in (labels, flipped))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_risk_and_gradient_equal_sums_over_rows():
    rng = np.random.default_rng(2)
    p, u = rng.standard_normal((40, 6)) + 0.7, rng.standard_normal((90, 6))
    loss = lambda z: (1 - z) ** 2 / 4
    clipped = set()
    for prior in (0.3, 0.8):
        for size in (0.01, 0.5, 2):
            w = rng.standard_normal(6) * size + (0.8 if prior > 0.5 else 0)
            second = loss(-u @ w).mean() - prior * loss(-p @ w).mean()
            clipped.add(second < 0)
            value, grad = quality.risk(w, quality.Moments.of(p), quality.Moments.of(u), prior)
            assert np.isclose(value, prior * loss(p @ w).mean() + max(0, second))
            slow = prior * (-(1 - p @ w) / 2) @ p / len(p)
            if second >= 0:
                slow = slow + ((1 + u @ w) / 2) @ u / len(u) - prior * ((1 + p @ w) / 2) @ p / len(p)
            assert np.allclose(grad, slow)
    assert clipped == {True, False}


def test_fit_lowers_the_risk_where_it_is_clipped_and_where_not():
    rng = np.random.default_rng(1)
    p, u = quality.expand(rng.standard_normal((150, 3)) + 1), quality.expand(rng.standard_normal((400, 3)))
    for prior in (0.2, 0.9):
        a, b = quality.Moments.of(p), quality.Moments.of(u)
        w = quality.fit(a, b, prior)
        value = quality.risk(w, a, b, prior)[0] + quality.RIDGE / 2 * w @ w
        assert value <= quality.risk(np.zeros(len(w)), a, b, prior)[0] and (p @ w).mean() > (u @ w).mean()
        for _ in range(50):
            v = w + rng.standard_normal(len(w)) * 0.02
            assert value <= quality.risk(v, a, b, prior)[0] + quality.RIDGE / 2 * v @ v + 1e-3


def test_the_prior_comes_from_positives_and_unlabelled_text():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.85):
        p = rng.normal(2, 1, 3000)
        u = np.where(rng.random(40_000) < prior, rng.normal(2, 1, 40_000), rng.normal(-2, 1, 40_000))
        edges = np.quantile(p, np.linspace(0, 1, 200)[:-1])
        got = quality.class_prior(np.array([(p >= e).mean() for e in edges]), np.array([(u >= e).mean() for e in edges]), len(p), len(u))
        assert abs(got - prior) < 0.04


def test_moments_and_counts_cover_every_row(spark):
    docs, _ = frames(spark, corpus(300))
    feats = quality.features_of(docs.repartition(5)).cache()
    x = np.array([r.x for r in feats.collect()])
    model = quality.Model(x.mean(axis=0), x.std(axis=0) + 1e-3, None)
    got, n = quality.moments_of(feats, model)
    want = quality.Moments.of(model.terms(x))
    assert n == 300 and np.allclose(got.first, want.first) and np.allclose(got.second, want.second)
    w = np.ones(quality.TERMS)
    g = model.terms(x) @ w
    edges = np.quantile(g, [0.2, 0.7])
    assert quality.counts_of(feats, model, [w], edges).tolist() == [np.bincount(np.searchsorted(edges, g, side="right"), minlength=3).tolist()]


def test_monotone_values():
    assert quality.monotone(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]


def test_odd_texts_and_missing_labels(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "w " * 200000, 1), (3, "w " * 200000, 1), (None, "a b", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    bad = spark.createDataFrame([(1, 0), (2, None), (7, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.classify(docs, bad).collect()}) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(empty, bad).collect() == []
    assert quality.accepted(empty, quality.constant(0.5)).columns == ["doc_id", "text"]


def test_accepted_rows_are_the_predicted_ones(spark):
    docs, labels = frames(spark, corpus(300))
    feats = quality.features_of(docs)
    model = quality.train(feats, labels)
    want = {r.doc_id for r in quality.score(feats, model).where("predicted = 1").collect()}
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
