import numpy as np

from lodestream.llm import embeddings


def slow(rows, t=0.98):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = {r[0]: set() for r in rows}
    for a, b in ((a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1])):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
            links[rows[a][0]].add(rows[b][0])
            links[rows[b][0]].add(rows[a][0])
    comp = {}
    for i in sorted(links):
        if i not in comp:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in comp:
                    comp[k] = i
                    stack += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, **kw).collect()}


def sample():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base = np.random.default_rng(100 + i % 40).standard_normal(16)
        v = base + rng.standard_normal(16) * rng.choice([0, 0.02, 0.1])
        rows.append((i, [float(np.float32(x)) for x in v], i % 40 % 3))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None], 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] + [0.0] * 15, 1), (906, rows[3][1], None)]
    rows += [(910, [1.0, 2.0], 1), (911, [2.0, 4.0], 1), (912, [2.0, 4.0], 1)]
    return rows


def test_results_equal_brute_force(spark):
    rows = sample()
    assert run(spark, rows) == slow(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_hot_bucket_counts_each_pair_once(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in np.float32(base + rng.standard_normal(8) * 0.05)], 1) for i in range(150)]
    df = spark.createDataFrame([(i, 1, [float(x) for x in v], 1) for i, v, _ in rows], "rep long, label long, v array<double>, n long")
    got = {r.a: 0 for r in []}
    for r in embeddings.links(df, block=16).where("b is null").collect():
        got[r.a] = got.get(r.a, 0) + r.n
    want = {i: s[0] for i, s in slow(rows).items() if s[0]}
    missed = sum(want.values()) - sum(got.values())
    assert all(got[i] <= want[i] for i in got) and missed <= 0.01 * sum(want.values())


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    n = 2000
    a = rng.standard_normal((n, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((n, 32))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    x, y = (embeddings.signatures(v, embeddings.BITS, embeddings.TABLES, 20) for v in (a, b))
    assert (x == y).any(axis=1).mean() > 0.99
