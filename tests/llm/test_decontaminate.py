import re

from lodestream.llm import decontaminate as dec
from tests import oracle

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def seeds_of(w):
    at = {}
    for m in dec.MASKS:
        for i in range(len(w) - len(m) + 1):
            at.setdefault((m, *(w[i + x] for x, c in enumerate(m) if c == "1")), []).append(i)
    return at


def slow(docs, items):
    """Every alignment that shares a seed, verified; seeds are compared as words, not as hashes."""
    out = {}
    held = [(k, words(t), seeds_of(words(t))) for k, t in items]
    for d, text in docs:
        w = words(text)
        at = seeds_of(w)
        for k, b, own in held:
            for o in {i - q for s in own.keys() & at.keys() for i in at[s] for q in own[s]}:
                same = [w[o + x] == b[x] for x in range(max(0, -o), min(len(b), len(w) - o))]
                span = min(dec.WINDOW, len(b))
                best = max((sum(same[p : p + span]) for p in range(len(same) - span + 1)), default=0)
                if best >= -(-span * 8 // 10):
                    out[d, k] = max(best, out.get((d, k), 0))
    return out


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
DOCS = [
    (1, "before it " + ITEM + " after it"),
    (2, "x " + ITEM.replace("delta", "DELTA!").replace("theta", "changed").replace("mu", "other") + " y"),
    (3, ITEM.replace("gamma", "q").replace("eta", "q").replace("iota", "q").replace("mu", "q").replace("pi", "q").replace("sigma", "q").replace("alpha", "q")),
    (4, "alpha beta gamma delta epsilon and then nothing of it at all, really nothing more of it"),
    (5, None),
    (6, ""),
    (7, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (8, "w " * 3000 + ITEM),
    (9, "one two three four five six"),
    (9, "one two three four five six"),
]
ITEMS = [(10, ITEM), (11, "one two three four five six"), (12, "too short"), (13, None), (14, ITEM)]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, w string, seed int"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hits string")


def test_overlaps_equal_brute_force(spark):
    got = {(r.doc_id, r.item_id): r.matched for r in dec.overlaps(*frames(spark)).collect()}
    want = slow(DOCS, [i for i in ITEMS if len(words(i[1])) >= 5])
    assert got == want
    assert {d for d, _ in got} == {1, 2, 7, 8, 9}


def test_beyond_the_broadcast_bound_the_result_is_the_same(spark):
    a, b = (sorted(map(tuple, dec.overlaps(*frames(spark), broadcast_tokens=n).collect())) for n in (0, 10**6))
    assert a == b and a


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert dec.overlaps(docs.limit(0), items).collect() == []
    assert dec.overlaps(docs, items.limit(0)).collect() == []


def test_removed_rows(spark):
    docs, items = frames(spark)
    kept = dec.remove(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6}


def test_no_python_in_the_plan(spark):
    df = dec.overlaps(*frames(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_against_sql(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    oracle.same(dec.overlaps(read("documents"), read("benchmark")), oracle.connect(SF), dec.oracle())


def test_recall_over_every_allowed_substitution(spark):
    """Each item length with every pattern of as many substitutions as its similarity allows, against all alignments: no seeds, no hashes."""
    import itertools
    import math

    items, docs, want = [], [], set()
    for n in range(2, 15):
        own = [f"item{n}word{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        for some in itertools.combinations(range(n), min(n, dec.WINDOW) - math.ceil(min(n, dec.WINDOW) * dec.SIMILARITY)):
            docs.append((len(docs), "before it " + " ".join("q" if k in some else w for k, w in enumerate(own)) + " and after"))
            if n > 2:
                want.add((docs[-1][0], n))
    for bound in (0, 10**6):
        got = {(r.doc_id, r.item_id) for r in dec.overlaps(*frames(spark, docs, items), broadcast_tokens=bound).collect()}
        assert not got - want
        assert len(got) == len(want), sorted(want - got)[:9]


def test_null_ids_are_ids(spark):
    docs, items = frames(spark, [(None, ITEM), (1, ITEM)], [(None, ITEM)])
    assert sorted(((r.doc_id is None, r.item_id) for r in dec.overlaps(docs, items).collect()), key=str) == [(False, None), (True, None)]
    assert dec.remove(docs, items).count() == 0


def test_short_items_against_sql(spark, tmp_path):
    import duckdb

    docs, items = frames(spark, DOCS + [(20, "one two other four five six"), (21, "so four words here now")], ITEMS + [(30, "four words here")])
    con = duckdb.connect()
    for name, df in (("documents", docs.dropDuplicates(["doc_id"])), ("benchmark", items)):
        con.register(name, df.toArrow())
    want = sorted(map(tuple, con.execute(dec.oracle()).fetchall()))
    assert sorted(map(tuple, dec.overlaps(docs, items).select("doc_id", "item_id", "matched", "compared").collect())) == want
    assert {d for d, i, *_ in want if i == 30} == {21} and {d for d, i, *_ in want if i == 11} == {9, 20}
