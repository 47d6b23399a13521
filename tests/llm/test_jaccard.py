import random

import corpus_pipeline as pipeline
from lodestream.llm import jaccard

SF = "/root/testdata/sf0.001"


def slow_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({b" ".join(words)} if words else set())


def slow_groups(rows):
    """doc_id -> smallest doc_id reachable at an exact similarity of 4/5 or more."""
    sets = {i: slow_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def rows_with_copies():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(0, None), (1, "  "), (2, "one two"), (3, "One  TWO"), (4, "one three")]
    line = [word() for _ in range(12)]
    for base in range(16):
        text = [word() for _ in range(rng.choice([8, 20, 60, 200, 400]))] + (line if base % 3 == 0 else [])
        for _ in range(7):
            t = list(text)
            for _ in range(rng.randrange(0, 1 + len(t) // 35)):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t[: len(t) - rng.randrange(0, 3)])))
    return rows


def test_groups_equal_exact_similarity(spark, monkeypatch):
    rows = rows_with_copies()
    df = spark.createDataFrame(rows + [(None, "one two")], "doc_id long, text string")
    want = slow_groups(rows)
    assert 10 < len(set(want.values())) < len(rows) - 20
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == want
    monkeypatch.setattr(jaccard, "LEADERS", ())
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == want


def test_pipeline_stage_removes_every_similar_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    assert got == {i for i in want if want[i] == i}
