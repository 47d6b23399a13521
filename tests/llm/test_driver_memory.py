import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import components as comp
from lodestream.llm import jaccard
from lodestream.llm.common import materialize, no_broadcasts

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def test_near_duplicates_builds_no_broadcast_on_the_driver(spark, monkeypatch):
    plans = []

    def seen(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *a, **b)

    monkeypatch.setattr(jaccard, "materialize", seen)
    monkeypatch.setattr(comp, "materialize", seen)
    before = spark.conf.get(THRESHOLD)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[: 30 + i % 3])) for i in range(6)] + [(9, "something else"), (10, None), (11, "")]
    out = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.doc_id for r in out.collect()) == [0, 9, 10]
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert spark.conf.get(THRESHOLD) == before


def test_thresholds_come_back_after_an_error(spark):
    before = spark.conf.get(THRESHOLD)
    with pytest.raises(ValueError), no_broadcasts(spark):
        assert spark.conf.get(THRESHOLD) == "-1"
        raise ValueError
    assert spark.conf.get(THRESHOLD) == before


def test_few_edges_need_no_rounds(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.randrange(300) - 150, r.randrange(300) - 150) for _ in range(160)] + [(5, 5), (None, 1), (2, None), (1 << 62, -(1 << 62))] + [(i, i + 1) for i in range(1000, 1100)]
    edges = spark.createDataFrame(rows, "a long, b long")
    calls = []
    monkeypatch.setattr(comp, "materialize", lambda df, *a: calls.append(1) or materialize(df, *a))
    got = {x.node: x.component for x in comp.components(edges).collect()}
    assert len(calls) == 2
    monkeypatch.setattr(comp, "ALONE", 0)
    want = {x.node: x.component for x in comp.components(edges).collect()}
    assert len(calls) > 5 and got == want and got[1100] == 1000
    assert comp.components(edges.where(F.lit(False))).count() == 0
    named = edges.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
    assert comp.components(named).count() > 0
