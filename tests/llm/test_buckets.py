import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import buckets, jaccard, simhash
from lodestream.llm.common import materialize


def test_exploded_rows_are_not_broadcast(spark):
    # a small table on disk, whose index keys are 35 times as many rows as the optimizer takes them for
    fps = np.random.default_rng(7).integers(-(2**63), 2**63 - 1, 3000)
    classes = materialize(spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps)], "rep long, fp long"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    keyed = classes.select("rep", "fp", F.explode(F.array(*[F.lit(i) + F.col("rep") % 1500 for i in range(35)])).alias("key"))
    for plan in (simhash.links(classes), buckets.cells(keyed, "rep", 64)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Broadcast" not in text


def test_prefixes_of_the_pipeline_are_not_broadcast(spark):
    some = [(i, 100, i * 7919, [0] * 8, [i % 50 * 1000 + j for j in range(21)]) for i in range(500)]
    kept = materialize(spark.createDataFrame(some, "k long, n long, fp long, map array<long>, prefix array<long>"))
    rows = kept.select(F.posexplode("prefix").alias("p", "key"), "k", "n", "fp")
    text = jaccard.met_somewhere(rows, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
    assert jaccard.met_somewhere(rows, 4096).count() == 500 * 12  # later places are too late for sets of 100
