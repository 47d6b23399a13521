from lodestream.operators import provenance
from lodestream.streaming import events as ev

SCHEMA = "run long, node string, seq long, status string"


def test_current_states_equal_the_batch_view(spark, tmp_path):
    rows = [(1, "a", 0, "PENDING"), (1, "a", 1, "RUNNING"), (1, "a", 2, "FAILED"), (1, "a", 3, "RUNNING"), (1, "a", 4, "COMPLETED"), (1, "b", 0, "PENDING"), (2, "a", 1, "RUNNING")]
    path = f"{tmp_path}/log"
    spark.createDataFrame(rows[3:], SCHEMA).coalesce(1).write.parquet(path)
    spark.createDataFrame(rows[:3], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    live = ev.stream(spark, path, SCHEMA, 1)
    batch = spark.read.schema(SCHEMA).parquet(path)
    got = ev.drain(ev.current_states(live, ["run", "node"], "seq"), "states").collect()
    want = provenance.current(batch, ["run", "node"], ["seq"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    tries = ev.drain(ev.attempts(live, ["run", "node"]), "tries").collect()
    assert sorted(map(tuple, tries)) == [(1, "a", 2), (2, "a", 1)]


def test_windows(spark, tmp_path):
    rows = [("x", "2024-01-01 00:00:10", 1.0), ("x", "2024-01-01 00:00:50", 3.0), ("x", "2024-01-01 00:01:10", 5.0)]
    spark.createDataFrame(rows, "k string, at string, v double").selectExpr("k", "cast(at AS timestamp) AS at", "v").write.parquet(f"{tmp_path}/w")
    live = ev.stream(spark, f"{tmp_path}/w", "k string, at timestamp, v double")
    got = ev.drain(ev.windowed_means(live, "at", "v", "k", "1 minute", "5 minutes"), "windows").collect()
    assert sorted((r.mean, r.n) for r in got) == [(2.0, 2), (5.0, 1)]
