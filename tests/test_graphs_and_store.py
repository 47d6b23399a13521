import pytest

from lodestream.operators import provenance as pv
from lodestream.plans import workflow as wf
from lodestream.sources.store import RunStore, frame_digest


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_a_long_chain_is_walked_to_its_end(spark):
    chain = edges(spark, [(f"n{i + 1:02}", f"n{i:02}") for i in range(39)])
    start = spark.createDataFrame([("n00",)], "node string")
    assert pv.downstream(chain, start).count() == 40
    assert {r.node: r.level for r in pv.levels(chain).collect()} == {f"n{i:02}": i for i in range(40)}
    steps = spark.createDataFrame([(f"n{i:02}", "FAILED" if i == 3 else "SKIPPED" if i == 36 else "COMPLETED") for i in range(40)], "node string, status string")
    got = {r.node: r.status for r in pv.propagate(steps, chain).collect()}
    assert [got[f"n{i:02}"] for i in (2, 3, 35, 36, 39)] == ["COMPLETED", "FAILED", "FAILED", "SKIPPED", "SKIPPED"]
    # lineage has a limit, by its definition
    up = pv.lineage(chain, spark.createDataFrame([("n39",)], "node string"))
    assert up.count() == 33 and up.agg({"depth": "max"}).first()[0] == 32


def test_many_ways_to_a_node_are_one_row(spark):
    pairs = []
    for k in range(12):
        pairs += [(f"a{k}", f"j{k}"), (f"b{k}", f"j{k}"), (f"j{k + 1}", f"a{k}"), (f"j{k + 1}", f"b{k}")]
    assert pv.downstream(edges(spark, pairs), spark.createDataFrame([("j0",)], "node string")).count() == 37


def test_a_cycle_is_an_error_for_levels_and_an_end_for_walks(spark):
    ring = edges(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")])
    with pytest.raises(ValueError):
        pv.levels(ring)
    assert pv.downstream(ring, spark.createDataFrame([("a",)], "node string")).count() == 4


@pytest.fixture
def doubled(monkeypatch):
    monkeypatch.setattr(wf, "REGISTRY", dict(wf.REGISTRY))
    calls = []

    @wf.task("double", {"x": {"type": "ThermodynamicSeries"}}, {"y": "ThermodynamicSeries"}, {})
    def double(inputs, params):
        calls.append(1)
        out = {"data": {"value": 2 * inputs["x"]["data"]["value"]}}
        if "frame" in inputs["x"]:
            out["frame"] = inputs["x"]["frame"].selectExpr("2 * v AS v")
        return {"y": out}

    spec = {"name": "w", "inputs": {"x": {"type": "ThermodynamicSeries"}}, "steps": {"a": {"task": "double", "inputs": {"x": "${inputs.x}"}}, "b": {"task": "double", "inputs": {"x": "${a.y}"}}}, "outputs": {"y": "${b.y}"}}
    return wf.compile_workflow(spec), calls


def test_other_contents_under_one_name_are_other_inputs(doubled):
    plan, _ = doubled
    runner = wf.Runner()
    for v in (1, 100):
        run = runner.execute(plan, {"x": {"data": {"value": v}}})
        assert set(run.steps.values()) == {"COMPLETED"} and run.outputs["y"]["data"]["value"] == 4 * v
    assert set(runner.execute(plan, {"x": {"data": {"value": 1}}}).steps.values()) == {"CACHED"}


def test_results_and_records_outlive_the_runner(spark, doubled, tmp_path):
    plan, calls = doubled
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "v long")
    first = wf.Runner(store=RunStore(spark, f"{tmp_path}/s")).execute(plan, {"x": {"data": {"value": 1}, "frame": frame([1, 2, 3])}})
    store = RunStore(spark, f"{tmp_path}/s")
    again = wf.Runner(store=store).execute(plan, {"x": {"data": {"value": 1}, "frame": frame([3, 2, 1])}})
    assert set(first.steps.values()) == {"COMPLETED"} and set(again.steps.values()) == {"CACHED"} and len(calls) == 2
    assert sorted(r.v for r in again.outputs["y"]["frame"].collect()) == [4, 8, 12] and again.outputs["y"]["data"] == {"value": 4}
    other = wf.Runner(store=store).execute(plan, {"x": {"data": {"value": 1}, "frame": frame([1, 2])}})
    assert set(other.steps.values()) == {"COMPLETED"}
    assert store.table("runs").count() == 3
    assert sorted((r.node, r.status) for r in store.table("steps").collect()) == sorted([("a", "COMPLETED"), ("b", "COMPLETED")] * 2 + [("a", "CACHED"), ("b", "CACHED")])
    assert {(r.child, r.parent) for r in store.table("edges").collect()} == {("b", "a")}
    status = {r.run: r.status for r in pv.run_status(store.table("steps")).collect()}
    assert set(status.values()) == {"COMPLETED"} and len(status) == 3


def test_frame_digests_follow_rows_not_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k long, t string")
    assert frame_digest(a) == frame_digest(a.repartition(3)) != frame_digest(a.distinct())
    assert frame_digest(a) != frame_digest(a.withColumnRenamed("t", "u"))
