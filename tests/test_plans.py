import threading

import pytest

from lodestream.functions import types, units
from lodestream.functions.scalars import canonical
from lodestream.plans import expr
from lodestream.plans import workflow as wf

CONTEXT = {"gate": {"melt": {"steady": True, "drift": 0.004}}, "cycles": 7, "stage": "anneal", "none_left": 0, "note": "", "parent": None}
TRUE = [
    "${gate.melt.steady}", "${cycles} == 7", "${gate.melt.drift} < 0.01 and ${stage} == anneal", "not ${none_left}", "not ${note} and not ${parent}",
    "${stage} == 'anneal' or ${absent}", "(${cycles} < 2 or ${cycles} >= 7) and true", "not ${cycles} == false", "${cycles} != 'x'", "${parent} == null",
]
FALSE = ["${none_left}", "${cycles} == 'anneal'", "not ${stage}", "false or ${note}", "${cycles} < 7", "${stage} and ${none_left}", "true == 1"]


@pytest.mark.parametrize("text", TRUE)
def test_conditions_that_hold(text):
    assert expr.holds(text, expr.from_mapping(CONTEXT))


@pytest.mark.parametrize("text", FALSE)
def test_conditions_that_do_not(text):
    assert not expr.holds(text, expr.from_mapping(CONTEXT))


@pytest.mark.parametrize("text", ["", "${absent}", "${cycles} < 'a'", "1 2", "${cycles} = 7", "(true", "true and", "1.2.3 == 1", "a ! b"])
def test_conditions_that_are_errors(text):
    with pytest.raises(expr.ExprError):
        expr.holds(text, expr.from_mapping(CONTEXT))


def test_references_and_substitution():
    assert expr.references({"a": ["${x.y} and ${z}", 3], "b": "none"}) == ["x.y", "z"]
    assert expr.whole(" ${a.b} ") == "a.b" and expr.whole("${a} ${b}") is None
    look = expr.from_mapping({"t": {"value": 300, "unit": "K"}, "n": 3, "s": "text"})
    assert expr.substitute({"a": "${t}", "b": "at ${t}, ${n} ${s}"}, look) == {"a": {"value": 300, "unit": "K"}, "b": "at 300 K, 3 text"}


def test_columns_agree_with_the_driver(spark):
    rows = [(1.0, "a", True), (0.0, "", False), (None, None, None), (5.0, "npt", True)]
    df = spark.createDataFrame(rows, "n double, name string, ok boolean")
    schema = {f.name: f.dataType.simpleString() for f in df.schema}
    for text in ["${n}", "${name}", "not ${ok}", "${n} > 0.5 and ${name} == npt", "${n} == 5 or ${name} == ''", "${name} != 'a'", "${ok} == true", "${n} == 'a'", "${n} == null"]:
        got = [r[0] for r in df.select(expr.to_column(text, schema).alias("c")).collect()]
        want = [expr.holds(text, expr.from_mapping(dict(zip(("n", "name", "ok"), r)))) if not (r[0] is None and "${n} >" in text) else False for r in rows]
        assert got == want, text
    with pytest.raises(expr.ExprError):
        expr.to_column("${missing}", schema)


def test_subtyping_is_the_closure_of_the_tree(spark):
    up = {(r.have, r.want): r.depth for r in types.closure(spark).collect()}
    names = types.all_types()
    assert len(set(names)) == len(names) and names[0] == types.ROOT
    for have in names:
        for want in names:
            assert types.is_subtype(have, want) == (have == want or (have, want) in up)
        family = types.family_of(have)
        assert family == "Root" if have == types.ROOT else (family, types.ROOT) in up and up[family, types.ROOT] == 1
    assert types.is_subtype("unheard of", "unheard of") and not types.is_subtype("unheard of", types.ROOT)


@pytest.mark.parametrize("dimension", sorted(units.UNITS))
def test_every_unit_in_both_forms(dimension):
    for n, (unit, factor) in enumerate(units.UNITS[dimension].items()):
        value = 2.5 + n
        want = {"value": pytest.approx(value * factor), "unit": units.canonical_unit(dimension)}
        assert units.parse(dimension, f"{value} {unit}") == want == units.parse(dimension, {"value": value, "unit": unit})
        assert units.parse(dimension, f"  {value}{unit} ") == want
    for bad in (7, "7", "7 parsec", "2e6 " + units.canonical_unit(dimension), {"value": True, "unit": unit}, {"value": 7}, None):
        with pytest.raises(units.SchemaError):
            units.parse(dimension, bad)


def test_canonical_json():
    assert canonical({"b": 1, "a": 300.0}) == canonical({"a": 300, "b": 1}) == '{"a":300,"b":1}'
    assert canonical([{"z": 1.5, "a": [1e3]}]) == '[{"a":[1000],"z":1.5}]'


@pytest.fixture
def registry(monkeypatch):
    monkeypatch.setattr(wf, "REGISTRY", {})
    calls = []

    @wf.task("make", {}, {"series": "ThermodynamicSeries"}, {"temperature": {"type": "temperature", "default": "300 K"}, "fail": {"type": "integer", "default": 0}})
    def make(inputs, params):
        calls.append(("make", params["temperature"]["value"]))
        if params["fail"] and len([c for c in calls if c[0] == "make"]) <= params["fail"]:
            raise wf.TaskFailure("provider", "not this time")
        return {"series": {"data": {"mean": params["temperature"]["value"]}}}

    @wf.task("fit", {"members": {"type": "Dataset", "many": True}}, {"result": "TgResult"})
    def fit(inputs, params):
        calls.append(("fit", len(inputs["members"])))
        return {"result": {"data": {"value": sum(m["data"]["mean"] for m in inputs["members"])}}}

    @wf.task("judge", {"series": {"type": "ThermodynamicSeries"}}, {"report": "EquilibrationReport"}, {"limit": {"type": "number", "default": 1.0}}, validators=("sane",))
    def judge(inputs, params):
        calls.append(("judge", params["limit"]))
        m = inputs["series"]["data"]["mean"]
        return {"report": {"data": {"equilibrated": m < params["limit"], "mean": m}}, "validation": [{"name": "sane", "passed": m > 0}]}

    wf.contract("run_npt", {"state": {"type": "State"}}, {"state": "SimulationState"}, {"pressure": {"type": "pressure", "required": True}})
    return calls


def sweep(temps="${params.temps}"):
    return {
        "name": "sweep",
        "params": {"temps": {"type": "string_list", "default": ["300 K", "350 K"]}},
        "steps": {
            "run": {"task": "make", "foreach": {"var": "t", "in": temps}, "params": {"temperature": "${t}"}},
            "fit": {"task": "fit", "inputs": {"members": "${run.series}"}},
        },
        "outputs": {"result": "${fit.result}", "all": "${run.series}"},
    }


def test_foreach_and_collect(registry):
    plan = wf.compile_workflow(sweep())
    assert [n.id for n in plan.nodes] == ["run__0", "run__1", "fit"]
    assert plan.nodes[2].deps == {"run__0", "run__1"}
    run = wf.Runner().execute(plan)
    assert run.status == "COMPLETED" and run.outputs["result"]["data"]["value"] == 650
    assert len(run.outputs["all"]) == 2


def test_a_single_member_is_a_list_too(registry):
    run = wf.Runner().execute(wf.compile_workflow(sweep(), {"temps": ["10 K"]}))
    assert run.outputs["result"]["data"]["value"] == 10


def test_second_run_is_cached_and_force_is_not(registry):
    plan, runner = wf.compile_workflow(sweep()), wf.Runner()
    first = runner.execute(plan)
    assert set(runner.execute(plan).steps.values()) == {"CACHED"}
    forced = runner.execute(plan, keep=first, force={"run__1"})
    assert forced.steps == {"run__0": "COMPLETED", "run__1": "COMPLETED", "fit": "COMPLETED"}
    assert [c for c in registry if c == ("make", 350.0)] == [("make", 350.0)] * 2


def test_gates_and_skips(registry):
    spec = {
        "name": "g",
        "steps": {
            "a": {"task": "make"},
            "check": {"task": "judge", "inputs": {"series": "${a.series}"}, "params": {"limit": 1000.0}},
            "more": {"task": "make", "when": "not ${check.report.equilibrated}"},
            "after": {"task": "judge", "inputs": {"series": "${more.series}"}},
            "same": {"task": "judge", "inputs": {"series": "${a.series}"}, "params": {"limit": "${check.report.mean}"}},
        },
    }
    run = wf.Runner().execute(wf.compile_workflow(spec))
    assert run.steps == {"a": "COMPLETED", "check": "COMPLETED", "more": "SKIPPED", "after": "SKIPPED", "same": "COMPLETED"}
    assert ("judge", 300.0) in registry and run.status == "COMPLETED"


def test_retries(registry):
    spec = lambda retry: {"name": "r", "steps": {"a": {"task": "make", "params": {"fail": 1}, **({"retry": retry} if retry is not None else {})}}}
    assert wf.Runner().execute(wf.compile_workflow(spec(None))).status == "FAILED"
    registry.clear()
    run = wf.Runner().execute(wf.compile_workflow(spec({})))
    assert run.status == "COMPLETED" and run.attempts == {"a": 2}
    registry.clear()
    assert wf.Runner().execute(wf.compile_workflow(spec({"on": ["input_error"]}))).status == "FAILED"


def test_failures_and_resume(registry):
    spec = {"name": "f", "steps": {"a": {"task": "make", "params": {"temperature": "-1 K"}}, "b": {"task": "judge", "inputs": {"series": "${a.series}"}}, "c": {"task": "make"}}}
    runner = wf.Runner()
    run = runner.execute(wf.compile_workflow(spec))
    assert run.steps == {"a": "COMPLETED", "b": "FAILED", "c": "COMPLETED"} and run.errors["b"].category == "scientific_validation"
    registry.clear()
    again = runner.execute(wf.compile_workflow(spec), keep=run)
    assert again.steps["a"] == "COMPLETED" and [c[0] for c in registry] == ["judge"]


def test_contracts_fail_when_run(registry):
    spec = {"name": "s", "inputs": {"state": {"type": "State"}}, "stages": [{"type": "npt", "id": "n", "state": "${inputs.state}", "pressure": "1 atm"}], "outputs": {"state": "${n.state}"}}
    plan = wf.compile_workflow(spec)
    assert plan.nodes[0].params["pressure"] == {"value": 1.01325, "unit": "bar"}
    run = wf.Runner().execute(plan, {"state": {"data": {}}})
    assert run.status == "FAILED" and "engine_missing" in str(run.errors["n"])


def test_subworkflows_are_inlined(registry):
    child = {"name": "c", "inputs": {"s": {"type": "ThermodynamicSeries"}}, "params": {"limit": {"type": "number", "default": 2.0}}, "steps": {"j": {"task": "judge", "inputs": {"series": "${inputs.s}"}, "params": {"limit": "${params.limit}"}}, "k": {"task": "make", "when": "not ${j.report.equilibrated}"}}, "outputs": {"report": "${j.report}"}}
    spec = {"name": "p", "steps": {"a": {"task": "make"}, "sub": {"workflow": "c", "inputs": {"s": "${a.series}"}, "params": {"limit": 400.0}}, "z": {"task": "make", "when": "${sub.report.equilibrated}"}}, "outputs": {"r": "${sub.report}"}}
    spec["steps"]["z"]["when"] = "${sub.j.report.equilibrated}"
    plan = wf.compile_workflow(spec, library={"c": child})
    assert [n.id for n in plan.nodes] == ["a", "sub.j", "sub.k", "z"]
    run = wf.Runner().execute(plan)
    assert run.steps == {"a": "COMPLETED", "sub.j": "COMPLETED", "sub.k": "SKIPPED", "z": "CACHED"} or run.steps["z"] == "COMPLETED"
    assert run.outputs["r"]["data"]["equilibrated"]


def test_compile_errors(registry):
    base = {"name": "e", "steps": {"a": {"task": "make"}}}
    bad = [
        {**base, "steps": {"a": {"task": "nope"}}},
        {**base, "steps": {"a": {"task": "make", "params": {"who": 1}}}},
        {**base, "steps": {"a": {"task": "make", "params": {"temperature": 300}}}},
        {**base, "steps": {"j": {"task": "judge"}}},
        {**base, "steps": {"a": {"task": "make"}, "f": {"task": "fit", "inputs": {"members": "${a.series}"}}}},
        {**base, "steps": {"a": {"task": "make"}, "j": {"task": "judge", "inputs": {"series": "x ${a.series}"}}}},
        {**base, "outputs": {"x": "${b.y}"}},
        {**base, "steps": {"a": {"task": "make", "after": ["zz"]}}},
        {**base, "steps": {"a": {"task": "make", "foreach": {"var": "i", "in": list(range(257))}}}},
    ]
    for spec in bad:
        with pytest.raises((wf.PlanError, units.SchemaError)):
            wf.compile_workflow(spec)
    with pytest.raises(wf.PlanError):
        wf.topological([wf.StepNode("x", "make", {}, {}, deps={"y"}), wf.StepNode("y", "make", {}, {}, deps={"x"})])


def test_unknown_and_missing_inputs(registry):
    plan = wf.compile_workflow({"name": "i", "inputs": {"s": {"type": "ThermodynamicSeries"}}, "steps": {"j": {"task": "judge", "inputs": {"series": "${inputs.s}"}}}})
    for given in ({}, {"s": 1, "t": 2}):
        with pytest.raises(wf.PlanError):
            wf.Runner().execute(plan, given)


def test_steps_run_side_by_side(registry):
    gate = threading.Barrier(2, timeout=10)

    @wf.task("meet", {}, {"o": "Result"})
    def meet(inputs, params):
        gate.wait()
        return {"o": {}}

    run = wf.Runner(max_concurrency=2).execute(wf.compile_workflow({"name": "m", "steps": {"a": {"task": "meet"}, "b": {"task": "meet", "after": []}}}))
    assert run.status == "COMPLETED"
