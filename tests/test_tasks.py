import pytest

from lodestream.plans import tasks
from lodestream.plans import workflow as wf
from lodestream.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(tasks.LIBRARY))
def test_every_workflow_compiles(name):
    spec = tasks.LIBRARY[name]
    params = {"temperature_sweep": {"temperatures": ["300 K", "350 K", "400 K"]}, "adhesion": {"interface_area": "5 nm2"}}.get(name)
    plan = wf.compile_workflow(spec, params)
    assert len(plan.nodes) == {"temperature_sweep": 4, "simple_equilibration": 5, "construct_system": 3, "diffusion": 2}.get(name, 1)


def test_density_and_gate(spark):
    frame = src.series(spark, SF).where("series = 'click'")
    if frame.isEmpty():
        frame = src.series(spark, SF).where("series = (select min(event_type) from parquet.`%s/events.parquet`)" % SF)
    runner = wf.Runner()
    art = {"frame": frame, "data": {}}
    run = runner.execute(wf.compile_workflow(tasks.LIBRARY["density"]), {"series": art})
    assert run.status == "COMPLETED", run.errors
    d = run.outputs["result"]["data"]
    assert d["n_samples"] + d["n_skipped"] == frame.count() and d["unit"] == "g/cm3"
    again = runner.execute(wf.compile_workflow(tasks.LIBRARY["density"]), {"series": art})
    assert set(again.steps.values()) == {"CACHED"}
    gate = {"name": "g", "inputs": {"series": {"type": "ThermodynamicSeries"}, "state": {"type": "State"}}, "steps": {"check": {"task": "check_polymer_equilibration", "inputs": {"series": "${inputs.series}"}, "params": {"drift_threshold": 1e-9}}, "promote": {"task": "promote_equilibrated_state", "inputs": {"state": "${inputs.state}", "report": "${check.report}"}}, "force": {"task": "promote_equilibrated_state", "inputs": {"state": "${inputs.state}", "report": "${check.report}"}, "params": {"require_pass": False}}}, "outputs": {"state": "${force.state}"}}
    run = runner.execute(wf.compile_workflow(gate), {"series": art, "state": {"data": {}, "metadata": {"a": 1}}})
    assert run.steps["promote"] == "FAILED" and run.errors["promote"].category == "scientific_validation"
    assert run.outputs["state"]["metadata"]["equilibration"]["forced"] is True


def test_diffusion_and_sweep(spark):
    art = {"frame": src.trajectory(spark, SF), "data": {"box": 1.0, "frame_interval_fs": 2.0}}
    spec = {"name": "d", "inputs": {"trajectory": {"type": "Trajectory"}}, "steps": {"msd": {"task": "compute_msd", "inputs": {"trajectory": "${inputs.trajectory}"}, "params": {"max_lag_fraction": 0.02}}, "fit": {"task": "fit_diffusion", "inputs": {"msd": "${msd.result}"}}}, "outputs": {"r": "${fit.result}"}}
    run = wf.Runner().execute(wf.compile_workflow(spec), {"trajectory": art})
    assert run.status == "COMPLETED", run.errors
    assert run.outputs["r"]["data"]["n"] >= 2
    sweep = src.sweep(spark, SF).selectExpr("'s' AS series", "temperature", "volume")
    run = wf.Runner().execute(wf.compile_workflow(tasks.LIBRARY["cte"], {"reference_temperature": "25 K"}), {"series": {"frame": sweep, "data": {}}})
    assert run.status == "COMPLETED" and run.outputs["result"]["data"]["reference"] == 25.0
