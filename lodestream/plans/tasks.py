"""The shipped tasks: analyses run, engine and construction tasks are contracts.

A task's inputs are artifacts {data, frame}: a frame for series and
trajectories, data for results. Results are collected to one small document per
series, which is what conditions read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, gate, series, traj
from .workflow import TaskFailure, contract, task

FRACTION = {"type": "number", "default": 0.5}
THERMO = {"series": {"type": "ThermodynamicSeries"}}
TRAJECTORY = {"trajectory": {"type": "Trajectory"}}


#: Rows of a result that is kept as a document; larger ones are tables, and asking for a document is an error.
MOST_ROWS = 1_000_000


def document(df, key: str | None = None) -> dict:
    """The row of a result as data: one series, or all rows by key."""
    rows = [r.asDict(recursive=True) for r in df.limit(2 if key is None else MOST_ROWS + 1).collect()]
    if key is not None:
        if len(rows) > MOST_ROWS:
            raise TaskFailure("schema", f"a document holds at most {MOST_ROWS} rows")
        return {"rows": rows}
    if len(rows) != 1:
        raise TaskFailure("schema", f"expected one series, found {len(rows)}")
    return rows[0]


@task("compute_density", THERMO, {"result": "DensityResult"}, {"equilibration_fraction": FRACTION})
def compute_density(inputs, params):
    return {"result": {"data": document(series.density(inputs["series"]["frame"], params["equilibration_fraction"])) | {"unit": "g/cm3"}}}


@task("compute_rdf", TRAJECTORY, {"result": "RDFResult"}, {"types_a": {"type": "number_list"}, "types_b": {"type": "number_list"}, "rmax": {"type": "length", "default": "10 A"}, "nbins": {"type": "integer", "default": 200}})
def compute_rdf(inputs, params):
    t = inputs["trajectory"]
    g = traj.radial_distribution(t["frame"], t["data"]["box"], params["rmax"]["value"], params["nbins"], params.get("types_a"), params.get("types_b"))
    return {"result": {"data": document(g.orderBy("bin"), "bin")}}


@task("compute_rg", TRAJECTORY, {"result": "RgResult"}, {"equilibration_fraction": FRACTION})
def compute_rg(inputs, params):
    return {"result": {"data": document(traj.radius_of_gyration(inputs["trajectory"]["frame"], params["equilibration_fraction"]))}}


@task("compute_ree", TRAJECTORY, {"result": "ReeResult"}, {"equilibration_fraction": FRACTION})
def compute_ree(inputs, params):
    t = inputs["trajectory"]
    return {"result": {"data": document(traj.end_to_end_distance(t["frame"], t["data"]["box"], params["equilibration_fraction"]))}}


@task("compute_msd", TRAJECTORY, {"result": "MSDResult"}, {"max_lag_fraction": FRACTION, "com_by_molecule": {"type": "boolean", "default": False}})
def compute_msd(inputs, params):
    t = inputs["trajectory"]
    lags = max(1, int(t["frame"].select("frame").distinct().count() * params["max_lag_fraction"]))
    m = traj.displacement(t["frame"], lags, params["com_by_molecule"], t["data"].get("frame_interval_fs", 1.0))
    return {"result": {"data": {"n_lags": lags}, "frame": m.select(F.lit("msd").alias("series"), (F.col("lag") - 1).alias("pos"), F.col("lag_time").alias("t"), F.col("msd").alias("y"))}}


@task("fit_diffusion", {"msd": {"type": "MSDResult"}}, {"result": "DiffusionResult"}, {"fit_start": {"type": "number", "default": 0.2}, "fit_stop": {"type": "number", "default": 0.8}})
def fit_diffusion(inputs, params):
    return {"result": {"data": document(fits.diffusion(inputs["msd"]["frame"], params["fit_start"], params["fit_stop"]))}}


@task("collect_thermo_series", {"series": {"type": "ThermodynamicSeries", "many": True}}, {"result": "TemperatureSeries"}, {"equilibration_fraction": FRACTION})
def collect_thermo_series(inputs, params):
    frames = [s["frame"].withColumn("member", F.lit(i)) for i, s in enumerate(inputs["series"])]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    out = series.collect_thermo(union, params["equilibration_fraction"])
    return {"result": {"data": document(out, "member"), "frame": out.select(F.lit("sweep").alias("series"), F.col("temperature_K").alias("temperature"), F.col("volume_A3").alias("volume"))}}


SWEEP = {"series": {"type": "TemperatureSeries"}}


@task("fit_cte", SWEEP, {"result": "CTEResult"}, {"reference_temperature": {"type": "temperature"}, "min_points": {"type": "integer", "default": 3}})
def fit_cte(inputs, params):
    ref = params.get("reference_temperature", {}).get("value")
    return {"result": {"data": document(fits.expansion(inputs["series"]["frame"], ref, params["min_points"]))}}


@task("fit_tg", SWEEP, {"result": "TgResult"}, {"min_points_per_branch": {"type": "integer", "default": 3}})
def fit_tg(inputs, params):
    rows = fits.transition(inputs["series"]["frame"], params["min_points_per_branch"]).limit(2).collect()
    if len(rows) != 1:
        raise TaskFailure("scientific_validation", "no split of the sweep crosses within it")
    return {"result": {"data": rows[0].asDict()}}


@task("fit_modulus", {"series": {"type": "StressStrainSeries"}}, {"result": "ModulusResult"}, {"max_strain": {"type": "number", "default": 0.05}})
def fit_modulus(inputs, params):
    return {"result": {"data": document(fits.modulus(inputs["series"]["frame"], params["max_strain"]))}}


@task("compute_adhesion", THERMO, {"result": "AdhesionResult"}, {"interface_area": {"type": "area", "required": True}, "equilibration_fraction": FRACTION})
def compute_adhesion(inputs, params):
    return {"result": {"data": document(fits.adhesion(inputs["series"]["frame"], params["interface_area"]["value"], params["equilibration_fraction"]))}}


@task("check_polymer_equilibration", THERMO | {"trajectory": {"type": "Trajectory", "required": False}}, {"report": "EquilibrationReport"}, {"drift_threshold": {"type": "number", "default": 0.01}, "sigma": {"type": "number", "default": 3.0}, "tail_fraction": FRACTION})
def check_polymer_equilibration(inputs, params):
    s = inputs["series"]["frame"]
    rg = None
    if inputs.get("trajectory"):
        per = traj.gyration(series.frames_tail(inputs["trajectory"]["frame"], 1 - params["tail_fraction"]).drop("frame_rank"))
        rg = per.groupBy("frame").agg(F.avg("rg").alias("rg")).crossJoin(s.select("series").distinct().limit(1))  # one name
    return {"report": {"data": document(gate.report(s, params["tail_fraction"], params["drift_threshold"], params["sigma"], rg))}}


@task("promote_equilibrated_state", {"state": {"type": "State"}, "report": {"type": "EquilibrationReport"}}, {"state": "EquilibratedState"}, {"require_pass": {"type": "boolean", "default": True}})
def promote_equilibrated_state(inputs, params):
    """The only way to an EquilibratedState; a forced one keeps its flag."""
    ok = bool(inputs["report"]["data"]["equilibrated"])
    if params["require_pass"] and not ok:
        raise TaskFailure("scientific_validation", "the state has not passed its report")
    meta = dict(inputs["state"].get("metadata", {})) | {"equilibration": inputs["report"]["data"] | {"forced": not ok}}
    return {"state": {**inputs["state"], "metadata": meta}}


_RUN = {"temperature": {"type": "temperature", "default": "300 K"}, "duration": {"type": "time", "default": "1 ns"}, "timestep": {"type": "time", "default": "1 fs"}}
_STATE = {"state": {"type": "State", "required": False}, "system": {"type": "System", "required": False}}
_MD = {"state": "SimulationState", "trajectory": "Trajectory", "log": "SimulationLog", "series": "ThermodynamicSeries"}
contract("energy_minimize", _STATE, {"state": "SimulationState", "log": "SimulationLog"}, {"etol": {"type": "number", "default": 1e-4}, "ftol": {"type": "number", "default": 1e-6}, "maxiter": {"type": "integer", "default": 10000}, "relax_duration": {"type": "time"}})
contract("run_nvt", _STATE, _MD, _RUN)
contract("run_npt", _STATE, _MD, _RUN | {"pressure": {"type": "pressure", "default": "1 atm"}})
contract("run_nve", _STATE, _MD, {k: v for k, v in _RUN.items() if k != "temperature"})
contract("run_soft_pushoff", _STATE, {k: v for k, v in _MD.items() if k != "trajectory"}, {"duration": {"type": "time", "default": "10 ps"}})
contract("run_deform", _STATE, {"state": "SimulationState", "series": "StressStrainSeries", "log": "SimulationLog"}, {"strain_rate": {"type": "number", "default": 1e-6}, "max_strain": {"type": "number", "default": 0.1}})
contract("build_system", {"spec": {"type": "SystemSpec"}}, {"system": "MolecularSystem"}, {"seed": {"type": "integer", "default": 1}})
contract("parameterize_system", {"system": {"type": "MolecularSystem"}}, {"system": "ParameterizedSystem"}, {"force_field": {"type": "string"}, "charge_method": {"type": "string"}})
contract("prepare_simulation_system", {"system": {"type": "ParameterizedSystem"}}, {"system": "SimulationSystem"}, {"target_density": {"type": "density"}})

#: Property workflows: one or two analyses each, and a sweep's fan-in.
LIBRARY = {
    "density": {"name": "density", "inputs": {"series": {"type": "ThermodynamicSeries"}}, "params": {"equilibration_fraction": FRACTION}, "steps": {"density": {"task": "compute_density", "inputs": {"series": "${inputs.series}"}, "params": {"equilibration_fraction": "${params.equilibration_fraction}"}}}, "outputs": {"result": "${density.result}"}},
    "rdf": {"name": "rdf", "inputs": {"trajectory": {"type": "Trajectory"}}, "params": {"types_a": {"type": "number_list"}, "types_b": {"type": "number_list"}}, "steps": {"rdf": {"task": "compute_rdf", "inputs": {"trajectory": "${inputs.trajectory}"}, "params": {"types_a": "${params.types_a}", "types_b": "${params.types_b}"}}}, "outputs": {"result": "${rdf.result}"}},
    "cte": {"name": "cte", "inputs": {"series": {"type": "TemperatureSeries"}}, "params": {"reference_temperature": {"type": "temperature"}}, "steps": {"cte": {"task": "fit_cte", "inputs": {"series": "${inputs.series}"}, "params": {"reference_temperature": "${params.reference_temperature}"}}}, "outputs": {"result": "${cte.result}"}},
    "tg": {"name": "tg", "inputs": {"series": {"type": "TemperatureSeries"}}, "steps": {"tg": {"task": "fit_tg", "inputs": {"series": "${inputs.series}"}}}, "outputs": {"result": "${tg.result}"}},
    "adhesion": {"name": "adhesion", "inputs": {"series": {"type": "ThermodynamicSeries"}}, "params": {"interface_area": {"type": "area", "required": True}}, "steps": {"adhesion": {"task": "compute_adhesion", "inputs": {"series": "${inputs.series}"}, "params": {"interface_area": "${params.interface_area}"}}}, "outputs": {"result": "${adhesion.result}"}},
    "mechanical_properties": {"name": "mechanical_properties", "inputs": {"series": {"type": "StressStrainSeries"}}, "steps": {"modulus": {"task": "fit_modulus", "inputs": {"series": "${inputs.series}"}}}, "outputs": {"result": "${modulus.result}"}},
    "diffusion": {"name": "diffusion", "inputs": {"trajectory": {"type": "Trajectory"}}, "steps": {"msd": {"task": "compute_msd", "inputs": {"trajectory": "${inputs.trajectory}"}}, "fit": {"task": "fit_diffusion", "inputs": {"msd": "${msd.result}"}}}, "outputs": {"result": "${fit.result}", "msd": "${msd.result}"}},
    "temperature_sweep": {"name": "temperature_sweep", "inputs": {"state": {"type": "State"}}, "params": {"temperatures": {"type": "string_list", "required": True}}, "steps": {"run": {"task": "run_npt", "foreach": {"var": "t", "in": "${params.temperatures}"}, "inputs": {"state": "${inputs.state}"}, "params": {"temperature": "${t}"}}, "collect": {"task": "collect_thermo_series", "inputs": {"series": "${run.series}"}}}, "outputs": {"series": "${collect.result}"}},
    "construct_system": {"name": "construct_system", "inputs": {"spec": {"type": "SystemSpec"}}, "params": {"force_field": {"type": "string"}, "target_density": {"type": "density"}}, "steps": {"build": {"task": "build_system", "inputs": {"spec": "${inputs.spec}"}}, "parameterize": {"task": "parameterize_system", "inputs": {"system": "${build.system}"}, "params": {"force_field": "${params.force_field}"}}, "prepare": {"task": "prepare_simulation_system", "inputs": {"system": "${parameterize.system}"}, "params": {"target_density": "${params.target_density}"}}}, "outputs": {"system": "${prepare.system}"}},
    "simple_equilibration": {"name": "simple_equilibration", "inputs": {"system": {"type": "SimulationSystem"}}, "stages": [{"type": "minimize", "id": "minimize"}, {"type": "nvt", "id": "nvt"}, {"type": "npt", "id": "npt", "pressure": "1 atm"}], "steps": {"check": {"task": "check_polymer_equilibration", "inputs": {"series": "${npt.series}"}}, "promote": {"task": "promote_equilibrated_state", "inputs": {"state": "${npt.state}", "report": "${check.report}"}}}, "outputs": {"state": "${promote.state}", "report": "${check.report}"}},
    "npt_thermodynamic_production": {"name": "npt_thermodynamic_production", "inputs": {"state": {"type": "EquilibratedState"}}, "stages": [{"type": "npt", "id": "run", "state": "${inputs.state}", "pressure": "1 atm"}], "outputs": {"series": "${run.series}", "state": "${run.state}"}},
    "dynamics_production": {"name": "dynamics_production", "inputs": {"state": {"type": "EquilibratedState"}}, "stages": [{"type": "nve", "id": "run", "state": "${inputs.state}"}], "outputs": {"trajectory": "${run.trajectory}"}},
    "mechanical_deformation": {"name": "mechanical_deformation", "inputs": {"state": {"type": "State"}}, "steps": {"run": {"task": "run_deform", "inputs": {"state": "${inputs.state}"}}}, "outputs": {"series": "${run.series}"}},
}
