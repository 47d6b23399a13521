"""The artifact type tree, subtyping, and the closure as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each type's direct subtypes. The root is Artifact.
CHILDREN = {
    "Artifact": ["Spec", "System", "State", "Dataset", "Result"],
    "Spec": ["SystemSpec"],
    "System": ["MolecularSystem", "ParameterizedSystem", "SimulationSystem"],
    "State": ["SimulationState"],
    "SimulationState": ["EquilibratedState"],
    "Dataset": ["Trajectory", "SimulationLog", "ThermodynamicSeries", "StressStrainSeries"],
    "Trajectory": ["ProductionTrajectory"],
    "ThermodynamicSeries": ["TemperatureSeries"],
    "Result": ["DensityResult", "RDFResult", "RgResult", "ReeResult", "MSDResult", "DiffusionResult", "CTEResult", "TgResult", "AdhesionResult", "ModulusResult", "EquilibrationReport"],
}
ROOT = "Artifact"
PARENT = {c: p for p, cs in CHILDREN.items() for c in cs}


def is_known(t: str) -> bool:
    return t == ROOT or t in PARENT


def is_subtype(have: str, want: str) -> bool:
    """Every type is a subtype of itself, also an unknown one."""
    while have != want:
        if have not in PARENT:
            return False
        have = PARENT[have]
    return True


def family_of(t: str) -> str:
    for f in CHILDREN[ROOT]:
        if is_subtype(t, f):
            return f
    return "Root"


def all_types() -> list[str]:
    """Root first, then parents before their subtypes."""
    out = [ROOT]
    for t in out:
        out += CHILDREN.get(t, [])
    return out


VALUES = ", ".join(f"('{c}', '{p}')" for c, p in PARENT.items())
CLOSURE_SQL = f"""WITH RECURSIVE edge(child, parent) AS (SELECT * FROM (VALUES {VALUES}) AS v(child, parent)),
up(have, want, depth) AS (
  SELECT child, child, 0 FROM edge UNION ALL
  SELECT up.have, edge.parent, up.depth + 1 FROM up JOIN edge ON up.want = edge.child WHERE up.depth < 32)
SELECT have, want, depth FROM up"""


def closure(spark: SparkSession) -> DataFrame:
    """(have, want, depth) of every subtype pair but the root's own: a table of fixed size."""
    return spark.sql(CLOSURE_SQL)
