"""Every registered query of the engine's own operators, with its SQL oracle."""

from __future__ import annotations

import importlib

#: Modules with QUERIES {name: (spark, sf_dir) -> DataFrame} and ORACLES {name: sql}.
MODULES = ("lodestream.operators.series", "lodestream.operators.fits", "lodestream.operators.traj", "lodestream.operators.gate", "lodestream.operators.extract", "lodestream.functions.scalars", "lodestream.operators.provenance", "lodestream.plans.columns")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(m).QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in importlib.import_module(m).ORACLES.items()}
