"""Quantities: text or {value, unit} to the canonical unit of a dimension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted units per dimension and what they are in the canonical (first) one.
UNITS = {
    "temperature": {"K": 1.0},
    "pressure": {"bar": 1.0, "atm": 1.01325, "Pa": 1e-5, "kPa": 1e-4, "MPa": 10.0, "GPa": 1e4, "psi": 0.0689476},
    "time": {"fs": 1.0, "ps": 1e3, "ns": 1e6, "us": 1e9, "s": 1e15, "min": 60e15, "h": 3600e15},
    "length": {"angstrom": 1.0, "A": 1.0, "nm": 10.0},
    "density": {"g/cm3": 1.0, "g/ml": 1.0, "kg/m3": 1e-3},
    "energy": {"kcal/mol": 1.0, "kcal": 1.0, "kJ/mol": 0.2390057, "kJ": 0.2390057, "eV": 23.06055},
    "area": {"angstrom2": 1.0, "A2": 1.0, "nm2": 100.0, "m2": 1e20},
}
SPLIT = r"^\s*([^\p{L}/°]*)([\p{L}/°].*?)\s*$"


class SchemaError(ValueError):
    """A value does not have the declared form."""


def canonical_unit(dimension: str) -> str:
    return next(iter(UNITS[dimension]))


def parse(dimension: str, raw) -> dict:
    """{value, unit} in the canonical unit; a bare number is refused, and so is exponent notation, whose e starts the unit."""
    if isinstance(raw, dict):
        value, unit = raw.get("value"), raw.get("unit")
        if isinstance(value, bool) or not isinstance(value, int | float) or not isinstance(unit, str):
            raise SchemaError("a quantity needs a numeric value and a unit")
    elif isinstance(raw, str):
        at = next((i for i, c in enumerate(raw) if c.isalpha() or c in "/°"), None)
        if at is None:
            raise SchemaError(f"no unit in {raw!r}")
        try:
            value, unit = float(raw[:at].strip()), raw[at:].strip()
        except ValueError:
            raise SchemaError(f"no number in {raw!r}") from None
    else:
        raise SchemaError(f"{raw!r} is no {dimension}: a unit is required")
    if unit not in UNITS[dimension]:
        raise SchemaError(f"unknown unit {unit!r} for {dimension}; accepted: {', '.join(UNITS[dimension])}")
    return {"value": value * UNITS[dimension][unit], "unit": canonical_unit(dimension)}


def table(spark: SparkSession) -> DataFrame:
    """(dimension, unit, factor, canonical): a few dozen fixed rows."""
    return spark.createDataFrame([(d, u, f, canonical_unit(d)) for d, us in UNITS.items() for u, f in us.items()], "dimension string, unit string, factor double, canonical string")


def convert(df: DataFrame, dimension: Column, text: Column) -> DataFrame:
    """df with value and unit in canonical form; NULL where the text is no quantity of the dimension."""
    parts = df.withColumn("_number", F.regexp_extract(text, SPLIT, 1).try_cast("double")).withColumn("_unit", F.regexp_extract(text, SPLIT, 2)).withColumn("_dimension", dimension)
    known = F.broadcast(table(df.sparkSession).select(F.col("dimension").alias("_dimension"), F.col("unit").alias("_unit"), "factor", "canonical"))
    return parts.join(known, ["_dimension", "_unit"], "left").withColumn("value", F.col("_number") * F.col("factor")).withColumn("unit", F.when(F.col("value").isNotNull(), F.col("canonical"))).drop("_number", "_unit", "_dimension", "factor", "canonical")


def display(value: Column, unit: Column) -> Column:
    return F.format_string("%s %s", value, unit)


def is_native(text: str) -> bool:
    return bool(re.fullmatch(r"\d+|\d+([:-]\d+)+", text))
