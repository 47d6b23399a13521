"""Conditions and parameters over tables: the compiled forms as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables as src
from . import expr


def where(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition on df's columns holds."""
    return df.where(as_column(df, condition))


def as_column(df: DataFrame, condition: str) -> Column:
    return expr.to_column(condition, {f.name: f.dataType.simpleString() for f in df.schema})


def canonical_number(c: Column) -> Column:
    """Text of a number parameter: NULL where it is none."""
    return c.try_cast("double")


def canonical_integer(c: Column) -> Column:
    """Only whole-number literals: 300.0 is refused."""
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))


def canonical_boolean(c: Column) -> Column:
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))


def bind(given: Column, default: Column, required: Column) -> Column:
    """struct(value, missing): what is given, else the default; missing if it is required and there is neither."""
    v = F.coalesce(given, default)
    return F.struct(v.alias("value"), (v.isNull() & required).alias("missing"))


def part(s, d):
    return src.read(s, d, "part").withColumn("odd", F.col("p_size") % 2 == 1).withColumn("maybe", F.when(F.col("p_size") % 3 == 0, F.col("p_size")))


RAW = "CASE p_size % 5 WHEN 0 THEN cast(p_size AS {s}) WHEN 1 THEN p_size || '.0' WHEN 2 THEN 'true' WHEN 3 THEN p_name ELSE NULL END"

QUERIES = {
    "cond_bool": lambda s, d: where(part(s, d), "(${odd} and ${p_size} > 10) or not ${p_brand}").select("p_partkey"),
    "cond_cmp": lambda s, d: part(s, d).select("p_partkey", as_column(part(s, d), "${p_size} >= 25.5").alias("a"), as_column(part(s, d), "${p_type} == ECONOMY").alias("b"), as_column(part(s, d), "${p_size} != 'x'").alias("c"), as_column(part(s, d), "${maybe} == null").alias("d")),
    "cond_truthy": lambda s, d: part(s, d).select("p_partkey", as_column(part(s, d), "${maybe}").alias("a"), as_column(part(s, d), "not ${odd}").alias("b"), as_column(part(s, d), "${p_name} and ${p_size}").alias("c")),
    "param_canon": lambda s, d: src.read(s, d, "part").withColumn("raw", F.expr(RAW.format(s="STRING"))).select("p_partkey", canonical_number(F.col("raw")).alias("number"), canonical_integer(F.col("raw")).alias("whole"), canonical_boolean(F.col("raw")).alias("flag")),
    "param_bind": lambda s, d: part(s, d).select("p_partkey", bind(F.col("maybe"), F.when(F.col("p_size") % 5 == 0, F.lit(7)), F.col("odd")).alias("x")).select("p_partkey", "x.value", "x.missing"),
}
ORACLES = {
    "cond_bool": "SELECT p_partkey FROM part WHERE (p_size % 2 = 1 AND p_size > 10) OR p_brand = ''",
    "cond_cmp": "SELECT p_partkey, p_size >= 25.5 AS a, p_type = 'ECONOMY' AS b, true AS c, p_size % 3 <> 0 AS d FROM part",
    "cond_truthy": "SELECT p_partkey, p_size % 3 = 0 AND p_size <> 0 AS a, p_size % 2 = 0 AS b, p_name <> '' AND p_size <> 0 AS c FROM part",
    "param_canon": f"WITH r AS (SELECT p_partkey, {RAW.format(s='VARCHAR')} AS raw FROM part) SELECT p_partkey, try_cast(CASE WHEN raw <> 'true' THEN raw END AS DOUBLE) AS number, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN try_cast(raw AS BIGINT) END AS whole, CASE raw WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM r",
    "param_bind": "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 5 = 0 THEN 7 END) AS value, p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 2 = 1 AS missing FROM part",
}
