"""Least-squares fits over grouped frames.

Slopes come from centred sums: x is shifted by its group's mean before the
regression aggregates, so a large offset (times in femtoseconds) loses no
digits. A fit that can't be made is NULL or, where an input is unusable, an
error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as src
from .series import drop_count, r6, sem, sized


def line(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys..., slope, intercept, n) of y on x."""
    w = W.partitionBy(*keys)
    centred = df.withColumn("_mx", F.avg(x).over(w)).withColumn("_x", F.col(x) - F.col("_mx"))
    return (
        centred.groupBy(*keys)
        .agg(F.regr_slope(F.col(y), F.col("_x")).alias("slope"), F.avg(y).alias("_my"), F.first("_mx").alias("_mx"), F.count(F.lit(1)).alias("n"))
        .select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "n")
    )


def index_window(df: DataFrame, start: float, stop: float, key: str = "series") -> DataFrame:
    """Rows [int(n * start), max(int(n * stop), int(n * start) + 2)) of each series."""
    first = F.floor(F.col("n") * start)
    return sized(df, key).where((F.col("pos") >= first) & (F.col("pos") < F.greatest(F.floor(F.col("n") * stop), first + 2)))


def diffusion(df: DataFrame, start: float = 0.2, stop: float = 0.8) -> DataFrame:
    """Slope of y on t over an index window, / 6, in units of 1e-1; the window's bounds are clamped to the rows there are."""
    w = index_window(df, start, stop)
    ends = w.groupBy("series").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    return line(w, "t", "y", "series").join(ends, "series").select("series", (F.col("slope") / 6 * 0.1).alias("value"), "slope", "t_first", "t_last", "n")


def nearest(df: DataFrame, x: str, at: Column, k: int, *keys: str) -> DataFrame:
    """The k rows of each group closest to `at`; ties go to the smaller x."""
    w = W.partitionBy(*keys).orderBy(F.abs(F.col(x) - at), F.col(x))
    return df.withColumn("_near", F.row_number().over(w)).where(F.col("_near") <= k).drop("_near")


def expansion(df: DataFrame, reference: float | None = None, min_points: int = 3) -> DataFrame:
    """Thermal expansion: (series, temperature, volume) -> slope / fitted volume at the reference temperature (the median if not given)."""
    w = W.partitionBy("series")
    ref = F.lit(float(reference)) if reference is not None else F.median("temperature").over(w)
    near = nearest(df.withColumn("reference", ref), "temperature", F.col("reference"), max(min_points, 3), "series")
    fit = line(near, "temperature", "volume", "series", "reference")
    v = F.col("slope") * F.col("reference") + F.col("intercept")
    return fit.select("series", "reference", "slope", v.alias("volume"), F.try_divide(F.col("slope"), v).alias("value"), "n")


def transition(df: DataFrame, min_points: int = 3) -> DataFrame:
    """Glass transition: the split of a sweep into two lines of least squared error.

    Every split i with min_points on both sides is fitted by running sums in
    one pass over the sorted sweep; the lines must cross within the sweep, and
    of equal errors the first split wins.
    """
    by = W.partitionBy("series").orderBy("temperature")
    left = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    right = by.rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy("series")
    x, y = F.col("_x"), F.col("_y")
    centred = (
        df.withColumn("_mx", F.avg("temperature").over(whole))
        .withColumn("_my", F.avg("volume").over(whole))
        .withColumn("_x", F.col("temperature") - F.col("_mx"))
        .withColumn("_y", F.col("volume") - F.col("_my"))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("t_first", F.min("temperature").over(whole))
        .withColumn("t_last", F.max("temperature").over(whole))
        .withColumn("i", F.row_number().over(by))
    )
    for name, w in (("1", left), ("2", right)):
        centred = (
            centred.withColumn("s" + name, F.regr_slope(y, x).over(w))
            .withColumn("b" + name, F.regr_intercept(y, x).over(w))
            .withColumn("e" + name, F.regr_syy(y, x).over(w) - F.regr_slope(y, x).over(w) * F.regr_sxy(y, x).over(w))
        )
    gap = F.col("s2") - F.col("s1")
    cross = (
        centred.where((F.col("i") >= min_points) & (F.col("i") <= F.col("n") - min_points) & (F.abs(gap) >= 1e-12))
        .withColumn("value", (F.col("b1") - F.col("b2")) / gap + F.col("_mx"))
        .withColumn("sse", F.greatest(F.lit(0.0), F.col("e1")) + F.greatest(F.lit(0.0), F.col("e2")))
        .where("value between t_first and t_last")
    )
    best = F.min_by(F.struct("value", "s1", "s2", "i", "sse"), F.struct("sse", "i"))
    return cross.groupBy("series").agg(best.alias("b")).select("series", "b.value", F.col("b.s1").alias("slope_below"), F.col("b.s2").alias("slope_above"), F.col("b.i").alias("split_index"), F.col("b.sse").alias("sse"))


def modulus(df: DataFrame, max_strain: float = 0.05, min_points: int = 3) -> DataFrame:
    """Slope of stress on strain over 0 < strain <= max_strain; too few points is an error."""
    used = df.where((F.col("strain") > 0) & (F.col("strain") <= max_strain))
    fit = line(used, "strain", "stress", "series")
    enough = F.when(F.col("n") >= min_points, F.col("slope")).otherwise(F.raise_error(F.lit("too few points for a modulus")).cast("double"))
    return fit.select("series", enough.alias("value"), F.col("n").alias("n_points"), F.col("intercept"))


#: kcal/mol per square angstrom to mJ per square metre
ADHESION = 0.69477 * 1000


def adhesion_column(columns: list[str]) -> str:
    """The first column that names an interaction energy."""
    for c in columns:
        if "interaction" in c.lower() or "eint" in c.lower():
            return c
    raise ValueError(f"no interaction energy among {columns}")


def adhesion(df: DataFrame, area: float, keep_fraction: float = 0.5) -> DataFrame:
    """Work of adhesion from the tail of an interaction energy."""
    e = adhesion_column(df.columns)
    t = sized(df).where(F.col("pos") >= drop_count(F.col("n"), keep_fraction))
    return t.groupBy("series").agg((-F.avg(e) / area * ADHESION).alias("value"), F.avg(e).alias("energy"), sem(F.col(e)).alias("sem"))


def one(df: DataFrame) -> DataFrame:
    return df.withColumn("series", F.lit("all"))


QUERIES = {
    "linfit": lambda s, d: line(src.series(s, d), "t", "y", "series").select("series", F.round("slope", 12).alias("slope"), r6("intercept").alias("intercept"), "n"),
    "fit_diffusion": lambda s, d: diffusion(src.series(s, d)).select("series", F.round("value", 12).alias("value"), r6("t_first").alias("t_first"), r6("t_last").alias("t_last"), "n"),
    "fit_cte": lambda s, d: expansion(one(src.sweep(s, d)), min_points=10).select("series", "reference", r6("slope").alias("slope"), r6("volume").alias("volume"), F.round("value", 9).alias("value"), "n"),
    "fit_tg": lambda s, d: transition(one(src.sweep(s, d))).select("series", F.round("value", 5).alias("value"), F.round("slope_below", 6).alias("slope_below"), F.round("slope_above", 6).alias("slope_above"), F.col("split_index").cast("bigint").alias("split_index")),
    "fit_modulus": lambda s, d: modulus(src.stress(s, d)).select("series", F.round("value", 5).alias("value"), "n_points", F.round("intercept", 6).alias("intercept")),
    "adhesion": lambda s, d: adhesion(src.series(s, d).withColumnRenamed("y", "e_interaction"), 250.0).select("series", F.round("value", 5).alias("value"), r6("energy").alias("energy"), r6("sem").alias("sem")),
}

_LINE = "regr_slope(y, x - mx)"
ORACLES = {
    "linfit": f"WITH {src.SERIES_SQL}, c AS (SELECT *, avg(t) OVER (PARTITION BY series) AS mx FROM series), f AS (SELECT series, regr_slope(y, t - mx) AS slope, avg(y) AS my, any_value(mx) AS mx, count(*) AS n FROM c GROUP BY series) SELECT series, round(slope, 12) AS slope, round(my - slope * mx, 6) AS intercept, n FROM f",
    "fit_diffusion": f"WITH {src.SERIES_SQL}, w AS (SELECT * FROM sized WHERE pos >= floor(n * 0.2) AND pos < greatest(floor(n * 0.8), floor(n * 0.2) + 2)), c AS (SELECT *, avg(t) OVER (PARTITION BY series) AS mx FROM w) SELECT series, round(regr_slope(y, t - mx) / 6 * 0.1, 12) AS value, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last, count(*) AS n FROM c GROUP BY series",
    "fit_cte": f"""WITH {src.SWEEP_SQL}, r AS (SELECT *, median(temperature) OVER () AS reference FROM sweep), k AS (SELECT *, row_number() OVER (ORDER BY abs(temperature - reference), temperature) AS near FROM r),
        c AS (SELECT *, avg(temperature) OVER () AS mx FROM k WHERE near <= 10), f AS (SELECT any_value(reference) AS reference, regr_slope(volume, temperature - mx) AS slope, avg(volume) AS my, any_value(mx) AS mx, count(*) AS n FROM c)
        SELECT 'all' AS series, reference, round(slope, 6) AS slope, round(slope * reference + my - slope * mx, 6) AS volume, round(slope / (slope * reference + my - slope * mx), 9) AS value, n FROM f""",
    "fit_tg": f"""WITH {src.SWEEP_SQL}, c AS (SELECT *, temperature - avg(temperature) OVER () AS x, volume - avg(volume) OVER () AS y, avg(temperature) OVER () AS mx, count(*) OVER () AS n, min(temperature) OVER () AS t0, max(temperature) OVER () AS t1, row_number() OVER (ORDER BY temperature) AS i FROM sweep),
        f AS (SELECT *, regr_slope(y, x) OVER l AS s1, regr_intercept(y, x) OVER l AS b1, regr_syy(y, x) OVER l - regr_slope(y, x) OVER l * regr_sxy(y, x) OVER l AS e1, regr_slope(y, x) OVER r AS s2, regr_intercept(y, x) OVER r AS b2, regr_syy(y, x) OVER r - regr_slope(y, x) OVER r * regr_sxy(y, x) OVER r AS e2
          FROM c WINDOW l AS (ORDER BY temperature ROWS UNBOUNDED PRECEDING), r AS (ORDER BY temperature ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        g AS (SELECT *, (b1 - b2) / (s2 - s1) + mx AS value, greatest(0, e1) + greatest(0, e2) AS sse FROM f WHERE i >= 3 AND i <= n - 3 AND abs(s2 - s1) >= 1e-12)
        SELECT 'all' AS series, round(value, 5) AS value, round(s1, 6) AS slope_below, round(s2, 6) AS slope_above, i AS split_index FROM g WHERE value BETWEEN t0 AND t1 ORDER BY sse, i LIMIT 1""",
    "fit_modulus": f"WITH {src.STRESS_SQL}, c AS (SELECT *, avg(strain) OVER (PARTITION BY series) AS mx FROM stress WHERE strain > 0 AND strain <= 0.05), f AS (SELECT series, regr_slope(stress, strain - mx) AS slope, avg(stress) AS my, any_value(mx) AS mx, count(*) AS n FROM c GROUP BY series) SELECT series, round(slope, 5) AS value, n AS n_points, round(my - slope * mx, 6) AS intercept FROM f",
    "adhesion": f"WITH {src.SERIES_SQL} SELECT series, round(-avg(y) / 250.0 * 694.77, 5) AS value, round(avg(y), 6) AS energy, round(stddev_samp(y) / sqrt(greatest(1, count(y) - 1)), 6) AS sem FROM sized WHERE pos >= greatest(1, round_even(n * 0.5, 0)) GROUP BY series",
}
