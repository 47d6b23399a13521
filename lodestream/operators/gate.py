"""The equilibration gate: drift and stationarity of a tail, and promotion of what passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as src
from .series import correlated_sem, drop_count, r6, sized


class ScientificValidation(RuntimeError):
    """A result is well formed and not good enough."""


def report(df: DataFrame, tail_fraction: float = 0.5, drift_limit: float = 0.01, sigma: float = 3.0, rg: DataFrame | None = None) -> DataFrame:
    """(series, metrics, checks, equilibrated) of (series, pos, t, y).

    The tail keeps 1 - tail_fraction. Drift is the tail's slope times its span
    over its mean (infinite for a mean of 0; negative means pass, as they do in
    the definition). Stationarity holds the tail's later half against the whole
    in correlated errors. rg (series, frame, rg), if given, adds a check of its
    slope; a series without it, or with no more than 3 frames, has none.
    """
    t = sized(df).where(F.col("pos") >= drop_count(F.col("n"), 1 - tail_fraction)).drop("n")
    w = W.partitionBy("series").orderBy("pos")
    t = sized(t.withColumn("pos", F.row_number().over(w) - 1)).withColumn("_t", F.col("t") - F.avg("t").over(W.partitionBy("series")))
    err = correlated_sem(t.select("series", "pos", "y")).select("series", "sem")
    a = t.groupBy("series").agg(
        F.avg("y").alias("mean"),
        F.regr_slope("y", "_t").alias("slope"),
        (F.max("t") - F.min("t")).alias("span"),
        F.avg(F.when(F.col("pos") >= F.floor(F.col("n") / 2), F.col("y"))).alias("late"),
        F.count("y").alias("n_tail"),
    )
    a = a.join(err, "series").withColumn("drift", F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.abs("slope") * F.col("span") / F.col("mean")))
    a = a.withColumn("shift", F.abs(F.col("late") - F.col("mean")))
    checks = [
        F.coalesce(F.col("drift") < drift_limit, F.lit(False)).alias("density_drift"),
        F.coalesce(F.col("shift") < sigma * F.greatest(F.col("sem"), F.lit(1e-12)), F.lit(False)).alias("density_stationarity"),
    ]
    if rg is not None:
        r = rg.withColumn("_i", (F.row_number().over(W.partitionBy("series").orderBy("frame")) - 1).cast("double"))
        g = r.groupBy("series").agg(F.when(F.count("rg") > 3, F.abs(F.regr_slope("rg", "_i")) * F.count("rg") / F.avg("rg")).alias("rg_drift"))
        a = a.join(g, "series", "left")
        checks.append((F.col("rg_drift") < 10 * drift_limit).alias("rg_stable"))
    out = a.select("series", F.struct(*[c for c in ("mean", "drift", "shift", "sem", "n_tail", "rg_drift") if c in a.columns]).alias("metrics"), F.struct(*checks).alias("checks"))
    names = ["density_drift", "density_stationarity"] + ["rg_stable"] * (rg is not None)
    return out.withColumn("equilibrated", F.forall(F.array(*[F.coalesce(F.col(f"checks.{n}"), F.lit(True)) for n in names]), lambda x: x))


def promote(states: DataFrame, reports: DataFrame, require_pass: bool = True) -> DataFrame:
    """States (series, ...) that may be used as equilibrated, with `forced`; a failing one is an error if a pass is required."""
    met = states.join(reports.select("series", "equilibrated"), "series")
    if require_pass:
        ok = F.when(F.col("equilibrated"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not equilibrated: "), F.col("series"))).cast("boolean"))
        return met.withColumn("forced", ok).drop("equilibrated")
    return met.withColumn("forced", ~F.col("equilibrated")).drop("equilibrated")


def flat(s, d):
    return report(src.series(s, d), drift_limit=0.5).select("series", r6("metrics.mean").alias("mean"), r6("metrics.drift").alias("drift"), r6("metrics.shift").alias("shift"), r6("metrics.sem").alias("sem"), "checks.density_drift", "checks.density_stationarity", "equilibrated")


QUERIES = {
    "gate_report": flat,
    "promote": lambda s, d: promote(src.series(s, d).groupBy("series").agg(F.count("y").alias("n_rows")), report(src.series(s, d), drift_limit=0.5), require_pass=False),
}
_GATE = f"""WITH {src.SERIES_SQL}, a AS (SELECT * FROM sized WHERE pos >= greatest(1, round_even(n * 0.5, 0))), t AS (SELECT series, t, y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY series) AS m, t - avg(t) OVER (PARTITION BY series) AS c, lag(y) OVER w AS b FROM a WINDOW w AS (PARTITION BY series ORDER BY pos)),
  g AS (SELECT series, avg(y) AS mean, abs(regr_slope(y, c)) * (max(t) - min(t)) / avg(y) AS drift, abs(avg(y) FILTER (k >= m // 2) - avg(y)) AS shift, count(*) AS n, stddev_samp(y) AS sd, greatest(-0.95, least(0.95, coalesce(corr(y, b) FILTER (b IS NOT NULL), 0))) AS rho FROM t GROUP BY series),
  e AS (SELECT *, CASE WHEN n < 8 THEN sd / sqrt(greatest(1, n - 1)) ELSE sd / sqrt(greatest(2, n * (1 - rho) / (1 + rho))) END AS sem FROM g),
  r AS (SELECT series, round(mean, 6) AS mean, round(drift, 6) AS drift, round(shift, 6) AS shift, round(sem, 6) AS sem, drift < 0.5 AS density_drift, shift < 3 * greatest(sem, 1e-12) AS density_stationarity, drift < 0.5 AND shift < 3 * greatest(sem, 1e-12) AS equilibrated FROM e)"""
ORACLES = {
    "gate_report": f"{_GATE} SELECT * FROM r",
    "promote": f"{_GATE} SELECT series, (SELECT count(*) FROM events WHERE event_type = series) AS n_rows, NOT equilibrated AS forced FROM r",
}
