"""Ordered-series operators: positional tails, means with errors, thermodynamic fan-in.

Every operator takes a long frame (series, pos, ...) and works on all series at
once: a sweep member or a run is a partition key, not a plan of its own.
Rounding to positions is half-to-even; a missing estimate is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as src


class InputInvalid(ValueError):
    """A frame lacks a column an operator needs."""


def need(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise InputInvalid(f"missing columns {missing}; there are {df.columns}")
    return df


def sized(df: DataFrame, key: str = "series") -> DataFrame:
    """df with n, the rows of each series: counted by a grouped join-free window without order."""
    return need(df, key, "pos").withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key)))


def drop_count(n: Column, keep_fraction: float) -> Column:
    """Leading rows that a tail leaves out: max(1, rint(n * (1 - keep_fraction)))."""
    return F.greatest(F.lit(1.0), F.rint(n * F.lit(1 - keep_fraction))).cast("bigint")


def tail(df: DataFrame, keep_fraction: float = 0.5, key: str = "series") -> DataFrame:
    """The last rows of each series. At least one row is always left out."""
    return sized(df, key).withColumn("n_skipped", drop_count(F.col("n"), keep_fraction)).where("pos >= n_skipped")


def frame_start(n: Column, fraction: float) -> Column:
    """First frame kept: min(n - 1, max(0, rint(n * fraction)))."""
    return F.least(n - 1, F.greatest(F.lit(0), F.rint(n * F.lit(fraction)).cast("bigint")))


def frames_tail(df: DataFrame, fraction: float = 0.5, frame: str = "frame") -> DataFrame:
    """Rows of the frames from frame_start on; frames count by rank, so gaps don't matter.

    The distinct frames are few against the rows; they are ranked in one task
    and joined back by equality.
    """
    frames = need(df, frame).select(frame).distinct()
    ranked = frames.withColumn("_rank", F.row_number().over(W.orderBy(frame)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    return df.join(ranked.where(F.col("_rank") >= frame_start(F.col("_n"), fraction)).select(frame, F.col("_rank").alias("frame_rank")), frame)


def sem(y: Column) -> Column:
    """Sample deviation over the root of max(1, n - 1); NULL for one row."""
    return F.stddev_samp(y) / F.sqrt(F.greatest(F.lit(1), F.count(y) - 1))


def mean_sem(df: DataFrame, key: str = "series", value: str = "y") -> DataFrame:
    return need(df, key, value).groupBy(key).agg(F.avg(value).alias("mean"), sem(F.col(value)).alias("sem"), F.count(value).alias("n"))


def correlated_sem(df: DataFrame, key: str = "series", value: str = "y") -> DataFrame:
    """Standard error with the lag-1 autocorrelation taken into account.

    rho is clamped to +-0.95 (0 where it is undefined) and thins n to
    max(2, n (1 - rho) / (1 + rho)); under 8 rows it is the plain error.
    """
    w = W.partitionBy(key).orderBy("pos")
    pairs = need(df, key, "pos", value).withColumn("_before", F.lag(value).over(w))
    y, b = F.col(value), F.col("_before")
    both = b.isNotNull()
    out = pairs.groupBy(key).agg(
        F.avg(y).alias("mean"),
        F.count(y).alias("n"),
        F.stddev_samp(y).alias("sd"),
        sem(y).alias("plain"),
        F.corr(F.when(both, y), b).alias("_rho"),
    )
    rho = F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.coalesce(F.nanvl("_rho", F.lit(0.0)), F.lit(0.0))))
    thin = F.greatest(F.lit(2.0), F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho")))
    return (
        out.withColumn("rho", rho)
        .withColumn("n_eff", thin)
        .withColumn("sem", F.when(F.col("n") < 8, F.col("plain")).otherwise(F.col("sd") / F.sqrt("n_eff")))
        .select(key, "mean", "n", "rho", "n_eff", "sem")
    )


def density(df: DataFrame, keep_fraction: float = 0.5) -> DataFrame:
    """Mean and error of the tail of y; `std` is the standard error, under its stored name."""
    t = tail(df, keep_fraction)
    return t.groupBy("series").agg(F.avg("y").alias("value"), sem(F.col("y")).alias("std"), F.count("y").alias("n_samples"), F.first("n_skipped").alias("n_skipped"))


def half_tail_shift(df: DataFrame) -> DataFrame:
    """Mean of the later half of each series against the whole."""
    return sized(df).groupBy("series").agg(F.avg("y").alias("mean"), F.avg(F.when(F.col("pos") >= F.floor(F.col("n") / 2), F.col("y"))).alias("late"))


def collect_thermo(df: DataFrame, keep_fraction: float = 0.5) -> DataFrame:
    """Members (member, pos, temperature, set_temperature, volume, density, energy) to one row each, by temperature.

    The temperature is the member's set one, or the mean over all rows where
    that is NULL.
    """
    s = sized(df, "member").withColumn("_in", F.col("pos") >= drop_count(F.col("n"), keep_fraction))
    late = lambda c: F.avg(F.when(F.col("_in"), F.col(c)))
    return (
        s.groupBy("member")
        .agg(
            F.coalesce(F.first("set_temperature", ignorenulls=True), F.avg("temperature")).alias("temperature_K"),
            late("volume").alias("volume_A3"),
            late("density").alias("density_g_cm3"),
            late("energy").alias("energy_kcal_mol"),
        )
        .orderBy("temperature_K", "member")
    )


def members(spark, sf_dir: str) -> DataFrame:
    e = src.read(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("member"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.col("value").alias("temperature"),
        F.when(F.col("user_id") % 2 == 0, 200.0 + F.col("user_id")).alias("set_temperature"),
        F.col("value").alias("volume"),
        (F.col("value") / 100).alias("density"),
        (F.col("value") * -2).alias("energy"),
    )


THERMO_COLUMNS = {"value": "density_g_cm3", "user_id": "temp_K"}


def thermo_rename(df: DataFrame, names: dict[str, str], step: str, dt_fs: float) -> DataFrame:
    """Keeps and renames known columns and turns steps into time."""
    kept = {a: b for a, b in names.items() if a in df.columns}
    return df.select((F.col(step) * F.lit(dt_fs)).alias("time_fs"), *[F.col(a).cast("double").alias(b) for a, b in kept.items()])


def payload(df: DataFrame, value: str, **fields: Column) -> DataFrame:
    """One JSON document per row."""
    return df.select(value, F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("data"))


def r6(c):
    return F.round(c, 6)


QUERIES = {
    "scan_series": lambda s, d: need(src.series(s, d), "series", "t", "y").groupBy("series").agg(F.count("y").alias("n"), r6(F.max("t")).alias("t_last"), r6(F.sum("y")).alias("total")),
    "series_tail": lambda s, d: tail(src.series(s, d), 0.3).groupBy("series").agg(F.min("pos").cast("bigint").alias("first_pos"), F.count("y").alias("n_kept"), r6(F.avg("y")).alias("mean")),
    "mean_sem": lambda s, d: mean_sem(src.series(s, d)).select("series", r6("mean").alias("mean"), r6("sem").alias("sem"), "n"),
    "correlated_sem": lambda s, d: correlated_sem(src.series(s, d)).select("series", r6("mean").alias("mean"), "n", r6("rho").alias("rho"), F.round("n_eff", 3).alias("n_eff"), r6("sem").alias("sem")),
    "compute_density": lambda s, d: density(src.series(s, d)).select("series", r6("value").alias("value"), r6("std").alias("std"), "n_samples", "n_skipped"),
    "frame_tail": lambda s, d: frames_tail(src.trajectory(s, d), 0.4).agg(F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("frame").alias("n_frames")),
    "half_tail": lambda s, d: half_tail_shift(src.series(s, d)).select("series", r6("mean").alias("mean"), r6("late").alias("late")),
    "collect_thermo": lambda s, d: collect_thermo(members(s, d)).select("member", r6("temperature_K").alias("temperature_K"), r6("volume_A3").alias("volume_A3"), r6("density_g_cm3").alias("density_g_cm3"), r6("energy_kcal_mol").alias("energy_kcal_mol")),
    "thermo_rename": lambda s, d: thermo_rename(src.read(s, d, "events"), THERMO_COLUMNS, "event_id", 2.0),
    "result_payload": lambda s, d: payload(density(src.series(s, d)), "series", n_samples=F.col("n_samples"), n_skipped=F.col("n_skipped"), unit=F.lit("g/cm3")),
}

_TAIL = "greatest(1, round_even(n * (1 - {f}), 0))"
_SEM = "stddev_samp(y) / sqrt(greatest(1, count(y) - 1))"
ORACLES = {
    "scan_series": f"WITH {src.SERIES_SQL} SELECT series, count(y) AS n, round(max(t), 6) AS t_last, round(sum(y), 6) AS total FROM series GROUP BY series",
    "series_tail": f"WITH {src.SERIES_SQL} SELECT series, min(pos) AS first_pos, count(y) AS n_kept, round(avg(y), 6) AS mean FROM sized WHERE pos >= {_TAIL.format(f=0.3)} GROUP BY series",
    "mean_sem": f"WITH {src.SERIES_SQL} SELECT series, round(avg(y), 6) AS mean, round({_SEM}, 6) AS sem, count(y) AS n FROM series GROUP BY series",
    "correlated_sem": f"""WITH {src.SERIES_SQL}, p AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY pos) AS b FROM series),
        a AS (SELECT series, avg(y) AS mean, count(y) AS n, stddev_samp(y) AS sd, {_SEM} AS plain, greatest(-0.95, least(0.95, coalesce(corr(y, b) FILTER (b IS NOT NULL), 0))) AS rho FROM p GROUP BY series),
        e AS (SELECT *, greatest(2, n * (1 - rho) / (1 + rho)) AS n_eff FROM a)
        SELECT series, round(mean, 6) AS mean, n, round(rho, 6) AS rho, round(n_eff, 3) AS n_eff, round(CASE WHEN n < 8 THEN plain ELSE sd / sqrt(n_eff) END, 6) AS sem FROM e""",
    "compute_density": f"WITH {src.SERIES_SQL} SELECT series, round(avg(y), 6) AS value, round({_SEM}, 6) AS std, count(y) AS n_samples, cast(any_value({_TAIL.format(f=0.5)}) AS BIGINT) AS n_skipped FROM sized WHERE pos >= {_TAIL.format(f=0.5)} GROUP BY series",
    "frame_tail": f"WITH {src.TRAJ_SQL}, r AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM traj)) SELECT min(frame) AS first_frame, count(*) AS n_rows, count(DISTINCT frame) AS n_frames FROM traj JOIN r USING (frame) WHERE k >= least(n - 1, greatest(0, round_even(n * 0.4, 0)))",
    "half_tail": f"WITH {src.SERIES_SQL} SELECT series, round(avg(y), 6) AS mean, round(avg(y) FILTER (pos >= n // 2), 6) AS late FROM sized GROUP BY series",
    "collect_thermo": """WITH m AS (SELECT user_id AS member, value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        k AS (SELECT *, pos >= greatest(1, round_even(n * 0.5, 0)) AS late FROM m)
        SELECT member, round(CASE WHEN member % 2 = 0 THEN 200.0 + member ELSE avg(value) END, 6) AS temperature_K, round(avg(value) FILTER (late), 6) AS volume_A3, round(avg(value / 100) FILTER (late), 6) AS density_g_cm3, round(avg(value * -2) FILTER (late), 6) AS energy_kcal_mol FROM k GROUP BY member""",
    "thermo_rename": "SELECT event_id * 2.0::DOUBLE AS time_fs, value AS density_g_cm3, cast(user_id AS DOUBLE) AS temp_K FROM events",
    "result_payload": f"""WITH {src.SERIES_SQL} SELECT series, '{{"n_samples":' || count(y) || ',"n_skipped":' || cast(any_value({_TAIL.format(f=0.5)}) AS BIGINT) || ',"unit":"g/cm3"}}' AS data FROM sized WHERE pos >= {_TAIL.format(f=0.5)} GROUP BY series""",
}
