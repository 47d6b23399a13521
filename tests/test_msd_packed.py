import math

import numpy as np
import pytest

from lodestream import catalogue
from lodestream.operators import traj

SCHEMA = "frame long, mol int, bead int, type int, mass double, x double, y double, z double"


def test_rows_are_packed_before_they_are_dealt_out(spark):
    plan = catalogue.queries()["msd_all_lags"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    dealt = plan[: plan.index("MapInArrow")]  # what the packed rows go through
    assert dealt.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "Window" not in plan
    rows = traj.packed(spark.range(10_000).selectExpr("id div 5 AS frame", "id % 5 AS particle", "0.5 AS x", "0.1 AS y", "1e300 AS z").selectExpr("frame", "particle", "double(x) x", "double(y) y", "double(z) z").coalesce(1), [0])
    assert rows.count() == 5


def test_packed_rows_come_back(spark):
    r = np.random.default_rng(1)
    frames = np.sort(r.choice(1 << 40, 500, replace=False)) - (1 << 39)
    value = [0.5, 0.1, -1e300, math.nan, math.inf, None]
    rows = [(int(f), int(r.integers(3)), *(value[i] for i in r.integers(0, 6, 3))) for f in frames]
    df = spark.createDataFrame(rows, "frame long, particle int, x double, y double, z double")
    got = []
    for part in traj.packed(df, [int(frames[0]), int(frames[200])]).groupBy("particle", "b").agg({"particle": "count"}).collect():
        held = traj.packed(df, [int(frames[0]), int(frames[200])]).where(f"particle = {part.particle} and b = {part.b}").toArrow()
        f, at, ok = traj.unpacked(held)
        assert all((x >= frames[200]) == (part.b == 1) for x in f)
        got += [(int(x), part.particle, *(repr(float(c[n])) for c in at)) if ok[n] else (int(x), part.particle, None) for n, x in enumerate(f)]
    want = [(f, p, *(repr(c) for c in at)) if None not in at else (f, p, None) for f, p, *at in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [100, 1 << 22])
@pytest.mark.parametrize("step", [1, 3])
def test_many_lags_travel_in_several_rows(spark, block, step):
    x = np.random.default_rng(2).normal(0, 1, (400, 3)).cumsum(axis=0)
    df = spark.createDataFrame([(7 + step * f, 0, 0, 1, 1.0, *v) for f, v in enumerate(x.tolist())], SCHEMA)
    got = {r.lag: (r.msd, r.n) for r in traj.lagged_displacement(df, 250, block=block, part=64).collect()}
    assert sorted(got) == list(range(1, 251))
    for lag, (msd, n) in got.items():
        assert n == 400 - lag and msd == pytest.approx(((x[lag:] - x[:-lag]) ** 2).sum(axis=1).mean(), rel=1e-9)


def test_lengths_for_fft():
    assert [traj.smooth(n) for n in (1, 7, 11, 13, 1025, 5923071)] == [1, 8, 12, 15, 1080, 5971968]
