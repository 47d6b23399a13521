import math

import numpy as np
import pytest

from lodestream import catalogue
from lodestream.operators import traj


def rows_of(frames=90, particles=3, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for f in sorted(r.choice(1000, frames, replace=False).tolist()):
        for b in range(particles):
            if r.random() < 0.9:  # frames without a bead, and beads twice in a frame
                out += [(f, b // 2, b, 1, 1.0 + b, *(1e3 + r.normal(0, 1, 3)).tolist()) for _ in range(1 + (r.random() < 0.1))]
    return out


SCHEMA = "frame long, mol int, bead int, type int, mass double, x double, y double, z double"


@pytest.mark.parametrize("by_molecule", [False, True])
@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_blocks_give_what_pairs_give(spark, by_molecule, block):
    rows = rows_of()
    rows[5] = (*rows[5][:5], None, 1.0, 2.0)
    rows[20] = (*rows[20][:5], 1.0, None, None)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.lag: r for r in traj.displacement(df, 45, by_molecule).collect()}
    got = {r.lag: r for r in traj.lagged_displacement(df, 45, by_molecule, block=block).collect()}
    assert sorted(got) == sorted(want)
    for lag, w in want.items():
        assert got[lag].n == w.n and got[lag].lag_time == w.lag_time and got[lag].msd == pytest.approx(w.msd, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_what_is_not_finite_stays_in_its_lags(spark, bad):
    rows = [(f, 0, 0, 1, 1.0, float(f), 0.0, 0.0) for f in range(12)]
    rows[1] = (*rows[1][:5], bad, 0.0, 0.0)
    rows[9] = (*rows[9][:5], 0.0, bad, 0.0)
    rows[10] = (*rows[10][:5], bad, 0.0, 0.0)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.lag: r.msd for r in traj.displacement(df, 11).collect()}
    got = {r.lag: r.msd for r in traj.lagged_displacement(df, 11, block=4).collect()}
    assert sorted(got) == sorted(want) and any(math.isfinite(x) for x in want.values()) == any(math.isfinite(x) for x in got.values())
    for lag in want:
        assert got[lag] == pytest.approx(want[lag], abs=1e-9, nan_ok=True)


def test_only_nulls_have_no_mean(spark):
    df = spark.createDataFrame([(f, 0, 0, 1, 1.0, None, 0.0, 0.0) for f in range(4)], SCHEMA)
    assert [(r.lag, r.msd, r.n) for r in traj.lagged_displacement(df, 2).orderBy("lag").collect()] == [(1, None, 3), (2, None, 2)]
    assert traj.lagged_displacement(df.limit(0), 1).count() == 0


def test_no_row_for_each_pair_of_frames(spark):
    plan = catalogue.queries()["msd_all_lags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "sequence(1, " not in plan
