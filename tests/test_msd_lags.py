import pytest

from lodestream import catalogue
from lodestream.operators import traj
from lodestream.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["msd_all_lags", "msd_all_lags_by_molecule"])
def test_every_lag_of_half_the_frames(spark, monkeypatch, name):
    beads = src.trajectory(spark, SF).where("frame < 60").select("frame", "mol", "bead", "type", "mass", *traj.AXES).collect()
    small = spark.createDataFrame(beads)
    monkeypatch.setattr(src, "trajectory", lambda s, d: small)
    at = {}
    for r in beads:
        key = (r.frame, r.mol if "molecule" in name else r.bead)
        m, x = at.get(key, (0.0, (0.0, 0.0, 0.0)))
        at[key] = (m + r.mass, tuple(a + r.mass * r[c] for a, c in zip(x, traj.AXES)))
    at = {k: [a / m for a in x] for k, (m, x) in at.items()}
    frames = sorted({f for f, _ in at})
    assert len(frames) > 42
    got = {r.lag: (r.msd, r.n) for r in catalogue.queries()[name](spark, SF).collect()}
    assert sorted(got) == list(range(1, len(frames) // 2 + 1))
    for lag, (msd, n) in got.items():
        d = [sum((a - b) ** 2 for a, b in zip(at[g, p], x)) for f, g in zip(frames, frames[lag:]) for (h, p), x in at.items() if h == f and (g, p) in at]
        assert n == len(d) and msd == pytest.approx(sum(d) / n, abs=1e-8)
