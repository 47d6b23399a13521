"""Trajectory operators over long frames (frame, mol, bead, type, mass, x, y, z).

A frame is a partition key: nothing needs more than one frame's beads, or two
blocks of one bead's frames, in a task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as src
from .series import frames_tail, r6, sem

AXES = ("x", "y", "z")


def minimum_image(d: Column, box: float | Column) -> Column:
    """A difference taken to the nearest periodic image; halves round to even."""
    return d - box * F.rint(d / box)


def centre_of_mass(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(a) for a in AXES])


def gyration(df: DataFrame) -> DataFrame:
    """(frame, mol, rg): the mass-weighted radius about each chain's centre of mass."""
    w = W.partitionBy("frame", "mol")
    d2 = sum((F.col(a) - F.sum(F.col("mass") * F.col(a)).over(w) / F.sum("mass").over(w)) ** 2 for a in AXES)
    return df.withColumn("_d2", d2).groupBy("frame", "mol").agg(F.sqrt(F.sum(F.col("mass") * F.col("_d2")) / F.sum("mass")).alias("rg"))


def radius_of_gyration(df: DataFrame, fraction: float = 0.5) -> DataFrame:
    """One row: mean and error over all chains and late frames, and the drift from the first to the last of them."""
    per = gyration(frames_tail(df, fraction).drop("frame_rank"))
    frames = per.groupBy("frame").agg(F.avg("rg").alias("m"), F.count(F.lit(1)).alias("k"))
    drift = frames.agg((F.max_by("m", "frame") - F.min_by("m", "frame")).alias("drift"), F.count(F.lit(1)).alias("n_frames"), F.max("k").alias("n_chains"))
    return per.agg(F.avg("rg").alias("value"), sem(F.col("rg")).alias("std")).crossJoin(drift)  # one row each


def end_to_end(df: DataFrame, box: float) -> DataFrame:
    """(frame, mol, ree): distance along each unwrapped chain, as the sum of its nearest-image steps."""
    w = W.partitionBy("frame", "mol").orderBy("bead")
    steps = df.select("frame", "mol", *[minimum_image(F.col(a) - F.lag(a).over(w), F.lit(box)).alias(a) for a in AXES])
    sums = steps.groupBy("frame", "mol").agg(*[F.coalesce(F.sum(a), F.lit(0.0)).alias(a) for a in AXES])
    return sums.select("frame", "mol", F.sqrt(sum(F.col(a) ** 2 for a in AXES)).alias("ree"))


def end_to_end_distance(df: DataFrame, box: float, fraction: float = 0.5) -> DataFrame:
    per = end_to_end(frames_tail(df, fraction).drop("frame_rank"), box)
    return per.agg(F.avg("ree").alias("value"), sem(F.col("ree")).alias("std"), F.count(F.lit(1)).alias("n_samples"), F.countDistinct("mol").alias("n_chains"))


def displacement(df: DataFrame, max_lag: int, by_molecule: bool = False, frame_interval: float = 1.0) -> DataFrame:
    """(lag, lag_time, msd, n): mean squared displacement over all origins and particles.

    Every position is sent to the origins it can be reached from: an equi-join on
    (particle, frame), whose size is rows times max_lag and whose keys are even.
    """
    p = centre_of_mass(df, "frame", "mol").withColumnRenamed("mol", "particle") if by_molecule else df.select("frame", F.col("bead").alias("particle"), *AXES)
    ranks = p.select("frame").distinct().withColumn("k", F.row_number().over(W.orderBy("frame")) - 1)
    p = p.join(ranks, "frame").select("k", "particle", *AXES)
    late = p.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).where("k >= lag")
    late = late.select((F.col("k") - F.col("lag")).alias("k"), "lag", "particle", *[F.col(a).alias(a + "1") for a in AXES])
    d2 = sum((F.col(a + "1") - F.col(a)) ** 2 for a in AXES)
    return late.join(p, ["k", "particle"]).groupBy("lag").agg(F.avg(d2).alias("msd"), F.count(F.lit(1)).alias("n")).withColumn("lag_time", F.col("lag") * frame_interval)


def radial_pairs(df: DataFrame, box: float, r_max: float, types_a=None, types_b=None) -> DataFrame:
    """(frame, r) of ordered pairs a != b within r_max, nearest image.

    Beads are put into cells no smaller than r_max and meet only beads of their
    own and the neighbouring cells: an equi-join on (frame, cell).
    """
    n = max(1, int(box / r_max))
    cell = lambda a: F.pmod(F.floor(F.col(a) / F.lit(box / n)).cast("int"), F.lit(n))
    beads = df.select("frame", "bead", "type", *AXES, *[cell(a).alias("c" + a) for a in AXES])
    a = beads.where(F.col("type").isin(*types_a)) if types_a else beads
    b = beads.where(F.col("type").isin(*types_b)) if types_b else beads
    around = F.sequence(F.lit(-1), F.lit(1)) if n > 2 else F.sequence(F.lit(0), F.lit(n - 1))
    for ax in AXES:
        a = a.withColumn("_o", F.explode(around)).withColumn("c" + ax, F.pmod(F.col("c" + ax) + F.col("_o"), F.lit(n))).drop("_o")
    b = b.select("frame", F.col("bead").alias("bead_b"), *["c" + x for x in AXES], *[F.col(x).alias(x + "b") for x in AXES])
    r2 = sum(minimum_image(F.col(x + "b") - F.col(x), F.lit(box)) ** 2 for x in AXES)
    return a.join(b, ["frame", "cx", "cy", "cz"]).where("bead <> bead_b").select("frame", F.sqrt(r2).alias("r")).where(F.col("r") < r_max)


def radial_distribution(df: DataFrame, box: float, r_max: float, bins: int, types_a=None, types_b=None) -> DataFrame:
    """(bin, r, pairs, g_r): counts per shell over those of an ideal gas of the same density.

    r_max is held to box / 2.2. Pairs of a bead with itself are left out; bins
    without an ideal count are 0.
    """
    r_max = min(r_max, box / 2.2)
    dr = r_max / bins
    counts = radial_pairs(df, box, r_max, types_a, types_b).groupBy(F.least(F.floor(F.col("r") / dr), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))
    in_a = F.col("type").isin(*types_a) if types_a else F.lit(True)
    in_b = F.col("type").isin(*types_b) if types_b else F.lit(True)
    ideal = df.groupBy("frame").agg(F.sum(in_a.cast("long")).alias("na"), F.sum(in_b.cast("long")).alias("nb")).agg(F.sum(F.col("na") * F.col("nb")).alias("nn"))
    shell = 4 * math.pi / 3 * dr**3 * ((F.col("bin") + 1) ** 3 - F.col("bin") ** 3)
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    g = F.coalesce(F.try_divide(F.col("pairs").cast("double"), F.col("nn") * shell / (box**3)), F.lit(0.0))
    return grid.join(counts, "bin", "left").na.fill(0, ["pairs"]).crossJoin(ideal).select("bin", ((F.col("bin") + 0.5) * dr).alias("r"), "pairs", g.alias("g_r"))  # ideal is one row


def box_tilt(df: DataFrame) -> DataFrame:
    """(a, b, c, alpha, beta, gamma in degrees) -> lx, ly, lz, xy, xz, yz of the triclinic cell."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in ("alpha", "beta", "gamma"))
    lx = F.col("a")
    xy, xz = F.col("b") * cg, F.col("c") * cb
    ly = F.sqrt(F.col("b") ** 2 - xy**2)
    yz = (F.col("b") * F.col("c") * ca - xy * xz) / ly
    return df.withColumns({"lx": lx, "ly": ly, "lz": F.sqrt(F.col("c") ** 2 - xz**2 - yz**2), "xy": xy, "xz": xz, "yz": yz})


def cells_of(s, d):
    p = src.read(s, d, "part").where("p_size > 0")
    return p.select("p_partkey", (10.0 + F.col("p_size")).alias("a"), F.lit(12.0).alias("b"), F.lit(15.0).alias("c"), (80.0 + F.col("p_size") % 10).alias("alpha"), F.lit(85.0).alias("beta"), (75.0 + F.col("p_size") % 7).alias("gamma"))


def all_lags(df: DataFrame, fraction: float = 0.5) -> int:
    """The largest lag of the whole job, from the number of frames."""
    return max(1, int(df.select("frame").distinct().count() * fraction))


def smooth(n: int) -> int:
    """The smallest number of the form 2^a 3^b 5^c from n on: a length that FFT is quick at."""
    odd = [3**b * 5**c for b in range(20) for c in range(14)]
    return min(o << max(0, -(-n // o) - 1).bit_length() for o in odd)


def block_sums(k: np.ndarray, at, ok: np.ndarray, i: int, j: int, block: int, most: int):
    """(lags, sums, pairs, counted) of one particle, from positions of block i to those of block j; within a block, up to lag `most`.

    k: frame numbers, used up; at: positions (3 arrays of rows); ok: rows without a null. pairs
    has all rows, counted those without a null, sums their squared distances.
    Over a lag these are m2 * q1 + q2 * m1 - 2 * p1 * p2 of the rows, squares
    and positions of each frame, so all lags are correlations, by FFT. A block
    can be long: no more than three spectra are held at a time.
    """
    first = second = slice(None)
    if i != j:
        first, second = k // block == i, k // block == j
    finite = ok & np.logical_and.reduce([np.isfinite(c) for c in at])
    slots = np.remainder(k, block, out=k)
    width = int(slots.max()) + 1
    lags = np.arange(1, min(width, most + 1)) if i == j else np.arange(1 - width, width)
    size = smooth(width + len(lags) if i == j else 2 * width)  # what goes around the end meets no lag that is asked for
    held = max(1, np.count_nonzero(finite))

    def axis(c):
        c = c.astype(float)
        c[~finite] = 0.0
        c -= c.sum() / held  # the same for both blocks: distances stay, squares get small
        c[~finite] = 0.0
        return c

    def spectrum(rows, weight):
        return np.fft.rfft(np.bincount(slots[rows], weight[rows], width), size)

    def lagged(total):
        return np.fft.irfft(total, size)[lags]

    def both(a, b):
        out = spectrum(first, a)
        other = out.copy() if i == j and a is b else spectrum(second, b)
        np.conj(out, out=out)
        out *= other
        return out

    def number(total):
        return np.rint(lagged(total)).astype(np.int64)

    square = sum(axis(c) ** 2 for c in at)
    total = both(finite, square)
    total += both(square, finite)
    del square
    for c in at:
        c = axis(c)
        part = both(c, c)
        part *= 2
        total -= part
        del c, part
    sums = np.maximum(0.0, lagged(total))
    del total
    every = np.ones(len(k), bool)
    pairs = number(both(every, every))
    counted = pairs if ok.all() else number(both(ok, ok))
    sums[(counted if (finite == ok).all() else number(both(finite, finite))) == 0] = 0.0
    if (ok & ~finite).any():
        nan, inf = ok & np.logical_or.reduce([np.isnan(c) for c in at]), ok & np.logical_or.reduce([np.isinf(c) for c in at])
        sums[number(both(inf, ok) + both(ok, inf)) > 0] = np.inf
        same = sum(both(x, x) for c in at for v in (np.inf, -np.inf) for x in [ok & (c == v)])
        sums[number(both(nan, ok) + both(ok, nan) + same) > 0] = np.nan
    return lags + (j - i) * block, sums, pairs, counted


#: Rows that a task packs at a time.
PACK = 1 << 19
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def shrunk(x: np.ndarray) -> bytes:
    """Integers as zipped differences, in as many bytes as they need."""
    d = np.diff(x, prepend=np.int64(0))
    size = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(d) or (np.iinfo(t).min <= d[1:].min(initial=0) and d[1:].max(initial=0) <= np.iinfo(t).max))
    return int(np.dtype(size).itemsize).to_bytes(1) + d[:1].astype(np.int64).tobytes() + zlib.compress(d[1:].astype(size).tobytes(), 1)


def grown(b: bytes) -> np.ndarray:
    rest = np.frombuffer(zlib.decompress(b[9:]), f"i{b[0]}")
    return np.cumsum(np.concatenate((np.frombuffer(b[1:9], np.int64), rest.astype(np.int64))))


def packed(p: DataFrame, edges: list[int]) -> DataFrame:
    """p (frame, particle, x, y, z) -> (particle, b, frames, at, single, nulls): rows of a particle and a block, as binaries.

    Block b begins with the frame edges[b]. Positions take four bytes if that loses nothing.
    """

    def pack(held):
        t = pa.Table.from_batches(held).combine_chunks()
        who = t.column("particle").combine_chunks().dictionary_encode()
        code, frame = who.indices.to_numpy(), t.column("frame").to_numpy()
        b = np.searchsorted(np.array(edges), frame, side="right") - 1
        order = np.lexsort((frame, b, code))
        code, frame, b = code[order], frame[order], b[order]
        ok = np.logical_and.reduce([t.column(a).is_valid().to_numpy() for a in AXES])[order]
        at = np.stack([t.column(a).fill_null(0.0).to_numpy()[order] for a in AXES])
        with np.errstate(over="ignore"):
            small = at.astype(np.float32)
        cut = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (b[1:] != b[:-1])))).tolist()
        out = []
        for s, e in zip(cut, [*cut[1:], len(code)]):
            single = np.array_equal(small[:, s:e], at[:, s:e], equal_nan=True)
            out.append((int(b[s]), shrunk(frame[s:e]), (small if single else at)[:, s:e].tobytes(), single, None if ok[s:e].all() else np.packbits(~ok[s:e]).tobytes()))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()))]
        return pa.RecordBatch.from_arrays([who.dictionary.take(pa.array(code[cut])), *columns], ["particle", "b", "frames", "at", "single", "nulls"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= PACK:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return p.mapInArrow(run, f"particle {dict(p.dtypes)['particle']}, b long, frames binary, at binary, single boolean, nulls binary")


def unpacked(t: pa.Table):
    """(frames, the three axes, rows without a null) of packed rows."""
    frames, at, ok = [], ([], [], []), []
    for f, a, single, nulls in zip(t.column("frames"), t.column("at"), t.column("single").to_pylist(), t.column("nulls").to_pylist()):
        frames.append(grown(f.as_py()))
        n = len(frames[-1])
        for held, c in zip(at, np.frombuffer(a.as_buffer(), np.float32 if single else np.float64).reshape(3, n)):
            held.append(c)
        ok.append(np.ones(n, bool) if nulls is None else ~np.unpackbits(np.frombuffer(nulls, np.uint8), count=n).astype(bool))
    return np.concatenate(frames), [np.concatenate(c) for c in at], np.concatenate(ok)


def lagged_displacement(df: DataFrame, max_lag: int, by_molecule: bool = False, frame_interval: float = 1.0, block: int = 1 << 22, part: int = 1 << 10) -> DataFrame:
    """What displacement() returns, for many lags: nothing is made for each pair of frames.

    A particle's frames are cut into blocks; every two blocks within max_lag meet
    in one group, which gives a sum for each lag between them. Rows are packed
    before they are dealt out, and so are the sums, of `part` lags each. A row goes to as many groups
    as its block meets: to one, if there is one block.
    """
    p = centre_of_mass(df, "frame", "mol").withColumnRenamed("mol", "particle") if by_molecule else df.select("frame", F.col("bead").alias("particle"), *AXES)
    if dict(p.dtypes)["frame"] not in INTEGERS:
        p = p.join(p.select("frame").distinct().withColumn("k", F.row_number().over(W.orderBy("frame"))), "frame").select(F.col("k").alias("frame"), "particle", *AXES)
    p = p.where("frame is not null").select(F.col("frame").cast("long"), "particle", *[F.col(a).cast("double").alias(a) for a in AXES])
    frames = p.select("frame").distinct()
    n, low, high = frames.agg(F.count(F.lit(1)), F.min("frame"), F.max("frame")).first()
    gapless = n == 0 or high - low + 1 == n
    if gapless or n <= block:
        edges = list(range(low or 0, (low or 0) + n, block)) if gapless else [low]
    else:
        ranks = frames.withColumn("k", F.row_number().over(W.orderBy("frame")) - 1)
        edges = [r.frame for r in ranks.where(F.col("k") % block == 0).orderBy("k").collect()]
    reach, last = (max_lag - 1) // block + 1, max(0, len(edges) - 1)
    p = p.where("particle is not null")
    rows = packed(p, edges).withColumn("list", F.lit(False))
    if not gapless:  # a task then needs the frames of its blocks, to number its own
        lists = packed(frames.select("frame", F.lit(0).alias("particle"), *[F.lit(0.0).alias(a) for a in AXES]), edges).withColumn("at", F.lit(None).cast("binary"))
        rows = rows.union(p.select("particle").distinct().crossJoin(lists.drop("particle")).select("particle", "b", "frames", "at", "single", "nulls", F.lit(True)))
    meets = F.concat(
        F.transform(F.sequence("b", F.least(F.lit(last), F.col("b") + reach)), lambda j: F.struct(F.col("b").alias("i"), j.cast("long").alias("j"))),
        F.transform(F.filter(F.sequence(F.greatest(F.lit(0), F.col("b") - reach), "b"), lambda i: i < F.col("b")), lambda i: F.struct(i.cast("long").alias("i"), F.col("b").alias("j"))),
    )
    rows = rows.withColumn("c", F.explode(meets)).select("particle", "c.i", "c.j", "b", "frames", "at", "single", "nulls", "list")

    def numbered(frame, lists):
        """The places of frames among all of them, counted from the first block's on."""
        if gapless:
            return np.subtract(frame, edges[0], out=frame)
        out = np.zeros(len(frame), np.int64)
        owner = np.searchsorted(np.array(edges), frame, side="right") - 1
        for b, held in lists.items():
            mine = owner == b
            out[mine] = b * block + np.searchsorted(np.sort(np.concatenate(held)), frame[mine])
        return out

    def run(key, t):
        lists = {}
        if not gapless:
            for b, f in zip(*(t.filter(t.column("list")).column(c).to_pylist() for c in ("b", "frames"))):
                lists.setdefault(b, []).append(grown(f))
            t = t.filter(pa.compute.invert(t.column("list")))
        out = {x: [] for x in ("part", "start", "s", "pairs", "counted")}
        if t.num_rows:
            frame, at, ok = unpacked(t)
            i, j = key[1].as_py(), key[2].as_py()
            frame = numbered(frame, lists)
            found = block_sums(frame, at, ok, i, j, block, max_lag)
            use = np.flatnonzero((found[0] >= 1) & (found[0] <= max_lag) & (found[2] > 0))
            if len(use):  # lags without a pair have sums of 0
                lag, s, pairs, counted = (f[use[0] : use[-1] + 1] for f in found)
                cut = [0, *(np.flatnonzero(lag[1:] // part != lag[:-1] // part) + 1).tolist(), len(lag)]
                for x, y in zip(cut, cut[1:]):
                    for c, v in zip(out, (lag[x] // part, lag[x] % part, s[x:y].tobytes(), shrunk(pairs[x:y]), shrunk(counted[x:y]))):
                        out[c].append(v)
        return pa.table([pa.array(v, kind) for v, kind in zip(out.values(), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], list(out))

    def total(key, t):
        s, pairs, counted = np.zeros(part), np.zeros(part, np.int64), np.zeros(part, np.int64)
        for start, a, b, c in zip(t.column("start").to_pylist(), t.column("s"), t.column("pairs"), t.column("counted")):
            a = np.frombuffer(a.as_buffer())
            here = slice(start, start + len(a))
            s[here] += a
            pairs[here] += grown(b.as_py())
            counted[here] += grown(c.as_py())
        use = np.flatnonzero(pairs)
        msd = s[use] / np.maximum(1, counted[use])
        return pa.table([pa.array(key[0].as_py() * part + use, pa.int32()), pa.array(msd, mask=counted[use] == 0), pa.array(pairs[use])], ["lag", "msd", "n"])

    sums = rows.groupBy("particle", "i", "j").applyInArrow(run, "part long, start long, s binary, pairs binary, counted binary")
    return sums.groupBy("part").applyInArrow(total, "lag int, msd double, n long").withColumn("lag_time", F.col("lag") * frame_interval)


def whole_displacement(df: DataFrame, by_molecule: bool = False) -> DataFrame:
    return lagged_displacement(df, all_lags(df), by_molecule).select("lag", F.round("msd", 9).alias("msd"), "n")


#: The lags that the SQL of msd and msd_by_molecule has; msd_all_lags and msd_all_lags_by_molecule have them all.
LAGS = 20
QUERIES = {
    "traj_scan": lambda s, d: src.trajectory(s, d).groupBy("mol", "type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("sx"), r6(F.sum("z")).alias("sz")),
    "msd_com": lambda s, d: centre_of_mass(src.trajectory(s, d), "frame", "mol").select("frame", "mol", *[F.round(a, 9).alias(a) for a in AXES]),
    "compute_rg": lambda s, d: radius_of_gyration(src.trajectory(s, d)).select(F.round("value", 9).alias("value"), F.round("std", 9).alias("std"), F.round("drift", 9).alias("drift"), "n_frames", "n_chains"),
    "compute_ree": lambda s, d: end_to_end_distance(src.trajectory(s, d), src.BOX).select(F.round("value", 9).alias("value"), F.round("std", 9).alias("std"), "n_samples", "n_chains"),
    "msd": lambda s, d: displacement(src.trajectory(s, d), LAGS).select("lag", F.round("msd", 9).alias("msd"), "n"),
    "msd_by_molecule": lambda s, d: displacement(src.trajectory(s, d), LAGS, by_molecule=True).select("lag", F.round("msd", 9).alias("msd"), "n"),
    "msd_all_lags": lambda s, d: whole_displacement(src.trajectory(s, d)),
    "msd_all_lags_by_molecule": lambda s, d: whole_displacement(src.trajectory(s, d), by_molecule=True),
    "rdf_hist": lambda s, d: radial_distribution(src.trajectory(s, d), src.BOX, 0.45, 9).select("bin", F.round("r", 6).alias("r"), "pairs", r6("g_r").alias("g_r")),
    "rdf_partial": lambda s, d: radial_distribution(src.trajectory(s, d), src.BOX, 0.3, 6, [1], [2]).select("bin", F.round("r", 6).alias("r"), "pairs", r6("g_r").alias("g_r")),
    "box_tilt": lambda s, d: box_tilt(cells_of(s, d)).select("p_partkey", *[r6(c).alias(c) for c in ("lx", "ly", "lz", "xy", "xz", "yz")]),
}

_LATE = f"{src.TRAJ_SQL}, k AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM traj)), late AS (SELECT traj.* FROM traj JOIN k USING (frame) WHERE k >= least(n - 1, greatest(0, round_even(n * 0.5, 0))))"
_MSD = "SELECT cast(b.k - a.k AS INTEGER) AS lag, round(avg((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 9) AS msd, count(*) AS n FROM p a JOIN p b ON a.particle = b.particle AND b.k - a.k BETWEEN 1 AND 20 GROUP BY 1"


def _rdf(rmax: float, bins: int, a: str, b: str) -> str:
    dr = rmax / bins
    mi = lambda x: f"(b.{x} - a.{x} - round_even(b.{x} - a.{x}, 0))"
    return f"""WITH {src.TRAJ_SQL}, p AS (SELECT sqrt({mi('x')} ** 2 + {mi('y')} ** 2 + {mi('z')} ** 2) AS r FROM traj a JOIN traj b ON a.frame = b.frame AND a.bead <> b.bead WHERE {a} AND {b}),
      h AS (SELECT cast(least(floor(r / {dr!r}), {bins - 1}) AS INTEGER) AS bin, count(*) AS pairs FROM p WHERE r < {rmax!r} GROUP BY 1),
      i AS (SELECT sum(na * nb) AS nn FROM (SELECT count(*) FILTER ({a.replace('a.', '')}) AS na, count(*) FILTER ({b.replace('b.', '')}) AS nb FROM traj GROUP BY frame))
      SELECT g.bin, round((g.bin + 0.5) * {dr!r}::DOUBLE, 6) AS r, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / (nn * (4 * pi() / 3 * {dr ** 3!r} * ((g.bin + 1) ** 3 - g.bin ** 3))), 6) AS g_r
      FROM (SELECT cast(unnest(range({bins})) AS INTEGER) AS bin) g LEFT JOIN h USING (bin), i"""


ORACLES = {
    "traj_scan": f"WITH {src.TRAJ_SQL} SELECT mol, type, count(*) AS n, round(sum(x), 6) AS sx, round(sum(z), 6) AS sz FROM traj GROUP BY mol, type",
    "msd_com": f"WITH {src.TRAJ_SQL} SELECT frame, mol, " + ", ".join(f"round(sum(mass * {a}) / sum(mass), 9) AS {a}" for a in AXES) + " FROM traj GROUP BY frame, mol",
    "compute_rg": f"""WITH {_LATE}, c AS (SELECT *, sum(mass * x) OVER w / sum(mass) OVER w AS cx, sum(mass * y) OVER w / sum(mass) OVER w AS cy, sum(mass * z) OVER w / sum(mass) OVER w AS cz FROM late WINDOW w AS (partITION BY frame, mol)),
        g AS (SELECT frame, mol, sqrt(sum(mass * ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) / sum(mass)) AS rg FROM c GROUP BY frame, mol), f AS (SELECT frame, avg(rg) AS m, count(*) AS k FROM g GROUP BY frame)
        SELECT round(avg(rg), 9) AS value, round(stddev_samp(rg) / sqrt(greatest(1, count(*) - 1)), 9) AS std, (SELECT round(max_by(m, frame) - min_by(m, frame), 9) FROM f) AS drift, (SELECT count(*) FROM f) AS n_frames, (SELECT max(k) FROM f) AS n_chains FROM g""",
    "compute_ree": f"""WITH {_LATE}, s AS (SELECT frame, mol, """ + ", ".join(f"{a} - lag({a}) OVER w AS d{a}" for a in AXES) + """ FROM late WINDOW w AS (partITION BY frame, mol ORDER BY bead)),
        e AS (SELECT frame, mol, sqrt(""" + " + ".join(f"coalesce(sum(d{a} - round_even(d{a}, 0)), 0) ** 2" for a in AXES) + """) AS ree FROM s GROUP BY frame, mol)
        SELECT round(avg(ree), 9) AS value, round(stddev_samp(ree) / sqrt(greatest(1, count(*) - 1)), 9) AS std, count(*) AS n_samples, count(DISTINCT mol) AS n_chains FROM e""",
    "msd": f"WITH {src.TRAJ_SQL}, p AS (SELECT *, bead AS particle, dense_rank() OVER (ORDER BY frame) AS k FROM traj) {_MSD}",
    "msd_by_molecule": f"WITH {src.TRAJ_SQL}, c AS (SELECT frame, mol AS particle, sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y, sum(mass * z) / sum(mass) AS z FROM traj GROUP BY frame, mol), p AS (SELECT *, dense_rank() OVER (ORDER BY frame) AS k FROM c) {_MSD}",
    "rdf_hist": _rdf(0.45, 9, "true", "true"),
    "rdf_partial": _rdf(0.3, 6, "a.type = 1", "b.type = 2"),
    "box_tilt": """WITH c AS (SELECT p_partkey, 10.0::DOUBLE + p_size AS a, 12.0::DOUBLE AS b, 15.0::DOUBLE AS c, cos(radians(80.0 + p_size % 10)) AS ca, cos(radians(85.0)) AS cb, cos(radians(75.0 + p_size % 7)) AS cg FROM part WHERE p_size > 0),
        t AS (SELECT *, b * cg AS xy, c * cb AS xz FROM c), u AS (SELECT *, sqrt(b ** 2 - xy ** 2) AS ly FROM t), v AS (SELECT *, (b * c * ca - xy * xz) / ly AS yz FROM u)
        SELECT p_partkey, round(a, 6) AS lx, round(ly, 6) AS ly, round(sqrt(c ** 2 - xz ** 2 - yz ** 2), 6) AS lz, round(xy, 6) AS xy, round(xz, 6) AS xz, round(yz, 6) AS yz FROM v""",
}
