"""SimHash near-duplicates brought to an exact Jaccard similarity of word shingles.

Two texts are linked if their sets of shingles (known by XXH64) have a
similarity of 4/5 or more.

1. SimHash: fingerprints of the distinct shingles, candidates by pigeonring filtering at
   a Hamming distance of 4 (simhash.links), each held against the sets
   themselves. A fingerprint of 64 bits lies about 10 bits apart at a similarity
   of 4/5, so this finds most copies, cheaply, and not all.
2. The rest exactly: under any one order of all shingles, linked sets share one
   of the first n - ceil(4n / 5) + 1 of each (the prefix principle), so every
   link is met in a bucket of a prefix shingle. The order puts the most frequent
   shingles of the table last, which decides the size of the buckets
   and never the links. Rows of a bucket count as met if sets of their sizes can
   be similar with this as the first shingle they share, and their fingerprints are at most APART bits apart (sets of under
   SMALL shingles: any number; at a similarity of 4/5 more than APART differ
   once in a million pairs, and less often above). Rows that meet nobody go at
   once. What step 1 joined is not compared again; the others first meet some
   leaders of their bucket, in rounds with new leaders, then in full. Pairs
   whose bitmaps differ in more bits than linked sets have members apart don't
   count as met either; each of the others is held against the sets.

Defined results: a text of up to `shingle` words is one shingle; null and blank
texts are equal sets; rows with a null doc_id are in no group; ties are decided
by the smallest doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import cells, whole_cells
from .common import drop, materialize, no_broadcasts, partitions, tidy
from .components import components
from .simhash import hashes, majority
from .simhash import links as simhash_links

#: A shingle is put last if so many texts hold it; the MOST most frequent ones are.
FREQUENT, MOST = 3, 50_000
#: Shingles whose counts a task combines before they are dealt out.
COMBINE = 1 << 20
#: Leaders of a bucket in each round.
LEADERS = (4, 12)
#: Fingerprints of linked sets of SMALL shingles or more are at most so many bits apart.
APART, SMALL = 24, 64


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct uint64 hashes of a text's word shingles."""
    return np.unique(hashes(text, k))


def name_of(held: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of its members."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))


def prefix(held: np.ndarray, last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n / 5) + 1 members, those in `last` (sorted) after the others by weight."""
    n = len(held)
    if not n:
        return held
    w = np.zeros(n, np.int64)
    if len(last):
        at = np.minimum(np.searchsorted(last, held), len(last) - 1)
        w = np.where(last[at] == held, weight[at], 0)
    return held[np.lexsort((held, w))[: n + 1 + (-4 * n // 5)]]


def parities(held: np.ndarray) -> np.ndarray:
    """A set's bitmap of 8 x 64 bits: of each place, whether an odd number of members falls there.

    Bitmaps of two sets differ in no more bits than the sets have members apart.
    """
    return np.packbits((np.bincount((held & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, counts) of the most frequent shingles, counted over all documents."""
    parts = partitions(docs.sparkSession)
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def dealt(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.concatenate(([0], np.searchsorted(h, edges), [len(h)])).tolist()
        some = [(i, s, e) for i, (s, e) in enumerate(zip(cut, cut[1:])) if e > s]
        n = n.astype(np.uint32)
        columns = [pa.array([i for i, _, _ in some], pa.int32()), *(pa.array([x[s:e].tobytes() for _, s, e in some], pa.binary()) for x in (h, n))]
        return pa.RecordBatch.from_arrays(columns, ["part", "h", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column("text"):
                held.append(shingles(t.as_py(), shingle))
                size += len(held[-1])
                if size >= COMBINE:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def total(batches):
        held = {}
        for b in batches:
            for i, h, n in zip(b.column("part").to_pylist(), b.column("h"), b.column("n")):
                held.setdefault(i, []).append((np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint32)))
        for i in list(held):
            h, n = (np.concatenate(x) for x in zip(*held.pop(i)))
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, n = h[at], np.add.reduceat(n, at, dtype=np.int64)
            use = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(h[use].view(np.int64)), pa.array(n[use])], ["h", "n"])

    counts = docs.select("text").mapInArrow(tidy(run), "part int, h binary, n binary").repartition(parts, "part").mapInArrow(tidy(total), "h long, n long")
    held = materialize(counts.orderBy(F.desc("n"), "h").limit(MOST))
    top = held.toArrow()
    drop(held)
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def named(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, k, n, fp, map, prefix): the name and the size of each text's set, its fingerprint, bitmap, and prefix."""
    last, weight = frequent(docs, shingle)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                sets = [shingles(t, shingle) for t in part.column("text").to_pylist()]
                fp = majority(sets)
                heads = pa.array([prefix(x, last, weight).view(np.int64) for x in sets], pa.list_(pa.int64()))
                maps = pa.array([parities(x) for x in sets], pa.list_(pa.int64()))
                columns = [part.column("doc_id"), pa.array([name_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fp.view(np.int64)), maps, heads]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "n", "fp", "map", "prefix"])

    return docs.mapInArrow(tidy(run), "doc_id long, k long, n long, fp long, map array<long>, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted (k, rep) -> (k, held): the members of each set, from the text of its smallest doc_id."""

    def run(batches):
        for b in batches:
            for k, t in zip(b.column("k").to_pylist(), b.column("text")):
                s = shingles(t.as_py(), shingle)
                if name_of(s) == k:  # a doc_id can have several texts
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([s.tobytes()])], ["k", "held"])

    return docs.join(wanted, docs.doc_id == wanted.rep).select("k", "text").mapInArrow(tidy(run), "k long, held binary").dropDuplicates(["k"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) of names -> those whose sets have a similarity of 4/5 or more."""

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y")):  # one pair at a time
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k")
    x, y = sets.select(F.col("k").alias("a"), F.col("held").alias("x")), sets.select(F.col("k").alias("b"), F.col("held").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def can_be_similar(n, m, p, q, x, y) -> np.ndarray:
    """Whether sets of sizes n and m that share a shingle at places p and q of their orders, with fingerprints x and y, count as met.

    If it is the first they share they have at most min(n - p, m - q) in common, and 4/9 of n + m are needed.
    """
    return (9 * np.minimum(n - p, m - q) >= 4 * (n + m)) & ((np.minimum(n, m) < SMALL) | (np.bitwise_count(x ^ y) <= APART))


def meetings(t: pa.Table):
    """(i, j) of the rows of whole cells that count as met; if t has them: whose bitmaps are near enough, and that differ in c."""
    key, ci, cj, n, p, fp = (t.column(x).to_numpy() for x in ("key", "ci", "cj", "n", "p", "fp"))
    fp = fp.view(np.uint64)  # counted bits are those of the absolute value otherwise
    c = t.column("c").to_numpy() if "c" in t.column_names else None
    maps = t.column("map").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 8) if "map" in t.column_names else None
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])
    cell, at, step = np.cumsum(new), np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[cell[at] == cell[at + step]]
        for s in range(0, len(at), 1 << 16):
            i = at[s : s + (1 << 16)]
            if c is not None:
                i = i[c[i] != c[i + step]]
            i = i[can_be_similar(n[i], n[i + step], p[i], p[i + step], fp[i], fp[i + step])]
            if maps is not None:
                # members apart: at most n + m - 2 * 4/9 * (n + m)
                i = i[9 * np.bitwise_count(maps[i] ^ maps[i + step]).sum(axis=1, dtype=np.int64) <= n[i] + n[i + step]]
            if len(i):
                yield i, i + step


def met_somewhere(rows: DataFrame, block: int) -> DataFrame:
    """The rows (key, k, n, p, fp, and map or not) that count as met with another of their key, once, without map."""

    def run(batches):
        for t in whole_cells(batches):
            use = np.zeros(t.num_rows, bool)
            for i, j in meetings(t):
                use[i] = use[j] = True
            yield from t.select(["key", "k", "n", "p", "fp"]).filter(pa.array(use)).to_batches()

    met = cells(rows, "k", block).select("ci", "cj", *rows.columns)
    return met.mapInArrow(tidy(run), "key long, k long, n long, p int, fp long").distinct()


def pairs_apart(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, k, n, p, fp, map, c) -> distinct (a, b) that count as met and differ in c."""

    def run(batches):
        for t in whole_cells(batches):
            k = t.column("k").to_numpy()
            for i, j in meetings(t):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[j])), pa.array(np.maximum(k[i], k[j]))], ["a", "b"])

    return cells(rows, "k", block).select("ci", "cj", *rows.columns).mapInArrow(tidy(run), "a long, b long").distinct()


def pairs_with_leaders(rows: DataFrame, leaders: range) -> DataFrame:
    """rows (key, k, n, p, fp, map, c) -> distinct (a, b) of rows and the leaders of their key that count as met and differ in c."""
    lead = rows.groupBy("key").agg(*[F.min_by("k", F.xxhash64(F.lit(i), "k")).alias(f"l{i}") for i in leaders])
    lead = lead.select("key", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in leaders]))).alias("k")).join(rows, ["key", "k"])
    lead = lead.select("key", F.struct("k", "n", "p", "fp", "map", "c").alias("l"))
    enough = F.least(F.col("n") - F.col("p"), F.col("l.n") - F.col("l.p")) * 9 >= (F.col("n") + F.col("l.n")) * 4
    close = (F.least("n", "l.n") < SMALL) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= APART)
    apart = F.aggregate(F.zip_with("map", "l.map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    met = rows.join(lead, "key").where((F.col("c") != F.col("l.c")) & enough & close).where(apart * 9 <= F.col("n") + F.col("l.n"))
    return met.select(F.least("k", "l.k").alias("a"), F.greatest("k", "l.k").alias("b")).distinct()


def still_apart(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """buckets (key, k, n, p, fp, map) -> the same with c, the component of the edges so far, of keys that hold more than one."""
    rows = buckets.join(components(edges).withColumnRenamed("node", "k"), "k", "left").select("key", "k", "n", "p", "fp", "map", F.coalesce("component", "k").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return materialize(rows.join(mixed, "key"))


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) of names whose fingerprints are linked: a spanning forest over fingerprints, equal ones by a star."""
    prints = materialize(classes.groupBy("fp").agg(F.min("k").alias("rep")))
    found = simhash_links(prints)
    equal = classes.select("k", "fp").join(prints.withColumnRenamed("rep", "first"), "fp").where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    return found.union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, names: DataFrame, classes: DataFrame, shingle: int, block: int = 4096) -> DataFrame:
    """(a, b) of names that join just what similarities of 4/5 or more join."""
    kept = names.join(classes.select("k", F.col("rep").alias("doc_id")), ["k", "doc_id"])
    maps = kept.select("k", "map").dropDuplicates(["k"])
    met = materialize(met_somewhere(kept.select(F.posexplode("prefix").alias("p", "key"), "k", "n", "fp"), block))
    near = materialize(met_somewhere(met.join(maps, "k").select("key", "k", "n", "p", "fp", "map"), block))
    buckets = materialize(near.join(maps, "k"))
    drop(met, near)
    sets = materialize(sets_of(docs, classes.select("k", "rep").join(buckets.select("k").distinct(), "k"), shingle))
    edges = materialize(verified(materialize(simhash_pairs(classes)), sets))
    for turn in range(len(LEADERS) + 1):
        left = still_apart(buckets, edges)
        if turn < len(LEADERS):
            pairs = materialize(pairs_with_leaders(left, range(sum(LEADERS[:turn]), sum(LEADERS[: turn + 1]))))
        else:
            pairs = materialize(pairs_apart(left, block))
        more = materialize(edges.union(verified(pairs, sets)))
        drop(edges, pairs, left)
        edges = more
    drop(buckets, sets)
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id): component_id the smallest doc_id reachable over links."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    with no_broadcasts(docs.sparkSession):
        names = materialize(named(docs, shingle))
        classes = materialize(names.groupBy("k", "n", "fp").agg(F.min("doc_id").alias("rep")))
        edges = links(docs, names, classes, shingle)
        a, b = (classes.select(F.col("k").alias(x), F.col("rep").alias("r" + x)) for x in "ab")
        comp = components(edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        group = classes.join(comp, classes.rep == comp.node, "left").select("k", F.coalesce("component", "rep").alias("component_id"))
        found = materialize(names.select("doc_id", "k").join(group, "k").select("doc_id", "component_id"))
        drop(names, classes, edges, comp)
    return found


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its group.

    Rows that repeat a kept doc_id, and rows with a null one, stay.
    """
    gone = near_duplicates(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("_lodestream_gone")).distinct().hint("merge")
    return docs.join(gone, F.col("doc_id") == F.col("_lodestream_gone"), "left_anti")
