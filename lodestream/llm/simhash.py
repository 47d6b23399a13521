"""Near-duplicate detection by SimHash, with pigeonring filtering of candidates.

A document's fingerprint is the 64-bit majority of the XXH64 hashes of its
word shingles. Fingerprints at Hamming distance <= 4 are linked.

Filter: the 64 bits form a ring of five segments. If two fingerprints differ
in at most 4 bits, some segment starts a chain in which, for every length
l = 1..5, the first l segments together differ in at most l * 4 / 5 bits: 0, 1,
2, 3, 4 (the strong form of the pigeonring principle). The index keys are the
ways to meet the first three budgets exactly: the first segment whole, and
parts of the next two that any split of their budget leaves untouched. Pairs
that share a key are then held against each budget in turn, and only those
that pass reach the full Hamming distance.

Defined results: a null or blank text has fingerprint zero and links like any
other; repeated rows of a doc_id give repeated result rows; rows with a null
doc_id get a fingerprint and a null component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import cells, whole_cells
from .common import materialize, tidy
from .components import components

DISTANCE = 4
SEGMENTS = 5


def segments(n: int = SEGMENTS, bits: int = 64) -> list[list[int]]:
    """The bit numbers of each ring segment, as even as they come."""
    cut = [bits * i // n for i in range(n + 1)]
    return [list(range(cut[i], cut[i + 1])) for i in range(n)]


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def parts(bits: list[int], n: int) -> list[list[int]]:
    cut = [len(bits) * i // n for i in range(n + 1)]
    return [bits[cut[i] : cut[i + 1]] for i in range(n)]


def chain_keys() -> list[tuple[int, int]]:
    """(start segment, mask) of each index key.

    For a chain with budgets 0, 1, 2: either the second segment is equal, and
    one of three parts of the third is (at most 2 bits differ there); or the
    second differs in one bit, which leaves one of its halves equal, and the
    third in at most one, which leaves one of its halves equal.
    """
    seg, out = segments(), []
    for i in range(SEGMENTS):
        a, b, c = (seg[(i + k) % SEGMENTS] for k in range(3))
        out += [(i, mask_of(a + b + x)) for x in parts(c, 3)]
        out += [(i, mask_of(a + x + y)) for x in parts(b, 2) for y in parts(c, 2)]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The uint64 hashes of a text's word shingles in their order, repeats included (none: empty)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(line, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)


def majority(held: list[np.ndarray]) -> np.ndarray:
    """uint64 fingerprints: the bits set in over half the hashes of each array (empty: zero)."""
    out = np.zeros(len(held), np.uint64)
    where = [k for k, h in enumerate(held) if len(h)]
    for s in range(0, len(where), 256):
        some = where[s : s + 256]
        sizes = np.array([len(held[k]) for k in some])
        bits = np.unpackbits(np.concatenate([held[k] for k in some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.int32)
        out[some] = np.packbits((2 * count > sizes[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_batch(texts: list, shingle: int = 4) -> np.ndarray:
    """uint64 fingerprints of a list of texts (None counts as empty)."""
    return np.concatenate([np.zeros(0, np.uint64), *(majority([hashes(t, shingle) for t in texts[s : s + 256]]) for s in range(0, len(texts), 256))])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = fingerprint_batch(b.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def linked(x: np.ndarray, y: np.ndarray, start: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs pass every chain budget from their start segment, then the full distance."""
    alive = np.arange(len(x))
    diff = x ^ y
    spent = np.zeros(len(x), np.int64)
    for l in range(SEGMENTS):
        spent[alive] += np.bitwise_count(diff[alive] & masks[(start[alive] + l) % SEGMENTS])
        alive = alive[spent[alive] <= (l + 1) * distance // SEGMENTS]
    ok = np.zeros(len(x), bool)
    ok[alive] = np.bitwise_count(diff[alive]) <= distance
    return ok


def forest(t: pa.Table, masks: np.ndarray, distance: int):
    """The links of whole cells, as the fewest edges that join what they join."""
    key, ci, cj = (t.column(c).to_numpy() for c in ("key", "ci", "cj"))
    fp, rep, start = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy(), t.column("start").to_numpy()
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])
    cell = np.cumsum(new)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    at, step = np.arange(n), 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[cell[at] == cell[at + step]]
        for s in range(0, len(at), 1 << 18):
            i = at[s : s + (1 << 18)]
            i = i[linked(fp[i], fp[i + step], start[i], masks, distance)]
            for p in i.tolist():
                x, y = find(p), find(p + step)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(rep[p])
                    b.append(rep[p + step])
    return np.array(a, np.int64), np.array(b, np.int64)


def links(classes: DataFrame, distance: int = DISTANCE, block: int = 4096) -> DataFrame:
    """classes (rep, fp), one row per fingerprint -> edges (a, b) that join just what links join.

    The edges of a bucket are a spanning forest of its links: never more than
    its rows, whatever the size of a group of copies.
    """
    if distance != DISTANCE:
        raise ValueError("the index keys hold for a distance of 4")
    keys = chain_keys()
    rows = classes.select(
        "rep",
        "fp",
        F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for n, (s, m) in enumerate(keys)])).alias("k"),
    ).select("rep", "fp", "k.start", "k.key")
    masks = np.array([mask_of(s) for s in segments()], np.uint64)

    def run(batches):
        for t in whole_cells(batches):
            a, b = forest(t, masks, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells(rows, "rep", block).select("key", "ci", "cj", "rep", "fp", "start").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id the smallest doc_id reachable over links."""
    fps = materialize(fingerprints(docs, shingle))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    comp = components(links(classes, distance))
    named = classes.join(comp, classes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its group.

    Rows that repeat a kept doc_id, and rows with a null one, stay.
    """
    near = near_duplicates(docs, shingle)
    gone = near.where("doc_id <> component_id").select(F.col("doc_id").alias("_lodestream_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_lodestream_gone"), "left_anti")
