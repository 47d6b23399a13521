"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words; the words at its care positions
are hashed, the others are ignored, so a substituted word spoils only the
seeds that care about it. Seeds of every benchmark position are joined with
seeds of every document position. A hit fixes an alignment of the item with
the document, which is verified without gaps: some window of `window` aligned
words (the whole item if it is shorter) must agree in at least `similarity` of
its words.

Four masks with 5 care positions: contiguous, so any five words in a row count,
and three spaced ones. With two of 13 (or 12) words substituted, wherever they
are, some seed stays whole. Items of under SHORT words get two lighter masks
besides, of 3 and 4 care positions, which find every pattern of substitutions
that is allowed for their length; documents get those seeds only if there is
such an item.

The scan, the seeds and the lookup are one generated stage: words are split
once per document, positions and masks are expanded inside it, and only hits
leave it. Seeds name their item by a 64-bit key, so an item's words are held
once. The benchmark side is broadcast only while it has at most
`broadcast_tokens` words of `broadcast_bytes` in all; beyond that document seeds
are shuffled to it and nothing is gathered by seed.

Words are lower-cased runs of letters and digits. Defined results: null or
empty texts match nothing; items of fewer than three words are never matched;
windows of an item with equal numbers of matching words are one result;
repeated rows of the benchmark or of a document give one result row per
(doc_id, item_id); null ids are kept as ids; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 cares, 0 ignores.
MASKS = ("11111", "1101011", "11100101", "101101001")
SHORT_MASKS = ("111", "11011")
SHORT = 12
WINDOW = 13
SIMILARITY = 0.8
BROADCAST_TOKENS = 200_000
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def seed_at(w: Column, i: Column, n: int, mask: str) -> Column:
    """Hash of the words a mask cares about at position i (from 0); null if it would run over the end."""
    care = [k for k, c in enumerate(mask) if c == "1"]
    return F.when(i + len(mask) <= F.size(w), F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in care]))


def seeds(rows: DataFrame, *keep: str, masks: tuple = MASKS) -> DataFrame:
    """rows (w, keep...) -> (keep..., w, i, seed) for each position and mask."""
    least = min(map(len, masks))
    at = rows.where(F.size("w") >= least).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("i"))
    hashed = F.array(*[seed_at(F.col("w"), F.col("i"), (MASKS + SHORT_MASKS).index(m), m) for m in masks])
    return at.select(*keep, "w", "i", F.explode(hashed).alias("seed")).where("seed is not null")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_tokens: int = BROADCAST_TOKENS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(doc_id, item_id, matched, compared): the best window of each verified overlap."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("item")).withColumn("k", F.xxhash64("item_id", "item"))
    size = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "item"))), F.lit(0)), F.count_if(F.size("item").between(3, SHORT - 1))).first()
    small = size[0] <= broadcast_tokens and size[1] <= broadcast_bytes
    # seeds name their item by a key; its words are held once
    known = items.dropDuplicates(["k"])
    of = known.select("k", F.col("item").alias("w"), F.size("item").alias("n"))
    held, masks = seeds(of, "k", "n"), MASKS
    if size[2]:
        masks = MASKS + SHORT_MASKS
        held = held.union(seeds(of.where(F.col("n") < SHORT), "k", "n", masks=SHORT_MASKS))
    held = held.select("seed", "k", "n", F.col("i").alias("q"))
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    if small:
        lists = held.groupBy("seed").agg(F.collect_list(F.struct("k", "n", "q")).alias("hits"))
        met = seeds(texts, "doc_id", masks=masks).join(F.broadcast(lists), "seed").select("doc_id", "w", "i", F.explode("hits").alias("h"))
        met = met.select("doc_id", "w", (F.col("i") - F.col("h.q")).alias("start"), "h.k", "h.n")
    else:
        # the words stay behind: positions are shuffled to the seeds, and distinct alignments back to the texts
        texts = texts.withColumn("row", F.xxhash64("doc_id", "w"))
        found = seeds(texts, "row", masks=masks).select("row", "i", "seed").join(held, "seed").select("row", "k", "n", (F.col("i") - F.col("q")).alias("start")).distinct()
        met = found.join(texts.dropDuplicates(["row"]), "row")
    # the hits of one alignment are combined where they are found, and verified once
    lead, at, span = F.greatest(-F.col("start"), F.lit(0)), F.greatest(F.col("start"), F.lit(0)), F.least(F.lit(window), F.col("n"))
    took = F.least(F.col("n") - lead, F.size("w") - at)
    aligned = met.where(took >= span).select("doc_id", "k", "n", lead.alias("lead"), F.slice("w", at + 1, took).alias("part")).distinct()
    aligned = aligned.join(F.broadcast(known) if small else known, "k")
    same = F.zip_with("part", F.slice("item", F.col("lead") + 1, F.size("part")), lambda a, b: (a == b).cast("int"))

    def best(flags: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(1), F.size(flags) - span + 1), lambda p: F.aggregate(F.slice(flags, p, span), F.lit(0), lambda t, x: t + x)))

    # one generator evaluates each alignment once; a filter would be pushed down and evaluate it again
    enough = F.filter(F.transform(F.array(same), best), lambda m: m >= F.ceil(span * F.lit(similarity)))
    scored = aligned.select("doc_id", "item_id", span.alias("compared"), F.explode(enough).alias("matched"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified overlap."""
    hit = overlaps(docs, benchmark).select(F.col("doc_id").alias("_lodestream_hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_lodestream_hit")), "left_anti")


ORACLE = r"""
WITH b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
m AS (SELECT unnest(MASKS) AS mask, false AS light UNION ALL SELECT unnest(LIGHT), true),
bs AS (SELECT item_id, q, mask || ':' || CARE_B AS seed FROM (SELECT item_id, w, unnest(range(0, len(w) - 2)) q FROM b), m WHERE q + len(mask) <= len(w) AND (NOT light OR len(w) < SHORT)),
ds AS (SELECT doc_id, i, mask || ':' || CARE_D AS seed FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) i FROM d), m WHERE i + len(mask) <= len(w) AND (NOT light OR EXISTS (SELECT 1 FROM b WHERE len(w) < SHORT))),
hit AS (SELECT DISTINCT doc_id, item_id, i - q AS o FROM ds JOIN bs USING (seed)),
al AS (SELECT hit.doc_id, hit.item_id, len(b.w) n, list_transform(range(greatest(0, -o), least(len(b.w), len(d.w) - o)), lambda k: CASE WHEN b.w[k + 1] = d.w[k + o + 1] THEN 1 ELSE 0 END) same
       FROM hit JOIN b USING (item_id) JOIN d USING (doc_id)),
sc AS (SELECT doc_id, item_id, least(WINDOW, n) AS compared, list_max(list_transform(range(1, len(same) - least(WINDOW, n) + 2), lambda p: list_sum(same[p:p + least(WINDOW, n) - 1]))) AS matched FROM al WHERE len(same) >= least(WINDOW, n))
SELECT doc_id, item_id, cast(max(matched) AS INTEGER) AS matched, cast(max(compared) AS INTEGER) AS compared FROM sc WHERE matched >= ceil(compared * 0.8) GROUP BY doc_id, item_id
"""


def oracle() -> str:
    longest = max(map(len, MASKS + SHORT_MASKS))

    def care(i: str) -> str:
        return "concat_ws(' ', " + ", ".join(f"CASE WHEN substr(mask, {k + 1}, 1) = '1' THEN w[{i} + {k + 1}] END" for k in range(longest)) + ")"

    return ORACLE.replace("MASKS", repr(list(MASKS))).replace("LIGHT", repr(list(SHORT_MASKS))).replace("SHORT", str(SHORT)).replace("CARE_B", care("q")).replace("CARE_D", care("i")).replace("WINDOW", str(WINDOW)).replace("0.8", str(SIMILARITY))
