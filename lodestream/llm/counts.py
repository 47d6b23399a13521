"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. A batch is a set of signed rows:
an insert adds a document's count, a delete takes back what the ledger holds
for it, a revision does both. Each batch keeps its document ledger and the
signed totals by (source, lang, version); totals are sums over batches, so a
commit never rewrites earlier ones. A batch is written under a temporary name
and renamed into place: a commit that was interrupted leaves nothing, and a
batch id that is already there is not applied again.

Changes are (doc_id, op, source, lang, version, n_tokens), op one of insert,
delete, revise; deletes need doc_id and version only. Within a batch a
document and version change once; if a batch repeats one, the repeats are
summed for inserts, and a delete or revision takes the ledger's holding back
once.

Defined results: null source or lang are groups of their own; a null n_tokens
counts as 0 tokens and one document; a null text counts 0 tokens; deleting or
revising what the ledger doesn't hold takes nothing back; rows with a null
doc_id can be inserted and never match later changes; an empty batch commits
and changes nothing; extra columns are ignored; groups whose documents are all
gone are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, drop, materialize, scratch, tidy
from .tokens import Encoder, default_tokenizer

KEYS = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, n_tokens long, n_docs long"


def word_count(text: Column) -> Column:
    """Tokens of version `words-1`: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def subword_counts(docs: DataFrame, tokenizer: str | None = None, block: int = 256) -> DataFrame:
    """docs with n_tokens, the subword tokens of the whole text."""
    path = tokenizer or default_tokenizer()
    keep = [c for c in ("doc_id", "source", "lang") if c in docs.columns]

    def run(batches):
        encoder = Encoder.held(path)
        for b in batches:
            for s in range(0, b.num_rows, block):
                part = b.slice(s, block)
                n = np.array([len(c) // 4 for c in encoder.encode(part.column("text").to_pylist())], np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n)], [*keep, "n_tokens"])

    rows = docs.select(*keep, F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", n_tokens long")


class Rollup:
    """Totals of tokens and documents by source, language and tokenizer version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark)
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """Committed batch ids."""
        fs, p = self._fs(f"{self.path}/batches")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, what: str) -> DataFrame:
        names = self.batches()
        schema = LEDGER if what == "ledger" else LEDGER.removeprefix("doc_id long, ")
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/batches/{n}/{what}" for n in names])

    def ledger(self) -> DataFrame:
        """What each document counts for now: non-zero sums of its signed rows."""
        return self._read("ledger").groupBy("doc_id", *KEYS).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).where("n_tokens <> 0 or n_docs <> 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        if batch_id in self.batches():
            return False
        new = changes.where("op in ('insert', 'revise')").select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("version").cast("string"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.lit(1).cast("long").alias("n_docs")
        )
        gone = changes.where("op in ('delete', 'revise')").select(F.col("doc_id").cast("long").alias("doc_id"), "version").distinct()
        signed = new
        if self.batches():
            old = self.ledger().join(gone, ["doc_id", "version"], "left_semi")
            signed = new.unionByName(old.select("doc_id", *KEYS, (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_docs")).alias("n_docs")))
        temporary = f"{self.path}/pending/{batch_id}"
        delete(self.spark, temporary)
        signed.select("doc_id", *KEYS, "n_tokens", "n_docs").write.parquet(f"{temporary}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{temporary}/ledger")
        written.groupBy(*KEYS).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).write.parquet(f"{temporary}/totals")
        fs, target = self._fs(f"{self.path}/batches/{batch_id}")
        fs.mkdirs(target.getParent())
        if not fs.rename(self._jvm.org.apache.hadoop.fs.Path(temporary), target):
            raise RuntimeError(f"batch {batch_id} could not be moved into place")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens), from batch totals only."""
        return self._read("totals").groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


#: Versions of the query: words, and subwords of the default tokenizer.
WORDS, SUBWORDS = "words-1", "word_bpe_49k-1"


def rollup_of(docs: DataFrame, tokenizer: str | None = None, subwords: bool = True) -> DataFrame:
    """The totals after loading every document under two versions, and two later batches.

    load: every document, in words and (unless left out) in subwords. revise:
    documents that hold '|' are counted again with '|' as a separator. drop:
    exact copies of a smaller doc_id are deleted under both versions. Each batch
    is committed twice; the second has no effect.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def counted(some: DataFrame, op: str) -> DataFrame:
        keys = ["doc_id", "source", "lang"]
        out = some.select(*keys, F.lit(WORDS).alias("version"), word_count(F.col("text")).alias("n_tokens"))
        if subwords:
            out = out.union(subword_counts(some, tokenizer).select(*keys, F.lit(SUBWORDS), "n_tokens"))
        return out.withColumn("op", F.lit(op))

    load = counted(rows, "insert")
    revise = counted(rows.where(F.contains("text", F.lit("|"))).withColumn("text", F.translate("text", "|", " ")), "revise")
    ids = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the join is one of two plain exchanges, whose hot keys adaptive execution splits
    first = materialize(first.select("digest", "first"))
    copies = ids.join(first, "digest").where("doc_id > first").select("doc_id")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_tokens", "long"))]
    gone = copies.select("doc_id", F.explode(F.array(*[F.lit(v) for v in ([WORDS, SUBWORDS] if subwords else [WORDS])])).alias("version"), F.lit("delete").alias("op"), *nothing)
    held = Rollup(spark)
    for name, changes in (("0-load", load), ("1-revise", revise), ("2-drop", gone)):
        held.commit(name, changes)
        held.commit(name, changes)
    drop(first)
    return held.totals()


#: The word version alone.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') t FROM documents),
     k AS (SELECT * FROM d WHERE doc_id = (SELECT min(doc_id) FROM d e WHERE e.t = d.t)),
     c AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(replace(t, '|', ' '), '[^\x20\x09-\x0D]+')) AS n FROM k)
SELECT source, lang, version, count(*) AS n_docs, cast(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""
