"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents: rejected documents are gone, and passages that repeat are cut out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import decontaminate, jaccard, packing, quality, suffixes
from lodestream.llm.common import crc_class, drop, materialize, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; held-out labels are not looked at."""
    labels = table(spark, sf_dir, "labels").where(crc_class("doc_id", 4) != 2)
    return quality.accepted(docs, quality.train_on(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near-duplicates: SimHash links and what they miss, held against a similarity of 0.8 or more on shingles of five words."""
    return jaccard.deduplicate(docs, shingle=5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a smaller doc_id holds already."""
    return suffixes.remove_repeats(docs, rewrite=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows."""
    return packing.packed(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", sequences),
]

#: Hashing, suffix sorting and subword ids are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            drop(before)
    return docs
