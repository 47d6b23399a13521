import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import counts, tokens
from tests import oracle

SF = "/root/testdata/sf0.001"
CHANGE = "doc_id long, op string, source string, lang string, version string, n_tokens long"


def totals(r):
    return {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_inserts_revisions_and_deletes(spark, tmp_path):
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == {}
    rows = [(1, "insert", "a", "en", "v1", 10), (2, "insert", "a", "en", "v1", 5), (3, "insert", None, "fr", "v1", None), (None, "insert", "a", "en", "v2", 7)]
    assert r.commit("b1", spark.createDataFrame(rows, CHANGE))
    assert totals(r) == {("a", "en", "v1"): (2, 15), (None, "fr", "v1"): (1, 0), ("a", "en", "v2"): (1, 7)}
    change = [(1, "revise", "b", "en", "v1", 12), (2, "delete", None, None, "v1", None), (99, "delete", None, None, "v1", None), (None, "delete", None, None, "v2", None)]
    assert r.commit("b2", spark.createDataFrame(change, CHANGE))
    want = {("b", "en", "v1"): (1, 12), (None, "fr", "v1"): (1, 0), ("a", "en", "v2"): (1, 7)}
    assert totals(r) == want
    assert {(x.doc_id, x.n_tokens) for x in r.ledger().collect()} == {(1, 12), (3, 0), (None, 7)}


def test_a_batch_counts_once(spark, tmp_path):
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([(1, "insert", "a", "en", "v1", 10)], CHANGE)
    assert r.commit("b", rows) and not r.commit("b", rows)
    assert totals(r) == {("a", "en", "v1"): (1, 10)}
    again = counts.Rollup(spark, f"file://{tmp_path}/r")
    assert not again.commit("b", rows) and totals(again) == totals(r)


def test_an_interrupted_commit_leaves_nothing(spark, tmp_path):
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([(1, "insert", "a", "en", "v1", 10)], CHANGE)
    rows.select("doc_id").write.parquet(f"file://{tmp_path}/r/pending/b/ledger")
    assert totals(r) == {} and r.commit("b", rows)
    assert totals(r) == {("a", "en", "v1"): (1, 10)}


def test_empty_batch(spark, tmp_path):
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.commit("e", spark.createDataFrame([], CHANGE)) and totals(r) == {}


def test_subword_counts(spark):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    rows = [(1, "Hello, world!", "s", "en"), (2, None, "s", "en"), (3, "", "s", "en"), (4, "x" * 5000, "s", "en")]
    got = {r.doc_id: r.n_tokens for r in counts.subword_counts(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, _, _ in rows}


def test_words_against_sql(spark):
    oracle.same(counts.rollup_of(spark.read.parquet(f"{SF}/documents.parquet"), subwords=False), oracle.connect(SF), counts.ORACLE)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    t, first, want = Tokenizer.from_file(tokens.default_tokenizer()), {}, {}
    rows = [(r.doc_id, r.text or "", r.source, r.lang) for r in docs.collect()]
    for i, x, *_ in sorted(rows):
        first.setdefault(x, i)
    assert len(first) < len(rows)
    for i, x, source, lang in rows:
        if first[x] == i:
            x = x.replace("|", " ")
            for version, n in ((counts.WORDS, len(re.findall(r"[^\x20\x09-\x0D]+", x))), (counts.SUBWORDS, len(t.encode(x, add_special_tokens=False).ids))):
                a, b = want.get((source, lang, version), (0, 0))
                want[source, lang, version] = (a + 1, b + n)
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in counts.rollup_of(docs).collect()} == want


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "a|b " * 60_000, "s", "en", "v", 3, "x"), (2, None, None, None, "v", 3, "x"), (2, None, None, None, "v", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, version string, n_tokens long, op string")
    got = {(r.source, r.version): (r.n_docs, r.n_tokens) for r in counts.rollup_of(docs).collect()}
    assert got["s", counts.WORDS] == (1, 120_000) and got[None, counts.WORDS] == (2, 0) and set(got) == {(s, v) for s in ("s", None) for v in (counts.WORDS, counts.SUBWORDS)}


def test_word_count_of_odd_texts(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), (" \t\x0b\x0c\r\n",), ("é x y",)], "text string")
    assert [r[0] for r in df.select(counts.word_count(F.col("text"))).collect()] == [2, 0, 0, 0, 2]
