import hashlib
import struct
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
from lodestream.llm import packing, quality, tokens
from tests.llm.test_decontaminate import slow as slow_overlaps
from tests.llm.test_decontaminate import words
from tests.llm.test_jaccard import slow_groups
from tests.llm.test_suffixes import slow as slow_repeats

SF = "/root/testdata/sf0.001"
ORDER = ["quality", "near_duplicates", "repeats", "benchmark", "packing"]


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ORDER
    docs, tables = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    tables["input"] = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns
            tables[name] = {r.doc_id: r for r in docs.collect()}
    # 1: what the model accepts
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marked = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in tables["input"]}
    right = [(i in tables["quality"]) == (q == 1) for i, q in marked.items()]
    assert sum(right) / len(right) > 0.9
    # 2: one of each group of texts with a similarity of 0.8 or more
    comp = slow_groups([(i, r.text) for i, r in tables["quality"].items()])
    assert set(tables["near_duplicates"]) == {i for i in comp if comp[i] == i}
    # 3: repeats are gone
    before = [(i, (r.text or "").encode()) for i, r in tables["near_duplicates"].items()]
    want = slow_repeats(before, 50)
    assert set(tables["repeats"]) == {i for i, _ in before}
    for i, t in before:
        text = tables["repeats"][i].text
        assert tables["repeats"][i].n_chars == len(text)
        assert len(text.encode()) <= len(t) - want[i][1]
        if want[i][1] == 0:
            assert text.encode() == t
        elif hashlib.sha256(text.encode()).hexdigest() != want[i][3]:
            assert len(text.encode()) >= len(t) - want[i][1] - 6 * want[i][2]
    # 4: no benchmark passage is left
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 5]
    hit = {d for d, _ in slow_overlaps([(i, r.text) for i, r in tables["repeats"].items()], items)}
    assert set(tables["benchmark"]) == set(tables["repeats"]) - hit
    # 5: pieces rebuild the ids
    encoder = tokens.Encoder(tokens.default_tokenizer())
    by_doc = defaultdict(list)
    for r in docs.collect():
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(tables["benchmark"])
    for i, r in tables["benchmark"].items():
        ids, at = encoder.encode([r.text])[0] + struct.pack("<I", 1), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4


def test_run_gives_packed_rows(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == [f.split()[0] for f in packing.SCHEMA.split(", ")] and out.count() > 100


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, None, None, None, "p"), (None, "some words", "en", "s", 10, "p"), (2, "", "en", "s", 0, "p"), (2, "", "en", "s", 0, "p"), (3, "word " * 50000, "en", "s", 250000, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, part string"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
        docs.collect()
    assert quality.accepted(spark.createDataFrame(rows, schema), quality.constant(0.9)).count() == 5
