import random
import struct
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestream.llm import packing, tokens


def check(lengths, capacity):
    seqs = packing.pack(lengths, capacity)
    seen = defaultdict(list)
    for s in seqs:
        n = sum(p[2] for p in s)
        assert n == capacity or (0 < n < capacity and n & (n - 1) == 0)
        for d, start, size in s:
            assert size > 0
            seen[d].append((start, size))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[d]):
            assert start == at
            at += size
        assert at == n
    return seqs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.sampled_from([8, 64, 100]))
def test_every_token_once_and_nothing_padded(lengths, capacity):
    check(lengths, capacity)


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    windows = packing.differencing(sizes, 20)
    loads = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400))
    assert max(loads) - min(loads) <= 3


def test_window_count_rises_when_capacity_is_exceeded():
    sizes = [60, 60, 60]  # 180 tokens would fit two windows of 100 only by cutting
    windows = packing.near_equal(sizes, 100)
    assert len(windows) == 3


def test_words_in_a_row_are_the_texts_ids():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["Hello, World! don't 12", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "Ünḯcode é　x\x85y\x1cz", "tab\tline\nret\r\n", "q" * 3000, "", None, "ΑΣ ς İ"]
    got = tokens.Encoder(tokens.default_tokenizer()).encode(texts)
    for x, y in zip(texts, got):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert y == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_rebuild_documents(spark):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma-ray", "Δ", "12"]) for _ in range(rng.randint(0, 900))), "x") for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (None, "one", "x")]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, start string"), capacity=256, block=16).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
