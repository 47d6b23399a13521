import gzip
import hashlib
import os

import pytest

from lodestream.llm import warc


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


PAGES = [
    (1, "http://a/1", "<p>" + "é" * 30000 + "</p>"),
    (2, "http://a/2", "short"),
    (3, "http://a/3", "short"),
    (5, "http://a/5", "<b>repeated page</b>\r\n\r\n" * 20),
    (4, "http://a/4", "<b>repeated page</b>\r\n\r\n" * 20),
    (6, "http://a/6", None),
    (7, None, ""),
    (8, "bad\r\nurl", "<p>" + "é" * 30000 + "</p>"),
    (9, "http://a/9", "0\r\n\r\nWARC/1.0\r\n" * 40),
]


def expected(rows):
    seen = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            seen[h] = min(i, seen.get(h, i))
    out = {}
    for i, _, h in rows:
        b = (h or "").encode()
        t = seen.get(h)
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if t not in (None, i) else "response", t if t not in (None, i) else None)
    return out


def test_round_trip(spark, tmp_path):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, PAGES), f"file://{tmp_path}/w").collect()}
    assert got == expected(PAGES)


def test_payloads_come_back_byte_by_byte(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(frame(spark, PAGES), path, segment=1000, per_file=2)
    back = {r.page_id: bytes(r.payload) for r in warc.read(spark, path).where("refers_to is null").collect()}
    want = expected(PAGES)
    assert back == {i: (h or "").encode() for i, _, h in PAGES if want[i][2] == "response"}
    kinds = {r.kind for r in warc.records(spark, path).select("kind").distinct().collect()}
    assert kinds == {"response", "revisit", "continuation"}


def test_archives_are_records_closed_by_two_line_breaks(spark, tmp_path):
    warc.write(frame(spark, PAGES[1:3]).coalesce(1), f"file://{tmp_path}/w")
    raw = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.startswith("part-"))
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: ") and raw.endswith(b"0\r\n\r\n\r\n\r\n")
    assert [h[b"WARC-Type"] for h, _ in warc.parse(raw)] == [b"response", b"response"]


def test_chunked_framing():
    for t in ("", "a", "é" * 5000, "x" * 4096, "\r\n0\r\n\r\n"):
        assert warc.dechunk(warc.chunked(t, 7).encode()) == t.encode()
    assert all(len(p.encode()) <= 7 for p in warc.cut("aé天😀" * 20, 7))
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcX\r\n0\r\n\r\n")


def test_a_missing_segment_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    records = warc.page_records(1, "u", "z" * 3000, hashlib.sha256(b"z" * 3000).hexdigest(), None, "0", 1000)
    spark.createDataFrame([(r,) for k, r in enumerate(records) if k != 1], "value string").write.option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, path).collect()


def test_odd_ids_and_empty_table(spark, tmp_path):
    rows = [(None, "u", "y" * 200), (3, "u", "y" * 200), (3, "v", "y" * 200)]
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, rows), f"file://{tmp_path}/a").collect())
    assert got == [(-1, "response", None), (3, "response", None), (3, "response", None)] or got == [(-1, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert warc.round_trip(frame(spark, []), f"file://{tmp_path}/b").collect() == []
