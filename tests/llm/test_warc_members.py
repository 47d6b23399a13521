import gzip
import os

from lodestream.llm import warc
from tests.llm.test_warc import PAGES, frame


def test_every_gzip_member_of_a_foreign_archive(spark, tmp_path):
    warc.write(frame(spark, PAGES[1:3]).coalesce(1), f"file://{tmp_path}/w")
    raw = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.startswith("part-"))
    cut = raw.index(b"WARC/1.0\r\n", 1)
    os.mkdir(tmp_path / "foreign")
    (tmp_path / "foreign" / "crawl.warc.gz").write_bytes(gzip.compress(raw[:cut]) + gzip.compress(raw[cut:]))
    got = warc.read(spark, f"file://{tmp_path}/foreign", "*.warc.gz").collect()
    assert {r.page_id: bytes(r.payload) for r in got} == {i: (h or "").encode() for i, _, h in PAGES[1:3]}
