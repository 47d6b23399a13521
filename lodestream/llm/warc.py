"""WARC archives: records written through Spark, revisits, segments, chunked framing.

Writing. Every page becomes a record. Of pages with equal payloads of at least
`revisit_from` bytes the smallest page_id is a response, the rest revisit it.
A payload longer than `segment` bytes is split into a first record and
continuation records, which carry the origin's id and their number; the last
gives the total length. HTTP bodies are sent in chunked transfer coding.
Archives are text files whose line ends are the two line breaks that close a
WARC record, so Spark's own committer writes them, on any file system, and a
lost task is redone alone. Continuations go to whatever file they fall in.

Reading. Whole archive files (bounded in records) are parsed by
Content-Length; continuation records are grouped by origin id, ordered by
segment number, checked against the total length, joined, and the chunked
framing is decoded. Groups are one record's segments, never more.

Defined results: a null payload is empty; a null page_id is written and read
back as null, and its record never is the target of a revisit; repeated
page_ids give as many records, each a response if the id is the smallest of its
payload; an empty table writes an empty archive and reads no rows; extra columns
are ignored; a segment missing or of the wrong length raises an error.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

END = "\r\n\r\n"
REVISIT_FROM = 100
SEGMENT = 16_384
CHUNK = 4_096
RECORDS_PER_FILE = 2_000
STAMP = "2024-01-01T00:00:00Z"


def record_id(page_id, row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{row}')}>"


def cut(text: str, most: int) -> list[str]:
    """Pieces of at most `most` UTF-8 bytes (4 at least), cut between characters."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    return out


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def chunked(text: str, chunk: int = CHUNK) -> str:
    return "".join(f"{size(p):x}\r\n{p}\r\n" for p in cut(text, chunk)) + "0\r\n\r\n"


def dechunk(raw: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = raw.index(b"\r\n", at)
        n = int(raw[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        at = end + 2
        if raw[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is not closed by a line break")
        out.append(raw[at : at + n])
        at += n + 2


def record(kind: str, fields: list[tuple[str, str]], block: str) -> str:
    head = [("WARC-Type", kind), *fields, ("WARC-Date", STAMP), ("Content-Length", str(size(block)))]
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block


def one_line(s) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in s or "")


def page_records(page_id, url, html: str, digest: str, refers_to, row: str, segment: int, refers_url=None) -> list[str]:
    """The records of one page, without the line breaks that close each."""
    origin = record_id(page_id, row)
    own = [("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    own += [("X-Page-Id", str(page_id))] if page_id is not None else []
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        fields = [("WARC-Record-ID", origin), *own, ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", one_line(refers_url)), ("WARC-Refers-To-Date", STAMP), ("X-Refers-To-Page", str(refers_to)), ("Content-Type", "application/http; msgtype=response")]
        return [record("revisit", fields, head)]
    block = head + chunked(html)
    parts = cut(block, segment) if size(block) > segment else [block]
    first = [("WARC-Record-ID", origin), *own, ("Content-Type", "application/http; msgtype=response")]
    out = [record("response", first + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), parts[0])]
    for n, part in enumerate(parts[1:], 2):
        fields = [("WARC-Record-ID", record_id(page_id, f"{row}/{n}")), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n))]
        out.append(record("continuation", fields + ([("WARC-Segment-Total-Length", str(size(block)))] if n == len(parts) else []), part))
    return out


def write(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, segment: int = SEGMENT, per_file: int = RECORDS_PER_FILE) -> None:
    """pages (page_id, url, html) -> WARC files under path."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= revisit_from).select("page_id", "url", "digest")
    shared = long.groupBy("digest").agg(F.min("page_id").alias("target"), F.min_by("url", "page_id").alias("target_url"), F.count(F.lit(1)).alias("copies"))
    shared = shared.where("copies > 1 and target is not null").select("digest", "target", "target_url")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        row = 0
        for b in batches:
            out = []
            for page_id, url, text, digest, target, target_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "target", "target_url"))):
                refers = target if target is not None and page_id != target else None
                out += page_records(page_id, url, text, digest, refers, f"{task}-{row}", segment, target_url)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    all_rows = rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", "target", "target_url")
    # Spark closes each record with the two line breaks
    all_rows.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse(raw: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in lines[1:])
        n = int(head[b"Content-Length"])
        block = raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) != n or raw[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is shorter than its Content-Length")
        yield head, block


def payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


RECORD = "kind string, page_id long, refers_to long, digest string, origin string, segment int, total long, block binary"


def records(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """Every record of the archives under path whose names match; block is null for revisits. Gzip files may have many members."""

    def run(batches):
        import gzip

        for b in batches:
            for raw in b.column("content").to_pylist():
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                rows, held = [], 0
                for head, block in parse(raw):
                    kind = head[b"WARC-Type"].decode()
                    number = lambda k: int(head[k]) if k in head else None
                    origin = head[b"WARC-Record-ID"] if kind != "continuation" else head[b"WARC-Segment-Origin-ID"]
                    rows.append((kind, number(b"X-Page-Id"), number(b"X-Refers-To-Page"), head.get(b"WARC-Payload-Digest", b"").decode().removeprefix("sha256:") or None, origin.decode(), number(b"WARC-Segment-Number"), number(b"WARC-Segment-Total-Length"), None if kind == "revisit" else block))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    return files.mapInArrow(run, RECORD)


KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], [f.split()[0] for f in RECORD.split(", ")])


def read(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """(page_id, payload, digest, refers_to): responses with payloads, reassembled and decoded; revisits without."""
    all_records = records(spark, path, pattern)

    def whole(batches):
        for b in batches:
            digests, blocks = b.column("digest").to_pylist(), b.column("block").to_pylist()
            out = [None if x is None else payload(x) for x in blocks]
            for want, got in zip(digests, out):
                if got is not None and want != hashlib.sha256(got).hexdigest():
                    raise ValueError("a payload differs from its digest")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.binary()), b.column("digest"), b.column("refers_to")], ["page_id", "payload", "digest", "refers_to"])

    single = all_records.where("segment is null").select("page_id", "digest", "refers_to", "block")
    parts = (
        all_records.where("segment is not null")
        .groupBy("origin")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max("digest").alias("digest"),
            F.max("total").alias("total"),
            F.max("segment").alias("last"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
        )
    )
    block = F.concat_ws("", F.transform("s", lambda x: F.hex(x["block"])))
    parts = parts.withColumn("block", F.unhex(block))
    fits = (F.size("s") == F.col("last")) & (F.octet_length("block") == F.col("total"))
    parts = parts.select("page_id", "digest", F.lit(None).cast("long").alias("refers_to"), F.when(fits, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), "origin")).cast("binary")).alias("block"))
    return single.unionByName(parts).mapInArrow(whole, "page_id long, payload binary, digest string, refers_to long")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives and returns what they hold: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or scratch(spark)
    write(pages, path)
    back = read(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("n"), "digest", "refers_to")
    own = back.where("refers_to is null").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), "refers_to")
    target = own.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= REVISIT_FROM).distinct()
    again = back.where("refers_to is not null").select("page_id", "refers_to", F.col("digest").alias("payload_digest")).join(target, ["refers_to", "payload_digest"], "left")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
