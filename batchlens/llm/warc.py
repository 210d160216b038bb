"""WARC archives of pages: writing with segmentation and chunked framing, and reading back by segment reassembly.

Writing: every page becomes a `response` record whose block is an HTTP response with its payload (the html in UTF-8) in
chunked transfer framing, or a `revisit` record where the same payload is stored under a smaller page id. A block
longer than a segment is cut: the record holds the first segment and continuation records the others, with the origin's
record id, their segment number and, on the last, the total length. Records are written as they are into gzipped files
of a bounded number of records, so that a file never holds more than records times segment length.

Reading: files are parsed into records. Continuation records are grouped by the origin identifier and ordered by
segment number in a sorted shuffle that one reader streams through, so a page is in memory and never a group of pages.
The total length is verified, the HTTP header is taken off and chunked framing decoded. A record that misses segments,
has a wrong length or broken framing comes back with `complete` false and no payload.

Nulls and odd input: null html is an empty payload; a null or repeated page_id is kept as it is. Of rows with equal
payloads all with the least page_id are responses; if no row has a page_id, all are. Very long pages are stored whole,
in segments. Payloads may hold anything, record markers included, as lengths alone delimit records. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import partitions, scratch_path, stage, table

#: Bytes of a block that one record holds, bytes of a chunk, records of a file, and the least payload that is revisited.
SEGMENT, CHUNK, RECORDS, LEAST = 16_384, 4_096, 2_048, 0
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body. Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response. Raises ValueError where it is broken."""
    end = block.index(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in block[:end].split(b"\r\n")[1:])}
    body = block[end + 4 :]
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its very last line feed, which the writer of lines adds."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError("no record where one should start")
        end = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def unzipped(data: bytes) -> bytes:
    """An archive's bytes, of any number of gzip members or plain."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) + data


def write(spark: SparkSession, pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """Write the archives of pages (page_id, url, html) below path."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Payloads that come more than once, with the page that holds them: narrow, and joined as its written size allows.
    narrow = rows.filter(F.octet_length("html") >= least).select("sha", "page_id")
    twice = narrow.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("holder")).filter("n > 1 AND holder IS NOT NULL").drop("n")
    rows = rows.join(stage(spark, twice, "warc-twice"), "sha", "left")
    rows = rows.withColumn("holder", F.when((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            html = batch.column("html").cast(pa.binary())
            for page_id, url, holder, payload in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("holder").to_pylist(), html.to_pylist(), strict=True):
                row += 1
                name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{part}/{row}')}>"
                fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A"))]
                fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", len(payload))]
                fields += [("X-Page-Id", page_id)] if page_id is not None else []
                if holder is not None:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    out.append(record([("WARC-Type", "revisit"), ("WARC-Profile", profile), ("X-Refers-To-Page", holder), *fields], b""))
                    continue
                block = HTTP + chunked(payload)
                if len(block) <= segment:
                    out.append(record([("WARC-Type", "response"), *fields], block))
                    continue
                out.append(record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment]))
                cuts = range(segment, len(block), segment)
                for number, at in enumerate(cuts, 2):
                    more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{part}/{row}/{number}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
                    more += [("WARC-Segment-Total-Length", len(block))] if at == cuts[-1] else []
                    out.append(record(more, block[at : at + segment]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = rows.select("page_id", "url", "holder", "html").mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


PIECE = "origin string, number int, total long, page_id long, record_type string, digest string, length long, refers_to long, block binary"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below path, each with the id of the record it belongs to."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                out = []
                for fields, block in records(unzipped(data.as_py())):
                    whole = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                    out.append((origin, whole("warc-segment-number"), whole("warc-segment-total-length"), whole("x-page-id"), fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:"), whole("x-payload-length"), whole("x-refers-to-page"), block))
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                for at in range(0, len(out), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 500]), kinds, strict=True)], [c.split()[0] for c in PIECE.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, PIECE)


READ = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, segments int, complete boolean, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: READ, with the payload of responses put together again."""
    dealt = pieces(spark, path).repartition(max(partitions(spark), 1), "origin").sortWithinPartitions("origin", F.coalesce("number", F.lit(1)))

    def joined(group: list[dict]) -> tuple:
        first = group[0]
        if first["record_type"] == "revisit":
            return first["page_id"], "revisit", first["length"], first["digest"], first["refers_to"], 1, True, None
        block, last, payload = b"".join(p["block"] for p in group), group[-1], None
        whole = len(group) == 1 and first["number"] is None or [p["number"] for p in group] == list(range(1, len(group) + 1)) and last["total"] == len(block)
        if whole and first["record_type"] == "response":
            try:
                payload = http_payload(block)
            except ValueError:
                payload = None
        good = payload is not None and digest(payload) == first["digest"]
        return first["page_id"], first["record_type"], len(payload) if good else first["length"], first["digest"], None, len(group), good, payload if good else None

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        group: list[dict] = []
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if group and row["origin"] != group[0]["origin"]:
                    out.append(joined(group))
                    group = []
                group.append(row)
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
        if group:
            out.append(joined(group))
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(reassemble, READ)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(spark, table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "complete")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS x,
    CAST(strlen(html) + ceil(strlen(html) / 4096.0) * 4 + list_sum(list_transform(range(0, CAST(ceil(strlen(html) / 4096.0) AS BIGINT)), lambda i: strlen(format('{:x}', least(4096, strlen(html) - 4096 * i))))) AS BIGINT) AS framed FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS dig FROM h),
m AS (SELECT x, min(page_id) AS holder FROM b GROUP BY x)
SELECT b.page_id, n AS payload_bytes, dig AS payload_digest, CASE WHEN b.page_id IS NOT DISTINCT FROM holder OR holder IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id IS DISTINCT FROM holder THEN holder END AS refers_to,
  CASE WHEN b.page_id IS DISTINCT FROM holder AND holder IS NOT NULL THEN 1 ELSE CAST(ceil((coalesce(framed, 0) + 5 + 87) / 16384.0) AS INTEGER) END AS segments, true AS complete
FROM b JOIN m USING (x)
"""
