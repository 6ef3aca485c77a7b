"""WARC: write captures as archives, read them back, and assemble each capture's records.

A capture is three records: a request, a response (or, for a payload that an earlier page has, a revisit) and a
metadata record; the first and last name the second in WARC-Concurrent-To. Each record is a gzip member of its own. A
task fills archives of about ARCHIVE_BYTES; an archive is one line of Spark's text writer, and the line separator is
the last byte of its last member. So any file system that Spark writes to will do, and its commit protocol covers lost
executors. Reading inflates an archive bit by bit and follows each record's Content-Length, so that payloads may hold
anything and memory holds one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import no_nulls, slices, work_path

ARCHIVE_BYTES = 32 << 20
PART = 1 << 16  # bytes that are inflated at once
MEMBER = 8 << 20  # a longer record is several members, so that the size of each ends in a zero byte
HELD = 8 << 20  # bytes of records to a batch
DATE = "2024-01-01T00:00:00Z"


def _header(kind: str, rid: str, url: str, body: bytes, ctype: str, more: str = "") -> str:
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{rid}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {url}\r\n{more}"
            f"Content-Type: {ctype}\r\nContent-Length: {len(body)}\r\n\r\n")  # fmt: skip


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _page_records(page: int, url: str, html: str, first: int | None) -> Iterator[str]:
    payload = html.encode()
    peer = f"WARC-Concurrent-To: <urn:page:{page}:capture>\r\n"
    about = f"WARC-Payload-Digest: sha1:{digest_of(payload)}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    if first is None:
        yield _header("response", f"{page}:capture", url, (head + html).encode(), "application/http; msgtype=response", about) + head + html
    else:
        about += f"WARC-Refers-To: <urn:page:{first}:capture>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        yield _header("revisit", f"{page}:capture", url, head.encode(), "application/http; msgtype=response", about) + head
    body = f"GET {url} HTTP/1.1\r\n\r\n"
    yield _header("request", f"{page}:request", url, body.encode(), "application/http; msgtype=request", peer) + body
    body = f"payload-bytes: {len(payload)}\r\n"
    yield _header("metadata", f"{page}:metadata", url, body.encode(), "application/warc-fields", peer) + body


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives without their last byte, which is zero."""
    held, size = [], 0
    give = lambda: pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)[:-1]], pa.binary())})
    for x in slices(batches):
        for page, url, html, first in zip(*(x.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id")), strict=True):
            for record in _page_records(page, _clean(url), html, first):
                data = (record + "\r\n\r\n").encode()
                for at in range(0, len(data), MEMBER):
                    held.append(gzip.compress(data[at : at + MEMBER], 6, mtime=0))
                    size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes the captures of rows (page_id, url, html) to gzip archives in `path`. Of pages with equal payloads of
    at least least_bytes bytes the one with the smallest page_id is a response and the others are revisits. Null
    html: an empty payload; null url: an empty address. Rows without page_id aren't captures and are left out; a
    page_id is one capture, so rows beyond the first of a page_id read back as the same capture. Other columns are
    ignored; no rows make no archive."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", no_nulls(F.col("html")).alias("html"))
    keys = rows.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1("html").alias("sha"))
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # payloads meet by page_id, never by digest: that of an error page may be a third of all
    later = keys.join(first, "sha").where("first_id < page_id").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first_id").distinct()
    rows = rows.join(later, (rows["page_id"] == later["p"]) & (F.sha1("html") == later["s"]), "left").select("page_id", "url", "html", "first_id")
    archives = rows.mapInArrow(_archives, "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    at, member = 0, zlib.decompressobj(wbits=31)
    while at < len(data):
        part = data[at : at + PART]
        yield member.decompress(part)
        at += len(part) - len(member.unused_data)
        if member.eof:
            member = zlib.decompressobj(wbits=31)


def _parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    held = bytearray()
    for part in parts:
        held += part
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            fields = (x.partition(":") for x in held[at:end].decode().split("\r\n")[1:])
            head = {k: v.strip() for k, _, v in fields}
            stop = end + 4 + int(head["Content-Length"])
            if len(held) < stop + 4:
                break
            yield head, bytes(held[end + 4 : stop])
            at = stop + 4
        del held[:at]
    if held:
        raise ValueError("an archive ends inside a record")


def _id(text: str | None) -> str | None:
    return text.strip("<>") if text else None


RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives in `path`, one row each; a field that a record lacks is null. Archives of any gzip
    members will do; a file is a row of binaryFile, so it stays under 2 GB. A folder without archives has no rows; an
    archive that ends inside a record is an error."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def row(head: dict[str, str], block: bytes) -> tuple:
        payload, n, kind = None, None, head["WARC-Type"]
        digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            n, digest = len(payload), digest_of(payload)
        elif kind == "metadata":
            said = dict(y.split(": ", 1) for y in block.decode().split("\r\n") if y)
            n = int(said["payload-bytes"]) if "payload-bytes" in said else None
        return kind, _id(head.get("WARC-Record-ID")), _id(head.get("WARC-Concurrent-To")), _id(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), digest, n, payload if with_payload else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for data in x.column("content").to_pylist():
                got, size = [], 0
                give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                for head, block in _parse(_inflated(data)):
                    got.append(row(head, block))
                    size += len(block) if with_payload else 200
                    if size >= HELD:
                        yield give(got)
                        got, size = [], 0
                if got:
                    yield give(got)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, url and structs request, response, metadata; response is the response
    or revisit record. The records meet by record_id, or by the record_id that they are concurrent to. A record
    without a peer gives a row whose other structs are null; of repeated records the one with the greatest fields
    stays. Records without either identifier are no capture's and are left out. Other columns are ignored. No rows in,
    none out."""
    key = F.coalesce("concurrent_to", "record_id").alias("record_id")
    body = F.struct("type", "uri", "digest", "payload_bytes", "refers_to", "payload")
    of = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), F.col("body")))
    rows = records.select(key, "type", body.alias("body")).where("record_id is not null").groupBy("record_id").agg(
        of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
    return rows.select("record_id", F.coalesce("response.uri", "request.uri", "metadata.uri").alias("url"), "request", "response", "metadata")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):capture$", 1).cast("long")
    rows = assemble(read_records(spark, path, with_payload=False)).where("response is not null")
    return rows.select(
        page("record_id").alias("page_id"), F.col("metadata.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.refers_to").isNotNull(), page("response.refers_to")).alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages WHERE page_id IS NOT NULL),
bits AS (SELECT page_id, h, d, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(d, i, 1))::BIGINT), 4, '0')), '') AS b FROM p),
first AS (SELECT d, min(page_id) AS f FROM p GROUP BY d)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: substr(b, (5 * i + k + 1)::BIGINT, 1)::INT * (16 >> k::INT)))::INT, 1)), '') AS payload_digest,
    CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM bits JOIN first USING (d)"""
