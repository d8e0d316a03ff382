"""WARC archives without repeated payloads, written and read back by Spark.

Of the records with one payload digest the smallest page_id keeps the payload as a response; the others
become revisit records that name it. Only digests and ids are shuffled to decide; the pages then meet
their decision by page_id, and each task writes its records, with fresh headers, as files of gzip
members, one per record, through Spark's text writer. Reading resolves revisit records by a join on
record ids, so the archives alone are enough.

Defined results: a null payload is empty; payloads shorter than ``shortest`` bytes are always
responses; rows that repeat both page_id and payload are the same record, each a response where the
first is one; rows of one page_id with different payloads are decided each by its payload; a null
page_id is written as -1 and is never the original; an empty table gives no record.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CLEANUP, folder, mapped

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
NONE = -1
LEVEL = 3
MEMBER = 1 << 23
CHUNK = 1 << 14
DATE = "2024-01-01T00:00:00Z"


def record_id(page: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}:{digest}')}>"


def record(page: int, url: str, payload: bytes, digest: str, origin: int | None) -> bytes:
    """One WARC record; with an origin a revisit record without the payload."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if origin is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {page}", f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if origin is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(origin, digest)}"]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = status + (payload if origin is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """gzip members of bounded size; the last byte of each (high byte of the size) is zero."""
    out = []
    for at in range(0, len(data), MEMBER):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.append(z.compress(data[at : at + MEMBER]) + z.flush())
    return b"".join(out)


def write(pages: DataFrame, path: str, shortest: int = 100, per_file: int = 4096) -> None:
    """pages(page_id, url, html) to gzip WARC files in a folder."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NONE)).alias("page"), F.sha2(html, 256).alias("digest"), "url", html.alias("payload"))
    headers = source.select("page", "digest", F.octet_length("payload").alias("size")).filter(F.col("size") >= shortest)
    first = headers.groupBy("digest").agg(F.min(F.when(F.col("page") != NONE, F.col("page"))).alias("origin"), F.count("*").alias("n")).filter("n > 1")
    told = headers.join(first, "digest").filter(F.col("page") != F.col("origin")).select("page", "digest", "origin").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page, digest, url, payload, origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(member(record(page, url or "", payload, digest, origin))[:-1])
                size += len(held[-1])
                if size > MEMBER:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    records = mapped(source.join(told, ["page", "digest"], "left").select("page", "digest", "url", "payload", "origin"), run, "record binary")
    spark = pages.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        # the writer ends each line by a zero byte, which is the one that each record lacks
        records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)
    finally:
        spark.conf.set(CLEANUP, before)


def members(data: bytes) -> Iterator[bytes]:
    """Contents of each gzip member of a file."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            chunk = data[at : at + CHUNK]
            if not chunk:
                raise EOFError("a gzip member ends early")
            parts.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a file."""
    held, ready = b"", 0
    for part in members(data):
        held = held + part if held else part
        if len(held) < ready:
            continue
        end = held.index(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        ready = end + 8 + n
        if len(held) >= ready:
            yield fields, held[end + 4 : end + 4 + n]
            held, ready = b"", 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page_id, url, record_type, payload_digest, payload_bytes, record_id, refers_to_record, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for f, block in parse(content.as_py()):
                    page = int(f["X-Page-Id"])
                    held.append((
                        None if page == NONE else page, f.get("WARC-Target-URI"), f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:"),
                        int(f["X-Payload-Length"]), f["WARC-Record-ID"], f.get("WARC-Refers-To"), block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None,
                    ))
                    size += len(block)
                    if size > MEMBER:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "record_id", "refers_to_record", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return mapped(files, run, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, record_id string, refers_to_record string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records with refers_to: for revisits the page_id of the response that they name."""
    originals = records.filter("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    return records.join(originals.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left")


def deduplicated(pages: DataFrame, shortest: int = 100) -> DataFrame:
    """Write the archives to a new shared folder and read them back, revisits resolved."""
    path = folder(pages.sparkSession, "warc")
    write(pages, path, shortest)
    return resolved(read(pages.sparkSession, path))
