"""WARC archives with resolved revisits.

Headers (digest, page id, address) are grouped by payload digest first; only the smallest id of each
repeated payload travels on.  While those headers are few, they go to the pages and no payload moves;
beyond that both sides meet by digest, where a digest's pages are dealt to ``SALTS`` tasks and payloads
that are never revisited are not matched at all.  A page is written as a ``response`` record with its
payload or as a ``revisit`` record that names the original.

Archives are WARC/1.1 with one gzip member for each record, as access by record needs it, written and
committed by Spark's text writer: each row is a member without its last byte, which the writer adds as
its line end (the size field of a gzip member ends with a zero byte below 16 MB; a larger record is
followed by an empty member, which does so too).  They are read back member by member.

Defined cases: a null payload is an empty one; payloads under ``least_bytes`` are always responses;
a page without an id never is an original where another has one; rows that repeat the smallest id
of a payload are all responses, with the smallest address as the original's; repeated page ids give
records with ids of their own only if their payloads differ; a very long payload is one record (of
under 2 GB); an empty table gives no archive; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migcheck.llm.shared import BROADCAST_ROWS, is_small, materialise, sliced

#: Tasks that the pages of one digest are dealt to where they meet its original by a shuffle.
SALTS = 16

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def resolve(pages: DataFrame, least_bytes: int = 100, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload (null for revisits) with digest, length, record type and the original's id and address.

    Up to ``most_rows`` headers of repeated payloads are broadcast.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    # partial aggregates: one row for each digest and task, however many copies there are
    known = pages.select("page_id", "url", F.sha2(F.coalesce(F.col("html").cast("binary"), F.lit(b"")), 256).alias("original_digest"), F.octet_length("html").alias("size"))
    known = known.where(F.col("size") >= least_bytes)
    header = F.struct(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"))
    originals = (
        known.groupBy("original_digest")
        .agg(F.count("*").alias("copies"), F.min(F.when(F.col("page_id").isNotNull(), header)).alias("original"))
        .where("copies > 1 AND original IS NOT NULL")
        .select("original_digest", F.col("original.id").alias("first_id"), F.col("original.url").alias("first_url"))
    )
    originals = materialise(originals, "originals")
    matched = F.col("payload_digest") == F.col("original_digest")
    if is_small(originals, most_rows):
        originals = F.broadcast(originals)
    else:
        # pages that cannot be revisits get a key of their own, the others one of the salted keys of their digest
        key = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(F.hash("page_id").cast("string"))
        rows = rows.withColumns({"meet": key, "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
        originals = originals.withColumn("original_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = (F.col("meet") == F.col("original_digest")) & (F.col("salt") == F.col("original_salt"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(originals, matched, "left").select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "payload_bytes",
        "payload_digest",
        F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(again, F.col("first_url")).alias("refers_to_url"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("null")), F.lit("\r\n"))


def _page_uri(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.left(digest, F.lit(16)), F.lit(">"))


def _address(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\r\n ]", "%20")


def records(resolved: DataFrame) -> DataFrame:
    """The bytes of each record in two binary columns, ``head`` and ``payload`` (null for revisits)."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.octet_length(http) + F.coalesce(F.octet_length("payload"), F.lit(0))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _page_uri(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Target-URI", _address(F.col("url"))),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", F.lit(PROFILE)),
                _line("WARC-Refers-To", _page_uri(F.col("refers_to"), F.col("payload_digest"))),
                _line("WARC-Refers-To-Target-URI", _address(F.col("refers_to_url"))),
                _line("WARC-Refers-To-Date", date),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return resolved.select(F.encode(head, "UTF-8").alias("head"), "payload")


GZIP = 16 + zlib.MAX_WBITS


def member(*parts: bytes) -> bytes:
    """The parts as one gzip member, which ends with a zero byte (or an empty member behind it does)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    out = b"".join([*(packer.compress(p) for p in parts), packer.flush()])
    return out if out[-1] == 0 else out + zlib.compressobj(6, zlib.DEFLATED, GZIP).flush()


def write(resolved: DataFrame, path: str, records_per_file: int = 1_000) -> None:
    """Write archives of at most ``records_per_file`` records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            packed = [member(h, p or b"", b"\r\n\r\n")[:-1] for h, p in zip(batch["head"].to_pylist(), batch["payload"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["member"])

    # the cast to a string keeps the bytes as they are
    members = records(resolved).mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def members(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members one by one."""
    at = 0
    while at < len(data):
        unpacker, parts = zlib.decompressobj(GZIP), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            piece = data[at : at + step]
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        if content := b"".join(parts):
            yield content


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(data: bytes) -> tuple:
    """The fields of :data:`RECORD` from the bytes of one record."""
    body = data.index(b"\r\n\r\n") + 4
    head = {k.lower(): v for k, v in HEADER.findall(data, 0, body)}
    end = body + int(head[b"content-length"])
    http = data.index(b"\r\n\r\n", body, end) + 4
    inner = {k.lower(): v for k, v in HEADER.findall(data, body, http)}
    kind, payload = head[b"warc-type"].decode(), data[http:end]
    digest = head[b"warc-payload-digest"].partition(b":")[2].decode()
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(inner[b"content-length"])):
        raise ValueError(f"damaged record of {head[b'warc-record-id'].decode()}")
    return (
        _page_id(head[b"warc-record-id"]),
        head[b"warc-target-uri"].decode(errors="replace"),
        kind,
        int(inner[b"content-length"]),
        digest,
        _page_id(head[b"warc-refers-to"]) if kind == "revisit" else None,
        payload if kind == "response" else None,
    )


def _page_id(uri: bytes) -> int | None:
    number = uri.removeprefix(b"<urn:page:").partition(b":")[0]
    return None if number == b"null" else int(number)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of :data:`RECORD` from all archives in a folder, one record in memory at a time; responses are held against their digests."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for record in members(memoryview(content.as_buffer())):
                    rows.append(parse(record))
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=RECORD.names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=RECORD.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)
