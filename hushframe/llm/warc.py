"""WARC archives with content-addressed payloads.

Writing: one record for each page; the payload of equal pages is in the record with the smallest page_id,
the others are revisits. Reading: archives are parsed by their content lengths. The store keeps each
payload once under its SHA-256, apart from the exact record headers, and records are rebuilt by a join.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, if_few, shared_dir

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
#: Bytes of one archive file, about, or one record if that is larger; records are written by classes of size, so that
#: the largest of a class says how many of them a file may hold.
FILE_BYTES = 64_000_000
CLASSES = (32_000, 1_000_000)
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(value: Column) -> Column:
    """SHA-1 in upper-case base32: 5 hex digits give 4 characters."""
    digest = F.sha1(value)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), (F.shiftright(bits, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"[\r\n]", " ")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a WARC record for every row of pages (page_id, url, html) to gzip files under path.

    Null html is an empty payload, a null url leaves out the target, a null page_id comes after all others; rows
    that repeat a page_id with the same payload are all written as that page's record. Payloads below min_bytes are always written
    in full. Other columns are not read; an empty table gives an archive without records.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha256": F.sha2("payload", 256), "n": F.octet_length("payload")})
    p = p.withColumn("class", sum(F.when(F.col("n") >= c, 1).otherwise(0) for c in CLASSES))
    narrow = cut(p.select("page_id", "sha256", "n", "class"), "digests")
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id"))["page_id"]
    # A payload that no other record has needs no look at the others: only digests that repeat meet the records, which
    # then travel only if those digests are too many to be sent to all.
    shared = cut(narrow.where(F.col("n") >= min_bytes).groupBy("sha256", "n").agg(first.alias("first_id"), F.count("*").alias("times")).where("times > 1").drop("times"), "shared")
    p = p.join(if_few(shared, shared.count()), ["sha256", "n"], "left").withColumn("revisit", F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    name = lambda value: F.concat(F.lit("<urn:page:"), _one_line(value), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.concat(F.lit("<urn:sha256:"), F.col("sha256"), F.lit(">")))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", _one_line(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))),
        field("Payload-SHA256", F.col("sha256")),
        F.when(F.col("revisit"), F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", name(F.col("first_id"))))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(header, http, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    largest = {r["class"]: r["n"] for r in narrow.groupBy("class").agg(F.max("n").alias("n")).collect()}
    for c, n in sorted(largest.items()) or [(0, 0)]:
        most = max(1, FILE_BYTES // (max(n, 32_000) + 1))
        out = p.where(F.col("class") == c).select(record.alias("value")).write.mode("append").option("maxRecordsPerFile", most)
        out.option("compression", "gzip").option("lineSep", _END).text(path)


@dataclass
class Record:
    header: bytes
    fields: dict[str, str]
    http: bytes
    payload: bytes


def parse(data: bytes) -> Iterator[Record]:
    """The records of an uncompressed archive; anything that is not a whole record is an error."""
    at, end = 0, _END.encode()
    while at < len(data):
        stop = data.index(end, at) + len(end)
        header = data[at:stop]
        lines = header.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = dict(x.split(": ", 1) for x in lines[1:] if x)
        at = stop + int(fields["Content-Length"])
        block = data[stop:at]
        if data[at : at + len(end)] != end:
            raise ValueError("a record does not end where its length says")
        at += len(end)
        head = block.index(end) + len(end) if block.startswith(b"HTTP/") else 0
        yield Record(header, fields, block[:head], block[head:])


def _records(with_payload: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                data = zlib.decompress(cell.as_buffer(), 31)
                found = [x for x in parse(data) if not with_payload or x.fields["WARC-Type"] == "response"]
                if with_payload:
                    digest = [hashlib.sha256(x.payload).hexdigest() for x in found]
                    for x, d in zip(found, digest, strict=True):
                        if d != x.fields["Payload-SHA256"]:
                            raise ValueError(f"payload of {x.fields['WARC-Record-ID']} does not match its digest")
                    columns = {"sha256": digest, "payload": [x.payload for x in found]}
                    types = [pa.string(), pa.binary()]
                else:
                    page = lambda v: m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", v or "")) else None
                    columns = {
                        "page_id": [page(x.fields["WARC-Record-ID"]) for x in found],
                        "record_type": [x.fields["WARC-Type"] for x in found],
                        "refers_to": [page(x.fields.get("WARC-Refers-To")) for x in found],
                        "digest": [x.fields["WARC-Payload-Digest"].removeprefix("sha1:") for x in found],
                        "sha256": [x.fields["Payload-SHA256"] for x in found],
                        "header": [x.header for x in found],
                        "http": [x.http for x in found],
                    }
                    types = [pa.string()] * 5 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], list(columns))

    return rows


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of the archives under path.

    headers: a row for each record with its exact header; payloads: (sha256, payload, n, sha1), each payload once,
    with digests taken from the bytes read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    headers = cut(files.mapInArrow(_records(False), "page_id string, record_type string, refers_to string, digest string, sha256 string, header binary, http binary"), "headers")
    stored = files.mapInArrow(_records(True), "sha256 string, payload binary")
    # Only rows that repeat a page_id make two records with one payload; without them no payload need be shuffled.
    if not headers.where("record_type = 'response'").groupBy("sha256").count().where("count > 1").isEmpty():
        stored = stored.dropDuplicates(["sha256"])
    measured = stored.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": sha1_base32(F.col("payload"))})
    return headers, cut(measured, "payloads")


def rebuild(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """headers with payload, n, sha1 and, as record, the bytes of the original record; every header finds its payload."""
    full = headers.join(payloads, "sha256", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    checked = F.when(F.col("sha1") == F.col("digest"), F.concat("header", "http", body)).otherwise(F.raise_error(F.concat(F.lit("no payload with digest "), F.col("digest"))).cast("binary"))
    return full.withColumn("record", checked)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives, read them back and rebuild the records: (page_id, payload_bytes, payload_digest,
    record_type, refers_to) and the rebuilt parts, one row for each row of pages; see write_archives for edge cases."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    headers, payloads = read_archives(spark, path)
    kind = pages.schema["page_id"].dataType
    rebuilt = rebuild(headers, payloads)
    return rebuilt.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("n", "payload_bytes")
