"""Operator 5, WARC: a content-addressed archive.

A record's payload bytes are stored once, by SHA-256; the exact header bytes of every record are kept
apart. Records come back whole by a join of both, and a payload that does not have its digest is an error.
Everything here is DataFrame expressions but for the reader of foreign WARC files.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import shared_dir

#: Digits of base 32 as `conv` has them and as RFC 4648 has them. Fixed values.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 40 bits of the hex digest are eight base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _CONV, _RFC)


def records_of(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One narrow record for each page: digests, type, what it refers to, and its exact header bytes; no payload.

    Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id is the response and the
    others revisit it; null ids are the smallest. Rows that repeat this id too are told apart by url,
    and all but one revisit. Payloads are compared by SHA-256 and length. Null html is empty.
    """
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url"), F.sha2(data, 256).alias("sha256"), base32_sha1(data).alias("payload_digest"), F.octet_length(data).cast("long").alias("payload_bytes"))
    heads = rows.groupBy("sha256", "payload_bytes").agg(F.max("page_id").alias("head"))
    same = W.partitionBy("sha256", "page_id").orderBy(F.col("url").asc_nulls_first())
    joined = rows.join(heads, ["sha256", "payload_bytes"])
    first = joined.filter(F.col("page_id").eqNullSafe(F.col("head"))).withColumn("turn", F.row_number().over(same))
    rest = joined.filter(~F.col("page_id").eqNullSafe(F.col("head"))).withColumn("turn", F.lit(2))
    small = F.col("payload_bytes") < least_bytes
    typed = first.unionByName(rest).withColumn("record_type", F.when(small | (F.col("turn") == 1), "response").otherwise("revisit"))
    revisit = F.col("record_type") == "revisit"
    refers = F.when(revisit, F.col("head"))
    date = F.lit("2024-01-01T00:00:00Z")
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), ident(F.col("page_id")), F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), ident(F.col("head")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"), http,
    )
    return typed.select("page_id", header.cast("binary").alias("header"), "sha256", F.col("record_type"), refers.alias("refers_to"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``path/headers`` (a row for each record) and ``path/payloads`` (a row for each distinct payload).

    Headers move as narrow rows. The one page that holds a payload for the archive is found by joining on (page_id,
    SHA-256); only if rows repeat such a page do payloads move once more to drop the repeats.
    """
    headers = records_of(pages, least_bytes)
    headers.write.parquet(f"{path}/headers")
    written = pages.sparkSession.read.parquet(f"{path}/headers")
    kept = written.filter("record_type = 'response'").groupBy("sha256").agg(F.max("page_id").alias("page_id"))
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").alias("own"), data.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    one = own.join(kept, (own["sha256"] == kept["sha256"]) & own["own"].eqNullSafe(kept["page_id"]), "left_semi")
    if least_bytes or written.filter(F.col("record_type") == "revisit").filter(F.col("page_id").eqNullSafe(F.col("refers_to"))).take(1):
        one = one.dropDuplicates(["sha256"])  # rows that repeat a response's id and payload
    one.select("sha256", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: ``page_id, record_type, refers_to, header, payload, record`` (exact bytes) — payload and record's body only for responses."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload without its digest: "), F.col("sha256")))))
    full = headers.filter("record_type = 'response'").join(checked, "sha256")
    bare = headers.filter("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    end = F.lit("\r\n\r\n").cast("binary")
    return full.unionByName(bare).withColumn("record", F.concat("header", F.coalesce("payload", F.lit("").cast("binary")), end))


def archive_digest(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archive to the shared folder, read it back and return what each page's record says.

    Of a response, length and digest are those of the body in its rebuilt record. A revisit's record has no body; its header
    gives them, and what it refers to. Empty tables give no rows; null ids stay null; other columns are not read. Payloads of any length are
    kept whole; of rows that repeat id and payload, that with the least url is the response (any one of those with one url).
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession, "archive")
    write_archive(pages, path, least_bytes)
    start = F.octet_length("header")
    records = read_archive(spark, path).withColumns({"text": F.col("header").cast("string"), "length": F.octet_length("record") - start - 4})
    records = records.select("page_id", "text", "length", F.substr("record", start + 1, F.col("length")).alias("body"))
    said = lambda pattern: F.regexp_extract("text", pattern, 1)
    kind = said(r"\r\nWARC-Type: (\w+)\r\n")
    revisit = kind == "revisit"
    size = F.when(revisit, said(r"(?s).*\r\nContent-Length: (\d+)\r\n\r\n$").try_cast("long")).otherwise(F.col("length").cast("long"))
    digest = F.when(revisit, said(r"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n")).otherwise(base32_sha1(F.col("body")))
    refers = F.when(revisit, F.nullif(said(r"\r\nWARC-Refers-To: <urn:page:(.*)>\r\n"), F.lit("null")).try_cast(pages.schema["page_id"].dataType))
    return records.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type"), refers.alias("refers_to"))


_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The records of a WARC file's bytes (plain or gzip members) as (exact header with http header, payload)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start) + 4
        m = _LENGTH.search(data, start, end)
        stop = end + int(m[1]) if m else end
        http = data.find(b"\r\n\r\n", end, stop) + 4 if data.startswith(b"HTTP/", end) else end
        http = max(http, end)
        yield data[start:http], data[http:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files below ``path``: ``file, number, header, payload``. A file is one task's matter, as WARC has no index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for k, (header, payload) in enumerate(parse_warc(data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([header], pa.binary()), pa.array([payload], pa.binary())], ["file", "number", "header", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, number long, header binary, payload binary")
