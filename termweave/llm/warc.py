"""WARC archives with revisit records: payload headers meet by digest, later captures refer to the original response.

Writing: headers (id, digest, length) are grouped by payload digest, partial minima first, so a payload that a third of all pages
share is no hot task. Only digests with several records are joined back. Every record becomes one text value, header block and
block, and Spark's text writer ends each with the record's closing blank lines; its files are the archives.

Reading: archives are read whole, one file per task and bounded by `archive_bytes` when written, and cut into records by their
Content-Length; the digest of each response block is computed anew and compared with its header.

Defined results: a null payload is empty; equal empty payloads are duplicates like others; records of one id are told apart by
nothing, the smallest id responds and of equal ids with equal payloads all respond; a null id stays null, never responds to others
when an id is there, and its record names no page. Blanks and control characters in a URL are percent-encoded, a null
URL is a urn of the id. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import run_folder, written

END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 16 << 20


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: forty bits at a time, in the digits of base 32, then its alphabet."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _safe(url: Column) -> Column:
    safe = F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25")
    for code in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return safe


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One text value per row of `pages`: a response, or a revisit with fresh headers and no payload."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    groups = rows.select("id", "digest", "bytes").filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    several = written(groups.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "op5-originals")
    joined = rows.join(several, "digest", "left")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes"), F.lit(f"{END}{END}"))
    block = F.when(later, http).otherwise(F.concat(http, "payload"))
    target = F.coalesce(_safe(F.col("url")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(later, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), target), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(later, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return joined.select(F.concat(F.concat_ws(END, *lines), F.lit(END + END), block).alias("value"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, size: int | None = None, compression: str = "gzip") -> None:
    """Write records as .warc text files of about `archive_bytes`; `size`: their bytes together, for the number of files."""
    spread = records if size is None else records.repartition(max(1, -(-size // archive_bytes)))
    spread.write.option("lineSep", END + END).option("compression", compression).text(path)


def _cut(data: bytes) -> Iterator[tuple]:
    """The records of an archive: id, original, type, digest, payload bytes, payload or None."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode().split(END)[1:]:
            name, _, value = line.partition(": ")
            fields[name.lower()] = value
        start, length = end + 4, int(fields["content-length"])
        block = data[start : start + length]
        head, _, payload = block.partition(b"\r\n\r\n")
        sizes = [int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        page = lambda name: (lambda v: None if v in (None, "none") else int(v))(fields.get(name, "<urn:page:none>")[10:-1])
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        yield page("warc-record-id"), page("warc-refers-to"), kind, digest, sizes[0], payload if kind == "response" else None
        at = start + length + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below a folder: page_id, refers_to, record_type, payload_digest, payload_bytes, payload."""
    import gzip

    names = ["page_id", "refers_to", "record_type", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows = list(_cut(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    if not payloads:
                        columns[-1] = [None] * len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, "page_id bigint, refers_to bigint, record_type string, payload_digest string, payload_bytes bigint, payload binary")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages as deduplicated archives in the shared folder and read them back, without their payloads."""
    spark = pages.sparkSession
    path = run_folder(spark, "op5-archives")
    size = pages.agg(F.sum(F.octet_length(payload) + 600)).first()[0] or 0
    write_archives(records(pages, key, url, payload, least_bytes), path, size=size)
    return read_archives(spark, path, payloads=False)
