"""WARC archives whose repeated payloads are revisit records.

Writing: headers (id and payload digest) are shuffled by digest to find each
payload's original; the pages join what was found by their own id, so that
copies of a payload don't gather anywhere, and become records, which Spark's
text writer streams out as gzip files with the record separator of the format
between them.  A file is one gzip member without a ``warcinfo`` record; readers
that go through a file in order take it, those that seek to records don't.  Reading: each archive is inflated piece by piece and cut
by ``Content-Length``; revisits then join the originals by digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

#: Records and bytes (before compression) that an archive file holds at most; a task reads a file whole.
FILE_RECORDS = 4000
FILE_BYTES = 1 << 30
RECORD_ID = "<urn:page:"

RECORDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "refers_to_id string, payload_bytes long, intact boolean"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1; 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_HEX, BASE32)


def _uri(url: Column, page_id: Column) -> Column:
    clean = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    return F.when(url.isNull() | (url == ""), F.concat(F.lit("urn:page:"), _name(page_id))).otherwise(clean)


def _name(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit("none"))


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``payload, payload_bytes, payload_digest, original`` to ``page_id, url``.

    ``original`` is the smallest page_id with the payload, or null where the
    row is an original itself: smaller payloads than ``least_bytes``, and rows
    that repeat the original's id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    headers = pages.select("page_id", payload.alias("p")).select(
        F.col("page_id").alias("_page"), F.octet_length("p").alias("_bytes"), base32_sha1(F.col("p")).alias("_digest")
    )
    # headers only meet by digest; a payload that is everywhere is one row of the smaller side
    first = headers.groupBy(F.col("_digest").alias("_d")).agg(F.min("_page").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = ~F.col("_page").eqNullSafe(F.col("original")) & (F.col("_bytes") >= least_bytes)
    revisits = headers.join(first, F.col("_digest") == F.col("_d")).where(later).select("_page", "_digest", "original").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return rows.join(revisits, same, "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", "original")


def _record(date: str) -> Column:
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(HTTP_HEAD), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: {RECORD_ID}"),
        _name(F.col("page_id")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        _uri(F.col("url"), F.col("page_id")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: {RECORD_ID}"),
                F.col("original").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )
    # The writer copies the bytes of a string as they are, so the payload needs no re-encoding.
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages(page_id, url, html)`` as gzip archives.

    Null html is an empty payload.  A null page_id is named ``none`` and is an
    original only where no other row has its payload.  A null or empty url
    becomes the record's own name; white space and control bytes in a url are
    percent-encoded.  Rows that repeat id and payload are written again with
    the same type.  No rows: archives without records.  Extra columns are
    ignored.  Where there are very long pages, files hold fewer records.
    """
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    records = max(1, min(FILE_RECORDS, FILE_BYTES // (most + 4096)))
    (
        with_roles(pages, least_bytes)
        .select(_record(date).alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records)
        .text(path)
    )


class _Inflated:
    """Reads a gzip archive (one member or many) without inflating it at once."""

    def __init__(self, data: bytes, piece: int = 1 << 18):
        self.data, self.piece, self.at = memoryview(data), piece, 0
        self.z, self.buffer = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                rest = self.z.unused_data
                if not rest and self.at >= len(self.data):
                    return False
                self.z = zlib.decompressobj(31)
                got = self.z.decompress(rest)
            elif self.at < len(self.data):
                got = self.z.decompress(self.data[self.at : self.at + self.piece])
                self.at += self.piece
            else:
                return False
            if got:
                self.buffer += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end."""
        seen = 0
        while (k := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        return self.take(k + len(mark))


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive; a payload is checked against its digest."""
    source = _Inflated(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        block = source.take(int(fields["content-length"]))
        source.take(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = fields["warc-type"]
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        intact = kind != "response" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
        yield (
            fields["warc-record-id"],
            kind,
            fields.get("warc-target-uri"),
            digest,
            fields.get("warc-refers-to"),
            len(payload) if kind == "response" else None,
            intact,
            payload,
        )


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``; with ``payloads`` their bytes too."""
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary()]
    if not payloads:
        names, kinds = names[:-1], kinds[:-1]
    kept = pa.schema(list(zip(names, kinds, strict=True)))

    def records(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for record in parse(data.as_py()):
                    rows.append(record[: len(names)])
                    held += len(record[-1]) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kept)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kept)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(records, RECORDS + (", payload binary" if payloads else ""))


def resolve(records: DataFrame) -> DataFrame:
    """Give every revisit its original's payload size.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    The originals are one row a digest; the revisits of a payload that is
    everywhere are split among tasks by adaptive execution.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    originals = (
        records.where("record_type = 'response'")
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    return records.join(originals, F.col("payload_digest") == F.col("_digest"), "left").select(
        number(F.col("record_id")).alias("page_id"),
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number(F.col("refers_to_id")).alias("refers_to"),
    )


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, then read and resolve them."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes)
    return resolve(saved(read(spark, path), "warc-headers"))


def _base32_sql(digest: str) -> str:
    chars = []
    for k in range(8):
        part = f"CAST('0x' || substr({digest}, {5 * k + 1}, 5) AS INTEGER)"
        chars += [f"substr('{BASE32}', (({part} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(chars)


WARC_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original
  FROM pages
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_base32_sql("digest")} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p
"""
