"""Content-addressed WARC archives.

An archive is two tables in the shared folder. payloads holds the bytes of every distinct payload once, under their
SHA-256. headers holds a row per record with the exact bytes of its WARC header and HTTP header, and the digest of the
payload that belongs to it. A join on the digest gives back the original records byte for byte; every payload is
verified against its digest when it is read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import shared_dir, stored, table

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """headers: (record_id, key, header, http, has_payload); payloads: (key, payload)."""

    headers: DataFrame
    payloads: DataFrame


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _uuid(c: Column) -> Column:
    h = F.md5(_bytes(c))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def write(pages: DataFrame) -> Archive:
    """pages (page_id, url, html, ...) -> an archive with a record per row, repeats included.

    NULL html is an empty payload; a NULL url an empty one; line ends in a url are escaped. Of records with equal payloads
    of at least REVISIT_BYTES bytes that with the largest page_id is the response (NULL counts as smallest, any one of
    repeated rows) and the others are revisits of it. Smaller payloads are all responses.
    """
    payload = _bytes(F.coalesce(F.col("html").cast("string"), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    keys = stored(rows.select(F.monotonically_increasing_id().alias("row_id"), "page_id", "url", "key", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")), "pages")
    best = keys.groupBy("key").agg(F.max(F.struct("page_id", "row_id")).alias("best"))
    own = keys.join(best, "key").withColumn("revisit", (F.col("bytes") >= REVISIT_BYTES) & (F.col("best.row_id") != F.col("row_id")))
    name = lambda page, row: _uuid(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), row.cast("string")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("page_id"), F.col("row_id")), F.lit(">"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url),
        _field("WARC-Page-ID", page(F.col("page_id"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("best.page_id"), F.col("best.row_id")), F.lit(">"))), _field("WARC-Refers-To-Page-ID", page(F.col("best.page_id"))))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    headers = own.select(name(F.col("page_id"), F.col("row_id")).alias("record_id"), "key", _bytes(header).alias("header"), _bytes(http).alias("http"), (~F.col("revisit")).alias("has_payload"))
    # one row of each payload: chosen on narrow rows, so that bytes move once
    chosen = own.where(F.col("best.row_id") == F.col("row_id")).select(F.col("key").alias("own_key"), F.col("page_id").alias("own_page")).hint("shuffle_hash")
    bodies = rows.join(chosen, (F.col("key") == F.col("own_key")) & F.col("page_id").eqNullSafe(F.col("own_page"))).select("key", "payload", "page_id")
    again = keys.groupBy("key", "page_id").agg(F.count("*").alias("n")).where("n > 1").select("key", "page_id")
    repeated = again.limit(1).count() > 0
    bodies = bodies.dropDuplicates(["key"]) if repeated else bodies
    return Archive(stored(headers, "warc-headers"), stored(bodies.select("key", "payload"), "warc-payloads"))


def verified(archive: Archive) -> DataFrame:
    """(key, payload, bytes, sha1, intact): intact if the bytes still have the digest they are kept under."""
    p = archive.payloads
    return p.select("key", "payload", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), (F.unhex(F.sha2("payload", 256)) == F.col("key")).alias("intact"))


def records(archive: Archive) -> DataFrame:
    """(record_id, record): the original bytes, header, HTTP header, payload (none for revisits) and the closing lines.
    A payload that fails its digest gives NULL."""
    body = verified(archive).select("key", F.when(F.col("intact"), F.col("payload")).alias("payload"))
    full = archive.headers.where("has_payload").join(body, "key").select("record_id", "header", "http", "payload")
    bare = archive.headers.where(~F.col("has_payload")).select("record_id", "header", "http", F.lit(b"").alias("payload"))
    return full.unionByName(bare).select("record_id", F.concat("header", "http", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def read(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact), a row per record, from the bytes of
    its header and from the payload stored for it; intact also holds the header's digest against the payload's."""
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(F.col("text"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    own = archive.headers.select("key", text.alias("text")).select("key", F.nullif(field("WARC-Page-ID"), F.lit("")).cast("long").alias("page_id"), field("WARC-Type").alias("record_type"), F.nullif(field("WARC-Refers-To-Page-ID"), F.lit("")).cast("long").alias("refers_to"), field("WARC-Target-URI").alias("url"), field("WARC-Payload-Digest").alias("digest"))
    body = verified(archive).select("key", "bytes", "sha1", "intact")
    return own.join(body, "key").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "url", (F.col("intact") & (F.col("digest") == F.concat(F.lit("sha1:"), F.col("sha1")))).alias("intact"))


def parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of an uncompressed WARC file; a record cut short ends the file."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        header = data[at : end + 4]
        length = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", header)
        if not header.startswith(b"WARC/") or not length or len(data) < end + 4 + int(length[1]):
            return
        block = data[end + 4 : end + 4 + int(length[1])]
        yield header, block
        at = end + 4 + len(block) + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, http, payload) of the records in WARC files, plain or gzipped, at most 2 GB each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for header, block in parse(data):
                    split = block.find(b"\r\n\r\n") + 4 if b"application/http" in header else 0
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (header, pa.binary()), (block[: max(split, 0)], pa.binary()), (block[max(split, 0) :], pa.binary()))], names=["path", "header", "http", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, header binary, http binary, payload binary")


def import_files(spark: SparkSession, path: str) -> Archive:
    """An archive of the records in WARC files: their exact headers, and their payloads once each."""
    got = stored(read_files(spark, path).withColumn("key", F.unhex(F.sha2("payload", 256))), "warc-import")
    headers = got.select(F.regexp_extract(F.decode("header", "UTF-8"), r"(?i)WARC-Record-ID: *<([^>]*)>", 1).alias("record_id"), "key", "header", "http", (F.octet_length("payload") > 0).alias("has_payload"))
    return Archive(headers, stored(got.select("key", "payload").dropDuplicates(["key"]), "warc-payloads"))


def export(archive: Archive, folder: str | None = None) -> str:
    """Writes the records as a Parquet table (record_id, record) in the shared folder and returns its path."""
    folder = folder or f"{shared_dir(archive.headers.sparkSession)}/loglens-warc-{uuid.uuid4().hex}"
    records(archive).write.parquet(folder)
    return folder


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages", "page_id", "url", "html"))).drop("url")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT page_id, n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {REVISIT_BYTES} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> best THEN best END AS refers_to, true AS intact FROM k
"""
