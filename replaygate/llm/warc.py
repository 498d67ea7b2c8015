"""WARC archives and revisit resolution (operator 1).

Records are written with Spark's text writer (a record is its header lines, its
payload and a closing blank line, all UTF-8) as gzip archives in the shared
folder, and read back archive by archive. Revisit resolution reads the headers
only: they are shuffled by payload digest, the record with the smallest page id
of each digest is the response, and the others become revisit records that name
it. The deduplicated archives carry fresh headers and each payload once.

Payloads without text form (null) are written as empty ones.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, table_path
from .words import stored

VERSION = "WARC/1.1"
#: Archives are cut after so many records, so that one is a task's unit of memory.
RECORDS_PER_ARCHIVE = 1000
EPOCH = "2000-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits are 4 groups of 40, each 10 hex or 8 base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value stays on its line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def record_text(fields: list[tuple[str, Column]], payload: Column) -> Column:
    """One record without its last newline, which the text writer adds; null-valued fields are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")), F.lit("")) for k, v in fields]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return F.concat(F.lit(f"{VERSION}\r\n"), *lines, size, F.lit("\r\n"), payload, F.lit("\r\n\r"))


def write_archives(records: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write columns (page_id, url, record_type, payload_digest, payload_bytes,
    refers_to, payload) as gzip archives below `path`."""
    fields = [
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", record_id(F.col("page_id"))), ("WARC-Date", F.lit(EPOCH)),
        ("WARC-Target-URI", _clean(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Refers-To", F.when(F.col("record_type") == "revisit", record_id(F.col("refers_to")))),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("X-Payload-Length", F.col("payload_bytes")),
    ]
    (records.select(record_text(fields, F.col("payload")).alias("value")).write
        .option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path))


def parse_records(data: bytes, with_payload: bool):
    """(headers, payload or None) of each record; the length field alone says where
    a payload ends, so a payload may contain anything."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        body, size = stop + 4, int(head["Content-Length"])
        if data[body + size : body + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, (data[body : body + size] if with_payload else None)
        at = body + size + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below `path`: (page_id, url, record_type,
    payload_digest, payload_bytes, refers_to[, payload])."""
    columns = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *(["payload"] if payloads else [])]
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + (", payload string" if payloads else "")

    def number(value: str | None) -> int | None:
        return None if value is None else int(value[len("<urn:page:") : -1])

    def run(batches):
        for batch in batches:
            for packed in batch.column("content"):
                rows = []
                for head, body in parse_records(gzip.decompress(packed.as_buffer()), payloads):
                    row = (number(head.get("WARC-Record-ID")), head["WARC-Target-URI"], head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"),
                           int(head["X-Payload-Length"]), number(head.get("WARC-Refers-To")))
                    rows.append(row + ((body.decode(),) if payloads else ()))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: len(columns)]]
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if c.type == pa.large_string() else c for c in cols], names=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def crawl_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A response record for every page."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.lit("response").alias("record_type"), payload_digest(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), payload.alias("payload"))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, original): for each header the response that stands for its payload.

    Headers with a digest of their own need no join: only digests of several
    records are joined, each to one original, which is read from its own table so
    that Spark can split a digest held by a large share of all records.
    """
    same = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    originals = stored(same.filter("n > 1").select(F.col("payload_digest").alias("digest"), "original"), "originals")
    return headers.join(originals, F.col("payload_digest") == F.col("digest"), "left").select("page_id", "payload_digest", F.coalesce("original", "page_id").alias("original"))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Rewrite the archives below `source` so that each payload of at least
    `min_bytes` bytes is stored once; the others become revisit records.

    Rows that share page id and payload are all responses if that id is the
    smallest; a record without page id is always a response, and no other
    record refers to it. Empty archives give empty ones.
    """
    headers = read_archives(spark, source, payloads=False)
    decided = resolve_revisits(headers, min_bytes)
    repeats = stored(decided.filter(F.col("original") != F.col("page_id")).distinct(), "revisits").select(F.col("page_id").alias("again"), F.col("payload_digest").alias("same"), "original")
    records = read_archives(spark, source)
    joined = records.join(repeats, (F.col("page_id") == F.col("again")) & (F.col("payload_digest") == F.col("same")), "left")
    revisit = F.col("original").isNotNull()
    fresh = joined.select(
        "page_id", "url", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "payload_digest", "payload_bytes",
        F.col("original").alias("refers_to"), F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"))
    write_archives(fresh, target, records_per_archive)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               records_per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """Write pages as archives, deduplicate those, and return the headers of the result."""
    raw, clean = scratch_path(spark, "warc-crawl"), scratch_path(spark, "warc-dedup")
    write_archives(crawl_records(pages, id_col, url_col, payload_col), raw, records_per_archive)
    deduplicate_archives(spark, raw, clean, min_bytes, records_per_archive)
    return read_archives(spark, clean, payloads=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(table_path(sf_dir, "pages"))
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body,
         sha1(coalesce(html, '')) AS hex
  FROM pages
), d AS (
  SELECT page_id, url, octet_length(body) AS payload_bytes, hex,
         (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + CAST((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INT), 1), '' ORDER BY i)
          FROM range(32) AS r(i)) AS payload_digest
  FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS original FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to, url
FROM m
"""
