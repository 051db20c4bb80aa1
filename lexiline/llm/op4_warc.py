"""WARC archives with revisit records in place of repeated payloads.

Pages are written once with a number for each row. Only headers (row, page, digest, length) are shuffled by payload digest, those of frequent payloads by
salts: the largest page of each group becomes the response, the others refer to it. What is found goes back to the pages by row: broadcast while there are at most
BROADCAST_REVISITS, else dealt by row, evenly. Records are written with fresh headers by Spark's text writer,
whose line end is the end of a WARC record (CR LF CR LF), so every file is a (gzipped) archive as it stands and the
writer's commit protocol covers lost tasks. Files hold a bounded number of records of a size class, so 64 MB or one record. Archives are read as
whole files and cut by Content-Length.

Only payloads of at least `least_bytes` are given up for a revisit record. Null html is an empty payload, a null url is
written as an empty target, a null page_id as none. Of rows with equal page_id and payload one is the response and the others revisit it.
An empty table gives no records. Other columns are ignored. A revisit whose response is missing from the archives ends the reading with an error.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm.common import Heavy, materialise, table, workspace

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _record_id(row: Column) -> Column:
    """A urn:uuid made of the row's number in this archive."""
    h = F.md5(F.concat(F.lit("warc-record-"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))], F.lit(">"))


#: revisits (row, original) that may be broadcast, by count
BROADCAST_REVISITS = 500_000


def resolve(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest (sha1, hex), row (its number), and original (the row of
    the response that it revisits, or null)."""
    place = workspace(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "utf-8")), "row": F.monotonically_increasing_id()})
    rows = materialise(rows, place, "pages")
    large = rows.filter(F.col("payload_bytes") >= least_bytes).select("page_id", F.concat_ws(":", "payload_digest", F.col("payload_bytes").cast("string")).alias("payload"), "row")
    top = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 62))).alias("p"), "row")).alias("top")
    first = materialise(large.groupBy("payload").agg(top, F.count("*").alias("n")).filter("n > 1"), place, "first")
    heavy = Heavy(first.select("payload", "n"), "payload", rows.count(), place)
    revisits = heavy.join(large.select("payload", "row"), first.select("payload", F.col("top.row").alias("original")), "row").filter("row <> original")
    revisits = materialise(revisits.select("row", "original"), place, "revisits")
    return rows.join(F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits, "row", "left")


#: most bytes of a payload, and records of that size to a file
SIZES = ((1 << 17, 500), (1 << 23, 8), (None, 1))


def write_archives(resolved: DataFrame, path: str, sizes: tuple = SIZES) -> None:
    """WARC/1.1 response and revisit records; page_id goes to a header of its own."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("row")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), clean,
        F.when(F.col("page_id").isNull(), "").otherwise(F.concat(F.lit(f"{CRLF}X-Page-ID: "), F.col("page_id").cast("string"))),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("original")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )
    least = -1
    for k, (most, records) in enumerate(sizes):
        own = resolved.filter(F.col("payload_bytes") > least).filter(F.col("payload_bytes") <= most if most else F.lit(True))
        own.select(head.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).option("compression", "gzip").text(f"{path}/size{k}")
        least = most


RECORD = "record_id string, record_type string, page_id long, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record. payload_bytes and payload_digest of a response are measured, those of a revisit are null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, at, rows = gzip.decompress(content.as_buffer()), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    lines = data[at:end].decode().split(CRLF)
                    assert lines[0] == "WARC/1.1", lines[0]
                    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                    first, size = end + 4, int(head["content-length"])
                    block = data[first : first + size]
                    assert data[first + size : first + size + 4] == b"\r\n\r\n"
                    at = first + size + 4
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
                    if payload is not None:
                        measured = hashlib.sha1(payload).hexdigest()
                        assert head["warc-payload-digest"] == f"sha1:{measured}"
                    page = head.get("x-page-id")
                    rows.append((
                        head["warc-record-id"], head["warc-type"], None if page is None else int(page), head.get("warc-refers-to"), head["warc-target-uri"],
                        head["warc-payload-digest"].removeprefix("sha1:") if payload is not None else None, len(payload) if payload is not None else None, payload if with_payload else None,
                    ))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    names = [x.split()[0] for x in RECORD.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(task, RECORD)


def resolved_records(records: DataFrame) -> DataFrame:
    """Revisit records with the payload's length and digest, and the page, of the response that they refer to."""
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("o_id"), F.col("page_id").alias("o_page"), F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes"))
    met = records.filter("record_type = 'revisit'").join(originals, F.col("refers_to_id") == F.col("o_id"), "left")
    lost = F.raise_error(F.concat(F.lit("no response record "), F.col("refers_to_id")))
    met = met.withColumn("record_type", F.when(F.col("o_id").isNull(), lost.cast("string")).otherwise(F.col("record_type")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return own.select(columns).unionByName(met.select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark)}/archives"
    write_archives(resolve(table(spark, sf_dir, "pages")), path)
    return resolved_records(read_archives(spark, path, with_payload=False))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
