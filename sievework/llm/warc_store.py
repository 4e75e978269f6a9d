"""WARC: a content-addressed archive.

Two written tables make the archive. ``payloads`` holds each distinct payload once under its SHA-256,
``headers`` the exact header bytes of every record with the digest of its payload. A join on the
digest gives the original records back, byte for byte. The digest is verified both ways: when
payloads are stored, rows that share a digest must agree in length and in two independent checksums;
when they are read, the digest is computed again from the stored bytes and the record's own
``WARC-Payload-Digest`` and ``Content-Length`` must match.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow_map, partitions, put_file, table
from sievework.scratch import materialize, new_dir

#: Payloads below so many bytes are never replaced by a revisit record.
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ")


def write_archive(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html) to ``folder``.

    Among records with equal payloads of at least ``REVISIT_BYTES`` bytes that with the smallest
    page_id is a response and the others revisit it; repeated rows of the smallest page_id are
    responses all. A null html is an empty payload, a null url an empty target; line breaks in a
    url become spaces. Rows with a null page_id are revisits if any row with an id has their
    payload, else responses. Only digests and ids are shuffled to find the first of each payload;
    payload bytes move once, one row for each digest.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    check = F.xxhash64("payload")
    first = rows.select("digest", "page_id", "n", check.alias("x"), F.crc32("payload").alias("c")).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    same = (F.col("n0") == F.col("n1")) & (F.col("x0") == F.col("x1")) & (F.col("c0") == F.col("c1"))
    first = first.select("digest", F.when(same, F.col("first_id")).otherwise(F.raise_error(F.concat(F.lit("different payloads under digest "), "digest"))).alias("first_id"))
    facts = rows.select("page_id", "url", "digest", "n").join(first, "digest")
    again = (F.col("n") >= REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    kind = F.when(again, "revisit").otherwise("response")
    refers = F.when(again, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id")), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise("")
    length = F.length(http) + F.when(again, 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), _clean(F.col("url")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF), refers, F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF), http,
    )
    facts.select(F.encode(head, "UTF-8").alias("header"), "digest").write.parquet(f"{folder}/headers")
    # One row keeps each payload; its digest names it, so which of the equal ones stays makes no
    # difference. The first id is the smallest, so "not above" means equal, and both the join and the
    # deduplication deal rows by digest alone: payload bytes are shuffled once, and none again when
    # the archive is read, because the table is bucketed by digest.
    one = first.select(F.col("digest").alias("d"), F.col("first_id"))
    keep = rows.join(one, (F.col("digest") == F.col("d")) & (F.col("first_id").isNull() | (F.col("page_id") <= F.col("first_id"))), "left_semi")
    keep = keep.select("digest", "payload").dropDuplicates(["digest"])
    keep.write.bucketBy(partitions(pages.sparkSession), "digest").sortBy("digest").option("path", f"{folder}/payloads").saveAsTable(_table(folder))


def _table(folder: str) -> str:
    return f"warc_payloads_{hashlib.md5(folder.encode()).hexdigest()}"


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """digest, header, payload (full), record (the WARC record's bytes) of every stored record.

    A revisit's record ends with its header, as it was written; its ``payload`` is the stored one.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    bucketed = spark.catalog.tableExists(_table(folder))  # known to the session that wrote it, until it is read
    payloads = spark.table(_table(folder)) if bucketed else spark.read.parquet(f"{folder}/payloads")
    payloads.schema  # resolved by now, so the catalog's entry is not needed any more; the files stay
    spark.sql(f"DROP TABLE IF EXISTS {_table(folder)}")
    head = F.decode("header", "UTF-8")
    revisit = F.regexp_extract(head, r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1) == "revisit"
    record = F.concat(F.col("header"), F.when(revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload")), F.encode(F.lit(CRLF + CRLF), "UTF-8"))
    return headers.join(payloads, "digest").withColumn("record", record)


def write_warc_files(records: DataFrame, folder: str, most: int = 1 << 28) -> DataFrame:
    """file, n_records, n_bytes: the ``record`` bytes as .warc.gz files that other tools read, a gzip member for each record.

    A file is closed after about ``most`` bytes. ``folder`` must be one that pyarrow opens; files of
    failed attempts are not in the result. An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        part = size = 0

        def flush() -> pa.RecordBatch:
            name = put_file(folder, f"part-{part:06d}.warc.gz", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["file", "n_records", "n_bytes"])

        for b in batches:
            for record in b.column("record").to_pylist():
                held.append(gzip.compress(record, 6, mtime=0))
                size += len(held[-1])
                if size >= most:
                    yield flush()
                    held, part, size = [], part + 1, 0
        if held:
            yield flush()

    return materialize(arrow_map(records.select("record"), run, "file string, n_records long, n_bytes long"), "warc-files")


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the records' own bytes."""
    text = F.decode("header", "UTF-8")
    get = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    block = F.octet_length("record") - F.octet_length(F.regexp_extract(text, r"(?s)^(.*?\r\n\r\n)", 1)).cast("long") - 4
    ok = (F.sha2("payload", 256) == F.regexp_replace(get("WARC-Payload-Digest"), "^sha256:", "")) & (block == get("Content-Length").try_cast("long"))
    out = records.select(
        number(get("WARC-Record-ID")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest"), F.regexp_extract(text, r"WARC-Type: (\w+)", 1).alias("record_type"),
        number(get("WARC-Refers-To")).alias("refers_to"), ok.alias("ok"),
    )
    return out.select("page_id", "payload_bytes", F.when(F.col("ok"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), "digest"))).alias("payload_digest"), "record_type", "refers_to")


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return parse_records(read_archive(spark, folder))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
