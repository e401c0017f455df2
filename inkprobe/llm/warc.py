"""WARC archives addressed by content.

An archive is two tables in shared storage:

- ``payloads``: (digest, payload), the payload bytes of each SHA-256 once;
- ``headers``: (page_id, digest, header): each record's header block exactly as it stands in the record, from the version
  line to the blank line.

A record is its header, its block and two line ends. A response's block is its payload; a revisit's block is empty and
its header names the record that holds the payload. Joining headers with payloads by digest gives back every record's
bytes, and any record's full payload. Payloads count as equal when SHA-256, SHA-1 and length all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, shared_dir, shuffles_deleted, stored, table, text_or_empty

REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _field(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def record_uri(page_id) -> F.Column:
    """Names the page by its id, so that reruns agree and a revisit's header tells which page it refers to."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def index_pages(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, digest, sha1, bytes, keeper_id, is_keeper): one row per row of ``pages``, without its payload.

    Of equal payloads of ``revisit_from`` bytes or more, the row with the largest id keeps the payload; of rows that tie
    there, one. Null ids count as smallest.
    """
    body = text_or_empty("html")
    rows = stored(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "").alias("url"),
            F.unhex(F.sha2(body, 256)).alias("digest"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("rid"),
        )
    )
    key = ["digest", "sha1", "bytes"]
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "rid"))
    keepers = rows.groupBy(*key).agg(best.alias("k")).select(*key, F.col("k.page_id").alias("keeper_id"), F.col("k.rid").alias("keeper_rid"))
    large = F.col("bytes") >= revisit_from
    return rows.join(keepers, key).select(
        "page_id", "url", *key, F.when(large, F.col("keeper_id")).otherwise(F.col("page_id")).alias("keeper_id"),
        (~large | (F.col("rid") == F.col("keeper_rid"))).alias("is_response"), (F.col("rid") == F.col("keeper_rid")).alias("is_keeper"),
    )


def with_headers(index: DataFrame) -> DataFrame:
    """Each record's exact header block."""
    common = lambda kind: [F.lit("WARC/1.1" + CRLF), _field("WARC-Type", F.lit(kind)), _field("WARC-Record-ID", record_uri(F.col("page_id")))]
    about = [_field("WARC-Date", F.lit(DATE)), _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))]
    response = F.concat(*common("response"), *about, _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    revisit = F.concat(*common("revisit"), *about, _field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", record_uri(F.col("keeper_id"))), _field("Content-Length", F.lit("0")), F.lit(CRLF))
    kept = F.col("is_response")
    return index.select(
        "page_id", "digest", F.when(kept, response).otherwise(revisit).alias("header")
    )


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html; others are ignored). Null html is an empty payload,
    a null url an empty one. What that shuffles is deleted as soon as it is written, for reading shuffles the payloads again."""
    with shuffles_deleted(pages.sparkSession):
        _write(pages, path, revisit_from)


def _write(pages: DataFrame, path: str, revisit_from: int) -> None:
    index = stored(index_pages(pages, revisit_from))
    with_headers(index).write.parquet(f"{path}/headers")
    # payloads move once, by page and digest, and only those that are kept; a repeated page meets itself there
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)))
    keep = index.where("is_keeper").select(page.alias("page"), "digest").distinct()
    body = pages.select(page.alias("page"), F.encode(text_or_empty("html"), "utf-8").alias("payload"))
    body = body.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    kept = body.join(keep, ["page", "digest"], "left_semi")
    kept.groupBy("page", "digest").agg(F.first("payload").alias("payload")).select("digest", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The headers, each with its full payload (a revisit's is that of the record it refers to), verified by digest."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    ok = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("binary"))
    return headers.join(payloads.withColumn("payload", ok), "digest")


def field(header, name: str):
    """The value of a header's field; null where it has none."""
    return F.nullif(F.regexp_extract(header, f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record, payload): the exact bytes of every record, and its full payload."""
    block = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_archive(spark, path).select("page_id", F.concat(F.encode("header", "utf-8"), block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact bytes of every record."""
    return rebuilt(spark, path).select("page_id", "record")


def described(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the rebuilt records say. A record whose block is not as
    long as its header says, or whose payload has another digest, is an error."""
    # bytes as characters: a header ends at the first blank line
    head = F.concat(F.substring_index(F.decode("record", "ISO-8859-1"), CRLF * 2, 1), F.lit(CRLF))
    rows = rebuilt(spark, path).select("page_id", "payload", F.octet_length("record").alias("n"), head.alias("head"))
    stated = F.col("n") - F.length("head") - 6
    sha1 = F.sha1("payload")
    agrees = (field(F.col("head"), "Content-Length").cast("long") == stated) & (field(F.col("head"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1))
    digest = F.when(agrees, sha1).otherwise(F.raise_error(F.lit("a record does not agree with its header")).cast("string"))
    refers = F.regexp_extract("head", r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1)
    return rows.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), field(F.col("head"), "WARC-Type").alias("record_type"),
        F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    delete_at_exit(spark, path)
    write_archive(table(spark, sf_dir, "pages"), path)
    return described(spark, path)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""
