"""Content-addressed WARC archive: payload bytes once, record headers apart, joined back on reading.

An archive is a folder with two Parquet tables: ``payloads`` (digest, owner, payload), one row per
distinct payload under its SHA-256, and ``records`` (page_id, digest, header, http), the exact header
bytes of every record. A record is header + HTTP block + payload (responses) + two line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.session import shared_folder

# Fixed values of the WARC 1.1 format and of RFC 4648 base32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = "\r\n"


def base32_of_hex(digest: Column, groups: int = 8) -> Column:
    """Base32 of a hexadecimal string of ``groups`` times 20 bits (SHA-1: 8)."""
    letters = []
    for group in range(groups):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31))
            letters.append(F.substr(F.lit(BASE32), at + 1, F.lit(1)))
    return F.concat(*letters)


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def _lines(*parts: Column) -> Column:
    """Header lines; a line whose value is NULL is left out."""
    return F.concat(F.concat_ws(LINE, *parts), F.lit(LINE + LINE))


def _headers(record_date: str) -> tuple[Column, Column]:
    """WARC header and HTTP header of a row with page_id, url, size, sha1, refers_to."""
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                  F.concat(F.lit("Content-Length: "), F.col("size")))
    revisit = F.col("record_type") == "revisit"
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    record = lambda page: F.concat(F.lit("<urn:page:"), page, F.lit(">"))
    header = _lines(
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {record_date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record(F.col("refers_to")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block),
    )
    return header, http


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
                  record_date: str = "1970-01-01T00:00:00Z") -> str:
    """Archive ``pages`` (page_id, url, html) under ``folder``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the record with the smallest page_id is
    the response and the others revisit it; smaller payloads are responses, stored once all the same.
    A null html is an empty payload, a null url has no target line. Repeated rows give repeated
    records, and those equal to the response are responses. A null page_id comes after all ids: such
    a record revisits if any row with an id has its payload, else it is a response. Extra columns are
    ignored; no pages give an empty archive.
    """
    spark = pages.sparkSession
    rows = _payloads(pages)
    (
        rows.groupBy("digest").agg(F.min("page_id").alias("owner"), F.any_value("payload").alias("payload"))
        .write.parquet(f"{folder}/payloads")
    )
    # Read from storage, both sides of the join sit on their own exchange: a payload that a third of
    # all pages share is a skewed partition that Spark can split.
    owners = spark.read.parquet(f"{folder}/payloads").select("digest", "owner")
    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"),
                        base32_of_hex(F.sha1("payload")).alias("sha1"))
    shared = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")) & (
        F.col("size") >= min_revisit_bytes
    )
    header, http = _headers(record_date)
    (
        facts.join(owners, "digest")
        .withColumn("refers_to", F.when(shared, F.col("owner")))
        .withColumn("record_type", F.when(shared, "revisit").otherwise("response"))
        .select("page_id", "digest", header.cast("binary").alias("header"), http.cast("binary").alias("http"))
        .write.parquet(f"{folder}/records")
    )
    return folder


def _header_value(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record restored: page_id, record_type, refers_to, payload and the record's bytes.

    A payload that does not have the digest it is stored under fails the read, and so does one whose
    SHA-1 differs from its record's header.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    records = spark.read.parquet(f"{folder}/records")
    sha1 = base32_of_hex(F.sha1("payload"))
    verified = F.when(
        (F.sha2("payload", 256) == F.col("digest")) & (_header_value("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.col("payload"),
    ).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    kind = _header_value("WARC-Type")
    refers = F.regexp_extract(_header_value("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return (
        records.join(payloads, "digest")
        .withColumn("sha1", sha1)
        .withColumn("payload", verified)
        .select(
            "page_id", kind.alias("record_type"),
            F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
            F.col("sha1").alias("payload_digest"), "payload",
            F.concat("header", "http", body, F.lit((LINE + LINE).encode())).alias("record"),
        )
    )


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive (a fresh one in the shared folder by default) and read it back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, folder or shared_folder(spark, "warc"), min_revisit_bytes))
