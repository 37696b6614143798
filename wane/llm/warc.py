"""Content-addressed WARC archive in two tables.

`payloads` holds each payload's bytes once under its SHA-256 and length; `headers` holds the exact header bytes of every record.
Joining the two by content address gives the records back byte by byte. A later record of an equal payload is a revisit: it has
a header only and names the record it repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base32 letters: eight groups of five hex digits give four letters each."""
    hexed = F.sha1(payload)
    letters = []
    for k in range(8):
        group = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
) -> None:
    """Write the records of all pages below `folder`.

    Of records with equal payloads of at least `min_bytes`, the one with the smallest id (null ids last) is the response and
    the others revisit it; shorter payloads are all responses. Null payloads are empty. Line ends within a URL are
    percent-encoded, a null URL gives no target line. Repeated rows give a record each; rows that repeat both an id and a payload
    revisit that id. Other columns are left out. An empty table gives an empty archive.
    """
    rows = pages.select(
        F.col(id_column).alias("page"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"),
    )
    keyed = rows.withColumns({"bytes": F.length("payload").cast("long"), "address": F.sha2("payload", 256)})
    # Map tasks already drop all but one payload of each address, so equal payloads never meet in one task.
    once = Window.partitionBy("address", "bytes").orderBy(F.col("page").asc_nulls_last())
    (
        keyed.select("address", "bytes", "page", "payload").withColumn("n", F.row_number().over(once)).filter("n = 1")
        .select("address", "bytes", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    )

    facts = keyed.select("page", "url", "bytes", "address", base32_sha1(F.col("payload")).alias("sha1"))
    first = facts.groupBy("address", "bytes").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur more than once need the join; it carries no payload and a hot address is split by AQE.
    again = first.filter(F.col("n") > 1).select("address", "bytes", "first_page")
    order = F.monotonically_increasing_id()
    facts = facts.join(again, ["address", "bytes"], "left").withColumn("line", order)
    revisit = (F.col("bytes") >= min_bytes) & F.col("first_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("first_page"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit(VERSION),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("first_page")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")
    facts.select("address", "bytes", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records of an archive: header and payload bytes, the parsed fields, and whether the payload's digests hold.

    `block` is what follows the header in the record (empty for a revisit); header + block + CRLF CRLF is the exact record.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "address", "bytes", "payload",
        ((F.sha2("payload", 256) == F.col("address")) & (F.length("payload") == F.col("bytes"))).alias("whole"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    head = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("none"))
    headers = spark.read.parquet(f"{folder}/headers").select(
        "address", "bytes", "header", field("WARC-Type").alias("record_type"),
        page(field("WARC-Record-ID")).alias("page"), page(field("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("said_sha1"),
    )
    return headers.join(payloads, ["address", "bytes"], "left").select(
        "header", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")).alias("block"), "payload",
        "page", "url", "record_type", "refers_to", "bytes", "sha1",
        (F.coalesce(F.col("whole"), F.lit(False)) & (F.col("sha1") == F.col("said_sha1"))).alias("verified"),
    )
