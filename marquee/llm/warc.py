"""Content-addressed WARC archive.

``write_archive`` stores every distinct payload once, under its SHA-256, and
beside it one row per record with the exact header block.  ``read_archive``
joins the two again and gives back the original records byte for byte.

Payloads are grouped by digest *and* bytes (partial aggregation first, so many
copies cost one row per map task); a digest that two different payloads share
stops the write instead of mixing them up.

Edge cases: null payload counts as empty; empty payloads are payloads like any
other; rows may repeat (same id, same payload): one is the response; null ids
come last when the response is chosen; an empty table gives an empty archive;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2025-01-01T00:00:00Z"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1: each five hex digits are four symbols."""
    digest = F.sha1(payload)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.lit(BASE32).substr(at, F.lit(1)))
    return F.concat(*out)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write ``path``/payloads (sha256, payload) and ``path``/records (record_id,
    sha256, header).  Of records with equal payloads of at least
    ``min_revisit_bytes`` bytes the one with the smallest id is the response;
    the others are revisits that name it."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    digested = src.withColumn("sha256", F.sha2("payload", 256))
    digested.select("sha256", "payload").distinct().write.parquet(f"{path}/payloads")
    spark = pages.sparkSession
    if not spark.read.parquet(f"{path}/payloads").groupBy("sha256").count().where("count > 1").isEmpty():
        raise ValueError("two different payloads share a SHA-256 digest")

    rows = materialize(digested.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", "sha256",
        F.length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("digest")), "warc-rows")
    # written before the join back, so both sides are plain shuffles that AQE can split
    firsts = materialize(rows.groupBy("sha256").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")).alias("first")), "warc-firsts")
    headed = rows.join(firsts, "sha256")
    revisit = (F.col("n_bytes") >= min_revisit_bytes) & (F.col("row") != F.col("first.row"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # line breaks in an address would end the header line
    url = F.regexp_replace("url", "[\r\n]", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", record_id(F.col("first.page_id"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"))
    headed.select(F.col("page_id").alias("record_id"), "sha256", header.alias("header")).write.parquet(f"{path}/records")


def field(name: str):
    """Value of a header line of ``header``; null when the line is missing."""
    got = F.regexp_extract("header", f"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_id``, ``header``, ``payload`` (the full payload, for revisits that of
    the record they refer to) and ``record`` (the record's own bytes)."""
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    revisit = field("WARC-Type") == "revisit"
    end = F.lit("\r\n\r\n").cast("binary")
    return records.join(payloads, "sha256").select(
        "record_id", "header", "payload",
        F.concat(F.col("header").cast("binary"),
                 F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")), end).alias("record"))


def page_records(pages: DataFrame) -> DataFrame:
    """Write the pages into a new archive, read it back and describe each record;
    a payload that no longer has the digest of its header is an error."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    back = read_archive(pages.sparkSession, path)
    digest = F.substring(field("WARC-Payload-Digest"), 6, 32)
    target = F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)
    return back.select(
        F.col("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), digest.alias("stated"),
        field("WARC-Type").alias("record_type"),
        F.when(target != "", target.cast("long")).alias("refers_to"),
    ).withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest"))
                 .otherwise(F.raise_error(F.lit("payload does not match its digest")))).drop("stated")
