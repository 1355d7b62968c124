"""A content-addressed WARC archive: payload bytes once per SHA-256, exact record headers apart.

`write_archive` writes two tables below a folder: `payloads` (digest, payload) and
`headers` (page_id, digest, header: the record's exact header block). Records that
share a payload of at least `least` bytes point to the one with the smallest
page_id, which is their response; they are revisits. `read_archive` joins the two
tables again, checks every payload against its digest and yields the records;
`export` writes them as ordinary WARC files, `parse` reads such bytes.

Defined results: a null payload is an empty one, a null url gives a header without
target, a null page_id gives a record without page number (never the smallest, so
never referred to unless no other row has one). Repeated rows give repeated
records. Empty texts, very long texts and extra columns need no care: a payload is
one value, and only the three named columns are read. An empty table gives an
empty archive. Control characters in a url are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written
from postulant.session import work_folder

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEDIA_TYPE = "text/html; charset=utf-8"
LEAST_BYTES = 100

HEADERS = "page_id long, digest string, header string"
PAYLOADS = "digest string, payload binary"


def _uuid(hex_digits: Column) -> Column:
    pieces = [F.substring(hex_digits, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def record_id(page_id: Column, digest: Column) -> Column:
    return _uuid(F.sha2(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest), 256))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Writes page_id, url and html as one WARC record per row.

    Payloads are made distinct per task before the shuffle, so many copies of one
    page do not meet in one task.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    known = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    named = known.withColumn("digest", F.sha2("payload", 256))
    named.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    rows = written(named.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")), "pages")
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    owners = written(shared.where("n > 1").drop("n"), "owners")
    joined = rows.join(small(owners), "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    safe_url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        F.coalesce(_line("WARC-Target-URI", safe_url), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", F.lit(PROFILE)),
                F.when(F.col("first").isNotNull(), _line("WARC-Refers-To", record_id(F.col("first"), F.col("digest")))).otherwise(F.lit("")),
                F.when(F.col("first").isNotNull(), _line("WARC-Refers-To-Page", F.col("first").cast("string"))).otherwise(F.lit("")),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", F.lit(MEDIA_TYPE)),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    joined.select("page_id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def field(header: Column, name: str) -> Column:
    """The value of a header line; null without such a line."""
    value = F.regexp_extract(header, rf"(?md)^{name}: ([^\r]*)\r$", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records: page_id, header, record_type, refers_to, payload, payload_bytes, payload_digest, intact.

    Digest and length are computed from the stored bytes beside their scan, so that
    a reader who does not ask for payloads joins narrow rows. `intact` tells whether
    the header's digest is that of the bytes found.
    """
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    headers = spark.read.schema(HEADERS).parquet(f"{folder}/headers")
    joined = headers.join(stored, "digest", "left")
    return joined.select(
        "page_id",
        "header",
        field(F.col("header"), "WARC-Type").alias("record_type"),
        field(F.col("header"), "WARC-Refers-To-Page").cast("long").alias("refers_to"),
        "payload",
        "payload_bytes",
        "payload_digest",
        F.coalesce(F.concat(F.lit("sha256:"), F.col("payload_digest")) == field(F.col("header"), "WARC-Payload-Digest"), F.lit(False)).alias("intact"),
    )


def export(records: DataFrame, folder: str) -> None:
    """Writes records as gzipped WARC files; two line ends close each record."""
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    lines = records.select(F.concat("header", body).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def parse(data: bytes) -> list[tuple[bytes, bytes]]:
    """(header block, block) of each record in the bytes of a WARC file."""
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        size = next(int(x.split(b":")[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        found.append((header, data[end : end + size]))
        at = end + size + 4
    return found


def archive(spark: SparkSession, folder: str) -> DataFrame:
    target = work_folder(spark, "warc")
    write_archive(table(spark, folder, "pages"), target)
    records = read_archive(spark, target)
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op2_warc": archive}
SQL = {
    "op2_warc": """WITH named AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
owned AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN owner IS DISTINCT FROM page_id AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM owned""",
}
