"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.llm.common import drop_staged, new_path, salted_join, staged

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: Signs that a URL in a header holds as percent codes only.
CONTROLS = "[\\x00-\\x20\\x7F-\\x{9F}\\x{2028}\\x{2029}]"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1: 160 bits are eight groups of five hex digits, each of them four signs."""
    digits = F.sha1(data)
    groups = [F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)])


def _urn(page: Column, row: Column) -> Column:
    """A record id that holds the page_id, and the row's number, so that repeated rows are records of their own."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit("#"), row.cast("string"), F.lit(">"))


def _escaped(url: Column) -> Column:
    """`url` with each space, control or line separator as its UTF-8 bytes in percent form: a header line holds nothing that ends it."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(CONTROLS), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(url.rlike(CONTROLS), F.array_join(coded, "")).otherwise(url)


def write_archive(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Writes `path`/payloads (digest, payload) and `path`/headers (digest, header) from `pages` (page_id, url, html).

    The address of a payload is its SHA-256. Of records with equal payloads that with the smallest page_id is the response, a null one
    last; the others revisit it. Rows alike in page_id and payload are records of their own and are all responses if the first is. Equal
    payloads meet map side first, so a payload that a third of all pages have moves once from each task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    addressed = rows.withColumn("digest", F.sha2("payload", 256))
    addressed.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = addressed.select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    light = staged(light, "pages")
    first = light.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))).alias("first"))
    same = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(same, "response").otherwise("revisit")), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _escaped(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(same, F.col("digest")).otherwise(F.sha2(F.lit(b""), 256)))),
        F.when(same, "").otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first.page_id"), F.col("first.row"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(same, F.col("bytes")).otherwise(F.lit(0)).cast("string")), F.lit(END),
    )
    salted_join(light, first, "digest", F.col("row")).select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    drop_staged(light)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of each record: headers joined with the payload store by digest. A payload that is missing or does not have its digest fails the read."""
    store = spark.read.parquet(f"{path}/payloads").withColumn("found", F.sha2("payload", 256))
    whole = F.when(F.col("found") == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged or missing: "), "digest")).cast("binary"))
    headers = spark.read.parquet(f"{path}/headers")
    return salted_join(headers, store, "digest", F.col("header")).select("header", whole.alias("payload"))


def field(name: str, header: str = "header") -> Column:
    """A header field's value. Only a line feed ends a line, so no other sign in a value can begin a field."""
    return F.regexp_extract(header, f"(?md)^{name}: ([^\r\n]*)", 1)


def record_bytes(records: DataFrame) -> DataFrame:
    """(record, payload): each record as it stands in a WARC file, a revisit's block being empty, and the payload that it has or refers to."""
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(F.concat(F.encode("header", "UTF-8"), block, F.lit((END + END).encode())).alias("record"), "payload")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each row of `pages`, from the archive that it is written to and read back from.

    Every record is rebuilt as bytes and its fields are read from those; one whose block has not the length it tells fails the read. A null
    html is an empty payload; empty payloads are deduplicated like any other. An empty table gives none.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archive(pages, path)
    number = lambda text: F.regexp_extract(text, r"^<urn:page:(-?\d+)#\d+>$", 1)
    as_id = lambda name: F.when(number(field(name)) != "", number(field(name))).cast("long")
    head = F.substring_index(F.col("record").cast("string"), END + END, 1)
    records = record_bytes(read_archive(spark, path)).select("record", "payload", head.alias("header"))
    block = F.length("record") - F.octet_length("header") - 2 * len(END + END)
    told = F.when(block == field("Content-Length").cast("int"), F.length("payload")).otherwise(F.raise_error(F.lit("record of another length than it tells")).cast("int"))
    return records.select(
        as_id("WARC-Record-ID").alias("page_id"), told.cast("long").alias("payload_bytes"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Type").alias("record_type"), as_id("WARC-Refers-To").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, sha256(h) AS address FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY address) AS first FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""
