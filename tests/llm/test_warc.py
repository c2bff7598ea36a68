import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuefold.llm import warc
from cuefold.llm.common import new_path, salted_join

ROWS = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "alone"), (None, "u", "<p>é</p>"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "WARC-Type: revisit\r\n\r\n")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    path = new_path(spark, "warc")
    rows = warc.archived(pages, path).collect()
    assert len(rows) == len(ROWS)
    first = {}
    for p, _, h in ROWS:
        own = (h or "").encode()
        first[own] = min(first.get(own, p), p) if p is not None and first.get(own, p) is not None else first.get(own) if p is None else p
    want = sorted(
        str((p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if first[d] == p else "revisit", None if first[d] == p else first[d]))
        for p, _, h in ROWS for d in [(h or "").encode()]
    )
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows) == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    records = [bytes(r[0]) for r in warc.record_bytes(warc.read_archive(spark, path)).collect()]
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert "X" not in fields and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        assert hashlib.sha256(rest[:-4]).hexdigest() == fields["WARC-Block-Digest"].removeprefix("sha256:")
        assert (fields["WARC-Type"] == "revisit") == (fields["Content-Length"] == "0" and "WARC-Refers-To" in fields)
    names = [dict(x.split(": ", 1) for x in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])["WARC-Record-ID"] for r in records]
    assert len(set(names)) == len(names)


def test_hostile_urls(spark):
    """What a URL holds never ends a header line, begins a field or empties a block."""
    urls = ["http://b/WARC-Type: revisit", "http://c/\u2028WARC-Refers-To: <urn:page:5>\u2028WARC-Payload-Digest: sha1:FAKE", "http://d/\u0085WARC-Type: revisit", "http://e/\r\nWARC-Type: revisit\r\n\r\n", "http://f/\x00\t\x0b é"]
    pages = spark.createDataFrame([(i, u, f"page {i}", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, header string")
    got = sorted(map(tuple, warc.archived(pages).collect()))
    assert got == [(i, 6, base64.b32encode(hashlib.sha1(f"page {i}".encode()).digest()).decode(), "response", None) for i in range(len(urls))]


def test_one_payload_in_many_parts(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "if(id < 200, 'same', concat('x', id % 40)) AS html")
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k long, v string")
    many = spark.range(1000).selectExpr("if(id < 900, 7, id % 60) AS k", "id")
    got = Counter(tuple(r) for r in salted_join(many, rows, "k", many["id"], heavy=20).select("k", "id", "v").collect())
    assert got == Counter((k, i, f"v{k}" if k < 50 else None) for i in range(1000) for k in [7 if i < 900 else i % 60])
    found = {r["page_id"]: r["refers_to"] for r in warc.archived(pages).collect()}
    assert len(found) == 300 and all(found[i] == 0 for i in range(1, 200)) and found[0] is None and found[200] is None and found[240] == 200


def test_damage_is_noticed(spark):
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    bad = new_path(spark, "warc")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"abd")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="payload damaged"):
        warc.read_archive(spark, bad).collect()


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
