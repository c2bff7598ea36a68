import hashlib
from collections import Counter

from pyspark.sql import functions as F

from cuefold.llm import line_dedup
from tests.llm.cases import corpus, edge_docs, empty


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain(rows, least=10):
    place = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, place(d)), place(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), place(d)) == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def hashed(rows):
    return Counter((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows)


def test_against_plain(spark):
    rows = [r[:2] for r in corpus()]
    rows += [(1000 + i, "A line that many documents share\n" + t[:500] + "\n \ta LINE that many documents share\r\nshort\nshort") for i, (_, t) in enumerate(rows[:80])]
    rows += [(2000, "Twice in one only document\nTwice in one only document"), (2001, "äöüäöüäöü\nÄÖÜÄÖÜäöüx"), (2002, "äöüäöüäöü\nÄÖÜÄÖÜäöüx\nÄÖÜÄÖÜÄÖÜX")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert hashed(plain(rows)) == Counter(map(tuple, line_dedup.line_report(docs).collect()))
    texts = {r["doc_id"]: r["text"] for r in line_dedup.deduped(docs).collect()}
    assert texts == {r[0]: r[3] for r in plain(rows)}


def test_one_line_fills_many_partitions(spark):
    """A key that spans partitions is decided by the partitions' last keys; so is one that a single document repeats over partitions."""
    rows = [(i, "the one line of all\nthe one line of all") for i in range(3_000)]
    rows += [(5_000, "\n".join(["a line told over and over"] * 4_000)), (4_000, "\n".join(["another one told over and over"] * 3_000)), (6_000, "another one told over and over")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert hashed(plain(rows)) == Counter(map(tuple, line_dedup.line_report(docs).collect()))
        assert {r["n_dropped"] for r in line_dedup.line_report(docs.where("doc_id > 0 and doc_id < 3000")).where("doc_id > 1").collect()} == {2}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps(spark):
    docs = spark.createDataFrame([(1, "some line here\nb"), (2, "x\nsome line here\ny"), (3, "only its own line")], "doc_id long, text string")
    (row,) = line_dedup.keep_bitmaps(docs).collect()
    assert row["doc_id"] == 2 and line_dedup.kept_lines(bytes(row["keep"]), 3).tolist() == [True, False, True]
    assert row["tid"] == docs.where("doc_id = 2").select(F.xxhash64("text")).first()[0]
    assert line_dedup.kept_lines(None, 2).tolist() == [True, True]


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [tuple(r)[:2] for r in docs.collect()]
    assert hashed(plain(rows)) == Counter(map(tuple, line_dedup.line_report(docs).collect()))
    assert line_dedup.line_report(empty(spark)).collect() == []


def test_very_long_unbroken_text(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "concat(repeat('x', 20000000), '\n', id) AS text")
    assert [tuple(r)[:3] for r in line_dedup.line_report(docs).orderBy("doc_id").collect()] == [(0, 2, 0), (1, 2, 1)]
