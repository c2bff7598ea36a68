import hashlib
import re
from collections import Counter

from cuefold.llm import exact_dedup
from tests.llm.cases import corpus, edge_docs, empty


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, len(t or "")))
    out = Counter()
    for key, own in groups.items():
        keep, chars = min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        for d, n in own:
            out[d, keep, len(own), (d, n) == (keep, chars), hashlib.sha256(key.encode()).hexdigest()] += 1
    return out


def test_against_groups(spark):
    rows = [r[:2] for r in corpus()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:60])] + [(2000 + i, t.replace(" ", " \n")) for i, (_, t) in enumerate(rows[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for bits in (None, 1 << 15):  # the small filter calls many rows repeated that are not
        got = exact_dedup.exact_duplicates(docs, bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert Counter(map(tuple, got.collect())) == want
    for heavy in (1, 3, 10**6):
        got = exact_dedup.exact_duplicates(docs, heavy=heavy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert Counter(map(tuple, got.collect())) == want


def test_filter_in_ranges(spark, monkeypatch):
    """A filter that is too large to go out at once gives the same marks, range by range."""
    rows = spark.range(20_000).selectExpr("id", "xxhash64(if(id < 18000, id, id % 700)) AS h")
    bits = 1 << 19
    want = {(r["id"], r["again"]) for r in exact_dedup.possibly_repeated(rows, bits).collect()}
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", bits // 8 // 4)
    got = exact_dedup.possibly_repeated(rows, bits).collect()
    assert {(r["id"], r["again"]) for r in got} == want and len(got) == 20_000
    assert all(again for i, again in want if i < 700 or i >= 18_000)


def shuffled_rows(spark, run):
    """Rows of joins' and aggregates' inputs that one query shuffles, by the plan's own counts."""
    df = run()
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_rows_told_once_are_not_shuffled(spark):
    docs = spark.range(6_000).selectExpr("id AS doc_id", "concat('text ', if(id < 5900, id, id % 7)) AS text").repartition(3)
    assert shuffled_rows(spark, lambda: exact_dedup.exact_duplicates(docs)) < 600  # the digests that the last join moves


def test_edges(spark):
    docs = edge_docs(spark)
    got = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == plain([tuple(r)[:2] for r in docs.collect()])
    assert exact_dedup.exact_duplicates(empty(spark)).collect() == []


def test_filter_lets_unique_rows_pass(spark):
    rows = spark.range(20_000).selectExpr("id", "xxhash64(if(id < 19000, id, 7)) AS h")
    marked = exact_dedup.possibly_repeated(rows)
    assert marked.where("id >= 19000 and not again").count() == 0
    assert marked.where("id < 19000 and again").count() < 19_000 * 0.01
