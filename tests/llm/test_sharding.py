import zlib
from collections import Counter

import pytest

from cuefold.llm import sharding
from tests.llm.cases import corpus, edge_docs, empty


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation(n):
    cells = {sharding.permuted(x, n, 7) for x in range(n)}
    assert len(cells) == n
    assert sorted((lambda s: s[1] * 24 + s[0])(sharding.place(x, n, 24, 7)) for x in range(n)) == list(range(n))


def check(docs, shards=24):
    rows = sharding.shard(docs, shards).collect()
    base = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in base)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sorted(r["row_number"] for r in rows) == list(range(len(base)))
    order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in sorted(rows, key=lambda r: r["row_number"])]
    assert order == sorted(order)
    slots = {}
    for r in rows:
        assert (r["shard"], r["slot"]) == sharding.place(r["row_number"], len(base), shards)
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    check(docs)
    check(docs.repartition(7), 5)


def test_edges(spark):
    check(edge_docs(spark))
    check(edge_docs(spark).limit(1), 3)
    assert sharding.shard(empty(spark)).collect() == []
