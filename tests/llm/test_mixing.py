import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from cuefold.llm import mixing
from tests.llm.cases import edge_docs, empty


def plain_count(seed, key, mean):
    parts = max(1, math.ceil(mean / 16))
    total = 0
    for j in range(1, parts + 1):
        text = f"{seed}:{'null' if key is None else key}:{j}"
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-mean / parts)
        k = 0
        while u >= cdf and k < 128:
            k += 1
            p *= mean / parts / k
            cdf += p
        total += k
    return total if mean > 0 else 0


def test_counts_follow_the_distribution(spark):
    for mean in (0.0, 0.3, 2.5, 70.0):
        rows = spark.range(3000).select("id", mixing.poisson_count(42, F.col("id"), F.lit(mean)).alias("k")).collect()
        assert all(r["k"] == plain_count(42, r["id"], mean) for r in rows)
        ks = [r["k"] for r in rows]
        average = sum(ks) / len(ks)
        assert abs(average - mean) <= 5 * math.sqrt(max(mean, 1e-9) / len(ks))
        if mean:
            assert abs(sum((k - average) ** 2 for k in ks) / len(ks) / mean - 1) < 0.15


def test_targets(spark):
    rows = [(i, "x" * 40, "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    got = Counter(r["source"] for r in mixing.mixed_documents(docs, targets=targets).collect())
    assert abs(got["small"] / sum(got.values()) - 0.75) < 0.03
    assert abs(sum(got.values()) / 4000 - 1) < 0.1
    only = mixing.mixed_documents(docs, targets=targets.where("source = 'small'"))
    assert {r["source"] for r in only.collect()} == {"small"}


def test_edges(spark):
    docs = edge_docs(spark)
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    assert None in rate
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in docs.collect():
        want[tuple(r)] += plain_count(42, r["doc_id"], rate[r["source"]])
    assert Counter(map(tuple, mixed.collect())) == +want
    assert mixing.mixed_documents(empty(spark)).collect() == []
    again = mixing.mix(docs.repartition(3)).select("doc_id", "__cf_copy", "__cf_order")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixing.mix(docs).select("doc_id", "__cf_copy", "__cf_order").collect()))
