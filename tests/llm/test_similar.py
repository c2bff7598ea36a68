import corpus_pipeline
from cuefold.llm import similar, simhash
from tests.llm.cases import edge_docs, empty, near_copies

SF = "/root/testdata/sf0.01"


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """{doc_id: smallest id reachable} by comparing all pairs of sets."""
    sets = [(d, plain(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, o in sets[:i]:
            both = len(s & o) if min(len(s), len(o)) >= 0.8 * max(len(s), len(o)) else -1
            if both >= 0.8 * (len(s) + len(o) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d, _ in sets}


def test_components_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(near_copies(60))] + [(2 * 10**6, None), (2 * 10**6 + 1, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()} == plain_components(rows)


def test_buckets_in_chunks(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.near_duplicates(docs, bucket=7)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain_components(rows)


def test_stage_drops_copies_beyond_four_bits(spark):
    words = [f"w{i}" for i in range(100)]
    one, two = " ".join(words), " ".join([*words[:40], "other", "words", *words[42:]])
    assert (simhash.fingerprint(one) ^ simhash.fingerprint(two)).bit_count() > 4
    docs = spark.createDataFrame([(1, one), (2, two), (3, " ".join(words[:60]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()) == [1, 3]


def test_edges(spark):
    docs = edge_docs(spark)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 7, 9]
    assert kept.where("doc_id is null").count() == 2
    assert similar.near_duplicates(empty(spark)).collect() == []
