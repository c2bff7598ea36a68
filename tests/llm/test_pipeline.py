from collections import Counter

import corpus_pipeline
from cuefold.llm import decontaminate, mixing, toxicity
from tests.llm.cases import SF, empty
from tests.llm.test_mixing import plain_count
from tests.llm.test_similar import plain_components
from tests.llm.test_token_output import check  # noqa: F401


def test_stages_against_plain_forms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["toxicity"](spark, docs, SF).cache()
    bad = {r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - bad and bad
    assert one.columns == docs.columns
    two = stage["near_duplicates"](spark, one, SF).cache()
    found = plain_components([(r["doc_id"], r["text"]) for r in one.collect()])  # all pairs of five-word shingle sets
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d for d, c in found.items() if d == c)
    three = stage["decontamination"](spark, two, SF).cache()
    hits = {r["doc_id"] for r in decontaminate.contaminated(two, bench).collect()}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - hits
    four = stage["mixing"](spark, three, SF).cache()
    rate = {r["source"]: r["rate"] for r in mixing.rates(three).collect()}
    want = Counter({r["doc_id"]: plain_count(42, r["doc_id"], rate[r["source"]]) for r in three.collect()})
    assert Counter(r["doc_id"] for r in four.collect()) == +want and four.columns == docs.columns
    last = Counter(map(tuple, stage["token_output"](spark, four, SF).collect()))
    assert last == Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_empty(spark):
    docs = empty(spark, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
