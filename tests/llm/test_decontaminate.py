import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cuefold.llm import decontaminate as D
from tests.llm.cases import LONG, corpus, edge_docs, empty


def plain(pattern, text):
    """(distance, end) by the full table of distances."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for at, ch in enumerate(text, 1):
        nxt = [0]
        for i, p in enumerate(pattern, 1):
            nxt.append(min(nxt[-1] + 1, row[i] + 1, row[i - 1] + (p != ch)))
        row = nxt
        if row[-1] < best[0]:
            best = (row[-1], at)
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=120))
def test_bit_parallel_distance(pattern, text):
    assert D.myers(pattern, text) == plain(pattern, text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=1, max_size=90), st.integers(0, 12))
def test_pieces_are_the_item(item, edits):
    parts = D.pieces(item, min(edits, len(item) - 1))
    assert "".join(p for _, p in parts) == item and all(item[o : o + len(p)] == p and p for o, p in parts)


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["q"], [out[at], "z"]])
    return "".join(out)


def test_against_full_distance(spark):
    rng = random.Random(5)
    texts = [t for _, t, _ in corpus(60)]
    items = [(i, t[40:240]) for i, t in enumerate(texts[:12])] + [(50, "ab"), (51, ""), (52, None), (None, texts[13][10:150])]
    docs = [(i, t) for i, t in enumerate(texts[20:])] + [(100 + i, f"{texts[30 + i][:300]} {edited(item, e, rng)} and more") for i, (_, item) in enumerate(items[:12]) for e in (0, 6, 9, 40)]
    docs += [(500, None), (None, items[0][1]), (501, items[0][1]), (501, items[0][1])]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter()
    for d, t in docs:
        for i, item in items:
            p = D.normalised(item)
            if p and (found := plain(p, D.normalised(t)))[0] <= int(len(p) * 0.05):
                want[d, i, found[0]] += 1
    assert Counter((r[0], r[1], r[2]) for r in got.collect()) == want and len(want) > 30


def test_blocks_and_edges(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, "text here, told once AND then"), (2, LONG[300:700]), (3, None)], "item_id long, text string")
    one = Counter(map(tuple, D.contaminated(docs, bench).collect()))
    assert one == Counter(map(tuple, D.contaminated(docs, bench, block=10).collect()))
    assert {k[0] for k in one} == {1, 2, 7, 8, 10} and one[2, 1, 0, 9, 38] == 2
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 9]
    assert D.contaminated(empty(spark), bench).collect() == [] and D.contaminated(docs, bench.limit(0)).collect() == []
