import re
from collections import Counter

import numpy as np
import xxhash

from cuefold.llm import simhash
from cuefold.llm.components import components
from tests.llm.cases import corpus, edge_docs, empty, near_copies


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    """{index: smallest id reachable} by comparing all pairs of fingerprints."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in rows]


def check(docs, rows, **options):
    got = Counter((r[0], r[1], r[2]) for r in simhash.near_duplicates(docs, **options).collect())
    assert got == Counter(plain_components([(d, plain_fingerprint(t)) for d, t, *_ in rows]))


def test_against_all_pairs(spark):
    rows = corpus(120) + [(1000 + i, t, "s") for i, t in enumerate(near_copies(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs, rows)
    check(docs, rows, bucket=8)  # every bucket is dealt out in chunks


def test_edges(spark):
    docs = edge_docs(spark)
    check(docs, [tuple(r)[:2] for r in docs.collect()])
    check(empty(spark), [])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 3, 7}.issubset(ids) and not {2, 4, 5, 8, 10} & set(ids)


def test_index_against_all_pairs():
    rng = np.random.default_rng(3)
    for n, spread in ((2, 3), (70, 6), (700, 9)):
        base = rng.integers(0, 2**63, 3, dtype=np.uint64)
        codes = base[rng.integers(0, 3, n)]
        for _ in range(spread):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        groups = rng.integers(0, 3, n)
        order = np.lexsort((codes, groups))
        codes, groups = codes[order], groups[order]
        keep = np.r_[True, (codes[1:] != codes[:-1]) | (groups[1:] != groups[:-1])]
        codes, groups = codes[keep], groups[keep]
        u, v = simhash.link_groups(codes, groups)
        for g in np.unique(groups):
            own = codes[groups == g].tolist()
            index = {c: i for i, c in enumerate(own)}
            got, want = list(range(len(own))), list(range(len(own)))

            def find(root, x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                if a in index and b in index:
                    got[find(got, index[a])] = find(got, index[b])
            for i, a in enumerate(own):
                for j in range(i):
                    if (a ^ own[j]).bit_count() <= 4:
                        want[find(want, i)] = find(want, j)
            parts = lambda root: sorted(Counter(find(root, i) for i in range(len(own))).values())
            assert len({find(got, i) for i in range(len(own))}) >= len({find(want, i) for i in range(len(own))})
            if len(np.unique(groups)) == 1:
                assert parts(got) == parts(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 150)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(200, 150)}
    assert components(edges.limit(0)).collect() == []
