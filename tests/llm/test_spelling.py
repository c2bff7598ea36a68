import random
import re
import zlib
from collections import Counter

import numpy as np

from cuefold.llm import spelling
from tests.llm.cases import corpus, edge_docs, empty

A_Z = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows, shortest=5, least=3, every=97):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    form, out = {}, []
    for w, n in words.items():
        best = sorted((-m, v) for v, m in words.items() if abs(len(v) - len(w)) < 2 and near(w, v))
        form[w] = (best[0][1] if best and -best[0][0] >= 2 * n else None, len(best))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], words.get(form[w][0])))
    return Counter(out)


def told(df):
    return Counter(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_words(rng, n, signs="abé", most=7):
    return {"".join(rng.choice(signs) for _ in range(rng.randrange(1, most))): rng.randrange(1, 60) for _ in range(n)}


def test_vocabulary(spark):
    rows = [r[:2] for r in corpus()] + [(None, "ZWÖLF Zwölf zwölf zwÖlf zwÖlf zwÖlf zwölf" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (97, 2):
        got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, every=every).collect()}
        assert got == plain_words(rows, every=every)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        text = np.r_[0, rng.integers(1, 3, n)]
        want = sorted(range(n + 1), key=lambda i: np.roll(text, -i).tolist())  # noqa: B023
        assert spelling.suffix_order(text).tolist() == want


def test_near_in_group():
    """All pairs of all words, through both directions: no pair twice, none lost, doubled letters and words of one sign included."""
    rng = random.Random(5)
    for k in range(60):
        words = sorted(made_words(rng, 40, most=rng.choice([3, 6, 12])))
        n = np.arange(1, len(words) + 1)
        text, query = np.array([rng.random() < 0.8 for _ in words]), np.array([rng.random() < 0.8 for _ in words])
        got = Counter()
        for front in (True, False):
            got.update((words[a], words[b]) for a, b in zip(*spelling.near_in_group(words, n, text, query, front), strict=True))
        want = Counter((a, b) for i, a in enumerate(words) for j, b in enumerate(words) if query[i] and text[j] and near(a, b))
        assert got == want, k


def test_against_all_pairs(spark):
    rng = random.Random(2)
    words = made_words(rng, 700, most=9) | {"x" * 300: 9, "x" * 299 + "y": 40, "x" * 301: 3, "\U0001f600abcd": 4, "\U0001f600abce": 8, "fé": 5, "fe": 30}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain(words)
    for shard in (40_000, 300, 25):  # 25: most halves have shards of their own
        assert told(spelling.grouped(rows, shard)) == want


def test_chain_of_forms(spark):
    words = {"a" * k: 2**k for k in range(1, 25)}  # each is near the next, which is twice as frequent
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = told(spelling.grouped(rows))
    assert got == plain(words) and {r[2] for r in got} == {"a" * 24}


def test_whole_texts(spark):
    rows = [r[:2] for r in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(spelling.variants(docs, every=5)) == plain(plain_words(rows, every=5))


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [tuple(r)[:2] for r in docs.collect()]
    assert told(spelling.variants(docs, shortest=1, least=1)) == plain(plain_words(rows, 1, 1))
    assert spelling.variants(empty(spark)).collect() == []
