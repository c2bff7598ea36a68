import random
import tracemalloc
import zlib

import numpy as np

from cuefold.llm import quality, terms, toxicity
from tests.llm.cases import corpus, edge_docs, empty

SF = "/root/testdata/sf0.1"


def held(spark, classify, label, folds, held_out):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = classify(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held_out) for r in rows)
    own = [r for r in rows if r["held_out"]]
    pos, neg = [r["score"] for r in own if r[label]], [r["score"] for r in own if not r[label]]
    auc = np.mean(np.asarray(pos)[:, None] > np.asarray(neg)[None, :])
    return np.mean([r["predicted"] == r[label] for r in own]), auc, len(own)


def test_quality_on_held_out_rows(spark):
    accuracy, auc, n = held(spark, quality.classify, "quality", 4, 2)
    assert accuracy > 0.97 and auc > 0.98 and n > 500, (accuracy, auc)


def test_toxicity_on_held_out_rows(spark):
    accuracy, auc, n = held(spark, toxicity.classify, "toxic", 5, 0)
    assert accuracy > 0.98 and auc > 0.93 and n > 500, (accuracy, auc)  # one toxic text in 25 has lost its words to junk


def test_pairs_of_terms_are_learnt():
    """Toxic only where two terms meet: no linear weights can tell."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(4000):
        a, b = (int(x) for x in rng.random(2) < 0.5)
        rows.append((int(a == b), [0] * a + [1] * b + [2]))
    machine = toxicity.fit([(y, sorted(set(t))) for y, t in rows], np.arange(3), toxicity.Settings())
    for a in (0, 1):
        for b in (0, 1):
            slot = np.array([0] * a + [1] * b + [2])
            assert (machine.dots(np.zeros(len(slot), int), slot, 1)[0] > 0) == (a == b)


def test_pairs_tell_where_no_term_does(spark):
    """Toxic if one of two words is there and not the other: each word is as frequent in clean texts as in toxic ones."""
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(4_000):
        a, b = (bool(x) for x in rng.random(2) < 0.5)
        words = [f"word{k}" for k in rng.integers(0, 3_000, 12)] + ["zebra"] * a + ["quokka"] * b
        docs.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(a != b)))
    found = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = [r for r in found.collect() if r["held_out"]]
    assert len(rows) > 500 and np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in rows]) > 0.97


def test_scores_against_plain_python(spark):
    """Each text's score from its words and stems, one by one, by the definition of the machine."""
    texts = [t for _, t, _ in corpus(60)] + ["", None, "x y x", "word " * 50]
    hashed = lambda t: terms.stems([t.encode()], (4, 5, 6))[1] >> np.uint64(44)
    rng = np.random.default_rng(2)
    known = np.unique(np.concatenate([hashed((t or "").lower()) for t in texts]))[::3].astype(np.int64)
    machine = toxicity.Machine(known, -0.3, rng.normal(0, 0.05, len(known)), rng.normal(0, 0.05, (len(known), 8)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, machine).collect():
        own = sorted({int(np.searchsorted(known, h)) for h in hashed((texts[r["doc_id"]] or "").lower()).tolist() if h in set(known.tolist())})
        dot = machine.bias + sum(machine.linear[i] for i in own)
        dot += sum(float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(own) for j in own[a + 1 :])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(dot, -35, 35)))) < 1e-9


def test_quality_against_plain_python(spark):
    """One shard of follow-the-regularised-leader steps, term by term, and the sparse dot products, by their definitions."""
    s = quality.Settings(shards=1, bits=12, epochs=2)
    rows = [(i, t) for i, t, _ in corpus(40)] + [(9_000, ""), (9_001, "one two one two")]
    labels = [(i, i % 2) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), settings=s).collect()}

    def counted(text):
        index = quality.features([text.encode()], s)[1].tolist()
        return {k: index.count(k) * quality.SCALE / len(index) for k in set(index)} | {"bias": 1.0}

    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= s.l1 else (np.sign(z[k]) * s.l1 - z[k]) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)
    keys = {r["doc_id"]: r["key"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS key").collect()}
    train = sorted((keys[i], t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2)
    for _ in range(s.epochs):
        for _, text, y in train:
            x = counted(text)
            w = {k: weight(k) for k in x}
            g = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x))) - y
            for k in x:
                d = g * x[k]
                z[k] = z.get(k, 0.0) + d - ((n.get(k, 0.0) + d * d) ** 0.5 - n.get(k, 0.0) ** 0.5) / s.alpha * w[k]
                n[k] = n.get(k, 0.0) + d * d
    for i, text in rows:
        dot = sum(weight(k) * v for k, v in counted(text).items() if k in z)
        assert abs(got[i] - 1 / (1 + np.exp(-dot))) < 1e-4


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (6, None, None), (None, 1, 1), (7, 5, 5)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for some in (labels, labels.limit(0)):
            rows = module.classify(docs, some).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            blank = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
            assert len(blank) == 1
        assert module.classify(empty(spark), labels).collect() == []
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.accepted(docs, labels, threshold=1.1).count() == docs.count()
    assert toxicity.accepted(docs, labels.limit(0)).count() == docs.count()


def test_terms():
    owner, h = terms.tokens([b"ab cd ab", b"", b"cd!! 12ab"])
    assert owner.tolist() == [0, 0, 0, 2, 2, 2, 2]
    ab, cd = h[0], h[1]
    assert h.tolist()[2:4] == [ab, cd] and h[6] == ab and len(set(h.tolist())) == 4
    owner, grams = terms.ngrams(owner, h, 2)
    assert len(grams) == 7 + 2 + 3
    big = "wörd " * 300_000
    assert sum(len(part) for _, part in terms.slices([big, None, "x", big])) == 4


def test_long_texts_in_parts():
    """Parts of any size give the n-grams and terms of the whole text, repeats, signs and other scripts included."""
    rng = random.Random(6)
    words = ["one", "Two", "x", "--", "7", "été", "日本", "one one", "a.b", "!!", "\n", "  ", "idiot"]
    s = quality.Settings()
    for size in (20, 64, 500):
        text = " ".join(rng.choices(words, k=400)).encode()
        want = np.bincount(quality.features([text], s)[1], minlength=1 << s.bits)
        got = sum(np.bincount(x, minlength=1 << s.bits) for x in quality.long_features(text, s, size))
        assert (got == want).all()


def test_texts_of_many_megabytes(monkeypatch):
    """One unbroken run, and plain words, in memory that does not go by the text's length; scores as the whole text has them where it has white space."""
    t = toxicity.Settings()
    text = b"some plain words and an idiot too " * 40_000
    whole = np.unique((terms.stems([text], t.stems)[1] >> np.uint64(64 - t.bits)).astype(np.int64))
    assert len(text) > terms.LONG and toxicity.distinct_terms([text], t)[1].tolist() == whole.tolist()
    tracemalloc.start()
    for long in (b"x" * 30_000_000, text * 20):
        assert sum(len(x) for x in quality.long_features(long, quality.Settings())) > 20
        assert len(toxicity.distinct_terms([long], t)[1]) > 0
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400_000_000
