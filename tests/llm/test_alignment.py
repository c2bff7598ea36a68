import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cuefold.llm import alignment
from tests.llm.cases import corpus, edge_docs, empty

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def of_piece(i):
    p = B.id_to_piece(i)
    return bytes([int(p[1:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


SIGNS = alignment._byte_signs()


def one(text):
    """(A ids, B ids, groups, links) of whole texts, by comparing all tokens' ranges."""
    if not text:
        return [], [], [], []
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a, bytes_b = [bytes(SIGNS[c] for c in A.id_to_token(i)) for i in ids_a], [of_piece(i) for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    ranges = []
    for parts in (bytes_a, bytes_b):
        at, own = 0, []
        for p in parts:
            own.append((at, at + len(p)))
            at += len(p)
        ranges.append(own)
    ra, rb = ranges
    links, low = [], 0
    for i, (s, e) in enumerate(ra):
        while rb[low][1] <= s:
            low += 1
        j = low
        while j < len(rb) and rb[j][0] < e:
            links.append((i, j))
            j += 1
    groups, ends_b, i, j = [], {e: k for k, (_, e) in enumerate(rb)}, 0, 0
    for k, (_, e) in enumerate(ra):
        if e in ends_b:
            groups.append((ids_a[i : k + 1], ids_b[j : ends_b[e] + 1]))
            i, j = k + 1, ends_b[e] + 1
    return ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]


def plain(rows):
    found = [one(t) for _, t in rows]
    count = Counter(p for *_, links in found for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = Counter()
    for (d, _), (a, b, groups, links) in zip(rows, found, strict=True):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if told else ""
        out[d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest] += 1
    return out


ODD = [
    "", None, " ", "  two  spaces ", "\n", "a\n b \n\nc", " lead", "tail ", "▁marked", "a ▁ b", "<s>hi</s> <|endoftext|> <0x41>", "tab\t\ttab \t x", "a\x00b", "　wide 　 x", " nb  x",
    "\U0001f600\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 family", "é́ combining é", "don't we'll it's", "x" * 3000, "0123456789" * 40, "\x1c\x1d sep \x85 y", "-- ==> ||", "ﬁne Ⅷ ſ",
]


def test_against_all_ranges(spark):
    rows = [r[:2] for r in corpus()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert Counter(map(tuple, alignment.aligned(docs).collect())) == want
    assert Counter(map(tuple, alignment.aligned(docs, slice_=500).collect())) == want  # many slices


def test_parts_and_memory_limit(monkeypatch):
    """Parts learnt over several calls, forgotten in between, give what whole texts do."""
    own = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert own.parted
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    texts = [t for _, t, _ in corpus(60)] + ODD
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        numbers, hashes, owner, pair, times = own(pa.array(some, pa.string()).slice(1))
        for i, t in enumerate(some[1:]):
            a, b, groups, links = one(t)
            assert numbers[i].tolist() == [len(a), len(b), len(groups), len(links)]
            mine = {divmod(int(p), 65536): int(n) for p, n in zip(pair[owner == i], times[owner == i], strict=True)}
            assert mine == Counter(links) and bool(hashes[i]) == bool(groups)


def test_whole_texts_for_other_kinds():
    own = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    own.parted = False
    texts = [t for _, t, _ in corpus(10)] + ODD
    numbers = own(pa.array(texts, pa.string()))[0]
    assert numbers.tolist() == [[len(x) for x in one(t)] for t in texts]


def test_galloping():
    rng = random.Random(3)
    for _ in range(200):
        lists = [(sorted(rng.sample(range(1, 60), rng.randrange(1, 20))), sorted(rng.sample(range(1, 60), rng.randrange(1, 50)))) for _ in range(rng.randrange(1, 6))]
        lists = [([*a, 60], [*b, 60]) for a, b in lists]
        flat = [np.array([x + 100 * k for k, pair in enumerate(lists) for x in pair[side]]) for side in (0, 1)]
        at = [np.r_[0, np.cumsum([len(pair[side]) for pair in lists])] for side in (0, 1)]
        found = alignment.ranks(flat[0], at[0], flat[1], at[1])
        assert found.tolist() == np.searchsorted(flat[1], flat[0]).tolist()
        cut_a, cut_b, link_a, link_b = alignment.align(flat[0], at[0], flat[1], at[1])
        assert flat[0][cut_a].tolist() == sorted(set(flat[0].tolist()) & set(flat[1].tolist())) == flat[1][cut_b].tolist()
        starts = [np.r_[0, f[:-1]] for f in flat]
        for s, a, f in zip(starts, at, flat, strict=True):
            s[a[:-1]] = (f[a[:-1]] // 100) * 100
        want = [(i, j) for i in range(len(flat[0])) for j in range(len(flat[1])) if starts[0][i] < flat[1][j] and starts[1][j] < flat[0][i] and flat[0][i] // 100 == flat[1][j] // 100 or (flat[0][i] % 100 == 60 == flat[1][j] % 100 and flat[0][i] == flat[1][j])]
        assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == sorted(set(want))


def test_edges(spark):
    docs = edge_docs(spark)
    assert Counter(map(tuple, alignment.aligned(docs).collect())) == plain([tuple(r)[:2] for r in docs.collect()])
    assert alignment.aligned(empty(spark)).collect() == []
