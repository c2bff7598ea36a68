import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuefold.llm import token_output as T
from tests.llm.cases import corpus, edge_docs, empty

PATH = public_tokenizers.path(T.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def listed(encoder, texts):
    ids, starts = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in pairwise(starts.tolist())]


def wanted(texts, library=LIBRARY):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=200) | st.text(" \n\tab,.é's1!<|endoftext|> ß\x1c\x85\u3000😀𮯰", max_size=60), max_size=4))
def test_encoder_is_the_library(texts):
    assert listed(T.encoder(PATH), texts) == wanted(texts)


def test_encoder_forgets_and_goes_on(monkeypatch):
    texts = [t for _, t, _ in corpus(60)] + ["  two  spaces ", " \n x", "a\x1cb \x85c", "it's 'll 's"]
    assert listed(T.Encoder(PATH), texts) == wanted(texts)
    monkeypatch.setattr(T, "REMEMBERED", 50)
    own = T.Encoder(PATH)
    assert [listed(own, [t])[0] for t in texts * 2] == wanted(texts * 2)


def test_long_texts(monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 1000)
    texts = [("wörd, " * 3000) + " end", "x" * 50_000, "<|endoftext|>" * 300 + " a b" * 2000, "  " * 4000]
    assert listed(T.Encoder(PATH), texts) == wanted(texts)


def test_other_vocabularies():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, and more.", "", "  two <|endoftext|> x"]
    assert listed(T.Encoder(path), texts) == wanted(texts, Tokenizer.from_file(path))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=60))
def test_round_trip(numbers):
    control, data = T.pack(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert T.unpack(control, data, len(numbers)).tolist() == numbers


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    want = []
    for r in rows:
        ids = np.array([*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    start, told = 0, []
    for d, n, c in sorted(want, key=key):
        told.append((d, start, n, c))
        start += n
    got = sorted(map(tuple, T.encoded(docs).collect()), key=lambda x: x[1])
    assert got == told


def test_files(spark):
    check(spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(5))


def test_edges(spark):
    check(edge_docs(spark))
    assert T.encoded(empty(spark)).collect() == []
