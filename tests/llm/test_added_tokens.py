import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuefold.llm import token_output as T
from tests.llm.test_token_output import listed, wanted

PATH = public_tokenizers.path(T.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "  ", "\n", "b c", "<|", "endoftext", "|>", "é😀"]), max_size=12).map("".join), max_size=4))
def test_encoder_is_the_unmodified_library(texts):
    assert listed(T.encoder(PATH), texts) == wanted(texts)


def test_files_hold_added_tokens(spark):
    texts = ["a <|endoftext|> b", "plain", "<|endoftext|><|endoftext|>"]
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, T.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())) == want
