import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.tokenize import VOCABULARY, PairIndexEncoder, decode_ids, encode_corpus, load_vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return PairIndexEncoder(*load_vocabulary(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", "aaaaaaaaa", "hello world", " \n\n  x", "I'LL it's 12345 ½ 日本語 <|endoftext|>", "x" * 5000, "for (int i = 0; i < n; i++) {\n\t}\n", "​  ﻿"]


def test_equals_the_library(encoder, library):
    assert encoder.encode(TEXTS) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    enc = PairIndexEncoder(*test_any_text.vocab)
    ids = enc.encode([text])[0]
    assert ids == test_any_text.library.encode(text, add_special_tokens=False).ids
    assert test_any_text.library.decode(ids, skip_special_tokens=False) == text or decode_ids(ids) == text


test_any_text.vocab = load_vocabulary(VOCABULARY)
test_any_text.library = tokenizers.Tokenizer.from_file(VOCABULARY)
test_any_text.library.encode_special_tokens = True


def test_words_are_independent_of_their_batch(encoder):
    words = [t for t in " ".join(TEXTS).split(" ") if t]
    random.Random(1).shuffle(words)
    together = encoder.encode_words(dict.fromkeys(words))
    assert all(together[w] == PairIndexEncoder(*test_any_text.vocab).encode_words([w])[w] for w in words[:20])


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "hello world", 0), (1, "hello world", 1), (2, None, 0), (3, "", 0), (4, "z" * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "_h")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and got[1] == [31373, 995] and len(got) == 4
    assert decode_ids(got[4]) == "z" * 200_000
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
