import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import tokens

PATH = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"
HARD = ["", " ", "  \n\n \t", "it's we'll don't 's 're", "<|endoftext|> <|endoftext|>", "a" * 500, "日本語のテキスト。次の文" * 30, "  x   y \r\n\r\n z", "12ab34,,,...!!!", "naïve café ‑ 　 ﬁ", "'" * 40, " '" * 40, "🙏" * 50]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoding(PATH)


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("leaf", [1, 3, 7, 64])
def test_tree_equals_plain(enc, text, leaf):
    assert tokens.encode_text(enc, text, leaf, 2).tolist() == enc.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 .'s\n\té日。re,ll-_", max_size=120), st.integers(1, 20), st.integers(1, 8))
def test_tree_equals_plain_on_random_texts(text, leaf, window):
    enc = tokens.encoding(PATH)
    ids = tokens.encode_text(enc, text, leaf, window)
    assert ids.tolist() == enc.encode_ordinary(text)
    assert enc.decode(ids.tolist()) == text


def test_matches_the_other_library(spark, sf):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs, "doc_id", "text", leaf=256).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == (other.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])


def test_nulls_duplicates_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "hi", 6), (1, "hi", None)], "k long, t string, ids int")
    rows = tokens.encode_corpus(df, "k", "t").collect()
    assert sorted((r["k"] or 0, len(r["ids"])) for r in rows) == [(0, 1), (1, 0), (1, 0), (1, 1)]
    assert tokens.encode_corpus(df.limit(0), "k", "t").collect() == []
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(df, "k", "t").collect()) == [0, 0, 1, 1]


def test_very_long_text(enc):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "it's ", "\n\n", "x1y2", "日本", "。", "  "]) for _ in range(60_000))
    assert np.array_equal(tokens.encode_text(enc, text), np.array(enc.encode_ordinary(text)))
