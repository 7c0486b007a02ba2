import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lightgraph.llm import bpe, queries

from .helpers import documents, empty_documents, odd_documents, odd_rows

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def hf(text):
    return HF.encode(text or "", add_special_tokens=False).ids


PARTS = ["ab", "aA'", "'s", "'re", "'ll", "a1 ", "é中", "　", "\xa0", "!?.' ", "\n", " \t", "   ", "01", "<|endoftext|>", "<|endo", "\U0001f600", "\x1c\x1d", "the ", " in", "-", "\x85", "ſ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(3, 60))
def test_tree_is_the_encoding(text, leaf):
    codec = bpe.codec()
    expected = hf(text)
    assert codec.encode(text) == expected
    assert bpe.encode_tree(codec, text, leaf) == expected
    assert codec.decode(expected).decode("utf-8", "replace") == HF.decode(expected, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(2, 40))
def test_tree_on_any_text(text, leaf):
    text = text.encode("utf-8", "replace").decode()
    assert bpe.encode_tree(bpe.codec(), text, leaf) == hf(text)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 40_000, "0123456789" * 9000, " " * 90_000 + "x", "é中文" * 20_000, "aB3/+x" * 15_000, "!?" * 40_000, "\n" * 70_000])
def test_long_unsplit_texts(text):
    assert bpe.encode_tree(bpe.codec(), text) == hf(text)


def varied(alphabet, n, seed):
    rng = np.random.default_rng(seed)
    return "".join(np.array(list(alphabet))[rng.integers(0, len(alphabet), n)])


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CHINESE = "".join(chr(0x4E00 + 7 * n) for n in range(2000))
RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюя     "


@pytest.mark.parametrize("text", [varied(BASE64, 1_200_000, 1), varied(CHINESE, 400_000, 2), varied(CHINESE + "，。" * 150, 400_000, 3), varied(RUSSIAN, 700_000, 4), varied("abcdefghij   .,'", 1_200_000, 5), varied(" \t\n", 300_000, 6)], ids=["base64", "chinese", "punctuated", "russian", "english", "blanks"])
def test_joins_encode_little_again(text):
    """Megabytes without ASCII words: a tenth of the text at most is encoded again, at all levels of the tree together."""
    codec = bpe.Codec()
    ids = bpe.encode_tree(codec, text)
    assert codec.encoded < 0.1 * len(text)
    assert codec.decode(ids).decode() == text
    assert ids == hf(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé中 '\u0301s re\n1.", max_size=400), st.integers(2, 30))
def test_tree_on_texts_of_few_characters(text, leaf):
    assert bpe.encode_tree(bpe.codec(), text, leaf) == hf(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "中文", "привет", "don't", "we'll", "   ", " ", "\n\n", "12", "3", "!", "''", "'s", "\u00a0", "\U0001f600"]), min_size=60, max_size=250).map("".join), st.integers(40, 200))
def test_windows_smaller_than_their_sides(text, leaf):
    """Sides of many tokens, so that windows end inside them."""
    assert bpe.encode_tree(bpe.codec(), text, leaf) == hf(text)


def test_pairs_merge_as_the_library_says():
    codec, rng = bpe.codec(), np.random.default_rng(0)
    for a, b in rng.integers(0, 50256, (3000, 2)).tolist():
        piece = codec.bytes[a] + codec.bytes[b]
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        if text.isalpha():
            assert codec.merged(piece) == hf(text)


def digests(text):
    ids = hf(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(HF.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_against_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = queries.op3_bpe_round_trip(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(texts[r.doc_id]) for r in rows)


def test_leaves_of_many_documents(spark, sf):
    """Every text through its leaves, as rows."""
    docs = documents(spark, sf).limit(50)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.round_trip(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), leaf=100).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(texts[r.doc_id]) for r in rows)


def test_odd_rows(spark):
    rows = bpe.round_trip(odd_documents(spark)).collect()
    expected = sorted((i is None, i or 0, *digests(t)) for i, t, *_ in odd_rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert bpe.round_trip(empty_documents(spark)).count() == 0
