"""Transducer counts against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm.chunk_encoder import text_bytes
from quantloom.llm.token_counts import TokenCounter, token_counts
from quantloom.llm.token_output import default_tokenizer


@pytest.fixture(scope="module")
def machine():
    return TokenCounter(default_tokenizer())


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_random_texts(machine):
    rng = random.Random(7)
    alphabet = ["a", "b", "'", "s", "r", "e", "v", "l", "t", "m", "d", " ", " ", "  ", "\n", "\t", "　", "\u0085", "\x1c", ".", ",", "!", "1", "٣", "é", "中", "\U0001f600", "Q", "the", "ing", "tion", "<|endoftext|>", "'ll", "'re", "²", "ͅ", "­"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(6000)]
    texts += ["", "a" * 3000, "'" * 700, " " * 600 + "x", "zq" * 2000, "<|endoftext|>" * 3]
    got = machine.count(*text_bytes(pa.array(texts))).tolist()
    expected = library(texts)
    wrong = [(t, g, e) for t, g, e in zip(texts, got, expected, strict=True) if g != e]
    assert not wrong, (len(wrong), wrong[:5])


def test_words_from_pieces(machine):
    rng = random.Random(9)
    pieces = sorted(machine.merges.tokens)
    texts = []
    while len(texts) < 4000:
        word = b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))
        try:
            texts.append(word.decode())
        except UnicodeDecodeError:
            pass
    assert machine.count(*text_bytes(pa.array(texts))).tolist() == library(texts)


def test_chunks_compose(machine, monkeypatch):
    from quantloom.llm import token_counts as module

    text = "Don't stop -- we'll see  \n\n they've 12 'things' ..." * 40
    whole = machine.count(*text_bytes(pa.array([text])))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(module, "CHUNK", size)
        assert np.array_equal(machine.count(*text_bytes(pa.array([text]))), whole)


def test_query_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "it's"), (4, "word " * 40_000)]
    found = token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = library([t for _, t in rows])
    assert sorted(r.n_tokens for r in found) == sorted(expected)
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    assert sorted(r.n_tokens for r in token_counts(clash).collect()) == sorted(expected)
