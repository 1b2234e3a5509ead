"""Chunked encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import bpe_chunks
from quantloom.llm.chunk_encoder import text_bytes


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_chunks.default_tokenizer())


def expected(library, texts):
    out = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()))
    return out


@pytest.mark.parametrize(("bits", "longest"), [(7, 2048), (3, 2048), (1, 2048), (7, 5)])
def test_random_texts(library, monkeypatch, bits, longest):
    monkeypatch.setattr(bpe_chunks, "CUT_BITS", bits)
    monkeypatch.setattr(bpe_chunks, "LONGEST_CHUNK", longest)
    coder = bpe_chunks.ChunkCoder(bpe_chunks.default_tokenizer())
    rng = random.Random(bits)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\u0085", "　", ".", "12", "é", "é", "́", "İ", "Σ", "ﬁ", "中", "\U0001f600", "the", "ing", "<|endoftext|>", "<|startoftext|>", "<|", "Å", "­", "한"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 90))) for _ in range(1500)]
    shared = " ".join(rng.choice(["alpha", "Beta", "gamma's", "delta-4"]) for _ in range(400))
    texts += [shared, "x" + shared, "lead " + shared + " tail", "", " ", "\n\n", "a" * 9000, " " * 3000 + "x", shared * 3]
    assert coder.code(*text_bytes(pa.array(texts))) == expected(library, texts)
    assert coder.code(*text_bytes(pa.array(texts))) == expected(library, texts)  # all of it kept


def test_shared_passages_are_encoded_once():
    coder = bpe_chunks.ChunkCoder(bpe_chunks.default_tokenizer())
    rng = random.Random(3)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    coder.code(*text_bytes(pa.array([passage])))
    known = len(coder.chunks)
    assert known > 50
    coder.code(*text_bytes(pa.array([f"other words {k} " + passage for k in range(5)])))
    assert len(coder.chunks) <= known + 15  # the first chunk of each differs


def test_tables_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MOST_CHUNKS", 10)
    monkeypatch.setattr(bpe_chunks, "MOST_WORDS", 10)
    monkeypatch.setattr(bpe_chunks, "LONGEST_WORD", 3)
    monkeypatch.setattr(bpe_chunks, "BLOCK", 1000)
    coder = bpe_chunks.ChunkCoder(bpe_chunks.default_tokenizer())
    for seed in range(4):
        rng = random.Random(seed)
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(300)) for _ in range(20)]
        assert coder.code(*text_bytes(pa.array(texts))) == expected(library, texts)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe_chunks.ChunkCoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_on_awkward_rows(spark, library, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, "It's <|endoftext|>"), (4, "word " * 40_000), (5, "z" * 50_000)]
    want = expected(library, [t for _, t in rows])
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, decoded string").write.parquet(f"{tmp_path}/documents.parquet")
    found = bpe_chunks.op13_chunk_bpe(spark, str(tmp_path)).collect()
    line = [(d, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for (d, _), (i, t) in zip(rows, want, strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(line, key=repr)
    assert bpe_chunks.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
