"""Importance resampling against a plain loop over zlib's CRCs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import resampling
from quantloom.llm.chunk_encoder import text_bytes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_features(text, run=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(words[i : i + k + 1]) for k in range(run) for i in range(len(words) - k)], len(words)


def plain(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text)[0]))
    for text in target:
        t.update(map(bucket, plain_features(text)[0]))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(S + 10000) / (float(s[b] + 1) * float(T + 10000))))
    rows = []
    for d, text in docs:
        f, n = plain_features(text)
        w = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = enough[: percent * len(enough) // 100]
    ranks = {id(r): i + 1 for i, r in enumerate(drawn)}
    return sorted([(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows], key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcXYZé中9") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    return [rng.choice([" ", ", ", "-", "\n\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def rows_of(df):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block", [1 << 19, 7])
def test_buckets_in_any_block(monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows = [*texts(60, 1), "", "a", "A b", "x" * 3000 + " y", "é" * 300, "end", "start", " ", "1:2_3"]
    found, total, words = resampling.feature_buckets(*text_bytes(pa.array(rows)))
    expected = [plain_features(t) for t in rows]
    assert total.tolist() == [len(f) for f, _ in expected] and words.tolist() == [n for _, n in expected]
    assert found.tolist() == [zlib.crc32(x.encode()) % 10000 for f, _ in expected for x in f]


def test_crc_of_every_length():
    rng = np.random.default_rng(1)
    buffer = rng.integers(0, 256, 9000, dtype=np.uint8)
    starts, lengths = rng.integers(0, 6000, 400), np.concatenate([np.arange(1, 300), rng.integers(1, 2500, 101)])
    assert resampling.crc_by_length(buffer, starts, lengths).tolist() == [zlib.crc32(buffer[a : a + n]) for a, n in zip(starts, lengths, strict=True)]


def test_different_words_never_share_a_number(monkeypatch):
    """A hash that mixes words up is replaced until bytes agree."""
    real, calls = np.random.default_rng, []

    class Bad:
        def integers(self, low, high, size=None, dtype=None):
            return np.ones(size, np.uint64) if size else 1

    monkeypatch.setattr(np.random, "default_rng", lambda seed: calls.append(seed) or (Bad() if seed == 0 else real(seed)))
    buffer = np.frombuffer(b"ab ba ab ", np.uint8)
    assert len(set(resampling.word_numbers(buffer, np.array([0, 3, 6]), np.array([2, 2, 2])).tolist())) == 2 and calls == [0, 1]


def test_against_plain_loop(spark):
    docs = list(enumerate(texts(400, 2))) + [(900, None), (901, ""), (902, "one two"), (903, "word " * 30_000)]
    target = [*texts(20, 3), None, "Word word word"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows_of(found) == plain(docs, target)
    assert sum(r[4] is not None for r in rows_of(found)) == 5 * sum(plain_features(t)[1] >= 20 for _, t in docs) // 100 > 0


def test_ties_repeats_nulls_clashes_and_empty_tables(spark):
    same = "a b c d e f g h i j k l m n o p q r s t u"
    docs = [(5, same)] * 30 + [(None, same)] * 12 + [(7, "short")] * 3
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in docs], "doc_id long, text string, score int, rank double, n_words string")
    target = spark.createDataFrame([("a b", 1)], "text string, doc_id int")
    assert rows_of(resampling.resample(df, target)) == plain(docs, ["a b"])
    none = spark.createDataFrame([], "text string")
    assert rows_of(resampling.resample(df, none)) == plain(docs, [])
    assert resampling.resample(spark.createDataFrame([], "doc_id long, text string"), target).count() == 0
