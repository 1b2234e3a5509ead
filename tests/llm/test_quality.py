"""Held-out accuracy of the quality classifier, and awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import quality
from quantloom.llm.chunk_encoder import text_bytes

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels.where("quality is not null"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= 0.97


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "word " * 30_000, None), (4, "plain words here", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1), (4, None), (1, 0), (6, None)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert [r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()] == [0.5] * 4
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_features_do_not_cross_texts():
    texts = ["ab ab cd!", "", "  x", "É12"]
    joined = quality.counted(*text_bytes(pa.array(texts)))
    for text, (index, share) in zip(texts, joined, strict=True):
        alone = quality.counted(*text_bytes(pa.array([text])))[0]
        assert np.array_equal(index, alone[0]) and np.allclose(share, alone[1])


def plain_features(text):
    """Buckets of a text by plain loops: words, shapes, repeats and trigrams within words."""
    many = 2**64 - 1

    def bucket(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & many
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & many
        return (x ^ (x >> 31)) >> (64 - quality.BITS)

    byte, gram, step, out, last = [int(x) for x in quality._BYTE], [int(x) for x in quality._GRAM], int(quality._STEP), [], None
    for word in text.encode().split():
        value = sum(byte[b] * pow(step, i + 1, 2**64) for i, b in enumerate(word)) & many
        kinds = [sum(65 <= b <= 90 for b in word), sum(97 <= b <= 122 or b >= 128 for b in word), 0, sum(48 <= b <= 57 for b in word)]
        kinds[2] = len(word) - sum(kinds)
        out += [bucket(value), bucket(sum(min(n, 2) * 3**k for k, n in enumerate(kinds)) + (1 << 40))]
        if value == last:
            out.append(bucket(1 << 41))
        padded = b" " + word + b" "
        out += [bucket((byte[a] * gram[0] + byte[b] * gram[1] + byte[c] * gram[2]) & many) for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]
        last = value
    return out


TEXTS = ["Good plain text, with words and words.", "BUY BUY now!!! 99 99 99", "", "another fine line of plain text here", "x1 x1 $$$ $$$ CLICK", "élan vital and words", "win 1000 1000 cash!!", "calm quiet words in a row"]


def test_features_against_plain_loops():
    for text, (index, share) in zip(TEXTS, quality.counted(*text_bytes(pa.array(TEXTS))), strict=True):
        found = plain_features(text)
        expected = {b: found.count(b) / len(found) for b in found}
        assert set(index.tolist()) == set(expected) and np.allclose(share, [expected[b] for b in index.tolist()])


def test_training_against_plain_loops(monkeypatch):
    """The same descent, one document and one feature at a time."""
    monkeypatch.setattr(quality, "BATCH", 3)
    truth = [1, 0, 0, 1, 0, 1, 0, 1]
    rows = [(i, s, y) for (i, s), y in zip(quality.counted(*text_bytes(pa.array(TEXTS))), truth, strict=True)]
    weights, bias = quality.train(rows, epochs=3)
    rng = np.random.default_rng(quality.SEED)
    vectors = rng.normal(0, 0.1, (1 << quality.BITS, quality.WIDTH))
    output, offset = rng.normal(0, 0.5, (quality.WIDTH, 2)), np.zeros(2)
    squares, balance = {}, [len(rows) / (2 * truth.count(k)) for k in (0, 1)]
    for epoch in range(3):
        rate, order = quality.RATE * (1 - epoch / 3), rng.permutation(len(rows))
        for a in range(0, len(order), 3):
            part, pulls, d_out, d_off = [rows[i] for i in order[a : a + 3]], [], 0, 0
            for index, share, y in part:
                mean = sum((vectors[b] * s for b, s in zip(index, share, strict=True)), np.zeros(quality.WIDTH))
                p = np.exp(mean @ output + offset)
                p /= p.sum()
                p[y] -= 1
                p *= balance[y]
                d_out, d_off = d_out + np.outer(mean, p), d_off + p
                pulls += [(b, s * (output @ p)) for b, s in zip(index, share, strict=True)]
            for b, pull in pulls:
                squares[b] = squares.get(b, 1e-6) + (pull**2).sum()
            for b, pull in pulls:
                vectors[b] -= rate * pull / np.sqrt(squares[b])
            output, offset = output - rate * d_out / len(part), offset - rate * d_off / len(part)
    assert bias == pytest.approx(offset[1] - offset[0], abs=1e-3)
    assert np.allclose(weights, vectors @ (output[:, 1] - output[:, 0]), atol=2e-3)


def test_long_labelled_texts_are_learned_from(spark):
    known = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:40]
    long = {i: ("calm quiet prose " if i % 2 else "cash now win ") * 40_000 + f"{i}" for i in known[:6]}
    docs = spark.createDataFrame([(i, long.get(i, "calm quiet prose" if i % 2 else "cash now win")) for i in known], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in known], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels)
    assert len(rows) == len(known) and all(abs(share.sum() - 1) < 1e-3 for _, share, _ in rows)
    assert all(r.predicted == r.doc_id % 2 for r in quality.quality_scores(docs, labels).collect())


def test_a_labelled_id_on_many_rows_is_learned_from_once(spark):
    known = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(known, f"text {i % 7}") for i in range(500)] + [(None, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(known, 1), (known, 1), (None, 0)], "doc_id long, quality int")
    (index, _, y), *more = quality.training_rows(docs, labels)
    assert not more and y == 1 and set(index.tolist()) == set(plain_features("text 0"))
