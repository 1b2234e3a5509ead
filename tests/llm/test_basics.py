"""Exact de-duplication, mixing and token output on small and awkward tables."""

import random
import zlib

import numpy as np
import pytest

from quantloom.llm import exact_dedup, mixing, token_output
from quantloom.llm.chunk_encoder import ChunkEncoder, text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (5, "a  b\tc", "en", "s1", 6),
    (3, "a b c", None, "s1", 5),
    (9, "a b\n\nc", "en", None, 6),
    (1, None, "en", "s2", None),
    (2, "", "en", "s2", 0),
    (2, "", "en", "s2", 0),
    (7, "word " * 30_000, "en", "s1", 150_000),
    (None, "lonely", "en", "s3", 6),
    (8, "x \n y 'stuff don't 　 café \U0001f600<|endoftext|>z", "en", "s3", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def test_exact_duplicates(docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert (by[5].keep_id, by[9].keep_id, by[3].kept, by[5].group_size) == (3, 3, True, 3)
    assert by[1].keep_id == 1 and by[1].group_size == 3
    assert sorted(r.kept for r in rows if r.doc_id == 2) == [False, False]
    assert by[None].kept and by[7].group_size == 1


def test_exact_duplicates_small_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", exact_dedup.SEGMENT_BITS)
    docs = spark.range(60_000).selectExpr("id as doc_id", "cast(id % 50000 as string) as text")
    rows = exact_dedup.exact_duplicates(docs)
    assert rows.where("kept").count() == 50_000
    assert rows.where("group_size = 2").count() == 20_000


def test_exact_duplicates_in_ranges(spark, monkeypatch):
    """A bitmap far too small for all rows: ranges pass one by one, unique digests pass straight through, one text has a third of the rows."""
    docs = spark.range(90_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id % 45000 as string)) as text")
    whole = sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BITS", exact_dedup.SEGMENT_BITS)
    read, plain = [], exact_dedup.repeated_bitmap

    def counting(shas, bits):
        read.append((shas.count(), shas.select("sha").distinct().count(), bits))
        return plain(shas, bits)

    monkeypatch.setattr(exact_dedup, "repeated_bitmap", counting)
    assert sorted(map(str, exact_dedup.exact_duplicates(docs).collect())) == whole
    assert len(read) == 9 and sum(n for n, _, _ in read) == 90_000 and sum(n for _, n, _ in read) == 30_001
    assert all(bits == exact_dedup.SEGMENT_BITS for *_, bits in read)
    alone = spark.range(60_000).selectExpr("id as doc_id", "cast(id as string) as text")
    assert exact_dedup.flagged_digests(alone).where("maybe").count() < 6_000


def test_exact_duplicates_of_nothing_and_of_clashing_columns(docs):
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    names = ["row", "id", "sha", "maybe", "g_sha", "n", "keep_id", "kept"]
    clash = docs.select("*", *(docs.n_chars.alias(n) for n in names))
    plain = sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    assert sorted(map(str, exact_dedup.exact_duplicates(clash).collect())) == plain


def brute_targets(sizes, weights, most=3):
    total, full = sum(sizes), [s == 0 for s in sizes]
    while True:
        left = total - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        open_weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        out = [most * s if f else w * left / open_weight for s, w, f in zip(sizes, weights, full, strict=True)]
        over = [o > most * s for o, s in zip(out, sizes, strict=True)]
        if not any(over):
            return out
        full = [f or o for f, o in zip(full, over, strict=True)]


def test_mix_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["a", "b", "b", "b", "b", "c", "d", None]), 0) for i in range(3000)]
    found = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    names = ["a", "b", "c", "d", None]
    sizes = [sum(r[1].count("w") for r in rows if r[3] == n) for n in names]
    targets = brute_targets(sizes, [5, 2, 1, 5, 2])
    source = {r[0]: r[3] for r in rows}
    for name, size, target in zip(names, sizes, targets, strict=True):
        mine = [r for r in found if source[r.doc_id] == name]
        assert {r.source_size for r in mine} == {size}
        assert mine[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in mine) - target) <= 60
        assert all(r.taken <= 3 * r.size for r in mine)
    again = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert again.count() == sum(r.times for r in found)


def test_mix_of_null_and_repeated_ids(spark):
    """Rows that share a hash are taken one by one: every source comes near its target, in the plan and in the mix."""
    rng = random.Random(5)
    rows = [(None, "w " * rng.randrange(1, 30), "en", "a", 0) for _ in range(2000)] + [(7, "w " * 10, "en", "b", 0)] * 3000 + [(i, "w " * 8, "en", "c", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    docs = mixing.materialize(docs, "t")
    names = ["a", "b", "c"]
    sizes = [sum(r[1].count("w") for r in rows if r[3] == n) for n in names]
    targets = dict(zip(names, brute_targets(sizes, [5, 2, 1]), strict=True))
    taken = {r.source: r.n for r in mixing.mix_documents(docs).selectExpr("source", "size(split(trim(text), ' ')) as n").groupBy("source").sum("n").toDF("source", "n").collect()}
    assert all(abs(taken[n] - targets[n]) <= 60 for n in names)
    plan = mixing.mix_plan(docs).collect()
    assert abs(sum(r.taken for r in plan if r.doc_id == 7) - targets["b"]) <= 60 and abs(sum(r.taken for r in plan if r.doc_id is None) - targets["a"]) <= 60


def test_mix_awkward(docs, spark):
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == len(AWKWARD) and all(r.target <= 3 * r.source_size for r in rows)
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).columns == docs.columns
    clash = docs.withColumn("size", docs.n_chars).withColumn("target", docs.n_chars)
    assert mixing.mix_documents(clash).columns == clash.columns


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(token_output.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_output_round_trip(docs):
    rows = token_output.token_output(docs).orderBy("start").collect()
    ordered = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, doc, ids in zip(rows, ordered, library(r[1] for r in ordered), strict=True):
        ids = [*ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc[0], start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_output.token_output(docs.limit(0)).count() == 0
    clash = docs.select("*", *(docs.n_chars.alias(n) for n in ("shard", "shard_start", "ids", "start", "n_tokens")))
    assert token_output.token_output(clash).orderBy("start").collect() == rows


def test_token_files_prune(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text"), path)
    found = token_output.read_tokens(spark, path).where("doc_id = 77").collect()
    assert len(found) == 1 and found[0].ids == [*library(["text 77"])[0], 0]


def test_chunk_encoder_random_unicode():
    import pyarrow as pa

    rng = random.Random(1)
    alphabet = "ab'sre  \n\t\r  　​\u0085\x1c.,!1٣é中\U0001f600ZQ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(3000)] + ["y" * 200, "<|endoftext|> a"]
    coder = ChunkEncoder(token_output.default_tokenizer())
    for _ in range(2):
        ids, counts = coder.encode(*text_bytes(pa.array(texts)))
        ends = np.cumsum(counts)
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == library(texts)
