"""The pipeline's chain on small tables: every stage works on what its predecessor kept, and its decisions take effect."""

import zlib

import corpus_pipeline
import numpy as np
import pytest

from quantloom.llm import decontam, minhash, quality, token_output
from quantloom.llm.common import materialize

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage, and the tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"t-{name}")
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_are_the_ones_asked_for(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    assert all(stages[n].columns == NAMES for n in ("quality", "near_dedup", "decontaminate", "mix"))


def test_decisions_take_effect(spark, stages):
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in quality.quality_scores(stages["documents"], labels).collect()}
    assert ids(stages["quality"]) == sorted(d for d, x in scores.items() if x >= quality.THRESHOLD)
    groups = minhash.near_duplicates(stages["quality"]).where("kept")
    assert ids(stages["near_dedup"]) == ids(groups) and len(ids(groups)) < stages["quality"].count()
    leaked = {r.doc_id for r in decontam.contamination(stages["near_dedup"], bench).collect()}
    assert leaked and ids(stages["decontaminate"]) == sorted(set(ids(stages["near_dedup"])) - leaked)


def test_mix_and_tokens(stages):
    before, after = stages["decontaminate"].collect(), stages["mix"].collect()
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(map(ids(stages["mix"]).count, {r.doc_id for r in after})) <= 3
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_output.default_tokenizer())
    rows, start = stages["tokens"].orderBy("start").collect(), 0
    assert sorted(r.doc_id for r in rows) == ids(stages["mix"])
    text = {r.doc_id: r.text or "" for r in after}
    for r in rows:
        tokens = [*library.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)


def test_run_is_the_chain(spark, stages):
    line = lambda df: sorted(map(tuple, df.select("start", "n_tokens", "ids_crc32").collect()))
    assert line(corpus_pipeline.run(spark, SF)) == line(stages["tokens"])


def test_empty_documents(spark, stages, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if name == "documents" else 10).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
