"""Token ids as ORC: sorted by document id, with row indexes and Bloom filters on the ids.

Documents are range-partitioned by id, encoded, and written one file per range. ORC stores the ids with
its integer run-length encoding; stripes can be read in parallel, and the row index and Bloom filter of
``doc_id`` let a reader skip row groups. Each row also carries its shard number and its offset within
the shard, so the global start of every document needs only one total per shard.

Defined cases: null text counts as empty (the end id alone); very long texts are encoded whole; null ids sort first; equal ids keep an
arbitrary but fixed order; an empty table gives an empty result; other columns are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import encoder, slices, text_bytes
from quantloom.llm.common import materialize, scratch_path, small_side

END_ID = 0
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """Append the end id to each document's ids."""
    out = np.full(len(ids) + len(counts), end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def write_tokens(docs: DataFrame, path: str, id_col="doc_id", text_col="text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches):
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = encoder(tokenizer).encode(*text_bytes(part.column(1)))
                ends = np.cumsum(counts + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(part), shard, np.int32)), pa.array(at + ends - counts - 1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(with_end(ids, counts, end_id)))],
                    ["doc_id", "shard", "shard_start", "ids"],
                )
                at += int(ends[-1])

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    id_type = ordered.schema["doc_id"].dataType.simpleString()
    rows = ordered.mapInArrow(encode, f"doc_id {id_type}, shard int, shard_start long, ids array<int>")
    writer = rows.write
    for key, value in ORC.items():
        writer = writer.option(key, value)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {id_type}, shard int, shard_start long, ids array<int>").orc(path)


def token_digest(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = np.asarray(ids.values, dtype="<u4")
            offsets = np.asarray(ids.offsets).astype(np.int64)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path, id_type).mapInArrow(digest, f"doc_id {id_type}, shard int, shard_start long, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "token-digest")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    shards = materialize(shards.select("shard", before.alias("before")), "token-shards")
    return rows.join(small_side(shards), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files and return the digest read back from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, id_col, text_col, tokenizer, end_id)
    return token_digest(spark, path, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("doc_id", id_col)


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
