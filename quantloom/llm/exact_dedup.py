"""Exact de-duplication by two passes over a saturating Bloom filter.

Texts are read once and reduced to SHA-256 digests of their white-space-normalised form. Pass one
marks every digest's slots in a pair of bitmaps ("seen", "seen again"); the bitmaps are merged by
segment on the executors. Pass two asks the merged "seen again" bitmap: a digest with a slot that was
seen only once is unique and passes straight through; only the others are grouped by digest. False
positives cost a little shuffling and change no result. More digests than a bitmap of ``MAX_BITS`` serves are first
written by range of their last bytes, and the ranges pass one after the other, each with its own bitmap.

Defined cases: null text counts as empty; very long texts are hashed whole; rows with equal texts and equal ids keep the first row; a
null id sorts after every other id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, discard, materialize, scratch_path, text_of

BITS_PER_ROW = 12
SLOTS = 4
SEGMENT_BITS = 1 << 17
#: Bound of one range's broadcast bitmap (128 MB, about 90 million digests).
MAX_BITS = 1 << 30
FLUSH_ROWS = 1_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, sha): one row per input row; sha is the binary SHA-256 of the normalised text."""
    norm = F.regexp_replace(text_of(text_col), SPACE + "+", " ")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"),
    )


def _slots(column: pa.Array, bits: int) -> np.ndarray:
    """Slot numbers of each digest, (rows, SLOTS), by double hashing; an odd step keeps a row's slots apart."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)
    step = raw[:, 1] | np.uint64(1)
    return (raw[:, :1] + np.arange(SLOTS, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(SEGMENT_BITS, 1 << int(np.ceil(np.log2(max(1, rows) * BITS_PER_ROW)))))


def repeated_bitmap(shas: DataFrame, bits: int) -> np.ndarray:
    """Pass one: the merged "seen again" bitmap of ``bits`` bits (bounded by MAX_BITS)."""

    def mark(batches):
        def flush(held):
            slots, counts = np.unique(np.concatenate(held).ravel(), return_counts=True)
            segments = (slots // SEGMENT_BITS).astype(np.int64)
            cuts = np.flatnonzero(np.diff(segments, prepend=-1))
            offsets = (slots % SEGMENT_BITS).astype("<u4")
            rows = [
                (int(segments[a]), offsets[a:b].tobytes(), offsets[a:b][counts[a:b] > 1].tobytes())
                for a, b in zip(cuts, [*cuts[1:], len(slots)], strict=True)
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)],
                ["segment", "once", "again"],
            )

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_slots(batch.column(0), bits))
                n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def merge(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, once, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment not in seen:
                    seen[segment] = (np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool))
                first, second = seen[segment]
                at = np.frombuffer(once, "<u4")
                second[at] |= first[at]
                second[np.frombuffer(again, "<u4")] = True
                first[at] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array([np.packbits(v[1]).tobytes() for v in seen.values()], pa.binary())],
            ["segment", "bitmap"],
        )

    marked = shas.select("sha").mapInArrow(mark, "segment long, once binary, again binary")
    merged = marked.repartition("segment").mapInArrow(merge, "segment long, bitmap binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        a = row.segment * (SEGMENT_BITS // 8)
        bitmap[a : a + SEGMENT_BITS // 8] = np.frombuffer(row.bitmap, np.uint8)
    return bitmap


def flag_repeated(shas: DataFrame, bits: int, bitmap: np.ndarray) -> DataFrame:
    """Pass two: ``maybe`` is false only for digests that occur once."""
    sent = shas.sparkSession.sparkContext.broadcast(bitmap)

    def ask(batches):
        held = sent.value
        for batch in batches:
            if batch.num_rows:
                slots = _slots(batch.column("sha"), bits)
                bit = held[slots >> np.uint64(3)] >> (np.uint8(7) - (slots & np.uint64(7)).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bit.all(axis=1))], [*batch.schema.names, "maybe"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shas.schema)
    return shas.mapInArrow(ask, schema + ", maybe boolean")


def in_ranges(shas: DataFrame, ranges: int) -> list[DataFrame]:
    """The digests in ``ranges`` parts by their last 28 bits, equal ones in the same part; slots come from the first 16 bytes. No shuffle:
    every task writes a file a range."""
    part = F.conv(F.substring(F.hex("sha"), -7, 7), 16, 10).cast("long") % ranges
    path = scratch_path(shas.sparkSession, "exact-ranges")
    shas.withColumn("part", part.cast("int")).write.partitionBy("part").parquet(path)
    whole = shas.sparkSession.read.parquet(path)
    return [whole.where(F.col("part") == k).drop("part") for k in range(ranges)]


def flagged_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, sha, maybe) of every row; ``maybe`` is false only for digests that occur once."""
    shas = materialize(digests(docs, id_col, text_col), "exact-digests")
    rows = shas.count()
    ranges = -(-rows * BITS_PER_ROW // MAX_BITS) if rows else 1
    bits = filter_bits(-(-rows // ranges))
    if ranges == 1:
        return materialize(flag_repeated(shas, bits, repeated_bitmap(shas, bits)), "exact-flagged")
    parts = in_ranges(shas, ranges)
    discard(shas)
    return reduce(DataFrame.unionByName, [materialize(flag_repeated(p, bits, repeated_bitmap(p, bits)), "exact-flagged") for p in parts])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    flagged = flagged_digests(docs, id_col, text_col)
    maybe = flagged.where("maybe").select("row", "id", "sha")
    order = F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("row"))
    groups = maybe.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select(F.col("sha").alias("g_sha"), F.col("first.id").alias("keep_id"), F.col("first.row").alias("first_row"), "n"), "exact-groups")
    one = F.lit(1).cast("long")
    joined = maybe.join(groups, F.col("sha") == F.col("g_sha"), "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("g_sha").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", one).alias("group_size"),
        (F.coalesce("first_row", "row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    single = flagged.where("not maybe").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    return single.unionByName(joined)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
