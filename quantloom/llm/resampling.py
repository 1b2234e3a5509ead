"""Importance resampling of documents towards a target text, on hashed word runs.

Features are runs of one to three words; a feature's bucket is the CRC of its bytes modulo the number
of buckets. CRCs are computed for many features at once: the distinct features of a block of words are
grouped by their length into two-dimensional byte arrays, all CRCs of an array are updated column by
column, and the buckets are scattered back to where the features stand. (A feature of over LONG bytes, such as
a file without a blank, gets the same CRC from the library, one at a time: its length is its own.)

The features of every text are found once and written as bucket numbers; corpus counts, weights and scores read
those. Counts are added up per task before they are shuffled: 10,000 rows a task at most. Scores are ranked
by ranges: documents are range-partitioned by score, numbered inside their range, and ranges are added up.

Defined cases: null text has no words; a document without features weighs 0; a null id counts as empty in its
hash and sorts first; repeated rows are ranked each; very long texts are taken block by block, whole; an empty
table of documents gives an empty result; an empty target counts 0 everywhere; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import slices, text_bytes
from quantloom.llm.common import discard, materialize, small_side, table

BUCKETS = 10_000
RUN = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Words of a block: their numbers, and runs of three numbers as one 64-bit number, stay exact.
BLOCK = 1 << 19
LONG = 512
#: Features of one matrix.
ROWS = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = crc_table()


def crc_by_length(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each buffer[start : start + length]."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, at = np.unique(lengths[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        if size > LONG:
            for i in order[a:b].tolist():
                out[i] = zlib.crc32(buffer[starts[i] : starts[i] + size])
            continue
        for part in (order[k : min(k + ROWS, b)] for k in range(a, b, ROWS)):
            letters = buffer[starts[part][None, :] + np.arange(size)[:, None]]  # a row for each byte place, a column for each feature
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in letters:
                crc = _CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and the number of words of each text."""
    word = _WORD[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | border[1:-1]
    starts = np.flatnonzero(begin)
    stops = np.append(np.flatnonzero(~word | border[:-1]), len(raw))
    ends = stops[np.searchsorted(stops, starts, "right")]
    counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
    return starts, ends - starts, counts.astype(np.int64)


def word_numbers(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Equal words, equal numbers below the number of words; hashes tell them apart, their bytes confirm it."""
    seed = 0
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = buffer[np.repeat(starts, lengths) + place]
    heads = np.cumsum(lengths) - lengths
    while True:
        rng = np.random.default_rng(seed)
        of_byte, step = rng.integers(1, 2**63, 256, dtype=np.uint64), np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        power = np.cumprod(np.full(int(lengths.max()), step))
        hashes = np.add.reduceat(of_byte[letters] * power[place], heads)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        same = first[number]
        if np.array_equal(lengths[same], lengths) and np.array_equal(letters[np.repeat(heads[same], lengths) + place], letters):
            return number
        seed += 1


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features text by text, the number of features of each text, and its number of words."""
    starts, lengths, words = word_spans(raw, offsets)
    total = sum(np.maximum(words - k, 0) for k in range(run))
    out, places = np.empty(int(total.sum()), np.uint16), np.cumsum(total) - total
    ends = np.cumsum(words)
    document = np.repeat(np.arange(len(words)), words)
    nth = np.arange(len(starts)) - (ends - words)[document]
    for a in range(0, len(starts), BLOCK):
        b = min(len(starts), a + BLOCK + run - 1)
        # the block's words in lower case, with one blank after each
        width = lengths[a:b] + 1
        at = np.cumsum(width) - width
        source = np.arange(int(width.sum())) + np.repeat(starts[a:b] - at, width)
        buffer = _LOWER[raw[np.minimum(source, len(raw) - 1)]]
        buffer[at + lengths[a:b]] = 32
        number = word_numbers(buffer, at, lengths[a:b])
        own = min(len(starts), a + BLOCK) - a
        keys, begin, size, target = [], [], [], []
        for k in range(run):  # runs of k + 1 words from each word on
            i = np.flatnonzero(nth[a : a + own] + k < words[document[a : a + own]])
            key = number[i].astype(np.int64)
            for j in range(1, run):
                key = key * (1 << 20) + (number[i + j] + 1 if j <= k else 0)
            keys.append(key)
            begin.append(at[i])
            size.append(at[i + k] + lengths[a:b][i + k] - at[i])
            d = document[a + i]
            target.append(places[d] + nth[a + i] + sum(np.maximum(words[d] - j, 0) for j in range(k)))
        _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        crc = crc_by_length(buffer, np.concatenate(begin)[first], np.concatenate(size)[first])
        out[np.concatenate(target)] = (crc % np.uint32(buckets)).astype(np.uint16)[back]
    return out, total.astype(np.int64), words


def features(docs: DataFrame, id_col="doc_id", text_col="text", run=RUN, buckets=BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (little-endian 16-bit numbers, as binary)."""

    def find(batches):
        for batch in batches:
            for part in slices(batch, 1):
                raw, offsets = text_bytes(part.column(1))
                found, total, words = feature_buckets(raw, offsets, run, buckets)
                ends = np.concatenate([[0], np.cumsum(total * 2)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(ends), pa.py_buffer(found.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(total), packed], ["doc_id", "n_words", "n_features", "buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), "<u2"), (offsets - offsets[0]) // 2


def bucket_counts(found: DataFrame, buckets=BUCKETS) -> np.ndarray:
    """How many features fall in each bucket; ``buckets`` rows come to the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(numbers_of(batch.column(0))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratios of target to source, in thousandths, floored."""
    n, s_all, t_all = len(source), float(source.sum()) + len(source), float(target.sum()) + len(target)
    ratio = ((target.astype(float) + 1) * s_all) / ((source.astype(float) + 1) * t_all)
    return np.array([math.floor(1000 * math.log(ratio[i])) for i in range(n)], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def weigh(batches):
        for batch in batches:
            if batch.num_rows:
                values, at = numbers_of(batch.column(3))
                total = np.concatenate([[0], np.cumsum(gain[values])])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total[at[1:]] - total[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(scored: DataFrame, percent=PERCENT, least_words=LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, ... over the drawn share of the documents with enough words, highest score first, then the smaller id."""
    by = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").asc(), F.col("weight"), F.col("n_features"), F.col("salt")]
    rows = scored.withColumn("salt", F.monotonically_increasing_id())  # equal rows may fall in several ranges
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("range"), within.alias("at")), "resampling-ranks")
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= least_words).alias("enough"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    ranges = materialize(ranges.select("range", "enough", before.alias("before")), "resampling-ranges")
    most = (ranges.agg(F.sum("enough")).first()[0] or 0) * percent // 100
    rank = F.col("before") + F.col("at")
    drawn = (F.col("n_words") >= least_words) & (rank <= most)
    return placed.join(small_side(ranges), "range").select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_text="text", percent=PERCENT, least_words=LEAST_WORDS, seed=SEED, run=RUN, buckets=BUCKETS) -> DataFrame:
    """Every document's id, n_features, weight, score and rank (null: not drawn).

    The score is the weight plus Gumbel noise from the id, so the highest scores are a sample without replacement in
    proportion to the weights' exponentials.
    """
    found = materialize(features(docs, id_col, text_col, run, buckets), "resampling-features")
    wanted = materialize(features(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), run=run, buckets=buckets), "resampling-target")
    scored = weights(found, gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(u)))
    out = draw(materialize(scored.withColumn("score", F.col("weight") + noise), "resampling-scores"), percent, least_words)
    discard(found, wanted)
    return out.withColumnRenamed("doc_id", id_col)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
