"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

Features are hashed words, word shapes, a mark for a word that repeats the one before it, and character
trigrams within words. Every bucket has a learned vector; a document is the mean of its features' vectors,
and a softmax layer over the mean gives the class. Training is stochastic gradient descent in numpy over a
bounded sample of labelled documents (``most`` documents, chosen by a hash of the id); scoring folds the
output layer into one number per bucket and runs over all documents on the executors. The id decides only
which fold a labelled row is in; labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts have no features and get the score of the output bias; very long texts are scored whole; every input row
gives one output row; labels that are null or repeated: nulls are left out, of repeats the smallest counts; of
labelled rows with one id the smallest text is learned from;
without any labelled rows every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import slices, text_bytes
from quantloom.llm.common import materialize, table
from quantloom.llm.shingles import mix

BITS, WIDTH = 16, 8
#: Bound of the training sample, in documents. A document has at most one share for each of the 2 ** BITS buckets, however long it is.
MOST = 3000
FOLDS = 5
THRESHOLD = 0.3
EPOCHS, BATCH, RATE = 8, 32, 0.4
SEED = 23

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHAPE = np.full(256, 3, np.uint64)  # others
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 4, 1, 2, 2
_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_GRAM = _rng.integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(int(_rng.integers(1, 2**63)) | 1)
_SHAPES = np.array([0, 3, 5, 7, 11], np.uint64)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - BITS)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of every text; order does not matter."""
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    document = np.searchsorted(offsets, starts, "right") - 1
    spans = np.diff(starts, append=len(raw))
    body = raw[starts[0] :]
    place = np.arange(len(body)) - np.repeat(starts - starts[0], spans)
    inside = word[starts[0] :]
    power = np.cumprod(np.full(int(spans.max()), _STEP))[place]
    at = starts - starts[0]
    whole = np.add.reduceat(np.where(inside, _BYTE[body] * power, 0), at)
    # a shape is the set of character classes and whether the word is short
    classes = [np.add.reduceat((inside & (_SHAPE[body] == k)).astype(np.int32), at) for k in (1, 2, 3, 4)]
    shape = sum((np.minimum(c, 2) * 3**k for k, c in enumerate(classes)), np.zeros(len(starts), np.int64))
    same = np.zeros(len(starts), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (document[1:] == document[:-1])
    blank = np.where(inside, body, 32).astype(np.uint64)
    key = _BYTE[blank.astype(np.int64)]
    before, after = np.empty_like(key), np.empty_like(key)
    before[0], before[1:], after[-1], after[:-1] = _BYTE[32], key[:-1], _BYTE[32], key[1:]
    first = np.zeros(len(body), bool)
    first[at] = True
    before[first] = _BYTE[32]
    after[at[1:] - 1] = _BYTE[32]
    gram = before * _GRAM[0] + key * _GRAM[1] + after * _GRAM[2]
    gram, owner = gram[inside], np.repeat(document, spans)[inside]
    buckets = [_bucket(whole), _bucket(shape.astype(np.uint64) + np.uint64(1 << 40)), np.full(int(same.sum()), _bucket(np.array([1 << 41], np.uint64))[0]), _bucket(gram)]
    return np.concatenate(buckets), np.concatenate([document, document, document[same], owner])


def counted(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and their shares."""
    bucket, document = features(raw, offsets)
    key, times = np.unique(document.astype(np.int64) << BITS | bucket, return_counts=True)
    cuts = np.searchsorted(key >> BITS, np.arange(len(offsets)))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(((key[a:b] & ((1 << BITS) - 1)).astype(np.uint16), (times[a:b] / max(1, times[a:b].sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Vectors, output layer and bias by stochastic gradient descent; folded to (a number per bucket, bias)."""
    if not rows:
        return np.zeros(1 << BITS), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares = np.full(1 << BITS, 1e-6, np.float32)
    ones = sum(r[2] for r in rows)
    balance = np.array([len(rows) / max(1, 2 * (len(rows) - ones)), len(rows) / max(1, 2 * ones)], np.float32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = [rows[i] for i in order[a : a + BATCH]]
            index = np.concatenate([r[0] for r in part])
            share = np.concatenate([r[1] for r in part])
            owner = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            mean = np.zeros((len(part), WIDTH), np.float32)
            np.add.at(mean, owner, vectors[index] * share[:, None])
            logits = mean @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            truth = np.array([r[2] for r in part])
            p[np.arange(len(part)), truth] -= 1
            p *= balance[truth][:, None]  # both classes weigh the same
            pull = (p @ output.T)[owner] * share[:, None]
            # each bucket has its own step, by the gradients it has seen
            np.add.at(squares, index, (pull**2).sum(axis=1))
            np.subtract.at(vectors, index, rate * pull / np.sqrt(squares[index])[:, None])
            output -= rate * mean.T @ p / len(part)
            bias -= rate * p.sum(axis=0) / len(part)
    return vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most: int = MOST) -> list:
    """Features and label of at most ``most`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).alias("known")).agg(F.min(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("known"), "known").limit(most)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("known"), text.alias("text")).join(F.broadcast(sample), "known")
    rows = rows.groupBy("known", "y").agg(F.min("text").alias("text"))  # one row an id, however often it repeats

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = counted(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "y", "index", "share"])

    id_type = docs.schema[id_col].dataType.simpleString()
    counts = rows.select("known", "text", "y").mapInArrow(count, f"id {id_type}, y int, index binary, share binary")
    found = sorted((r.id, r.y, bytes(r["index"]), bytes(r.share)) for r in materialize(counts, "quality-sample").collect())  # bounded by ``most``
    return [(np.frombuffer(i, np.uint16).astype(np.int32), np.frombuffer(s, np.float32), y) for _, y, i, s in found]


def fold(id_column):
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, id_col="doc_id", text_col="text", keep: list[str] = ()) -> DataFrame:
    """(id, held_out, score, predicted) for every row, and the columns ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches):
        for batch in batches:
            for part in slices(batch, 0):
                raw, offsets = text_bytes(part.column(0))
                bucket, document = features(raw, offsets)
                n = np.bincount(document, minlength=len(part))
                total = np.bincount(document, sent.value[bucket].astype(np.float64), len(part))
                p = 1 / (1 + np.exp(-(total / np.maximum(1, n) + bias)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p)], [*part.schema.names[1:], "score"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = F.struct(F.col(f"`{id_col}`").alias("id"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    rows = docs.select(text.alias("text"), rest.alias("rest"))
    rows = rows.mapInArrow(score, f"rest {rows.schema['rest'].dataType.simpleString()}, score double")
    kept = [F.col(f"rest.k{i}").alias(c) for i, c in enumerate(keep)]
    id_column = F.col("rest.id")
    return rows.select(id_column.alias(id_col), *[c for c, name in zip(kept, keep, strict=True) if name != id_col], (F.coalesce(fold(id_column), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most: int = MOST) -> DataFrame:
    return score_documents(docs, *train(training_rows(docs, labels, id_col, text_col, label_col, most)), id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most: int = MOST) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, all columns kept."""
    weights, bias = train(training_rows(docs, labels, id_col, text_col, label_col, most))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def keep(batches):
        for batch in batches:
            for part in slices(batch, 1):
                raw, offsets = text_bytes(part.column(1))
                bucket, document = features(raw, offsets)
                n = np.bincount(document, minlength=len(part))
                total = np.bincount(document, sent.value[bucket].astype(np.float64), len(part))
                p = 1 / (1 + np.exp(-(total / np.maximum(1, n) + bias)))
                yield part.select([0]).filter(pa.array(p >= THRESHOLD))

    return packed.mapInArrow(keep, packed.select("id").schema).select("id.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
