"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words before it and the two after it. The vocabulary is counted over
the whole corpus: its most frequent words have numbers of their own, all others share hashed ones, so no
word is dropped. A shared number's probability is split over its words by their counts: a word's probability is its number's, times
the word's share of the number. (KNOWN words have their count at hand; the rarer ones of a number share what is left of it
alike, so that the shares of a number add up to 1.) The network (embeddings, one hidden layer, a softmax over word classes and one within the
class) starts at the corpus's word frequencies and is trained in numpy. Documents are dealt to shards of a
fixed number of words, whatever the partitions of the input; every shard descends on its own windows and the
parameters are averaged between rounds, weighed by windows. The rounds share out the positions of every
document, so each word of the corpus is a training target once. A document's score is the sum of the
log-probabilities of all its words. A step that leaves the finite numbers ends the job. As the network has seen the document itself, ``n_own`` says how many
distinct words of it no other document holds: words whose probability nothing else in the corpus supports.

What is moved: one count per distinct word and task, the word numbers once, and one parameter update per
shard and round, all in step with the input. What the driver holds is bounded by the vocabulary and the network.

Defined cases: null and empty texts have no words and score 0 (their mean is null); very long texts are read
whole, in pieces of bounded memory; every input row gives one output row; rows of one id and one text count as
the same document for ``n_own``; ties in the vocabulary are broken by the word's hash; updates are added in the
order of shards; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import slices, text_bytes
from quantloom.llm.common import materialize, table
from quantloom.llm.shingles import word_hashes

CLASSES, MEMBERS = 64, 64
WORDS = CLASSES * MEMBERS
#: Numbers that the rarer words share.
SHARED = 512
SIDE, WIDTH, HIDDEN = 2, 16, 32
ROUNDS, BATCH = 2, 2048
#: Rates of the summed gradients of embeddings and members, and of the mean gradients of what every window touches.
RATES = {"embed": 0.1, "of_member": 0.1, "hidden": 1.6, "of_class": 6.4}
LONGEST_STEP = np.float32(1)
SEED = 11
#: Words with shared numbers whose counts every task holds.
KNOWN = 1 << 19
#: Words of a shard, and windows that are shuffled together.
SHARD_WORDS, MIXED = 2_000_000, 1_000_000
#: Shards whose updates are added in one step, and parts that an update is cut into.
FAN, BLOCKS = 64, 32


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def _handle(id_col: str, text_col: str):
    """One number for an id and its text."""
    return F.xxhash64(F.col(id_col), _text(text_col)).alias("handle")


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(word, times, low, high) of every distinct word's hash; low and high are the least and the greatest handle of its documents."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1, 8_000_000):
                hashes, sizes = word_hashes(*text_bytes(part.column(1)))
                if not len(hashes):
                    continue
                order = np.argsort(hashes)
                words, holder = hashes[order], np.repeat(np.asarray(part.column(0)), sizes)[order]
                at = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
                columns = [words[at].view(np.int64), np.diff(at, append=len(words)), np.minimum.reduceat(holder, at), np.maximum.reduceat(holder, at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "times", "low", "high"])

    counts = docs.select(_handle(id_col, text_col), _text(text_col)).mapInArrow(count, "word long, times long, low long, high long")
    return counts.groupBy("word").agg(F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))


def known_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and times of the words above the lowest level of frequency over which there are at most ``most``."""
    level = F.floor(16 * F.log2("times"))
    above, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):  # 16 rows a doubling
        above += r.n
        if above > most:
            break
        least = r.level
    rows = counts.where(level >= least if least is not None else F.lit(False)).select("word", "times").toArrow()
    return rows.column("word").to_numpy().view(np.uint64), rows.column("times").to_numpy()


def head(counts: DataFrame, most: int) -> list:
    """The most frequent words of a written table. Heads of FAN partitions at a time are merged, so that no task reads all of them."""

    def first(batches):
        held = pa.table({"word": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
        for batch in batches:
            both = pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = both.sort_by([("times", "descending"), ("word", "ascending")]).slice(0, most)
        yield from held.combine_chunks().to_batches()

    rows, parts = counts.select("word", "times"), counts.rdd.getNumPartitions()
    rows = rows.mapInArrow(first, "word long, times long")
    while parts > FAN:
        parts = -(-parts // FAN)
        rows = rows.repartition(parts).mapInArrow(first, "word long, times long")
    return rows.orderBy(F.desc("times"), "word").limit(most).collect()  # bounded by ``most``


class Vocabulary:
    """Hashes of the most frequent words, most frequent first; how often each word number occurs; all words; and the logarithm of
    the share that a word has of its shared number."""

    def __init__(self, counts: DataFrame, known: int = KNOWN):
        rows = head(counts, WORDS - SHARED)
        self.frequent = np.array([r.word for r in rows], np.int64).view(np.uint64)
        by_number, rare, words = np.zeros(WORDS, np.int64), np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for r in counts.groupBy(F.col("word").bitwiseAND(SHARED - 1).alias("low")).agg(F.sum("times").alias("n"), F.count("*").alias("words")).collect():  # SHARED rows
            rare[r.low], words[r.low] = r.n, r.words
        self.total = int(rare.sum())
        times = np.array([r.times for r in rows], np.int64)
        number = (self.frequent % np.uint64(SHARED)).astype(np.int64)
        np.subtract.at(rare, number, times)
        np.subtract.at(words, number, 1)
        by_number[: len(times)], by_number[WORDS - SHARED :] = times, rare
        self.counts = np.zeros(WORDS, np.int64)
        self.counts[dealt(np.arange(WORDS))] = by_number
        hashes, often = known_words(counts, known + WORDS - SHARED)
        own = ~np.isin(hashes, self.frequent)
        order = np.argsort(hashes[own])
        self.known, often = hashes[own][order], often[own][order]
        number = (self.known % np.uint64(SHARED)).astype(np.int64)
        whole = np.log(np.maximum(rare, 1))
        self.known_share = (np.log(often) - whole[number]).astype(np.float32)
        left, others = rare - np.bincount(number, often, SHARED), words - np.bincount(number, minlength=SHARED)
        self.other_share = (np.log(np.where(others > 0, left / np.maximum(others, 1), 1.0)) - whole).astype(np.float32)

    def parts(self) -> tuple:
        return self.frequent, self.known, self.known_share, self.other_share


def dealt(number: np.ndarray) -> np.ndarray:
    """Deal the numbers over the classes, so that classes weigh alike."""
    return number % CLASSES * MEMBERS + number // CLASSES


class Numbering:
    """Word hashes to word numbers and to the logarithms of the words' shares of them."""

    def __init__(self, frequent: np.ndarray, known: np.ndarray, known_share: np.ndarray, other_share: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.number = frequent[order], order.astype(np.int64)
        self.known, self.known_share, self.other_share = known, known_share, other_share

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, share = np.empty(len(hashes), np.int64), np.zeros(len(hashes), np.float32)
        rest = np.arange(len(hashes))
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            held = self.frequent[at] == hashes
            number[held], rest = self.number[at[held]], np.flatnonzero(~held)
        rare = hashes[rest]
        low = (rare % np.uint64(SHARED)).astype(np.int64)
        number[rest], share[rest] = WORDS - SHARED + low, self.other_share[low]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, rare), len(self.known) - 1)
            held = self.known[at] == rare
            share[rest[held]] = self.known_share[at[held]]
        return dealt(number).astype(np.uint16), share


def numbered(docs: DataFrame, vocabulary: Vocabulary, id_col="doc_id", text_col="text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, row, id, handle, words, share): the word numbers of every text, two bytes each, and the sum of the logarithms of its words'
    shares, ordered by shard and row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.parts())
    shards = shard_count(vocabulary, shard_words)

    def number(batches):
        give = Numbering(*sent.value)
        for batch in batches:
            for part in slices(batch, 3):
                hashes, counts = word_hashes(*text_bytes(part.column(3)))
                found, share = give(hashes)
                words, ends = found.tobytes(), np.cumsum(counts) * 2
                shares = np.bincount(np.repeat(np.arange(len(counts)), counts), share, len(counts)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([words[a:b] for a, b in zip(ends - counts * 2, ends, strict=True)], pa.binary()), pa.array(shares)], ["row", "id", "handle", "words", "share"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _handle(id_col, text_col), _text(text_col))
    rows = rows.mapInArrow(number, f"row long, id {docs.schema[id_col].dataType.simpleString()}, handle long, words binary, share double")
    rows = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "id", "handle", "words", "share")
    return rows.repartition(max(min(shards, 1000), -(-shards // FAN)), "shard").sortWithinPartitions("shard", "row")


def shard_count(vocabulary: Vocabulary, shard_words: int = SHARD_WORDS) -> int:
    return max(1, -(-vocabulary.total // shard_words))


#: The last hidden unit is always on, at this value: its weights are the biases of the output layers.
ON = np.float32(0.5)
SHAPES = {"embed": (WORDS + 1, WIDTH), "hidden": (2 * SIDE * WIDTH, HIDDEN), "of_class": (HIDDEN + 1, CLASSES), "of_member": (CLASSES, HIDDEN + 1, MEMBERS)}
_ONES = np.ones(max(CLASSES, MEMBERS), np.float32)


def initial(counts: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """Small random weights, and biases that give every word number its frequency (plus one) in the corpus."""
    rng = np.random.default_rng(seed)
    net = {k: rng.normal(0, 0.1 if k == "embed" else 0.15, s).astype(np.float32) for k, s in SHAPES.items()}
    often = (counts + 1.0).reshape(CLASSES, MEMBERS)
    net["of_class"][-1] = np.log(often.sum(axis=1) / often.sum()) / ON
    net["of_member"][:, -1] = np.log(often / often.sum(axis=1, keepdims=True)) / ON
    return net


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = values[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def windows(words: list[bytes], turn: int = 0, turns: int = 1, most: int = MIXED):
    """(targets, contexts) in pieces of about ``most``: every position of every document, or every ``turns``-th from
    ``turn`` on; places outside a document hold the edge's number."""
    edge = np.full(SIDE, WORDS, np.uint16).tobytes()
    line = np.frombuffer(edge + edge.join(words) + edge, np.uint16)
    sides = [k for k in range(-SIDE, SIDE + 1) if k]
    for a in range(0, len(line), most * turns):
        at = a + np.flatnonzero(line[a : a + most * turns] != WORDS)
        at = at[at % turns == turn]
        if len(at):
            yield line[at], np.stack([line[at + k] for k in sides], axis=1)


def _hidden(net: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The input of every window and the hidden units, the last of which is always on."""
    x = net["embed"].take(context.ravel(), axis=0).reshape(len(context), -1)
    h = np.full((len(context), HIDDEN + 1), ON, np.float32)
    np.tanh(x @ net["hidden"], out=h[:, :-1])
    return x, h


def _by_class(net: dict, target: np.ndarray, context: np.ndarray) -> tuple:
    """Windows in the order of their targets: order, input, hidden, class, member, class's outputs, member's outputs, and
    (class, first, end) of every class that occurs."""
    order = np.argsort(target, kind="stable")
    x, h = _hidden(net, context[order])
    group, member = np.divmod(target[order].astype(np.int64), MEMBERS)
    cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    held = [(g, a, b) for g, a, b in zip(range(CLASSES), cuts, cuts[1:], strict=False) if a < b]
    inner = np.empty((len(target), MEMBERS), np.float32)
    for g, a, b in held:
        np.matmul(h[a:b], net["of_member"][g], out=inner[a:b])
    return order, x, h, group, member, h @ net["of_class"], inner, held


def log_probabilities(net: dict, target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The log-probability of each target, given its context."""
    out = np.empty(len(target), np.float32)
    for a in range(0, len(target), 2 * BATCH):
        order, _, _, group, member, outer, inner, _ = _by_class(net, target[a : a + 2 * BATCH], context[a : a + 2 * BATCH])
        at = np.arange(len(order))
        for outputs in (outer, inner):
            outputs -= outputs.max(axis=1)[:, None]
        out[a + order] = outer[at, group] - np.log(np.exp(outer) @ _ONES[:CLASSES]) + inner[at, member] - np.log(np.exp(inner) @ _ONES[:MEMBERS])
    return out


def _missed(outputs: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Softmax less the truth, in place."""
    outputs -= outputs.max(axis=1)[:, None]
    np.exp(outputs, out=outputs)
    outputs /= (outputs @ _ONES[: outputs.shape[1]])[:, None]
    outputs[np.arange(len(truth)), truth] -= 1
    return outputs


def gradients(net: dict, target: np.ndarray, context: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the negative sum of the windows' log-probabilities."""
    order, x, h, group, member, outer, inner, held = _by_class(net, target, context)
    outer, inner = _missed(outer, group), _missed(inner, member)
    out = {k: np.zeros(SHAPES[k], np.float32) for k in ("embed", "of_member")}
    dh = outer @ net["of_class"].T
    for g, a, b in held:
        dh[a:b] += inner[a:b] @ net["of_member"][g].T
        np.matmul(h[a:b].T, inner[a:b], out=out["of_member"][g])
    dz = dh[:, :-1] * (1 - h[:, :-1] ** 2)
    out["of_class"], out["hidden"] = h.T @ outer, x.T @ dz
    place = context[order].astype(np.int64).reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    np.add.at(out["embed"].reshape(-1), place.ravel(), (dz @ net["hidden"].T).ravel())
    return out


def clipped(step: np.ndarray, axis) -> np.ndarray:
    """``step``, shortened where its length along ``axis`` is over LONGEST_STEP."""
    length = np.sqrt((step * step).sum(axis=axis, keepdims=True))
    return step * (LONGEST_STEP / np.maximum(length, LONGEST_STEP))


def descend(net: dict, target: np.ndarray, context: np.ndarray) -> None:
    """One pass of minibatch gradient descent over the windows, in place. What every window touches takes
    the mean gradient; a member or an embedding takes the sum over the few windows that hold it. A last
    batch of fewer windows takes a step that is shorter in proportion. No word's step, and no layer's, is longer than
    LONGEST_STEP, however often a text repeats the word."""
    for a in range(0, len(target), BATCH):
        found = gradients(net, target[a : a + BATCH], context[a : a + BATCH])
        for k, rate in RATES.items():
            step = np.float32(rate / (1 if k in ("embed", "of_member") else BATCH)) * found[k]
            net[k] -= clipped(step, {"embed": 1, "of_member": 1}.get(k))


def shards_of(batches):
    """(shard, texts) one after another, from batches of (shard, words) that are ordered by shard."""
    held, texts = None, []
    for batch in batches:
        for shard, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != held:
                if texts:
                    yield held, texts
                held, texts = shard, []
            texts.append(words)
    if texts:
        yield held, texts


def _mean_updates(updates: pa.Table) -> pa.Table:
    """The mean of updates of one block by weight, added in the order of shards."""
    rows = sorted(zip(*(updates.column(k).to_pylist() for k in ("shard", "weight", "update", "block", "parent")), strict=True))
    weight = sum(r[1] for r in rows)
    mean = sum(w * np.frombuffer(u, np.float32).astype(np.float64) for _, w, u, _, _ in rows) / weight
    return pa.table({"block": pa.array([rows[0][3]], pa.int32()), "shard": pa.array([rows[0][4]], pa.int64()), "weight": pa.array([weight], pa.int64()), "update": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(words: DataFrame, net: dict[str, np.ndarray], shards: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of local descent on every shard of (shard, words), with the parameters averaged after each."""
    spark, schema = words.sparkSession, "block int, shard long, weight long, update binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(flat(net))

        def descend_here(batches, sent=sent, turn=turn):
            for shard, texts in shards_of(batches):
                net, weight, rng = unflat(sent.value), 0, np.random.default_rng([SEED, turn, shard])
                for target, context in windows(texts, turn, rounds):
                    order = rng.permutation(len(target))
                    descend(net, target[order], context[order])
                    weight += len(target)
                update = flat(net) - sent.value
                if not np.isfinite(update).all():
                    raise FloatingPointError(f"shard {shard}: descent left the finite numbers; lower RATES")
                if weight:
                    parts = [p.tobytes() for p in np.array_split(update, BLOCKS)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int64()), pa.array([weight] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], ["block", "shard", "weight", "update"])

        updates, left = words.select("shard", "words").mapInArrow(descend_here, schema), shards
        while True:
            updates = updates.withColumn("parent", F.floor(F.col("shard") / FAN)).groupBy("block", "parent").applyInArrow(_mean_updates, schema)
            left = -(-left // FAN)
            if left == 1:
                break
        rows = sorted(updates.collect(), key=lambda r: r.block)  # BLOCKS rows
        if rows:
            net = unflat(flat(net) + np.concatenate([np.frombuffer(r.update, np.float32) for r in rows]))
    return net


def score(words: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """(id, handle, n_words, log_prob) of every row of (id, handle, words, share)."""
    sent = words.sparkSession.sparkContext.broadcast(flat(net))

    def score_here(batches):
        net = unflat(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = part.column(2).to_pylist()
                counts = np.array([len(t) // 2 for t in texts], np.int64)
                p = [log_probabilities(net, *piece).astype(np.float64) for piece in windows(texts)]
                sums = np.bincount(np.repeat(np.arange(len(texts)), counts), np.concatenate([np.zeros(0), *p]), len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(counts), pa.array(sums + part.column(3).to_numpy())], ["id", "handle", "n_words", "log_prob"])

    return words.select("id", "handle", "words", "share").mapInArrow(score_here, f"id {words.schema['id'].dataType.simpleString()}, handle long, n_words long, log_prob double")


def pseudo_likelihood(docs: DataFrame, id_col="doc_id", text_col="text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_own, log_prob, mean_log_prob."""
    counts = materialize(word_counts(docs, id_col, text_col), "lm-counts")
    vocabulary = Vocabulary(counts)
    words = materialize(numbered(docs, vocabulary, id_col, text_col, shard_words), "lm-words")
    net = train(words, initial(vocabulary.counts), shard_count(vocabulary, shard_words))
    own = counts.where("low = high").groupBy(F.col("low").alias("handle")).agg(F.count("*").alias("n_own"))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return score(words, net).join(own, "handle", "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("n_own", F.lit(0)).alias("n_own"), "log_prob", mean.alias("mean_log_prob"))


def op1_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
