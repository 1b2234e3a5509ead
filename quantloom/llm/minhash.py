"""Near-duplicate documents: universal hash minima, banding, signature checks, exact confirmation, components.

1. Texts become sets of five-word shingles; each set gets 125 hash minima. Texts with equal sets form a
   class, of which one row goes on.
2. Classes that share a band of five minima meet in a bucket (a pair misses all 25 bands once in two
   million at similarity 0.85, once in twenty thousand at 0.8). In every bucket each member is held against the smallest one: first the
   signatures, then the full sets. Large-star and small-star turn the links into components.
3. Buckets whose members still lie in several components are compared fully, but only across components, and
   only a spanning forest of confirmed links leaves a comparison. A bucket of more than ``BLOCK`` members (texts
   that share a passage, say) is first cut finer, without losing a link: two sets of the wanted similarity always
   share one of the rarest shingles of each, so its members meet again by those. What has its frequent shingles
   in common and no rare one is never compared. Cut buckets with many members in common (near copies share many rare shingles) are
   made one again where that takes fewer comparisons, so that their pairs meet once. The shorter text of a pair has it among fewer of its shingles than the longer
   one, so two texts that have it only as the longer one of a pair are not compared. If texts in different components still
   share a rare shingle in large numbers (texts put together from passages, say), they are cut again, by the shingles that
   are rare among them, as often as that at least halves the comparisons. Then they are compared block against block; no task
   holds more than two blocks. Groups whose full
   sets are compared are bounded in bytes of text as well as in members, so that only a single text can exceed the bound.

Defined cases: null and empty texts have no shingles and are linked with nothing; very long texts are read
whole, their sets in pieces; rows with equal sets are linked whatever their ids; null ids sort last; an empty
table gives an empty result; other columns are ignored by ``near_duplicates`` and kept by ``near_dedup_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import slices, text_bytes
from quantloom.llm.common import discard, materialize, small_side
from quantloom.llm.components import connected_components
from quantloom.llm.shingles import mix, overlap, shingle_sets

BANDS, ROWS = 25, 5
#: Least similarity of a link: the default of operators on shingles, and that of the registered query.
PERCENT, QUERY_PERCENT = 80, 85
BLOCK = 256
#: Pairs whose full sets are compared in one task's group.
CELL = 64
#: Bytes of text that such a group, or a group of a bucket, is meant to hold.
GROUP_BYTES = 32 << 20
#: A bucket of more comparisons than those of a bucket of so many members is cut again.
CROWD = 16 * BLOCK
#: A shingle counts as frequent from so many texts on, and so many frequent shingles are told to the tasks at most.
FREQUENT, MOST_FREQUENT = 64, 200_000

_rng = np.random.default_rng(17)
_FACTOR = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the set (top 32 bits)."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048]
        least = np.minimum(least, (_FACTOR[:, None] * part[None, :] + _SHIFT[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature, different between bands."""
    grouped = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key ^ grouped[:, :, k])
    return key.astype(np.int64)


def _text_handle(text):
    """Two 64-bit hashes of the raw text, by which a later pass finds it again."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")


def signatures(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(row, id, h1, h2, n, class_hash, signature) for every row."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, 4):
                sets = shingle_sets(*text_bytes(part.column(4)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([minima(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["row", "id", "h1", "h2", "n", "class_hash", "signature"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *_text_handle(text), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(sign, f"row long, id {id_type}, h1 long, h2 long, n long, class_hash binary, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, node), BANDS rows for each class."""

    def split(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], ["bucket", "node"])

    return classes.select("node", "signature").mapInArrow(split, "bucket long, node long")


def agreement(percent: int) -> float:
    """Signatures that agree less are not confirmed: five standard errors below the threshold."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / (BANDS * ROWS)) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    same, union = overlap(a, b)
    return 100 * same >= percent * union > 0


def confirm(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) that are links: signatures first, then full sets. ``nodes``: (node, signature, bytes, text).
    A text u that is in many pairs is sent once for every ``CELL`` of them, or ``GROUP_BYTES`` of their texts."""

    def compare_signatures(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.filter(pa.array((a == b).mean(axis=-1) >= agreement(percent))).select([0, 1, 4, 5])

    def compare_sets(first: pa.Table, second: pa.Table) -> pa.Table:
        left, out = {}, []
        for batch in first.combine_chunks().to_batches():
            for part in slices(batch, 2, 1_000_000):
                left |= dict(zip(part.column(1).to_pylist(), shingle_sets(*text_bytes(part.column(2))), strict=True))
        for batch in second.combine_chunks().to_batches():
            for part in slices(batch, 3, 1_000_000):
                sets = shingle_sets(*text_bytes(part.column(3)))
                out += [(u, v) for u, v, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), sets, strict=True) if linked(left[u], x, percent)]
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    left = nodes.select(F.col("node").alias("u"), F.col("signature").alias("a"), F.col("bytes").alias("u_bytes"))
    right = nodes.select(F.col("node").alias("v"), F.col("signature").alias("b"), F.col("bytes").alias("v_bytes"))
    likely = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", "u_bytes", "v_bytes")
    likely = materialize(likely.mapInArrow(compare_signatures, "u long, v long, u_bytes long, v_bytes long"), "near-likely")
    load = F.ceil(F.greatest(F.count("*") / CELL, F.sum("v_bytes") / GROUP_BYTES))
    parts = likely.groupBy("u").agg(load.alias("parts"))
    whole = likely.agg(F.count("*").alias("n"), F.sum(F.col("u_bytes") + F.col("v_bytes")).alias("bytes")).first()
    cells = max(1, whole.n // CELL, (whole.bytes or 0) // GROUP_BYTES)
    placed = likely.join(parts, "u").withColumn("cell", F.pmod(F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("parts"))), F.lit(cells)))
    placed = materialize(placed.select("cell", "u", "v"), "near-cells")
    text = nodes.select("node", "text")
    first = placed.select("cell", "u").distinct().join(text.withColumnRenamed("node", "u"), "u").select("cell", "u", "text").toDF("cell", "u", "text")
    second = placed.join(text.withColumnRenamed("node", "v"), "v").select("cell", "u", "v", "text").toDF("cell", "u", "v", "text")
    links = materialize(first.groupBy("cell").cogroup(second.groupBy("cell")).applyInArrow(compare_sets, "u long, v long"), "near-links")
    discard(likely, placed)
    return links


def forest(held: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of confirmed links between members (node, component, signature, set) of different components."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(m[3]) for m in held])
    signs = np.array([m[2] for m in held])
    out = []
    for i in range(len(held)):
        near = (signs[i + 1 :] == signs[i]).mean(axis=1)
        room = np.minimum(sizes[i + 1 :], sizes[i]) * 100 >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        for j in (i + 1 + np.flatnonzero((near >= agreement(percent)) & room)).tolist():
            a, b = root(held[i][1]), root(held[j][1])
            if a != b and linked(held[i][3], held[j][3], percent):
                parent[a] = b
                out.append((held[i][0], held[j][0]))
    return out


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """(bucket, size) of the buckets of (bucket, node, component) that lie in several components, one for each set of members."""
    fingerprint = F.xxhash64("node")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"), F.sum(F.shiftright(fingerprint, 20)).alias("f1"), F.bit_xor(fingerprint).alias("f2")).where("a <> b")
    mixed = mixed.groupBy("size", "f1", "f2").agg(F.min("bucket").alias("bucket"))
    return materialize(mixed.select("bucket", "size"), "near-mixed")


def merged(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, node, component, short) of the buckets that lie in several components, one bucket for each set of members,
    and (bucket, size, shorts). A member is short if it is so in any bucket of those members; buckets without one are left out."""
    fingerprint = F.xxhash64("node")
    groups = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"), F.sum(F.shiftright(fingerprint, 20)).alias("f1"), F.bit_xor(fingerprint).alias("f2")).where("a <> b")
    groups = materialize(groups.drop("a", "b"), "near-groups")
    first = groups.groupBy("size", "f1", "f2").agg(F.min("bucket").alias("first"))
    one = materialize(groups.join(first, ["size", "f1", "f2"]).select("bucket", "first"), "near-same")
    rows = placed.join(one, "bucket").groupBy(F.col("first").alias("bucket"), "node", "component").agg(F.max("short").alias("short"))
    rows = materialize(rows, "near-merged")
    sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("short").alias("shorts")).where("shorts > 0"), "near-sizes")
    discard(groups, one)
    return rows, sizes


def strangers(signs: np.ndarray, component: np.ndarray, short: np.ndarray, percent: int) -> np.ndarray:
    """Which members have a member of another component with a signature like theirs, one of the two being short."""
    found = np.zeros(len(signs), bool)
    for i in range(len(signs) - 1):
        near = ((signs[i + 1 :] == signs[i]).mean(axis=1) >= agreement(percent)) & (component[i + 1 :] != component[i]) & (short[i + 1 :] | short[i])
        if near.any():
            found[i] = True
            found[i + 1 :] |= near
    return found


def compared(placed: DataFrame, mixed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links across components inside the buckets ``mixed``, block against block: signatures first, then the full sets of
    those whose signature is like one of another component. Blocks of members that are not short meet only blocks of short ones."""
    key = ["bucket", "p", "q"]
    if "short" not in placed.columns:
        placed, mixed = placed.withColumn("short", F.lit(True)), mixed.withColumn("shorts", F.col("size"))
    one = F.col("size") <= BLOCK
    rows = placed.join(mixed, "bucket").withColumn("first", F.when(one, 1).otherwise(F.ceil(F.col("shorts") / BLOCK)).cast("int"))
    rows = rows.withColumn("rest", F.when(one, 0).otherwise(F.ceil((F.col("size") - F.col("shorts")) / BLOCK)).cast("int"))
    front, draw = F.col("short") | (F.col("rest") == 0), F.xxhash64("node", F.lit(7))
    block = F.when(front, F.pmod(draw, F.col("first"))).otherwise(F.col("first") + F.pmod(draw, F.greatest("rest", F.lit(1)))).cast("int")
    last = F.when(front, F.col("first") + F.col("rest")).otherwise(F.col("first")) - 1
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "component", "short")

    def involved(frame: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), -1)
        return frame.loc[strangers(signs, frame["component"].to_numpy(), frame["short"].to_numpy(bool), percent), [*key, "node", "component"]]

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        sets = shingle_sets(*text_bytes(pa.array(frame["text"], pa.string())))
        held = [(n, c, np.frombuffer(s, np.uint32), x) for n, c, s, x in zip(frame["node"], frame["component"], frame["signature"], sets, strict=True)]
        return pd.DataFrame(forest(held, percent), columns=["u", "v"], dtype="int64")

    alike = rows.join(nodes.select("node", "signature"), "node").groupBy(*key).applyInPandas(involved, "bucket long, p int, q int, node long, component long")
    alike = materialize(alike, "near-alike")
    sized = alike.join(nodes.select("node", "bytes"), "node").groupBy(*key).agg(F.ceil(2 * F.sum("bytes") / GROUP_BYTES).alias("cuts"))
    cut = alike.join(sized, key).withColumn("cuts", F.when(F.col("cuts") <= 2, 1).otherwise(F.col("cuts")))
    mine = F.pmod(F.xxhash64("node", F.lit(8)), F.col("cuts"))
    cut = cut.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    cut = cut.select(*key, F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "node", "component")
    links = materialize(cut.join(nodes.select("node", "signature", "text"), "node").groupBy(*key, "i", "j").applyInPandas(compare, "u long, v long"), "near-cross")
    discard(alike)
    return links


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of texts) of the most frequent shingles of (node, text), by shingle. Leaving some out costs time, never a link."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                found, n = np.unique(np.concatenate(shingle_sets(*text_bytes(part.column(1)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counts = texts.select("node", "text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where(F.col("n") >= FREQUENT), "near-frequent")
    # the powers of two a count can reach, at most 64 rows
    least, total = FREQUENT, 0
    for r in sorted(counts.groupBy((F.length(F.bin("n")) - 1).alias("power")).count().collect(), key=lambda r: -r.power):
        total += r["count"]
        if total > MOST_FREQUENT:
            least = 2 << r.power
            break
    rows = counts.where(F.col("n") >= least).collect()  # at most MOST_FREQUENT
    discard(counts)
    found = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.n for r in rows], np.int64)[order]


def rarest(shingles: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order (frequency, hash), as many as one of which any set of the wanted similarity must share."""
    if not len(shingles):
        return shingles
    often = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        often = np.where(frequent[at] == shingles, times[at], 0)
    need = -(-percent * len(shingles) // 100)
    return shingles[np.lexsort((shingles, often))[: len(shingles) - need + 1]]


def short_length(n, percent: int):
    """Among how many of the first shingles of a set of ``n`` any similar set of as many or more shingles must share one."""
    return n + 1 + -(2 * percent * n) // (100 + percent)


def by_rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, short): every text of (node, text) under each of its rarest shingles; short: those shared with similar texts that are no shorter."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def give(batches):
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                sets = shingle_sets(*text_bytes(part.column(1)))
                rare = [rarest(x, *sent.value, percent) for x in sets]
                short = [np.arange(len(r)) < short_length(len(x), percent) for r, x in zip(rare, sets, strict=True)]
                columns = [np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64), np.repeat(np.asarray(part.column(0)), [len(x) for x in rare])]
                columns.append(np.concatenate([np.zeros(0, bool), *short]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "node", "short"])

    return texts.select("node", "text").mapInArrow(give, "bucket long, node long, short boolean")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, n, shingle): every shingle of every text of (node, text), n being the size of its set."""

    def give(batches):
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                sets = shingle_sets(*text_bytes(part.column(1)))
                n = np.array([len(x) for x in sets], np.int64)
                columns = [np.repeat(np.asarray(part.column(0)), n), np.repeat(n, n), np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "shingle"])

    return texts.select("node", "text").mapInArrow(give, "node long, n long, shingle long")


def cut_again(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(parent, bucket, node, component, short): the rows (bucket, node, component) under those of their shingles that the
    fewest members of the same bucket have. Shingles without another member take their place in the order and give no row."""
    # files of shingles that many texts share are small for their rows, so no join here may go by file sizes
    rows = materialize(shingle_rows(texts.join(members.select("node").distinct(), "node", "left_semi")), "near-shingles")
    wide = members.select("bucket", "node", "component").join(rows.hint("merge"), "node")
    times = materialize(wide.groupBy("bucket", "shingle").agg(F.count("*").alias("times")).where("times > 1"), "near-times")
    order = Window.partitionBy("bucket", "node").orderBy(F.coalesce("times", F.lit(1)), "shingle")
    ranked = wide.join(times.hint("merge"), ["bucket", "shingle"], "left").withColumn("place", F.row_number().over(order))
    size, n = F.lit(percent) * F.col("n"), F.col("n")
    ranked = ranked.where(F.col("times").isNotNull() & (F.col("place") <= n + 1 - F.ceil(size / 100)))
    short = F.col("place") <= n + 1 - F.ceil(2 * size / (100 + percent))
    ranked = ranked.select(F.col("bucket").alias("parent"), F.xxhash64("bucket", "shingle").alias("bucket"), "node", "component", short.alias("short"))
    ranked = materialize(ranked, "near-again")
    discard(rows, times)
    return ranked


def overlapping(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and sizes like those of ``merged``, in which large buckets with many members in common are one wherever that takes
    fewer comparisons than they take apart: similar texts share many rare shingles and would else meet again in every bucket of them."""
    large = materialize(sizes.where(F.col("size") > BLOCK), "near-large")
    if large.isEmpty():
        discard(large)
        return rows, sizes
    held = materialize(rows.join(large.select("bucket"), "bucket"), "near-held")
    times = held.groupBy("node").agg(F.struct(F.count("*"), F.xxhash64("node"), F.col("node")).alias("often"))
    marks = materialize(held.join(times, "node").groupBy("bucket").agg(F.max("often").alias("mark")).select("bucket", F.col("mark.node").alias("mark")), "near-marks")
    both = held.join(marks, "bucket").groupBy("mark", "node", "component").agg(F.max("short").alias("short"))
    after = both.groupBy("mark").agg(F.count("*").alias("size"), F.count_if("short").alias("shorts"))
    cost = F.col("size").cast("double") * F.col("shorts")
    apart = large.join(marks, "bucket").groupBy("mark").agg(F.sum(cost).alias("apart"), F.count("*").alias("n"), F.min("bucket").alias("first"))
    one = materialize(after.join(apart, "mark").where((F.col("n") > 1) & (cost <= F.col("apart"))), "near-one")
    gone = materialize(marks.join(one.select("mark", "first"), "mark"), "near-gone-buckets")
    left = rows.join(gone.select("bucket"), "bucket", "left_anti")
    found = both.join(one.select("mark", F.col("first").alias("bucket")), "mark").select("bucket", "node", "component", "short")
    found = materialize(left.unionByName(found), "near-overlapping")
    found_sizes = materialize(sizes.join(gone.select("bucket"), "bucket", "left_anti").unionByName(one.select(F.col("first").alias("bucket"), "size", "shorts")), "near-sizes")
    discard(rows, sizes, large, held, marks, one, gone)
    return found, found_sizes


def crowd_links(rows: DataFrame, sizes: DataFrame, texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links across components inside the buckets of ``merged``; crowded ones are cut again while that at least halves their comparisons."""
    found = []
    cost = F.col("size").cast("double") * F.col("shorts")
    while True:
        rows, sizes = overlapping(rows, sizes)
        parents = materialize(sizes.where(cost > float(CROWD) ** 2), "near-parents")
        if parents.isEmpty():
            found.append(compared(rows, sizes, nodes, percent))
            break
        children = cut_again(rows.join(parents.select("bucket"), "bucket"), texts, percent)
        after, after_sizes = merged(children)
        of = materialize(after_sizes.join(children.select("bucket", "parent").distinct(), "bucket"), "near-of")
        spent = of.groupBy(F.col("parent").alias("bucket")).agg(F.sum(cost).alias("spent"))
        better = parents.join(spent, "bucket", "left").where(2 * F.coalesce("spent", F.lit(0.0)) <= cost).select("bucket")
        better = materialize(better, "near-better")
        found.append(compared(rows, sizes.join(better, "bucket", "left_anti"), nodes, percent))
        kept = materialize(of.join(better.withColumnRenamed("bucket", "parent"), "parent", "left_semi").select("bucket", "size", "shorts"), "near-kept")
        discard(rows, sizes, parents, children, after_sizes, of, better)
        rows, sizes = after, kept
        if sizes.isEmpty():
            break
    discard(rows, sizes)
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def cross_links(members: DataFrame, nodes: DataFrame, component: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between components inside the same bucket. members: (bucket, node); component: (node, component)."""

    def place(rows):
        rows = rows.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return materialize(rows.select("bucket", "node", "component", *(c for c in rows.columns if c == "short")), "near-placed")

    placed = place(members)
    mixed = mixed_buckets(placed)
    links = compared(placed, mixed.where(F.col("size") <= BLOCK), nodes, percent)
    large = mixed.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        crowd = placed.join(large.select("bucket"), "bucket").select("node").distinct()
        texts = materialize(nodes.select("node", "text").join(crowd, "node", "left_semi"), "near-crowd")
        finer = place(by_rare_shingles(texts, percent))
        more = crowd_links(*merged(finer), texts, nodes, percent)
        discard(texts, finer)
        links = links.union(more)
    discard(placed, mixed)
    return links


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, and first: whether the row is the one that stays."""
    signed = materialize(signatures(docs, id_col, text_col), "near-signatures")
    # classes of equal sets: the first row stands for the class
    words = signed.where("n > 0")
    classes = words.groupBy("class_hash").agg(F.min("row").alias("node"), F.count("*").alias("size")).where("size > 1")
    classes = materialize(classes.select("class_hash", "node"), "near-classes")
    copies = materialize(words.select("row", "class_hash").join(classes, "class_hash").select("row", "node"), "near-copies")
    others = copies.where("row <> node").select("row")
    one_each = materialize(words.join(small_side(others, 2_000_000), "row", "left_anti").select(F.col("row").alias("node"), "h1", "h2", "signature"), "near-nodes")
    rows = materialize(signed.select("row", "id", "n"), "near-ids")
    discard(signed, classes)

    banded = materialize(bands(one_each), "near-bands")
    shared = materialize(banded.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1").select("bucket", "least"), "near-buckets")
    members = materialize(banded.join(small_side(shared, 2_000_000), "bucket").select("bucket", "node", "least"), "near-members")
    discard(banded, shared)
    pairs = materialize(members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(), "near-pairs")
    wanted = materialize(one_each.join(members.select("node").distinct(), "node", "left_semi"), "near-wanted")
    discard(one_each)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*_text_handle(text), text.alias("text")).join(small_side(wanted.select("h1", "h2", "node"), 2_000_000), ["h1", "h2"]).select("node", "text")
    nodes = texts.groupBy("node").agg(F.first("text").alias("text")).join(wanted.select("node", "signature"), "node")
    nodes = materialize(nodes.select("node", "signature", F.octet_length("text").cast("long").alias("bytes"), "text"), "near-members-text")
    discard(wanted)

    links = confirm(pairs, nodes, percent)
    discard(pairs)
    component = connected_components(links)
    more = cross_links(members.select("bucket", "node"), nodes, component, percent)
    if not more.isEmpty():
        discard(component)
        component = connected_components(links.union(more))

    placed = rows.join(copies.withColumnRenamed("node", "copy_of"), "row", "left").withColumn("node", F.coalesce("copy_of", "row"))
    placed = placed.join(component, "node", "left").withColumn("component", F.coalesce("component", "copy_of"))
    placed = materialize(placed.select("row", "id", "n", "component"), "near-rows")
    discard(rows, copies, members, nodes, component)
    order = F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("row"))
    least = placed.where("component is not null").groupBy("component").agg(F.min(order).alias("m"))
    least = materialize(least.select("component", F.col("m.id").alias("least_id"), F.col("m.row").alias("least_row")), "near-least")
    grouped = placed.where("component is not null").join(least, "component")
    alone = placed.where("component is null").withColumn("least_id", F.col("id")).withColumn("least_row", F.col("row"))
    rows = grouped.select("row", "id", "n", "least_id", "least_row").unionByName(alone.select("row", "id", "n", "least_id", "least_row"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least_id").alias("component_id"), F.col("id").eqNullSafe(F.col("least_id")).alias("kept"), (F.col("row") == F.col("least_row")).alias("first"))


def near_dedup_documents(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, all columns kept."""
    names = docs.columns
    numbered = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.monotonically_increasing_id().alias("at")), "near-documents")
    keyed = numbered.select(F.struct(F.col(f"doc.`{id_col}`").alias("id"), F.col("at")).alias("key"), F.col(f"doc.`{text_col}`").alias("text"))
    gone = near_duplicates(keyed, "key", "text", percent).where("not first").select(F.col("key.at").alias("at"))
    gone = materialize(gone, "near-gone")
    return numbered.join(small_side(gone, 2_000_000), "at", "left_anti").select("doc.*")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=QUERY_PERCENT)
