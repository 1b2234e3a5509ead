"""Mixing sources to target weights by capped water-filling.

Targets: every source asks for its weight's share of the total; a source is clamped at ``max_epochs``
times its own size, and what it cannot take is reshared among the others by weight, again and again
until no source is above its cap. Sampling: a source with target e * size is repeated floor(e) times
whole, and the remaining fraction is a seeded sample without replacement: documents in the order of
a seeded hash of the id, up to the wanted number of words. The cut is found from a histogram of hash
ranges first, so no source, however hot, is ever ordered as a whole. Rows that share an id, or have none,
share that hash; where the cut falls among them, a second histogram over a hash of the row decides.

Defined cases: null text counts as empty (size 0); very long texts are documents like others, counted whole;
null sources form one source, last in order; rows of equal or null ids are documents of their own; sources
without words get target 0; an empty table gives an empty result; other columns are kept by
``mix_documents`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, materialize, small_side, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
HASH_BITS, BUCKET_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def seeded_hash(id_column: Column, seed: str = SEED) -> Column:
    """60 bits of an md5, a non-negative long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_hash() -> Column:
    """60 bits of a hash of the row's place in the table, a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)


def source_key(name: str) -> Column:
    """A key that is never null: null and the text of any source stay apart."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("n"))


def capped_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (skey, weight, source_size); adds ``target``. One small aggregation a round."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, above = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("spent"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if row.n == above or not row.open:
            break
        level, above = (total - row.spent) / row.open, row.n
    full = cap <= F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix_sources(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of (id, source, skey, size, h): source_size, target, whole repetitions, cut hash."""
    totals = sized.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row per source, not per document
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    sources = materialize(totals.withColumn("weight", weight), "mix-sources")
    sources = capped_targets(sources, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources, "mix-targets")

    part = sources.where("part > 0").select("skey", "part", F.lit(0).cast("long").alias("before"))
    edge = first_above(sized, part, "h", HASH_BITS - BUCKET_BITS)  # the range of hashes in which the cut falls
    inside = sized.withColumn("bucket", F.shiftright("h", HASH_BITS - BUCKET_BITS)).join(small_side(edge), ["skey", "bucket"])
    edge = first_above(inside.select("skey", "h", "size"), edge.drop("bucket"), "h", 0)  # the hash at the cut, as "bucket"
    tied = materialize(sized.join(small_side(edge), (sized.skey == edge.skey) & (sized.h == edge.bucket)).select(sized.skey, "g", "size"), "mix-tied")
    within = first_above(tied, edge.drop("bucket"), "g", HASH_BITS - BUCKET_BITS)
    ends = tied.groupBy("skey").agg(F.min("g").alias("first"), F.max("g").alias("end"))
    tied = tied.withColumn("bucket", F.shiftright("g", HASH_BITS - BUCKET_BITS)).join(small_side(within), ["skey", "bucket"])
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("skey").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    last = tied.withColumn("upto", upto).where(F.col("upto") * 2 - F.col("size") <= F.col("part") * 2).groupBy("skey").agg(F.max("g").alias("inner"))
    low = F.shiftleft(within["bucket"], HASH_BITS - BUCKET_BITS) - 1
    everything, none = F.lit(1 << HASH_BITS).cast("long"), F.lit(-1).cast("long")
    cuts = edge.select("skey", F.col("bucket").alias("cut")).join(within.select("skey", low.alias("low")), "skey").join(ends, "skey").join(last, "skey", "left")
    # a row that shares its hash with no other is taken or not, whatever its place in the table
    tie = F.coalesce("inner", "low")
    cuts = cuts.select("skey", "cut", F.when(tie == F.col("end"), everything).when(tie < F.col("first"), none).otherwise(tie).alias("tie"))
    cut = F.coalesce("cut", F.when(F.col("part") > 0, everything).otherwise(none))
    return materialize(sources.join(cuts, "skey", "left").select("skey", "source_size", "target", "whole", cut.alias("cut"), F.coalesce("tie", none).alias("tie")), "mix-cuts")


def first_above(rows: DataFrame, wanted: DataFrame, column: str, shift: int) -> DataFrame:
    """Per source of ``wanted`` (skey, part, before): the first range of ``column``, 2**shift wide, up to whose end there are
    more than ``part`` words, counted from ``before``; with the words before it. As (skey, part, bucket, before)."""
    ranges = rows.groupBy("skey", F.shiftright(column, shift).alias("bucket")).agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("after", F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))).join(small_side(wanted), "skey")
    edge = ranges.where("before + after > part").groupBy("skey", "part").agg(F.min_by(F.struct("bucket", (F.col("before") + F.col("after") - F.col("words")).alias("before")), "bucket").alias("e"))
    return materialize(edge.select("skey", "part", "e.bucket", "e.before"), "mix-edges")


def sampled(whole: str, cut: str, tie: str, h: Column, g: Column) -> Column:
    """How often a document of hashes h and g is taken."""
    once = (h < F.col(cut)) | ((h == F.col(cut)) & (g <= F.col(tie)))
    return F.col(whole) + once.cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    size = word_count(text_of(text_col))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), source_key(source_col).alias("skey"), size.alias("size"), seeded_hash(F.col(id_col), seed).alias("h"), row_hash().alias("g"))


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, times."""
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    sources = mix_sources(sized, weights, max_epochs)
    times = sampled("whole", "cut", "tie", F.col("h"), F.col("g"))
    return sized.join(small_side(sources), "skey").select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def mix_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The mix itself: every document as often as the plan takes it, with the columns of ``docs``."""
    sources = mix_sources(materialize(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes"), weights, max_epochs)
    sources = sources.select(F.col("skey").alias("_mix_key"), F.col("whole").alias("_mix_whole"), F.col("cut").alias("_mix_cut"), F.col("tie").alias("_mix_tie"))
    joined = docs.withColumn("_mix_row", row_hash()).join(small_side(sources), source_key(source_col) == F.col("_mix_key"))
    times = sampled("_mix_whole", "_mix_cut", "_mix_tie", seeded_hash(F.col(id_col), seed), F.col("_mix_row")).cast("int")
    repeated = joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *, coalesce(CAST(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent,
         CAST(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight,
         (SELECT CAST(sum(size) AS BIGINT) FROM d) AS total FROM w
), l AS (
  SELECT coalesce(max(CAST(total - spent AS DOUBLE) / open_weight), 0.0) AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size <= weight * level THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM w, l
), p AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t
), c AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), x AS (
  SELECT *, max(CASE WHEN upto * 2 - size <= part * 2 AND part > 0 THEN h END) OVER (PARTITION BY source) AS cut FROM c
)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN h <= coalesce(cut, -1) THEN 1 ELSE 0 END) AS taken,
       whole + CASE WHEN h <= coalesce(cut, -1) THEN 1 ELSE 0 END AS times
FROM x
"""
