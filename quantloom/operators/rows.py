"""Row positions and chunks, so that one pair's history need not be one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 50_000
#: Rows of a range of values, and the most ranges of a group.
PART_ROWS, MOST_PARTS = 100_000, 2_048


def bar_index(bars: DataFrame, period: str = "month") -> DataFrame:
    """``bar_idx``: the position of each bar in its pair, from 0. Counted per (pair, period), then summed over periods."""
    parts = bars.withColumn("_part", F.date_trunc(period, "ts"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("pair").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("pair", "_part").agg(F.count("*").alias("_n")).select("pair", "_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("pair", "_part").orderBy("ts")) - 1
    return parts.withColumn("_place", place).join(offsets, ["pair", "_part"]).withColumn("bar_idx", (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def positions(df: DataFrame, keys: list[str], order: tuple = ("ts",), place: str = "place", size: str = "size", period: str = "month") -> DataFrame:
    """The position of each row in its group, from 0, and the group's size. Counted per period of the first column
    of ``order``, then summed over periods, so that no group is ordered as a whole."""
    parts = df.withColumn("_part", F.date_trunc(period, order[0]))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", before.alias("_before"), F.sum("_n").over(group).alias(size))
    at = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return parts.withColumn(place, at).join(offsets, [*keys, "_part"]).withColumn(place, F.col("_before") + F.col(place)).drop("_part", "_before")


def value_positions(df: DataFrame, keys: tuple, column: str, tie: str, place: str = "place", size: str = "size", part_rows: int = PART_ROWS) -> DataFrame:
    """The position of each row in its group by (column, tie), from 0, and the group's size. Rows are counted per range
    between approximate quantiles and ranked inside a range, so that no group is ordered as a whole. The number of ranges grows with
    the group, one for ``part_rows`` rows, up to MOST_PARTS. Equal values share a range."""
    whole = [*keys, "_all"]
    df = df.withColumn("_all", F.lit(1))
    marks = F.percentile_approx(column, [k / MOST_PARTS for k in range(1, MOST_PARTS)], 4 * MOST_PARTS)
    cuts = df.groupBy(*whole).agg(marks.alias("_cuts"), F.count(column).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(MOST_PARTS * part_rows / F.greatest("_n", F.lit(1))))
    cuts = cuts.select(*whole, F.array_distinct(F.filter("_cuts", lambda c, k: (k + 1) % step == 0)).alias("_cuts"))
    df = df.join(F.broadcast(cuts), whole) if not keys else df.join(cuts, whole)
    df = df.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    group = Window.partitionBy(*whole)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = df.groupBy(*whole, "_part").agg(F.count("*").alias("_n")).select(*whole, "_part", before.alias("_before"), F.sum("_n").over(group).alias(size))
    at = F.row_number().over(Window.partitionBy(*whole, "_part").orderBy(column, tie)) - 1
    return df.withColumn(place, at).join(offsets, [*whole, "_part"]).withColumn(place, F.col("_before") + F.col(place)).drop("_all", "_part", "_before")


def chunked(indexed: DataFrame, rows: int = CHUNK_ROWS, before: int = 0, after: int = 0) -> DataFrame:
    """``chunk`` of each bar and ``own``; a chunk also holds copies of the ``before`` bars that precede it and the
    ``after`` bars that follow it (own = false). Windows over (pair, chunk) that reach no further are exact."""
    first = F.floor((F.col("bar_idx") - after) / rows)
    last = F.floor((F.col("bar_idx") + before) / rows)
    spread = indexed.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.withColumn("own", F.floor(F.col("bar_idx") / rows) == F.col("chunk"))


def sliced(df: DataFrame, at: str, reach: int, width: int) -> DataFrame:
    """``_slice`` of each row by its number ``at`` and ``_own``; a slice also holds copies of the rows up to ``reach`` before it
    (_own = false). Range windows over the slice that look back no further are exact."""
    first, last = F.floor(F.col(at) / width), F.floor((F.col(at) + reach) / width)
    spread = df.withColumn("_slice", F.explode(F.sequence(first, last)))
    return spread.withColumn("_own", F.col("_slice") == first)


KEYS = ("pair", "chunk")


def own(df: DataFrame) -> DataFrame:
    return df.where("own").drop("own", "chunk")
