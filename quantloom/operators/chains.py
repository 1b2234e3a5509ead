"""Picking spans that do not overlap, first come first taken, without walking a whole history in one task.

Every span points to the first one that may follow it. The spans picked are those on the path from a key's first
span. Blocks of positions turn the pointers of a block into a map from where a path enters the block to where it goes
on outside; maps of ``FAN`` blocks compose into the map of a larger block, which needs only the spans at which a path can
enter. Going back down, each block learns where the one path enters it and which of its spans lie on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.tables import written

#: Positions of the smallest block, and blocks of the next larger one.
SIZE, FAN = 1024, 16
END = (1 << 62) - 1


def with_follower(spans: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Adds ``next``: the first ``at`` of the same keys that is not before ``free`` (END if none). Looked up inside blocks of
    positions; where a block has none, the first span of the later blocks serves."""
    block = F.floor(F.col("_pos") / size)
    asks = spans.select(*keys, F.col("free").alias("_pos"), F.lit(0).alias("_side"), "at")
    answers = spans.select(*keys, F.col("at").alias("_pos"), F.lit(1).alias("_side"), "at")
    both = asks.unionByName(answers).withColumn("_block", block)
    ahead = Window.partitionBy(*keys, "_block").orderBy("_pos", "_side").rowsBetween(0, Window.unboundedFollowing)
    first = F.when(F.col("_side") == 1, F.col("_pos"))
    found = both.withColumn("next", F.min(first).over(ahead)).where("_side = 0")
    blocks = both.groupBy(*keys, "_block").agg(F.min(first).alias("_first"))
    later = F.min("_first").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing))  # a row a block
    found = found.join(blocks.select(*keys, "_block", later.alias("_later")), [*keys, "_block"])
    return found.select(*keys, "at", F.coalesce("next", "_later", F.lit(END)).alias("next"))


def _blocks(spans: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Spans of each block in order."""
    return spans.groupBy(*keys, F.floor(F.col("at") / size).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("at", "next"))).alias("_spans"))


def _exits(spans: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Adds ``out``: the first span on the path from this one that lies outside its block."""
    none = F.array().cast("array<struct<at:bigint,out:bigint>>")

    def step(later, span):
        known = F.filter(later, lambda x: x["at"] == span["next"])
        out = F.when(F.size(known) > 0, known[0]["out"]).otherwise(span["next"])
        return F.concat(F.array(F.struct(span["at"].alias("at"), out.alias("out"))), later)

    return _blocks(spans, keys, size).select(*keys, F.inline(F.aggregate(F.reverse("_spans"), none, step)))


def _path(spans: DataFrame, entries: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The spans on the path, given the one at which it enters each block that it visits."""
    blocks = _blocks(spans, keys, size).join(entries.select(*keys, F.floor(F.col("at") / size).alias("_block"), F.col("at").alias("_entry")), [*keys, "_block"])
    start = F.struct(F.col("_entry").alias("at"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda path, span: F.when(span["at"] == path["at"], F.struct(span["next"].alias("at"), F.concat(path["taken"], F.array(span["at"])).alias("taken"))).otherwise(path)
    return blocks.select(*keys, F.explode(F.aggregate("_spans", start, take)["taken"]).alias("at"))


def pick_disjoint(spans: DataFrame, keys: list[str], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(keys, at) of the spans picked. ``spans``: keys, at (a position from 0, unique in its keys) and free, the first
    position after ``at`` at which the next span may begin."""
    spans = spans.select(*keys, F.col("at").cast("long").alias("at"), F.col("free").cast("long").alias("free"))
    levels, last = [written(with_follower(spans, keys, size), "spans")], size
    first = levels[0].groupBy(*keys).agg(F.min("at").alias("at"))
    most = levels[0].agg(F.max("at")).first()[0] or 0
    while last <= most:
        outs = written(_exits(levels[-1], keys, last), "span-exits")
        entries = outs.where(F.col("out") < END).select(*keys, F.col("out").alias("at")).unionByName(first).distinct()
        levels.append(written(outs.join(entries, [*keys, "at"]).select(*keys, "at", F.col("out").alias("next")), "span-level"))
        last *= fan
    path = first
    for spans in reversed(levels):
        path = _path(spans, path, keys, last)
        last //= fan
    return path
