"""Connected components by alternating large-star and small-star steps.

Edges are pairs of long node numbers. Every step groups by node with partial minima and joins them back;
nothing is gathered per node, so a hub of any degree is spread by Spark's skew join. The loop ends when
a round leaves the edges as they were; every edge then points at its component's smallest node. A round's
tables are deleted when the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star-least")
    out = materialize(both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "star-least")
    near = down.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(near.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "star-small")
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """A written table (node, component) of every node of ``edges`` (u, v); component is its smallest node. Loops and repeats are harmless."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    before = _mark(edges)
    while before[0]:
        large = _large_star(edges)
        small = _small_star(large)
        discard(edges, large)
        edges, after = small, _mark(small)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = materialize(nodes.union(edges.select(F.col("v"), F.col("v")).distinct()), "star-components")
    discard(edges)
    return out
