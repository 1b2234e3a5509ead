"""Random controls matched by stratum, as an equi-join on ranks: no per-event loops, no range join.

A control of an event is a pool row of its stratum that is not of the same pair within ``gap`` of it. Strata are
any fields: pair, year, quarter, month, a bucket of volatility. The pool of a stratum is ranked by (pair, time), so
around an event the own-pair rows within the gap are one run of ranks, and a draw is a slot among the ranks outside
the run. Ranks are counted per pair and added up, so no stratum is ordered as a whole. Draws are a hash of (seed,
event, draw number), the same however rows are partitioned, and with replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import md5_number, median, stamp
from quantloom.operators.asof import asof_join


def ranked_pool(pool: DataFrame, fields: list[str], columns: list[str]) -> DataFrame:
    """Pool rows with their rank in the stratum, where the pair's rows start in it, and its size."""
    groups = list(dict.fromkeys([*fields, "pair"]))
    stratum = Window.partitionBy(*fields)
    before = F.coalesce(F.sum("_n").over(stratum.orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pool.groupBy(*groups).agg(F.count("*").alias("_n")).select(*groups, before.alias("start"), F.sum("_n").over(stratum).alias("n"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("ts")) - 1
    rows = pool.select(*groups, "ts", *columns, place.alias("_place")).join(starts, groups)
    return rows.withColumn("rank", F.col("start") + F.col("_place")).drop("_place")


def draws(events: DataFrame, pool: DataFrame, fields: list[str], k: int, gap: str, seed: str) -> DataFrame:
    """events x k rows with the drawn ``rank``; none where the stratum has no row outside the gap."""
    groups, keys = list(dict.fromkeys([*fields, "pair"])), list(dict.fromkeys([*fields, "pair", "ts"]))
    wide = F.expr(f"INTERVAL {gap}")
    bounds = F.array(F.struct(F.lit(0).alias("side"), (F.col("ts") - wide - F.expr("INTERVAL 1 MICROSECOND")).alias("at")), F.struct(F.lit(1).alias("side"), (F.col("ts") + wide).alias("at")))
    both = events.select(*keys, F.explode(bounds).alias("b")).select(*keys, "b.side", "b.at")
    steps = pool.select(*groups, F.col("ts").alias("at"), (F.col("rank") + 1).alias("upto"))
    found = asof_join(both, steps, "at", tuple(groups), ("upto",)).groupBy(*keys).agg(*(F.max(F.when(F.col("side") == s, F.col("upto"))).alias(c) for s, c in enumerate(("_left", "_right"))))
    found = found.join(pool.groupBy(*groups).agg(F.min("start").alias("start")), groups, "left").join(pool.groupBy(*fields).agg(F.first("n").alias("n")), fields)
    found = found.withColumns({c: F.coalesce(c, "start", F.lit(0)) for c in ("_left", "_right")})
    found = found.withColumn("_free", F.col("_left") + F.col("n") - F.col("_right")).where("_free > 0")
    found = found.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    slot = md5_number(F.lit(seed), F.col("pair"), stamp(F.col("ts")), F.col("draw").cast("string")) % F.col("_free")
    rank = F.when(slot < F.col("_left"), slot).otherwise(F.col("_right") + slot - F.col("_left"))
    return found.withColumn("rank", rank).select(*keys, "draw", "rank")


def matched_null(events: DataFrame, pool: DataFrame, fields: list[str], columns: list[str], k: int, gap: str, seed: str = "null-1") -> DataFrame:
    """events with null_<column> (median of the controls), excess_<column> and null_samples."""
    ranked = ranked_pool(pool, fields, columns)
    keys = list(dict.fromkeys([*fields, "pair", "ts"]))
    drawn = draws(events.select(*keys).distinct(), ranked, fields, k, gap, seed)
    drawn = drawn.join(ranked.select(*fields, "rank", *(F.col(c).alias(f"_{c}") for c in columns)), [*fields, "rank"])
    medians = drawn.groupBy(*keys).agg(F.count("*").alias("null_samples"), *(median(f"_{c}").alias(f"null_{c}") for c in columns))
    out = events.join(medians, keys, "left")
    return out.withColumns({f"excess_{c}": F.col(c) - F.col(f"null_{c}") for c in columns} | {"null_samples": F.coalesce("null_samples", F.lit(0))})
