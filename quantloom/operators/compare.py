"""Bootstrap intervals, fixed candidate sets and cost stress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import flag, md5_number, median
from quantloom.functions.tables import written
from quantloom.operators.rows import positions

RESAMPLES = 1000


def resampled_medians(df: DataFrame, keys: list[str], column: str, n: int = RESAMPLES, seed: str = "boot-1", order: tuple = ("ts", "pair")) -> DataFrame:
    """(keys, draw, resampled): the median of each of n resamples of a group, as large as the group and with replacement.
    The k-th value of a resample is that at a hashed position of the group, so draws depend on the seed, the keys and the
    rows' order alone. Equal positions are counted before medians are taken; no group is gathered in one task."""
    known = df.where(F.col(column).isNotNull()).select(*dict.fromkeys([*keys, *order]), F.col(column).cast("double").alias("_value"))
    placed = written(positions(known, keys, order, "_place", "_size").select(*keys, "_place", "_size", "_value"), "boot-places")
    draws = placed.select(*keys, "_place", "_size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    slot = md5_number(F.lit(seed), *(F.col(k).cast("string") for k in keys), F.col("draw").cast("string"), F.col("_place").cast("string")) % F.col("_size")
    times = draws.groupBy(*keys, "draw", slot.alias("_place")).agg(F.count("*").alias("_times"))
    values = times.join(placed.select(*keys, "_place", "_value"), [*keys, "_place"])
    return values.groupBy(*keys, "draw").agg(F.percentile("_value", F.lit(0.5), F.col("_times")).alias("resampled"))


def interval(drawn: DataFrame, keys: list[str], column: str = "resampled", prefix: str = "") -> DataFrame:
    """The 95% interval of ``column`` over the draws of each group."""
    return drawn.groupBy(*keys).agg(F.percentile(column, F.lit(0.025)).alias(f"{prefix}ci_low"), F.percentile(column, F.lit(0.975)).alias(f"{prefix}ci_high"))


def bootstrap_median_ci(df: DataFrame, keys: list[str], column: str, n: int = RESAMPLES, seed: str = "boot-1", order: tuple = ("ts", "pair")) -> DataFrame:
    """Per group: rows with a value, their median and its 95% interval; null where there is no value."""
    whole = df.groupBy(*keys).agg(F.count(column).alias("n"), median(column).alias("median"))
    return whole.join(interval(resampled_medians(df, keys, column, n, seed, order), keys), keys, "left")


def delta_intervals(drawn: DataFrame, key: str, pairs: DataFrame, prefix: str = "delta_") -> DataFrame:
    """For ``pairs`` of groups (a, b) of (key, draw, resampled): the 95% interval of the difference of their medians."""
    left, right = (drawn.select(F.col(key).alias(side), "draw", F.col("resampled").alias(f"_{side}")) for side in ("a", "b"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "draw"])
    return interval(both.withColumn("_delta", F.col("_a") - F.col("_b")), ["a", "b"], "_delta", prefix)


def bootstrap_delta_ci(df: DataFrame, keys: list[str], side: str, column: str, n: int = RESAMPLES, seed: str = "boot-1", order: tuple = ("ts", "pair")) -> DataFrame:
    """Per group: difference of the medians of side "a" and side "b", with its 95% interval; null where a side has no value."""
    part = lambda s: F.when(F.col(side) == s, F.col(column))
    whole = df.groupBy(*keys).agg(F.count(part("a")).alias("n_a"), F.count(part("b")).alias("n_b"), (median(part("a")) - median(part("b"))).alias("delta"))
    drawn = written(resampled_medians(df, [*keys, side], column, n, seed, order), "boot-draws")
    a, b = (drawn.where(F.col(side) == s).select(*keys, "draw", F.col("resampled").alias(f"_{s}")) for s in ("a", "b"))
    deltas = a.join(b, [*keys, "draw"]).withColumn("_delta", F.col("_a") - F.col("_b"))
    return whole.join(interval(deltas, keys, "_delta"), keys, "left")


def cost_stress_clusters(firsts: DataFrame, keys: list[str], far: str, split: str, bps: tuple = (0, 10, 20, 40), least: int = 200) -> DataFrame:
    """Net medians of cluster-first events at several costs, and whether the edge survives each."""
    cost = F.col("cost_bps") / 10000.0
    late = F.col("ts") >= F.lit(split).cast("timestamp")
    rows = firsts.withColumn("cost_bps", F.explode(F.array(*map(F.lit, bps))))
    net, excess = F.col(far) - cost, F.col(f"excess_{far}") - cost
    out = rows.groupBy(*keys, "cost_bps").agg(
        F.count("*").alias("clusters"), median(net).alias("net_median"), median(excess).alias("net_excess_median"), median(F.when(late, excess)).alias("net_validation_median"), F.avg(F.when(net.isNotNull(), (net > 0).cast("double"))).alias("net_win_rate")
    )
    return out.withColumn("survives_cost", flag((F.col("clusters") >= least) & (F.col("net_excess_median") > 0) & (F.col("net_validation_median") > 0)))


def grouped_concentration(firsts: DataFrame, keys: list[str], columns: tuple, far: str, n: int = 8) -> DataFrame:
    """Per key the n largest values of each of ``columns`` by clusters, with share and medians; one pass for all columns."""
    rows = firsts.select(*keys, far, f"excess_{far}", F.inline(F.array(*(F.struct(F.lit(c).alias("grouped_by"), F.col(c).cast("string").alias("value")) for c in columns))))
    groups = rows.groupBy(*keys, "grouped_by", "value").agg(F.count("*").alias("clusters"), median(far).alias("median"), median(f"excess_{far}").alias("excess_median"))
    of = Window.partitionBy(*keys, "grouped_by")  # a row a value
    groups = groups.withColumn("share", F.col("clusters") / F.sum("clusters").over(of))
    return groups.withColumn("rank", F.row_number().over(of.orderBy(F.desc("clusters"), "value"))).where(F.col("rank") <= n)


def removal_concentration(firsts: DataFrame, keys: list[str], far: str, split: str) -> DataFrame:
    """Per key: what is left of its clusters without its busiest pair, three busiest pairs or busiest month, and whether the edge survives."""
    late = F.col("ts") >= F.lit(split).cast("timestamp")
    parts = None
    for column in ("pair", "month"):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), column))
        counts = firsts.groupBy(*keys, column).agg(F.count("*").alias("_n")).withColumn("_r", rank).drop("_n")
        ranked = firsts.join(counts, [*keys, column]).select(*keys, "ts", f"excess_{far}", F.lit(column).alias("_by"), "_r")
        parts = ranked if parts is None else parts.union(ranked)
    cases = [("remove_top_1_pair", "pair", 1), ("remove_top_3_pairs", "pair", 3), ("remove_top_1_month", "month", 1)]
    cases = F.array_compact(F.array(*(F.when(F.col("_by") == c, F.struct(F.lit(a).alias("analysis"), (F.col("_r") > n).alias("keep"))) for a, c, n in cases)))
    rows = parts.withColumn("_case", F.explode(cases)).select("*", "_case.*")
    kept = lambda value, test=F.lit(True): F.when(F.col("keep") & test, value)
    out = rows.groupBy(*keys, "analysis").agg(F.count(kept(F.lit(1))).alias("clusters"), (F.count(kept(F.lit(1))) / F.count("*")).alias("cluster_share"), median(kept(F.col(f"excess_{far}"))).alias("excess_median"), median(kept(F.col(f"excess_{far}"), late)).alias("validation_median"))
    return out.withColumn("decision", F.when(flag((F.col("excess_median") > 0) & (F.col("validation_median") > 0)), "survives").otherwise("weakens"))


def canonical_manifest(candidates: DataFrame) -> DataFrame:
    """One fixed candidate per signal set: the original first, then the larger excess, then the id."""
    order = F.struct((~F.col("is_original")).cast("int").alias("a"), (-F.col("excess_far")).alias("b"), F.col("candidate_id"))
    out = candidates.groupBy("signal_set").agg(
        F.min_by("candidate_id", order).alias("canonical_id"), F.concat_ws(",", F.array_sort(F.collect_set("candidate_id"))).alias("alias_ids"), F.concat_ws(",", F.array_sort(F.collect_set("source_id"))).alias("source_ids"), F.count("*").alias("members")
    )
    return out


def select_candidates(summary: DataFrame, k_strong: int, k_weak: int, nearest_id: str) -> DataFrame:
    """The best strong and weak survivors and the one nearest to the seed, each once, in that order."""
    strong, weak = F.col("candidate_decision") == "SURVIVES_BASELINES_STRONG", F.col("candidate_decision") == "SURVIVES_BASELINES_WEAK"
    r = F.row_number().over(Window.partitionBy("candidate_decision").orderBy(F.desc(F.when(strong, F.col("ci_wins")).otherwise(F.col("point_wins"))), F.desc("worst_delta_far"), "candidate_id"))
    place = F.when(strong & (r <= k_strong), r).when(weak & (r <= k_weak), 1000 + r).when(F.col("candidate_id") == nearest_id, 2000)
    return summary.withColumn("place", place).where("place is not null")


def fixed_definitions(recommended: DataFrame) -> DataFrame:
    """Candidate definitions with the recommended gates dropped; a changed one gets a suffix to its id."""
    weak, block = F.col("simplifications").contains("DROP_WEAK_TREND_GATE"), F.col("simplifications").contains("DROP_BREAKOUT_BLOCK")
    suffix = F.concat(F.when(weak, F.lit("_NW")).otherwise(""), F.when(block, F.lit("_NB")).otherwise(""))
    return recommended.withColumns({"fixed_candidate_id": F.concat("candidate_id", suffix), "use_weak_trend": F.col("use_weak_trend") & ~weak, "use_breakout_block": F.col("use_breakout_block") & ~block, "is_original": suffix == ""})


def experiment_matrix(manifest: DataFrame, exits: tuple, fees: tuple, key: str = "candidate_id") -> DataFrame:
    """Candidates x exits x fees with a class name each; ``collides`` where a name of another candidate and exit is the same."""
    rows = manifest.select(key).withColumn("exit_mode", F.explode(F.array(*map(F.lit, exits)))).withColumn("fee", F.explode(F.array(*(F.lit(float(f)) for f in fees))))
    rows = rows.withColumn("class_name", F.concat(F.lit("Flush"), F.replace(F.col(key), F.lit("_"), F.lit("")), F.initcap("exit_mode")))
    members = rows.select("class_name", key, "exit_mode").distinct().groupBy("class_name").agg((F.count("*") > 1).alias("collides"))
    return rows.join(members, "class_name")


def promotion_rows(trades: DataFrame, keys: list[str], cutoff: str, least: int) -> DataFrame:
    """Trades before ``cutoff`` select, later ones are the holdout: counts, profit and a verdict per key."""
    late = F.col("open_date") >= F.lit(cutoff).cast("timestamp")
    part = lambda side, test: [F.count(F.when(test, 1)).alias(f"{side}_trades"), F.sum(F.when(test, F.col("profit_abs")).otherwise(0.0)).alias(f"{side}_profit")]
    out = trades.groupBy(*keys).agg(*part("selection", ~late), *part("holdout", late))
    verdict = F.when((F.col("selection_trades") < least) | (F.col("holdout_trades") < least), "insufficient").when(F.col("selection_profit") <= 0, "rejected_in_selection").when(F.col("holdout_profit") <= 0, "fails_holdout").otherwise("stable")
    return out.withColumn("verdict", verdict)
