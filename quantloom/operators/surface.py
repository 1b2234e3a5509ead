"""Threshold surfaces: many cells over the same events.

Every event passes the first so many levels of each numeric axis, so events collapse to few level
signatures. A cell's signal set is a union of signatures; its fingerprint (count, sum and xor of event
hashes) comes from the signatures alone, and only one cell of each fingerprint is expanded over events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import flag
from quantloom.functions.tables import written
from quantloom.operators import quantiles
from quantloom.operators.events import cluster_events, share_positive

AXES = ("price_z", "rsi", "vol_z", "bb_width")
GATES = ("weak_trend", "breakout_block", "below_band")
SIGNATURE = [*(f"passed_{a}" for a in AXES), *(f"ok_{g}" for g in GATES)]


@dataclass(frozen=True)
class Grid:
    """Levels per axis, from loosest to strictest; every gate is tried off and on."""

    price_z: tuple
    rsi: tuple
    vol_z: tuple
    bb_width: tuple

    def cells(self, spark: SparkSession) -> DataFrame:
        """cell_id, level_<axis> (1-based), the thresholds, and use_<gate>; numbered in the order of the axes."""
        df = spark.range(1).select()
        for axis in AXES:
            levels = F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(float(v)).alias("v")) for k, v in enumerate(getattr(self, axis))))
            df = df.withColumn("_l", F.explode(levels)).withColumns({f"level_{axis}": F.col("_l.k"), f"{axis}_threshold": F.col("_l.v")}).drop("_l")
        for gate in GATES:
            df = df.withColumn(f"use_{gate}", F.explode(F.array(F.lit(False), F.lit(True))))
        order = Window.orderBy(*(f"level_{a}" for a in AXES), *(f"use_{g}" for g in GATES))  # the grid itself: a few thousand rows
        return df.withColumn("cell_id", F.row_number().over(order))


def with_signature(events: DataFrame, grid: Grid) -> DataFrame:
    """How many levels of each axis an event passes, and which gates."""
    tests = {"price_z": lambda t: F.col("price_z") < -t, "rsi": lambda t: F.col("rsi") < t, "vol_z": lambda t: F.col("vol_z") > t, "bb_width": lambda t: F.col("bb_width") > t}
    out = {f"passed_{a}": sum((flag(tests[a](float(t))).cast("int") for t in getattr(grid, a)), F.lit(0)) for a in AXES}
    out |= {"ok_weak_trend": flag(F.col("weak_trend_regime")), "ok_breakout_block": ~flag(F.col("breakout_block_long")), "ok_below_band": flag(F.col("close") < F.col("bb_lower"))}
    return events.withColumns(out)


def cell_members(signatures: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, signature) pairs. Both sides are bounded by the grid, whatever the number of events, so the cells can be broadcast."""
    on = F.lit(True)
    for a in AXES:
        on = on & (F.col(f"passed_{a}") >= F.col(f"level_{a}"))
    for g in GATES:
        on = on & (~F.col(f"use_{g}") | F.col(f"ok_{g}"))
    return signatures.join(F.broadcast(cells), on)


def fingerprints(events: DataFrame, grid: Grid) -> DataFrame:
    """Every cell with its signals, signal_set (null if empty), canonical_cell_id and duplicate count."""
    cells = grid.cells(events.sparkSession)
    h = F.xxhash64("pair", "ts")
    signatures = with_signature(events, grid).groupBy(*SIGNATURE).agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 24)).alias("s"), F.bit_xor(h).alias("x"))
    sets = cell_members(signatures, cells).groupBy("cell_id").agg(F.sum("n").alias("signals"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    out = cells.join(sets, "cell_id", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))
    out = out.withColumn("signal_set", F.concat_ws(":", "signals", "s", "x"))
    same = Window.partitionBy("signal_set")
    return out.withColumns({"canonical_cell_id": F.min("cell_id").over(same), "duplicate_signal_set_count": F.count("*").over(same)}).withColumn("is_duplicate_signal_set", F.col("cell_id") != F.col("canonical_cell_id")).drop("s", "x")


def expand_cells(events: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """One row per (cell, event), for the cells given; an equi-join on the signature."""
    signed = with_signature(events, grid)
    lists = cell_members(signed.select(*SIGNATURE).distinct(), cells.select("cell_id", *(f"level_{a}" for a in AXES), *(f"use_{g}" for g in GATES)))
    lists = lists.groupBy(*SIGNATURE).agg(F.collect_list("cell_id").alias("cell_ids"))
    return signed.join(lists, SIGNATURE).withColumn("cell_id", F.explode("cell_ids")).drop("cell_ids", *SIGNATURE)


def cell_metrics(rows: DataFrame, keys: list[str], near: str, far: str, gap: str, split: str, least_train: int = 3, least_validation: int = 3) -> DataFrame:
    """Metrics per cell of (cell, event) rows; ``near`` and ``far`` name the two return columns. Shares and positive groups
    by pair and by year come from one pass over both groupings."""
    return clustered_metrics(written(cluster_events(rows, (*keys, "pair"), gap, sizes=False), "cell-rows"), keys, near, far, split, least_train, least_validation)


def clustered_metrics(rows: DataFrame, keys: list[str], near: str, far: str, split: str, least_train: int = 3, least_validation: int = 3, buffered: int = quantiles.BUFFERED_ROWS) -> DataFrame:
    """``cell_metrics`` of rows that know which of them is first in its cluster. Where a cell has more than ``buffered`` rows, medians
    and other quantiles are found by ranges of values instead of in one buffer a cell; the results are the same."""
    first, late = F.col("is_cluster_first"), F.col("ts") >= F.lit(split).cast("timestamp")
    excess = F.col(f"excess_{far}")
    measures = {f"{kind}{c}_median": (F.col(f"{kind}{c}"), 0.5) for c in (near, far) for kind in ("", "null_", "excess_")}
    measures |= {f"cluster_{kind}{c}_median": (F.when(first, F.col(f"{kind}{c}")), 0.5) for c in (near, far) for kind in ("", "excess_")}
    measures |= {
        "cluster_excess_p25": (F.when(first, excess), 0.25),
        "mfe_median": (F.col("mfe"), 0.5),
        "mae_median": (F.col("mae"), 0.5),
        "mae_p10": (F.col("mae"), 0.1),
        "train_excess_median": (F.when(first & ~late, excess), 0.5),
        "validation_excess_median": (F.when(first & late, excess), 0.5),
    }
    large = quantiles.largest_group(rows, keys, buffered) > buffered
    in_place = lambda found: [] if large else [F.percentile(v, F.lit(q)).alias(name) for name, (v, q) in found.items()]
    main = rows.groupBy(*keys).agg(
        F.count("*").alias("signals"),
        F.count(F.when(first, 1)).alias("clusters"),
        *(F.count_distinct(c).alias(f"active_{c}s") for c in ("pair", "year", "month")),
        *in_place(measures),
        *(share_positive(c).alias(f"{c}_win_rate") for c in (near, far)),
        F.count(F.when(first & ~late, 1)).alias("train_clusters"),
        F.count(F.when(first & late, 1)).alias("validation_clusters"),
    )
    if large:
        main = main.join(quantiles.quantiles_by_range(rows, keys, measures), keys)
    ok = lambda side, least: flag((F.col(f"{side}_clusters") >= least) & (F.col(f"{side}_excess_median") > 0))
    main = main.withColumns({"passes_train": ok("train", least_train), "passes_validation": ok("validation", least_validation)})
    middle = {"_m": (F.when(first, excess), 0.5)}
    groups = rows.groupingSets([[*keys, "pair"], [*keys, "year"]], *keys, "pair", "year")
    groups = groups.agg(F.grouping("year").alias("_by_pair"), F.count("*").alias("_n"), F.count(F.when(first, 1)).alias("_c"), *in_place(middle))
    if large:
        found = [quantiles.quantiles_by_range(rows, [*keys, g], middle).withColumn("_by_pair", F.lit(k)) for k, g in ((1, "pair"), (0, "year"))]
        medians = found[0].unionByName(found[1], allowMissingColumns=True)
        value = lambda df: F.coalesce(df["pair"], df["year"])
        groups = groups.withColumn("_g", value(groups)).join(medians.select(*keys, "_by_pair", value(medians).alias("_g"), "_m"), [*keys, "_by_pair", "_g"], "left")
    part = lambda side, value: F.when(F.col("_by_pair") == side, value)
    share = lambda side, n: F.max(part(side, F.col(n))) / F.nullif(F.sum(part(side, F.col(n))), F.lit(0))
    shares = groups.groupBy(*keys).agg(
        *(share(side, n).alias(f"top_{name}_{kind}") for side, name in ((1, "pair"), (0, "year")) for n, kind in (("_n", "share"), ("_c", "cluster_share"))),
        *(F.count(F.when((F.col("_by_pair") == side) & (F.col("_m") > 0), 1)).alias(f"positive_{name}s") for side, name in ((1, "pair"), (0, "year"))),
    )
    return main.join(shares, keys)


def surface(events: DataFrame, grid: Grid, near: str, far: str, gap: str, split: str) -> DataFrame:
    """The whole surface: metrics of canonical cells, joined back to every cell of the same signal set."""
    events = written(events, "surface-events")
    cells = written(fingerprints(events, grid), "surface-cells")
    canonical = cells.where("not is_duplicate_signal_set and signals > 0")
    metrics = cell_metrics(expand_cells(events, canonical, grid), ["cell_id"], near, far, gap, split).withColumnRenamed("cell_id", "canonical_cell_id").drop("signals")
    return cells.join(metrics, "canonical_cell_id", "left")


def simplicity_score(df: DataFrame) -> DataFrame:
    """Enabled gates, plus one for each numeric filter above zero."""
    score = sum((F.col(f"use_{g}").cast("int") for g in GATES), F.lit(0)) + (F.col("vol_z_threshold") > 0).cast("int") + (F.col("bb_width_threshold") > 0).cast("int")
    return df.withColumn("simplicity_score", score)


#: Six orderings of candidates: column, descending?
BUCKETS = {
    "top_excess_far": (("cluster_excess_far", True), ("clusters", True), ("signals", True)),
    "top_excess_near": (("cluster_excess_near", True), ("clusters", True), ("signals", True)),
    "highest_density": (("clusters", True), ("signals", True), ("cluster_excess_far", True)),
    "lowest_pair_concentration": (("top_pair_share", False), ("cluster_excess_far", True), ("clusters", True)),
    "lowest_year_concentration": (("top_year_share", False), ("cluster_excess_far", True), ("clusters", True)),
    "simplest_definition": (("simplicity_score", False), ("cluster_excess_far", True), ("clusters", True)),
}


def freeze_manifest(cells: DataFrame, n: int, seed: dict) -> DataFrame:
    """The first n cells of each ordering and the cell nearest to ``seed``; one row per signal set with its first
    bucket, all its buckets and best rank, numbered by rank, then excess."""
    distance = sum(((F.col(c) != v).cast("double") if isinstance(v, bool) else F.abs(F.col(c) - v) for c, v in seed.items()), F.lit(0.0))
    cells = simplicity_score(cells).withColumn("seed_distance", distance)
    orders = {**BUCKETS, "nearest_to_seed": (("seed_distance", False), ("cluster_excess_far", True), ("clusters", True))}
    ranks = {}
    for bucket, order in orders.items():
        keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
        ranks[f"_{bucket}"] = F.row_number().over(Window.orderBy(*keys, "cell_id"))  # at most the grid's cells
    cells = cells.withColumns(ranks)
    limit = lambda b: 1 if b == "nearest_to_seed" else n
    picked = F.array_compact(F.array(*(F.when(F.col(f"_{b}") <= limit(b), F.struct(F.lit(k).alias("no"), F.lit(b).alias("bucket"), F.col(f"_{b}").alias("rank"))) for k, b in enumerate(orders))))
    rows = cells.withColumn("p", F.explode(picked))
    first = F.struct("p.no", "p.rank", "cell_id")
    out = rows.groupBy("signal_set").agg(
        F.min_by("cell_id", first).alias("cell_id"), F.min_by("p.bucket", first).alias("selection_bucket"), F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("p.no", "p.bucket"))), lambda x: x["bucket"])).alias("selection_buckets"),
        F.min("p.rank").alias("selection_rank"), F.min_by("cluster_excess_far", first).alias("cluster_excess_far"),
    )
    number = F.row_number().over(Window.orderBy("selection_rank", F.desc("cluster_excess_far"), "cell_id"))
    return out.withColumn("candidate_id", F.format_string("RFC%03d", number)).drop("signal_set")


def bucket_counts(manifest: DataFrame) -> DataFrame:
    rows = manifest.select("candidate_id", F.explode(F.split("selection_buckets", ";")).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count_distinct("candidate_id").alias("candidates"))
