"""Point-in-time universes: coverage at anchors, snapshots, market filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def anchors(spark: SparkSession, start: str, end: str, months: int = 3) -> DataFrame:
    """Anchor dates from ``start`` (month starts) to ``end``, every ``months`` months."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {months} months)")).alias("anchor")).select(F.col("anchor").cast("timestamp_ntz").alias("anchor"))


def complete_anchors(spark: SparkSession, start: str, months: int, latest: str) -> DataFrame:
    """Anchors of windows of ``months`` months, one after another from ``start`` on, that end with month ``latest`` (yyyy-MM) or before."""
    end = F.add_months(F.lit(f"{latest}-01").cast("date"), 1 - months)
    anchors = F.when(end >= F.lit(start).cast("date"), F.sequence(F.lit(start).cast("date"), end, F.expr(f"INTERVAL {months} MONTHS")))
    return spark.range(1).select(F.explode(anchors).alias("anchor")).select(F.col("anchor").cast("timestamp_ntz").alias("anchor"))


def near_anchors(first: Column, last: Column, start: str, end: str, months: int) -> Column:
    """The anchors, every ``months`` months from the month's first ``start`` to ``end``, in the months of ``first`` to ``last``.
    Counted from the months between, so that no row is held against all anchors."""
    y, m = int(start[:4]), int(start[5:7])
    count = ((int(end[:4]) - y) * 12 + int(end[5:7]) - m) // months
    index = lambda t: (F.year(t) - y) * 12 + F.month(t) - m
    low = F.greatest(F.ceil(index(first) / months), F.lit(0)).cast("int")
    high = F.least(F.floor(index(last) / months), F.lit(count)).cast("int")
    at = lambda k: F.add_months(F.lit(start).cast("date"), k * months).cast("timestamp_ntz")
    return F.when(low <= high, F.transform(F.sequence(low, high), at))


def coverage(bars: DataFrame, start: str, end: str, months: int, lookback_days: int, post_days: int, bar_minutes: int) -> DataFrame:
    """Per (anchor, pair): bars before and after the anchor, their share of the expected, first and last bar, and
    approximate quote volume before it. Each bar is put to the anchors near it."""
    back, post = F.expr(f"INTERVAL {lookback_days} DAYS"), F.expr(f"INTERVAL {post_days} DAYS")
    near = near_anchors(F.col("ts") - post, F.col("ts") + back, start, end, months)
    rows = bars.withColumn("anchor", F.explode(near)).where((F.col("ts") >= F.col("anchor") - back) & (F.col("ts") < F.col("anchor") + post))
    before = F.col("ts") < F.col("anchor")
    expected = lambda days: float(int(days * 1440 / bar_minutes + 1e-9))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = rows.groupBy("anchor", "pair").agg(
        F.count(F.when(before, 1)).alias("lookback_bars"), F.count(F.when(~before, 1)).alias("post_bars"), F.min("ts").alias("first_bar"), F.max("ts").alias("last_bar"), F.sum(F.when(before, typical * F.col("volume")).otherwise(0.0)).alias("quote_volume")
    )
    return out.withColumns({"lookback_coverage": F.col("lookback_bars") / expected(lookback_days), "post_coverage": F.col("post_bars") / expected(post_days)})


def flag_coverage(df: DataFrame, least: float) -> DataFrame:
    """``selected`` and the first failing reason, lookback before post."""
    reason = F.when(F.col("lookback_coverage") < least, F.format_string("lookback coverage %.2f < %.2f", "lookback_coverage", F.lit(least)))
    reason = reason.when(F.col("post_coverage") < least, F.format_string("post coverage %.2f < %.2f", "post_coverage", F.lit(least))).otherwise("")
    return df.withColumn("exclusion_reason", reason).withColumn("selected", F.col("exclusion_reason") == "")


def ranked(df: DataFrame) -> DataFrame:
    """Rank of the selected pairs of each anchor: volume, then coverages (rounded to six places), then the name."""
    order = [F.desc("quote_volume"), F.desc(F.round("lookback_coverage", 6)), F.desc(F.round("post_coverage", 6)), "pair"]
    return df.where("selected").withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))


def snapshot(df: DataFrame, n: int) -> DataFrame:
    return ranked(df).where(F.col("rank") <= n)


def snapshot_sensitivity(df: DataFrame, ns: tuple) -> DataFrame:
    """Per anchor and n: eligible and selected counts, first and last selected pair."""
    rows = ranked(df).withColumn("top_n", F.explode(F.array(*map(F.lit, ns))))
    inside = F.col("rank") <= F.col("top_n")
    return rows.groupBy("anchor", "top_n").agg(
        F.count("*").alias("eligible"), F.count(F.when(inside, 1)).alias("selected_pairs"), F.min_by("pair", "rank").alias("first_pair"), F.max_by("pair", F.when(inside, F.col("rank"))).alias("last_pair")
    )


def universe_union(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("pair").distinct()


def candidate_universe(markets: DataFrame, n: int, latest: str, excluded: tuple = ()) -> DataFrame:
    """Every market with its first exclusion reason, or its rank by volume, age and name; ``chosen`` for the first n."""
    reason = (
        F.when(~F.coalesce("active", F.lit(False)), "inactive")
        .when(~F.coalesce(F.col("base").rlike(r"^[\x00-\x7F]*$"), F.lit(False)), "non_ascii")
        .when(F.col("pair").isin(*excluded), "excluded")
        .when(F.col("onboard_date").isNull() | (F.col("onboard_date") > F.lit(latest).cast("timestamp")), "listed_late")
        .when(~(F.coalesce("quote_volume", F.lit(0.0)) > 0), "no_volume")
    )
    rows = markets.withColumn("exclusion_reason", reason)
    order = [F.desc("quote_volume"), "onboard_date", "pair"]
    r = F.row_number().over(Window.partitionBy(F.col("exclusion_reason").isNull()).orderBy(*order))
    return rows.withColumn("rank", F.when(F.col("exclusion_reason").isNull(), r)).withColumn("chosen", F.coalesce(F.col("rank") <= n, F.lit(False)))


def pair_filters(bars: DataFrame, as_of: str, top: int = 25, listed_days: int = 30, days: int = 5, change: tuple = (0.08, 0.8), vol: tuple = (0.04, 0.35), blacklist: str = "^$") -> DataFrame:
    """Pairs that pass volume rank, age, range and volatility over the last ``days`` bars before ``as_of``."""
    rows = bars.where(F.col("ts") < F.lit(as_of).cast("timestamp"))
    w = Window.partitionBy("pair").orderBy("ts")
    rows = rows.withColumns({"_r": F.log(F.col("close") / F.lag("close").over(w)), "_back": F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("ts")))})
    recent = F.col("_back") <= days
    out = rows.groupBy("pair").agg(
        F.min("ts").alias("first_bar"), F.sum(F.when(recent, F.col("close") * F.col("volume"))).alias("quote_volume"), F.max(F.when(recent, F.col("high"))).alias("_hi"), F.min(F.when(recent, F.col("low"))).alias("_lo"), F.stddev_samp(F.when(recent, F.col("_r"))).alias("_sd")
    )
    out = out.withColumns({"range_change": (F.col("_hi") - F.col("_lo")) / F.nullif(F.col("_lo"), F.lit(0.0)), "volatility": F.col("_sd") * days**0.5, "rank": F.row_number().over(Window.orderBy(F.desc("quote_volume"), "pair"))})
    ok = (F.col("rank") <= top) & (F.col("first_bar") <= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {listed_days} DAYS")) & F.col("range_change").between(*change) & F.col("volatility").between(*vol) & ~F.col("pair").rlike(blacklist)
    return out.withColumn("passes", F.coalesce(ok, F.lit(False))).drop("_hi", "_lo", "_sd")
