"""What prices did after a signal: forward returns, excursions, touches, clusters, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import flag, median, safe_div
from quantloom.operators.indicators import line
from quantloom.operators.rows import KEYS

HORIZONS = (1, 3, 6, 12, 24)


def forward_returns(df: DataFrame, horizons=HORIZONS, entry: str = "next_open", keys=KEYS) -> DataFrame:
    """entry_price, forward_k and has_forward_k: the close k bars after the entry bar against the entry price."""
    w, offset = line(keys), 1 if entry == "next_open" else 0
    df = df.withColumn("entry_price", F.lead("open", 1).over(w) if offset else F.col("close"))
    out = {}
    for k in horizons:
        later = F.lead("close", k + offset).over(w)
        out[f"forward_{k}"] = safe_div(later - F.col("entry_price"), F.col("entry_price"))
        out[f"has_forward_{k}"] = later.isNotNull() & F.col("entry_price").isNotNull()
    return df.withColumns(out)


def excursions(df: DataFrame, n: int, offset: int = 1, keys=KEYS, block: bool = True) -> DataFrame:
    """mfe and mae: the highest high and lowest low of the n bars after the entry bar against entry_price; a
    shorter tail counts. Blocks of n rows carry running extremes from both ends, so a frame of n rows costs two
    look-ups however large n is (needs bar_idx)."""
    w = line(keys)
    a, b = offset + 1, offset + n
    if not block:
        high, low = F.max("high").over(w.rowsBetween(a, b)), F.min("low").over(w.rowsBetween(a, b))
        df = df.withColumns({"_hi": high, "_lo": low})
    else:
        blocks = Window.partitionBy(*keys, F.floor(F.col("bar_idx") / n)).orderBy("ts")
        head, tail = blocks.rowsBetween(Window.unboundedPreceding, 0), blocks.rowsBetween(0, Window.unboundedFollowing)
        df = df.withColumns({"_ph": F.max("high").over(head), "_pl": F.min("low").over(head), "_sh": F.max("high").over(tail), "_sl": F.min("low").over(tail)})
        rest = w.rowsBetween(0, Window.unboundedFollowing)
        end = {c: F.last(c).over(rest) for c in ("_ph", "_pl")}
        last_block = F.floor(F.last("bar_idx").over(rest) / n)
        there = F.col("bar_idx") + a <= F.last("bar_idx").over(rest)
        other = there & (F.floor((F.col("bar_idx") + a) / n) != last_block)
        far = {c: F.coalesce(F.lead(c, b).over(w), F.when(other, end[c])) for c in ("_ph", "_pl")}
        df = df.withColumns({"_hi": F.greatest(F.lead("_sh", a).over(w), far["_ph"]), "_lo": F.least(F.lead("_sl", a).over(w), far["_pl"])})
    entry = F.col("entry_price")
    return df.withColumns({"mfe": safe_div(F.col("_hi") - entry, entry), "mae": safe_div(F.col("_lo") - entry, entry)}).drop("_hi", "_lo", "_ph", "_pl", "_sh", "_sl")


def signal_events(df: DataFrame, horizons=(1, 3, 6, 12, 24), reach: int = 48, keys=KEYS) -> DataFrame:
    """One row per long or short signal, entered at the signal's close; returns and excursions in its direction."""
    w = line(keys)
    out = {f"_f{h}": F.lead("close", h).over(w) for h in horizons}
    out |= {"_hi": F.max("high").over(w.rowsBetween(1, reach)), "_lo": F.min("low").over(w.rowsBetween(1, reach))}
    df = df.withColumns(out)
    sides = F.array_compact(F.array(F.when(F.col("enter_long") == 1, F.lit("long")), F.when(F.col("enter_short") == 1, F.lit("short"))))
    df = df.withColumn("side", F.explode(sides)).withColumn("entry_price", F.col("close"))
    sign, entry, is_long = F.when(F.col("side") == "long", 1.0).otherwise(-1.0), F.col("entry_price"), F.col("side") == "long"
    returns = {f"ret_{h}": sign * (safe_div(F.col(f"_f{h}"), entry) - 1) for h in horizons}
    returns["mfe"] = F.when(is_long, safe_div(F.col("_hi"), entry) - 1).otherwise(safe_div(entry, F.col("_lo")) - 1)
    returns["mae"] = F.when(is_long, safe_div(F.col("_lo"), entry) - 1).otherwise(safe_div(entry, F.col("_hi")) - 1)
    return df.withColumns(returns).drop(*out)


def mean_hit(df: DataFrame, horizon: int, target: str = "bb_mid", keys=KEYS) -> DataFrame:
    """Whether price touches this bar's target within ``horizon`` bars; null where that many bars are not there."""
    w = line(keys).rowsBetween(1, horizon)
    up = F.max("high").over(w) >= F.col(target)
    down = F.min("low").over(w) <= F.col(target)
    touched = F.when(F.col(target) >= F.col("close"), up).otherwise(down)
    complete = (F.count("close").over(w) == horizon) & F.col(target).isNotNull()
    return df.withColumn(f"mean_hit_{horizon}", F.when(complete, touched))


def cluster_events(events: DataFrame, keys=("pair",), gap: str = "72 hours", ts: str = "ts", period: str = "year", sizes: bool = True) -> DataFrame:
    """Clusters of events no more than ``gap`` apart: cluster_no per key, whether the event is first and, with ``sizes``, the
    cluster's start and size. Events are put in line inside a ``period``; periods are joined by their first and last events, and
    numbers, starts and sizes are added up over them, so that no history is ordered as a whole."""
    part = [*keys, "_part"]
    w = Window.partitionBy(*part).orderBy(ts)
    apart = lambda later, earlier: F.col(later) > earlier + F.expr(f"INTERVAL {gap}")
    out = events.withColumn("_part", F.date_trunc(period, ts)).withColumn("_new", apart(ts, F.lag(ts).over(w)).cast("int"))  # null: the period's first
    out = out.withColumn("_inner", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    ends = out.groupBy(*part).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_inner").alias("_n"))
    periods = Window.partitionBy(*keys).orderBy("_part")  # a row a period
    ends = ends.withColumn("_border", F.coalesce(apart("_first", F.lag("_last").over(periods)), F.lit(True)).cast("int"))
    begun = F.sum(F.col("_n") + F.col("_border")).over(periods.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    out = out.join(ends.select(*part, "_border", begun.alias("_begun")), part)
    out = out.withColumns({"cluster_no": F.col("_begun") + F.col("_inner"), "is_cluster_first": F.coalesce("_new", "_border") == 1}).drop("_new", "_inner", "_border", "_begun")
    if sizes:
        pieces = out.groupBy(*part, "cluster_no").agg(F.min(ts).alias("cluster_start"), F.count("*").alias("cluster_size"))
        cluster = Window.partitionBy(*keys, "cluster_no")  # a row a period
        whole = {"cluster_start": F.min("cluster_start").over(cluster), "cluster_size": F.sum("cluster_size").over(cluster)}
        out = out.join(pieces.withColumns(whole), [*part, "cluster_no"])
    return out.drop("_part")


def share_positive(column: str) -> Column:
    return F.avg((F.col(column) > 0).cast("double"))


def event_summary(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Counts, independent clusters, pairs, and mean, median and win rate of each return column."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("median", median), ("win_rate", lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")))))]
    return events.groupBy(*keys).agg(F.count("*").alias("signals"), F.count(F.when(F.col("is_cluster_first"), 1)).alias("clusters"), F.count_distinct("pair").alias("pairs"), *stats)


def study_summary(events: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Means over several groupings in one pass; ``level`` names the grouping, absent keys are "ALL"."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = events.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    level = F.grouping_id(*keys) if keys else F.lit(0)
    out = grouped.agg(level.cast("int").alias("level"), F.count("*").alias("signals"), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    return out.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("ALL")) for k in keys})


def indicator_summary(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.avg(c).alias(f"avg_{c}") for c in columns))


def signal_funnel(df: DataFrame, steps: list[tuple[str, Column]], key: str = "pair") -> DataFrame:
    """Rows that pass each of the steps and all before it, per key and in total (key "ALL")."""
    counts, so_far = [F.count("*").alias("rows")], F.lit(True)
    for name, condition in steps:
        so_far = so_far & flag(condition)
        counts.append(F.count(F.when(so_far, 1)).alias(name))
    out = df.rollup(key).agg(*counts)
    return out.withColumn(key, F.coalesce(key, F.lit("ALL")))


def top_share(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Share of the most frequent value of ``column`` in each group."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias(f"top_{column}_share"))


def positive_groups(df: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """How many values of ``column`` have a positive median of ``value``."""
    medians = df.groupBy(*keys, column).agg(median(value).alias("_m"))
    return medians.groupBy(*keys).agg(F.count(F.when(F.col("_m") > 0, 1)).alias(f"positive_{column}s"))
