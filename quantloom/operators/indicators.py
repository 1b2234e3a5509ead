"""Rolling indicators as window functions; one partitioning by (pair, chunk) serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import flag, safe_div
from quantloom.operators.rows import KEYS, value_positions


def last_rows(n: int, keys=KEYS):
    return Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(n - 1), 0)


def line(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("ts")


def full(column: str, value: Column, n: int, keys=KEYS) -> Column:
    """``value`` once the frame holds n non-null rows of ``column``."""
    return F.when(F.count(column).over(last_rows(n, keys)) == n, value)


def rolling_z(df: DataFrame, column: str, out: str, n: int = 20, keys=KEYS) -> DataFrame:
    w = last_rows(n, keys)
    z = safe_div(F.col(column) - F.avg(column).over(w), F.stddev_pop(column).over(w))
    return df.withColumn(out, full(column, z, n, keys))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, keys=KEYS) -> DataFrame:
    w = last_rows(n, keys)
    mid, dev = full("close", F.avg("close").over(w), n, keys), full("close", F.stddev_pop("close").over(w), n, keys)
    df = df.withColumns({"bb_mid": mid, "bb_upper": mid + k * dev, "bb_lower": mid - k * dev})
    return df.withColumn("bb_width", safe_div(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")))


def session_vwap(df: DataFrame, session: str = "day") -> DataFrame:
    """Volume-weighted typical price since the start of the session."""
    w = Window.partitionBy("pair", F.date_trunc(session, "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap", safe_div(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def slope(df: DataFrame, column: str, out: str, keys=KEYS) -> DataFrame:
    before = F.lag(column).over(line(keys))
    return df.withColumn(out, safe_div(F.col(column) - before, before))


def realized_vol(df: DataFrame, n: int = 288, least: int = 72, keys=KEYS) -> DataFrame:
    """Standard deviation of log returns over n bars, from ``least`` on, scaled to n bars."""
    df = df.withColumn("_r", F.log(F.col("close") / F.lag("close").over(line(keys))))
    w = last_rows(n, keys)
    return df.withColumn("realized_vol", F.when(F.count("_r").over(w) >= least, F.stddev_pop("_r").over(w) * n**0.5)).drop("_r")


def reversals(df: DataFrame, keys=KEYS) -> DataFrame:
    before = F.lag("close").over(line(keys))
    up = (F.col("close") > F.col("open")) & (F.col("close") > before)
    down = (F.col("close") < F.col("open")) & (F.col("close") < before)
    return df.withColumns({"bullish_reversal": flag(up), "bearish_reversal": flag(down)})


def gates(df: DataFrame, p) -> DataFrame:
    """Gate columns of ``p`` (a Profile). Strict comparisons; unknown is false."""
    c = F.col
    strong, cap = p.adx_max + 5.0, p.slope_cap
    return df.withColumns(
        {
            "active_pair": flag((c("vol_z") > p.vol_z_min) & (c("natr") > p.natr_min) & (c("bb_width") > p.bb_width_min)),
            "weak_trend_regime": flag((c("adx_info") < p.adx_max) & (F.abs("ema50_slope_info") < cap)),
            "breakout_block_long": flag((c("adx_info") > strong) & (c("ema50_info") < c("ema200_info")) & (c("ema50_slope_info") < -cap) & (c("close_info") < c("bb_lower_info"))),
            "breakout_block_short": flag((c("adx_info") > strong) & (c("ema50_info") > c("ema200_info")) & (c("ema50_slope_info") > cap) & (c("close_info") > c("bb_upper_info"))),
            "trend_expand_against_long": flag((c("adx_info") > strong) & (c("ema50_slope_info") < -cap)),
            "trend_expand_against_short": flag((c("adx_info") > strong) & (c("ema50_slope_info") > cap)),
        }
    )


def quantile_bucket(df: DataFrame, column: str, out: str, q: int = 5, keys=("pair",)) -> DataFrame:
    """Quantile bucket of each row within its key, ties by time; invalid rows get -1. It ranks over all loaded
    rows, later ones too: a stratifier, not a signal."""
    ranked = value_positions(df.where(F.col(column).isNotNull()), keys, column, "ts", "_r", "_size")
    buckets = F.least("_size", F.lit(q))
    number = F.when(F.col("_size") == 1, F.lit(0)).otherwise(F.greatest(F.ceil(F.col("_r") * buckets / (F.col("_size") - 1)), F.lit(1)) - 1)
    ranked = ranked.withColumn(out, number.cast("int")).drop("_r", "_size")
    return ranked.unionByName(df.where(F.col(column).isNull()).withColumn(out, F.lit(-1)))


def bucket_three(df: DataFrame, column: str, out: str, keys: tuple = (), order: str = "ts") -> DataFrame:
    """Terciles low, mid and high by rank; with fewer than three distinct values, high above the median. The median of two
    values is told by how many rows have the lower one."""
    known, c = df.where(F.col(column).isNotNull()), F.col(column)
    ends = known.withColumn("_all", F.lit(1)).groupBy(*keys, "_all").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    ranked = value_positions(known, keys, column, order, "_r", "_size").withColumn("_all", F.lit(1))
    ranked = ranked.join(ends, [*keys, "_all"])
    facts = ranked.groupBy(*keys, "_all").agg(F.bool_or((c > F.col("_low")) & (c < F.col("_high"))).alias("_inner"), F.count_if(c == F.col("_low")).alias("_lows"))
    ranked = ranked.join(facts, [*keys, "_all"])
    third = F.least(F.floor(F.col("_r") * 3 / F.greatest(F.col("_size") - 1, F.lit(1))), F.lit(2))
    by_rank = F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (third + 1).cast("int"))
    above = (c > F.col("_low")) & (F.col("_lows") > F.floor((F.col("_size") - 1) / 2))
    ranked = ranked.withColumn(out, F.when(F.col("_inner"), by_rank).when(above, "high").otherwise("low")).drop("_r", "_size", "_all", "_low", "_high", "_inner", "_lows")
    return ranked.unionByName(df.where(F.col(column).isNull()).withColumn(out, F.lit(None).cast("string")))
