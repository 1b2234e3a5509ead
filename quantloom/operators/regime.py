"""Market breadth and regime attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import flag
from quantloom.operators.asof import asof_join
from quantloom.operators.ledger import match_trades, max_drawdown


def breadth(df: DataFrame, flags: list[str], ts: str = "ts") -> DataFrame:
    """Per timestamp: share of pairs with each flag, and the number of pairs."""
    return df.groupBy(ts).agg(*(F.avg(F.col(f).cast("double")).alias(f"{f}_share") for f in flags), F.count_distinct("pair").alias("universe"))


def trend_label(df: DataFrame) -> DataFrame:
    """up, down or flat by the order of close, ema50 and ema200 of the larger timeframe."""
    c = F.col
    label = F.when((c("close_info") > c("ema50_info")) & (c("ema50_info") > c("ema200_info")), "up").when((c("close_info") < c("ema50_info")) & (c("ema50_info") < c("ema200_info")), "down").otherwise("flat")
    return df.withColumn("trend", label)


def regime_summary(rows: DataFrame, features: list[str], columns: list[str]) -> DataFrame:
    """Per feature and bucket: rows and mean of each column; features are stacked first, so one shuffle serves all."""
    stacked = rows.withColumn("f", F.explode(F.array(*(F.struct(F.lit(name).alias("feature"), F.coalesce(F.col(name).cast("string"), F.lit("missing")).alias("bucket")) for name in features))))
    return stacked.groupBy("f.feature", "f.bucket").agg(F.count("*").alias("rows"), *(F.avg(c).alias(f"mean_{c}") for c in columns))


def with_context(df: DataFrame, context: DataFrame, ts: str = "ts") -> DataFrame:
    """Signals or trades with the market context of their timestamp, null where there is none."""
    return df.join(context, ts, "left")


def signal_quality(rows: DataFrame, label: str, column: str) -> DataFrame:
    """Per label (signal, or the first gate that failed): rows, complete rows, mean and good share of a return."""
    return rows.groupBy(label).agg(F.count("*").alias("rows"), F.count(column).alias("complete"), F.avg(column).alias(f"mean_{column}"), F.avg(F.when(F.col(column).isNotNull(), (F.col(column) > 0).cast("double"))).alias("good_share"))


def quality_classes(setups: DataFrame, trades: DataFrame, bar: str, near: str, hit: str, columns: list[str], keys: tuple = ("strategy",)) -> DataFrame:
    """Per class what prices did afterwards: signals, setups that missed by their last gates, those of them that would have been good
    (``near`` above 0, or ``hit``), all with keys "ALL", and per key the trades that were really made, with the returns of the signal one
    ``bar`` before them, profit and win rate. ``setups``: pair, ts, first_failed_gate and the ``columns``; null returns count in rows only."""
    missed = F.col("first_failed_gate") != "signal"
    classes = F.array_compact(F.array(F.when(~missed, "raw_signal"), F.when(missed, "near_miss"), F.when(missed & good_outcome(near, hit), "good_near_miss")))
    values, nothing = [F.col(c).cast("double").alias(c) for c in columns], F.lit(None).cast("double").alias("profit_abs")
    stacked = setups.select(*(F.lit("ALL").alias(k) for k in keys), F.explode(classes).alias("class"), *values, nothing)
    signals = setups.where(~missed).select("pair", "ts", *columns)
    made = match_trades(trades.select("pair", "open_date", "profit_abs", *keys), signals, bar)
    realized = made.select(*keys, F.lit("realized_trade").alias("class"), *values, F.col("profit_abs").cast("double").alias("profit_abs"))
    means = [F.avg(c).alias(f"mean_{c}") for c in columns]
    won = F.avg(F.when(F.col("profit_abs").isNotNull(), (F.col("profit_abs") > 0).cast("double"))).alias("win_rate")
    return stacked.unionByName(realized).groupBy(*keys, "class").agg(F.count("*").alias("rows"), F.count(columns[0]).alias("complete"), *means, F.sum("profit_abs").alias("profit"), won)


def good_outcome(near: str, hit: str) -> Column:
    return flag(F.col(near) > 0) | flag(F.col(hit))


def gate_blockers(setups: DataFrame, near: str, hit: str) -> DataFrame:
    """Per gate that kept a good setup from being a signal: rows, mean return, and the share that came back to the mean."""
    blocked = setups.where((F.col("first_failed_gate") != "signal") & good_outcome(near, hit))
    return blocked.groupBy("first_failed_gate").agg(F.count("*").alias("rows"), F.avg(near).alias(f"mean_{near}"), F.avg(F.col(hit).cast("double")).alias("hit_share"))


def market_trend(bars: DataFrame) -> DataFrame:
    """(ts, market_trend) of one market's bars with ema50, ema200 and ema50_slope: up and down need the order and the slope."""
    c = F.col
    up, down = (c("ema50") > c("ema200")) & (c("ema50_slope") > 0), (c("ema50") < c("ema200")) & (c("ema50_slope") < 0)
    return bars.select("ts", F.when(flag(up), "market_up").when(flag(down), "market_down").otherwise("market_neutral").alias("market_trend"))


def market_context(context: DataFrame, trend: DataFrame, vol: DataFrame, period: str = "month") -> DataFrame:
    """``context`` (ts, ...) with the last known market trend and realized volatility; no key, rows in order per period only."""
    out = asof_join(context, trend, "ts", (), ("market_trend",), period=period)
    return asof_join(out, vol, "ts", (), ("realized_vol",), period=period)


def attribution(signals: DataFrame, trades: DataFrame, bucket: str, returns: list[str]) -> DataFrame:
    """Per bucket: signals and their mean returns, trades, win rate, profit and drawdown; 0 where a bucket has no trades."""
    entered = signals.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("signals"), *(F.avg(c).alias(f"mean_{c}") for c in returns))
    keyed = trades.withColumn("bucket", F.col(bucket))
    won = keyed.groupBy("bucket").agg(F.count("*").alias("trades"), F.avg((F.col("profit_abs") > 0).cast("double")).alias("win_rate"), F.sum("profit_abs").alias("profit"))
    fall = max_drawdown(keyed.withColumn("profit_abs", F.round("profit_abs", 2).cast("decimal(18,2)")), ["bucket"]).select("bucket", F.col("max_drawdown").cast("double").alias("drawdown"))
    out = entered.join(won, "bucket", "left").join(fall, "bucket", "left")
    return out.na.fill(0, ["trades", "win_rate", "profit", "drawdown"])
