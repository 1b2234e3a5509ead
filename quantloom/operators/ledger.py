"""Trade ledgers: contributions, concentration, drawdown, removals, stress, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import safe_div, stamp
from quantloom.operators.universe import near_anchors


def notional(default: float = 0.0) -> Column:
    return (F.coalesce("open_rate", F.lit(default)) + F.coalesce("close_rate", "open_rate", F.lit(default))) / 2 * F.abs(F.coalesce("amount", F.lit(default)))


def stressed_profit(trades: DataFrame, fee: float, slip: float) -> DataFrame:
    """Profit after raising each side's fee to ``fee`` and adding ``slip`` per side, on the mean notional."""
    extra = F.greatest(fee - F.coalesce("fee_open", F.lit(0.0)), F.lit(0.0)) + F.greatest(fee - F.coalesce("fee_close", F.lit(0.0)), F.lit(0.0)) + 2 * slip
    return trades.withColumn("stressed_profit_abs", F.col("profit_abs") - notional() * extra)


def cost_scenarios(trades: DataFrame, scenarios: list[tuple[str, float, float]], keys: list[str]) -> DataFrame:
    """Totals per scenario (name, fee, slip) and key, in one pass."""
    rows = trades.withColumn("s", F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("fee"), F.lit(p).alias("slip")) for n, f, p in scenarios))))
    side = lambda c: F.greatest(F.col("s.fee") - F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    profit = F.col("profit_abs") - notional() * (side("fee_open") + side("fee_close") + 2 * F.col("s.slip"))
    return rows.groupBy("s.scenario", *keys).agg(F.count("*").alias("trades"), F.sum(profit).alias("profit"), F.avg(profit).alias("average"))


def contribution(trades: DataFrame, keys: list[str], profit: str = "profit_abs") -> DataFrame:
    """Per key: trades, wins, profit, average, best, worst, and its share of the total."""
    p = F.col(profit)
    out = trades.groupBy(*keys).agg(F.count("*").alias("trades"), F.count(F.when(p > 0, 1)).alias("wins"), F.sum(p).alias("profit"), F.avg(p).alias("average"), F.max(p).alias("best"), F.min(p).alias("worst"))
    return out.withColumn("share", safe_div(F.col("profit"), F.sum("profit").over(Window.partitionBy())))


def profit_factor(p: Column) -> Column:
    """Gross profit over gross loss; without losses infinite, or 0 without profits."""
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0))
    return F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)


def concentration(trades: DataFrame, keys: list[str], group: str, ks=(1, 3, 5), profit: str = "profit_abs") -> DataFrame:
    """Per key: HHI of positive group contributions, share of the top k groups, and the largest group's share
    of the total (1 where the total is not positive)."""
    groups = trades.groupBy(*keys, group).agg(F.sum(profit).alias("p"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), group))
    gain = F.greatest("p", F.lit(0.0))
    groups = groups.withColumns({"r": rank, "gain": gain})
    total, gains = F.sum("p"), F.sum("gain")
    share = lambda a: F.when(gains > 0, a / F.nullif(gains, F.lit(0.0))).otherwise(0.0)
    return groups.groupBy(*keys).agg(
        F.when(gains > 0, F.sum(F.pow("gain", F.lit(2.0))) / F.nullif(gains * gains, F.lit(0.0))).otherwise(0.0).alias("hhi"),
        *(share(F.sum(F.when(F.col("r") <= k, F.col("gain")).otherwise(0.0))).alias(f"top_{k}_share") for k in ks),
        F.when(total > 0, F.max("gain") / F.nullif(total, F.lit(0.0))).otherwise(1.0).alias("max_group_share"),
    )


def max_drawdown(trades: DataFrame, keys: list[str], profit: str = "profit_abs") -> DataFrame:
    """The largest fall of cumulative profit below its own running maximum, which starts at the first value.
    Two levels: days are summed first with their own inner fall, then days are put in line."""
    order = ["open_date", "close_date", "pair", profit]
    inner = Window.partitionBy(*keys, "open_date").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("c", F.sum(profit).over(inner)).withColumn("low", F.col("c") - F.max("c").over(inner))
    days = rows.groupBy(*keys, "open_date").agg(F.sum(profit).alias("total"), F.max("c").alias("peak"), F.min("c").alias("bottom"), F.min("low").alias("low"))
    before = Window.partitionBy(*keys).orderBy("open_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    days = days.withColumn("high", F.max(F.col("start") + F.col("peak")).over(before))
    fall = F.least(F.col("low"), F.coalesce(F.col("start") + F.col("bottom") - F.col("high"), F.lit(0.0)))
    return days.groupBy(*keys).agg(F.abs(F.min(fall)).alias("max_drawdown"), F.count("*").alias("days"))


def leave_one_out(trades: DataFrame, keys: list[str], removed: str, profit: str = "profit_abs") -> DataFrame:
    """Totals without each value of ``removed``: the whole less the part, as sums and counts add up."""
    parts = trades.groupBy(*keys, removed).agg(F.sum(profit).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return parts.select(*keys, F.col(removed).alias("removed"), (F.sum("p").over(w) - F.col("p")).alias("profit_after"), (F.sum("n").over(w) - F.col("n")).alias("trades_after"))


def remove_top(trades: DataFrame, keys: list[str], group: str, ns=(1, 3, 5), profit: str = "profit_abs") -> DataFrame:
    """Profit and trades left after removing the n best values of ``group``."""
    parts = trades.groupBy(*keys, group).agg(F.sum(profit).alias("p"), F.count("*").alias("n"))
    parts = parts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), group)))
    parts = parts.withColumn("removed_top", F.explode(F.array(*map(F.lit, ns))))
    left = F.col("r") > F.col("removed_top")
    return parts.groupBy(*keys, "removed_top").agg(F.coalesce(F.sum(F.when(left, F.col("p"))), F.lit(0.0)).alias("profit_after"), F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("trades_after"), F.sum("p").alias("profit"), F.sum("n").alias("trades"))


def match_trades(trades: DataFrame, signals: DataFrame, bar: str) -> DataFrame:
    """Trades left-joined with the signal one bar before their opening."""
    s = signals.withColumn("open_date", F.col("ts") + F.expr(f"INTERVAL {bar}")).withColumnRenamed("ts", "signal_ts")
    return trades.join(s, ["pair", "open_date"], "left")


def value_counts(df: DataFrame, keys: list[str], column: str, limit: int = 12) -> DataFrame:
    """"value:count" of the most frequent values, most frequent first."""
    n = df.groupBy(*keys, F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")).alias("v")).agg(F.count("*").alias("n"))
    n = n.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "v"))).where(F.col("r") <= limit)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("r", "v", "n"))), lambda x: F.concat(x["v"], F.lit(":"), x["n"].cast("string")))
    return n.groupBy(*keys).agg(F.concat_ws(", ", entries).alias(f"{column}_counts"))


def largest_gains(trades: DataFrame, keys: list[str], ks: tuple = (1, 5), profit: str = "profit_abs", salts: int = 64) -> DataFrame:
    """Per key the sum of its k largest gains. The largest are taken inside salted parts first, so that no key is ranked as a whole."""
    gains = trades.where(F.col(profit) > 0).select(*keys, profit).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    for part in ([*keys, "_salt"], keys):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(profit)))
        gains = gains.withColumn("_r", rank).where(F.col("_r") <= max(ks))
    return gains.groupBy(*keys).agg(*(F.sum(F.when(F.col("_r") <= k, F.col(profit))).alias(f"gain_top_{k}") for k in ks))


def ledger_summary(trades: DataFrame, keys: list[str], split: str, funding_bps: float = 30.0) -> DataFrame:
    """One row per run: counts, validation split, duration, removals, cost and funding proxies, same-candle collisions."""
    p = F.col("profit_abs")
    late = F.col("open_date") >= F.lit(split).cast("timestamp")
    hours = (F.col("close_date").cast("timestamp").cast("long") - F.col("open_date").cast("timestamp").cast("long")) / 3600
    fees = notional() * (F.coalesce("fee_open", F.lit(0.0)) + F.coalesce("fee_close", F.lit(0.0)))
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum(p).alias("profit"), F.count(F.when(late, 1)).alias("validation_trades"), F.sum(F.when(late, p).otherwise(0.0)).alias("validation_profit"), F.avg(hours).alias("mean_hours"), F.percentile(hours, F.lit(0.5)).alias("median_hours"),
        F.size(F.collect_set("pair")).cast("long").alias("active_pairs"), F.size(F.collect_set(F.year("open_date"))).cast("long").alias("active_years"),  # sets of pairs and years are small; distinct counts would triple the rows
        F.sum(p - fees).alias("profit_after_fee_2x"), F.sum(p - notional() * 0.002).alias("profit_after_20bps"), F.sum(p - notional() * (funding_bps / 10_000)).alias("profit_after_funding"),
        F.count(F.when(F.col("open_date") == F.col("close_date"), 1)).alias("same_candle"), profit_factor(p).alias("profit_factor"),
    )
    out = out.join(largest_gains(trades, keys), keys, "left")
    return out.withColumns({f"profit_after_top_{k}": F.col("profit") - F.coalesce(f"gain_top_{k}", F.lit(0.0)) for k in (1, 5)}).drop("gain_top_1", "gain_top_5")


def in_windows(trades: DataFrame, start: str, end: str, step: int, months: int) -> DataFrame:
    """One row for each window [anchor, anchor + months) that a trade opens in; anchors every ``step`` months from the month's first ``start`` to ``end``."""
    since = F.add_months(F.trunc("open_date", "month"), 1 - months)
    return trades.withColumn("anchor", F.explode(near_anchors(since, F.col("open_date"), start, end, step)))


def signature() -> Column:
    return F.concat_ws("|", "pair", stamp(F.col("open_date")), F.col("is_short").cast("string"))


def per_value(rows: DataFrame, keys: list[str], column: str, out: str, between: str, order: str = "value", limit: int | None = None) -> DataFrame:
    """Counts of ``column`` as text, by value or (``order`` "count") most frequent first."""
    counts = rows.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    entry = F.struct("v", "n") if order == "value" else F.struct((-F.col("n")).alias("k"), "v", "n")
    if limit:
        counts = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "v"))).where(F.col("_r") <= limit)
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat(x["v"], F.lit(between), x["n"].cast("string")))
    return counts.groupBy(*keys).agg(F.concat_ws(", ", entries).alias(out))


def validation_matrix(windowed: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Per anchor window and variant of ``in_windows``: trades, distinct signatures, sides, profit, months and pairs as text."""
    keys = ["anchor", *keys]
    rows = windowed.withColumns({"month": F.date_format("open_date", "yyyy-MM"), "signature": signature()})
    short = F.count(F.when(F.col("is_short"), 1))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_distinct("signature").alias("unique_trades"), F.count_distinct("pair").alias("pairs"), F.sum("profit_abs").alias("profit"), (F.count("*") - short).alias("long_trades"), short.alias("short_trades")
    )
    out = out.join(per_value(rows, keys, "month", "monthly_distribution", ":"), keys).join(per_value(rows, keys, "pair", "pair_contribution", ":", "count", 8), keys)
    return out.withColumn("usable_sample", F.col("trades") >= least)


def variant_totals(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Per variant over all its windows: trades, distinct signatures, profit and sides."""
    short = F.count(F.when(F.col("is_short"), 1))
    return windowed.groupBy(*keys).agg(F.count("*").alias("raw_trades"), F.count_distinct(signature()).alias("unique_trades"), F.sum("profit_abs").alias("profit"), (F.count("*") - short).alias("long_trades"), short.alias("short_trades"))


def window_drawdowns(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Drawdown of each window and variant."""
    return max_drawdown(windowed.withColumn("profit_abs", F.round("profit_abs", 2).cast("decimal(18,2)")), ["anchor", *keys]).withColumn("max_drawdown", F.col("max_drawdown").cast("double")).drop("days")


def promotion_windows(windowed: DataFrame, keys: list[str], cutoff: str, least: int = 20) -> DataFrame:
    """One row per variant for all windows before ``cutoff``, the reference that selected it, and one for each later window, a holdout."""
    late = F.col("anchor") >= F.lit(cutoff).cast("timestamp_ntz")
    role = F.when(late, "promotion_holdout").otherwise("candidate_selection_reference")
    rows = windowed.withColumns({"evidence_role": role, "window": F.when(late, stamp(F.col("anchor"))).otherwise("selection"), "month": F.date_format("open_date", "yyyy-MM")})
    key = [*keys, "evidence_role", "window"]
    falls = window_drawdowns(windowed, keys).withColumns({"evidence_role": role, "window": F.when(late, stamp(F.col("anchor"))).otherwise("selection")})
    out = rows.groupBy(*key).agg(F.count_distinct("anchor").alias("windows"), F.count("*").alias("trades"), F.count_distinct(signature()).alias("unique_trades"), F.sum("profit_abs").alias("profit"))
    out = out.join(falls.groupBy(*key).agg(F.max("max_drawdown").alias("max_drawdown")), key).join(per_value(rows, key, "month", "monthly_distribution", ":"), key)
    return out.withColumn("sample_large_enough", F.col("trades") >= least)


def time_stress(windowed: DataFrame, keys: list[str], cutoff: str) -> DataFrame:
    """Per variant: profit, trades and drawdown of the windows before ``cutoff``, of the same without the best month, the two
    best months, the best window, and the profit and trades of the later windows."""
    late = F.col("anchor") >= F.lit(cutoff).cast("timestamp_ntz")
    rows = windowed.withColumns({"month": F.date_format("open_date", "yyyy-MM"), "_late": late})
    before = rows.where("not _late")
    for column in ("month", "anchor"):
        parts = before.groupBy(*keys, column).agg(F.round(F.sum("profit_abs"), 6).alias("_p"))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_p"), column))
        rows = rows.join(parts.select(*keys, column, rank.alias(f"_{column}")), [*keys, column], "left")
    tests = {"selection_reference": F.lit(True), "remove_best_month": F.col("_month") > 1, "remove_best_two_months": F.col("_month") > 2, "remove_best_anchor_window": F.col("_anchor") > 1}
    names = [F.when(~F.col("_late") & test, F.lit(name)) for name, test in tests.items()] + [F.when(F.col("_late"), F.lit("promotion_holdouts_only"))]
    rows = rows.withColumn("scenario", F.explode(F.array_compact(F.array(*names))))
    key = [*keys, "scenario"]
    fall = max_drawdown(rows.where("not _late").withColumn("profit_abs", F.round("profit_abs", 2).cast("decimal(18,2)")), key).select(*key, F.col("max_drawdown").cast("double").alias("max_drawdown"))
    out = rows.groupBy(*key).agg(F.count("*").alias("trades"), F.sum("profit_abs").alias("profit")).join(fall, key, "left")
    return out.withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))


def strict_gate(windowed: DataFrame, expected: DataFrame, keys: list[str], fee: float, slip: float, balance: float, latest: int, least_window: int) -> DataFrame:
    """Inputs of the strict gate, one row per variant: missing windows, trades, usable windows, positive ones among the latest,
    stressed profit, average and profit factor, the largest drawdown in percent of ``balance``, and the largest shares of a month
    and a pair. ``expected``: (anchor, keys)."""
    rows = stressed_profit(windowed, fee, slip).withColumn("month", F.date_format("open_date", "yyyy-MM"))
    key = ["anchor", *keys]
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("stressed_profit_abs").alias("p")).join(window_drawdowns(windowed, keys), key)
    per = expected.select(*key).distinct().join(per, key, "left")
    back = F.when(F.col("n").isNotNull(), F.row_number().over(Window.partitionBy(*keys, F.col("n").isNull()).orderBy(F.desc("anchor"))))  # a row a window
    windows = per.withColumn("_back", back).groupBy(*keys).agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("missing_windows"), F.count(F.when(F.col("n") >= least_window, 1)).alias("usable_windows"), F.count(F.when((F.col("_back") <= latest) & (F.col("p") > 0), 1)).alias("latest_positive_windows"),
        (F.coalesce(F.max("max_drawdown"), F.lit(0.0)) / balance * 100).alias("max_drawdown_pct"),
    )
    p = F.col("stressed_profit_abs")
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total_trades"), F.sum(p).alias("stressed_profit"), F.avg(p).alias("avg_stressed_trade"), profit_factor(p).alias("profit_factor_stressed"))
    out = windows.join(totals, keys, "left")
    for g in ("month", "pair"):
        out = out.join(concentration(rows, keys, g, profit="stressed_profit_abs").select(*keys, F.col("max_group_share").alias(f"max_{g}_profit_share")), keys, "left")
    return out


def buy_hold(bars: DataFrame, pairs: DataFrame, start: str, end: str) -> DataFrame:
    """Per pair of the list: first and last close in the window, change in percent and a status."""
    inside = bars.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    ends = inside.groupBy("pair").agg(F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"), F.count("*").alias("bars"))
    known = bars.select("pair").distinct().withColumn("known", F.lit(True))
    out = pairs.join(known, "pair", "left").join(ends, "pair", "left")
    status = F.when(F.col("known").isNull(), "missing").when(F.col("bars").isNull(), "no_data").when(~(F.coalesce("first_close", F.lit(0.0)) > 0), "bad_start").otherwise("ok")
    return out.withColumn("status", status).withColumn("change_pct", F.when(status == "ok", (F.col("last_close") / F.col("first_close") - 1) * 100)).drop("known")


def buy_hold_summary(returns: DataFrame) -> DataFrame:
    """Over the pairs of ``buy_hold``: how many, how many usable, mean and median change, the best and the worst pair."""
    ok = F.col("status") == "ok"
    change, pair = F.when(ok, F.col("change_pct")), F.when(ok, F.col("pair"))
    best, worst = F.struct((-change).alias("k"), pair.alias("pair")), F.struct(change.alias("k"), pair.alias("pair"))
    return returns.agg(
        F.count("*").alias("pairs"), F.count(F.when(ok, 1)).alias("usable_pairs"), F.avg(change).alias("mean_change"), F.percentile(change, F.lit(0.5)).alias("median_change"),
        F.min(F.when(ok, best))["pair"].alias("best_pair"), F.max(change).alias("best_change"), F.min(F.when(ok, worst))["pair"].alias("worst_pair"), F.min(change).alias("worst_change"),
    )
