"""Queries on trade ledgers, universes, regimes, text and result checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import flag, stamp
from quantloom.functions.tables import written
from quantloom.operators import asof, events, gates, indicators, ledger, quality, recursive, regime, rows, signals, universe
from quantloom.plans import frames
from quantloom.plans.book import Book
from quantloom.plans.study import EVENT_CTES, TS, WITH, P, flush_events, nine_places
from quantloom.sources import bars as source

book = Book()
SPLIT = "1999-01-01 00:00:00"


def trades(s, d):
    df = source.trades(s, d)
    return df.withColumns({"year": F.date_format("open_date", "yyyy"), "month": F.date_format("open_date", "yyyy-MM")})


T = """WITH trades AS (
  SELECT p_brand AS pair, least(o_orderdate, l_shipdate) AS open_date, greatest(o_orderdate, l_shipdate) AS close_date, l_returnflag = 'R' AS is_short,
    l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit_abs, l_quantity AS amount, p_retailprice AS open_rate,
      l_extendedprice / l_quantity AS close_rate,
    l_tax / 100 AS fee_open, l_discount / 100 AS fee_close, l_linestatus AS exit_reason, o_orderpriority AS strategy,
    strftime(least(o_orderdate, l_shipdate), '%Y') AS year, strftime(least(o_orderdate, l_shipdate), '%Y-%m') AS month,
      (p_retailprice + l_extendedprice / l_quantity) / 2 * abs(l_quantity) AS notional
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
STRESS = "profit_abs - notional * (greatest({f} - fee_open, 0) + greatest({f} - fee_close, 0) + 2 * {s})"
book.add("trades", lambda s, d: trades(s, d).groupBy("strategy", "pair", "is_short", "month").agg(F.count("*").alias("trades"), F.sum("profit_abs").alias("profit")), f"{T} SELECT strategy, pair, is_short, month, count(*) AS trades, sum(profit_abs) AS profit FROM trades GROUP BY ALL", "profit:2")
book.add("stressed_profit", lambda s, d: ledger.stressed_profit(trades(s, d), 0.0007, 0.0005).groupBy("strategy").agg(F.sum("stressed_profit_abs").alias("stressed")), f"{T} SELECT strategy, sum({STRESS.format(f=0.0007, s=0.0005)}) AS stressed FROM trades GROUP BY strategy", "stressed:1")
SCENARIOS = [("base", 0.0, 0.0), ("fee7", 0.0007, 0.0), ("fee7_slip5", 0.0007, 0.0005)]
book.add(
    "cost_scenarios",
    lambda s, d: ledger.cost_scenarios(trades(s, d), SCENARIOS, ["strategy"]),
    f"{T} " + " UNION ALL ".join(f"SELECT '{n}' AS scenario, strategy, count(*) AS trades, sum({STRESS.format(f=f, s=p)}) AS profit, avg({STRESS.format(f=f, s=p)}) AS average FROM trades GROUP BY strategy" for n, f, p in SCENARIOS),
    "profit:1 average:4",
)
for key in ("pair", "year", "month", "exit_reason"):
    book.add(
        f"contribution_by_{key}",
        lambda s, d, key=key: ledger.contribution(trades(s, d), [key]),
        f"{T}, n AS (SELECT {key}, count(*) AS trades, count(*) FILTER (profit_abs > 0) AS wins, sum(profit_abs) AS profit, avg(profit_abs) AS average, max(profit_abs) AS best, min(profit_abs) AS worst FROM trades GROUP BY {key}) SELECT *, profit / nullif(sum(profit) OVER (), 0) AS share FROM n",
        "profit:1 average:4 best:4 worst:4 share",
    )
book.add(
    "concentration",
    lambda s, d: ledger.concentration(trades(s, d), ["strategy"], "pair"),
    f"""{T}, g AS (SELECT strategy, pair, sum(profit_abs) AS p, greatest(sum(profit_abs), 0) AS gain FROM trades GROUP BY ALL), r AS (SELECT *, row_number()
      OVER (PARTITION BY strategy ORDER BY p DESC, pair) AS r FROM g)
    SELECT strategy, CASE WHEN sum(gain) > 0 THEN sum(gain * gain) / (sum(gain) * sum(gain)) ELSE 0 END AS hhi,
      {', '.join(f'coalesce(sum(gain) FILTER (r <= {k}) / nullif(sum(gain), 0), 0) AS top_{k}_share' for k in (1, 3, 5))}, CASE
        WHEN sum(p) > 0 THEN max(gain) / sum(p) ELSE 1 END AS max_group_share FROM r GROUP BY strategy""",
    "hhi top_1_share top_3_share top_5_share max_group_share",
)
book.add(
    "max_drawdown",
    lambda s, d: ledger.max_drawdown(trades(s, d).withColumn("profit_abs", F.round("profit_abs", 2).cast("decimal(18,2)")), ["strategy"]).withColumn("max_drawdown", F.col("max_drawdown").cast("double")),
    f"""{T}, t AS (SELECT strategy, pair, open_date, close_date, CAST(round(profit_abs, 2) AS DECIMAL(18, 2)) AS p FROM trades), c AS (SELECT *, sum(p)
      OVER (PARTITION BY strategy ORDER BY open_date, close_date, pair, p ROWS UNBOUNDED PRECEDING) AS c FROM t),
    m AS (SELECT *, c - max(c) OVER (PARTITION BY strategy ORDER BY open_date, close_date, pair, p ROWS UNBOUNDED PRECEDING) AS fall FROM c) SELECT strategy,
      CAST(abs(min(fall)) AS DOUBLE) AS max_drawdown, count(DISTINCT open_date) AS days FROM m GROUP BY strategy""",
    "max_drawdown:1",
)
book.add("leave_one_out", lambda s, d: ledger.leave_one_out(trades(s, d), ["strategy"], "pair"), f"{T}, g AS (SELECT strategy, pair AS removed, sum(profit_abs) AS p, count(*) AS n FROM trades GROUP BY ALL) SELECT strategy, removed, sum(p) OVER w - p AS profit_after, CAST(sum(n) OVER w - n AS BIGINT) AS trades_after FROM g WINDOW w AS (PARTITION BY strategy)", "profit_after:1")


def removals(s, d):
    df = ledger.remove_top(trades(s, d), ["strategy"], "month")
    return df.withColumn("resilience", gates.resilience(F.col("profit_after"), F.col("trades_after"), F.col("profit"), F.col("trades"))).drop("profit", "trades")


book.add(
    "remove_top_months",
    removals,
    f"""{T}, g AS (SELECT strategy, month, sum(profit_abs) AS p, count(*) AS n FROM trades GROUP BY ALL), r AS (SELECT *, row_number()
      OVER (PARTITION BY strategy ORDER BY p DESC, month) AS r FROM g),
    x AS (SELECT strategy, k AS removed_top, coalesce(sum(p) FILTER (r > k), 0) AS profit_after, CAST(coalesce(sum(n) FILTER (r > k), 0) AS BIGINT) AS trades_after,
      sum(p) AS profit, sum(n) AS trades FROM r, (VALUES (1), (3), (5)) v(k) GROUP BY ALL)
    SELECT strategy, removed_top, profit_after, trades_after, CASE WHEN trades_after <= 0 OR profit_after <= 0 THEN 'collapses' WHEN (CASE
      WHEN profit > 0 THEN profit_after / profit ELSE 0 END) < 0.5 OR trades_after / trades < 0.6 THEN 'weakens materially' ELSE 'survives' END AS resilience FROM x""",
    "profit_after:1",
)
SUMMARY = ["trades", "profit", "validation_trades", "validation_profit", "mean_hours", "median_hours", "active_pairs", "active_years", "profit_after_top_1", "profit_after_top_5", "profit_after_fee_2x", "profit_after_20bps", "profit_after_funding", "same_candle", "profit_factor"]
LEDGER = f"""{T}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY profit_abs DESC, pair, open_date, close_date, amount) AS r,
      epoch(close_date - open_date) / 3600 AS hours FROM trades),
ledger AS (SELECT strategy, count(*) AS trades, sum(profit_abs) AS profit, count(*) FILTER (open_date >= '{SPLIT}') AS validation_trades,
      sum(profit_abs) FILTER (open_date >= '{SPLIT}') AS validation_profit, avg(hours) AS mean_hours, quantile_cont(hours, 0.5) AS median_hours,
  count(DISTINCT pair) AS active_pairs, count(DISTINCT year) AS active_years, sum(profit_abs) FILTER (r > 1 OR profit_abs <= 0) AS profit_after_top_1,
    sum(profit_abs) FILTER (r > 5 OR profit_abs <= 0) AS profit_after_top_5, sum(profit_abs - notional * 0.003) AS profit_after_funding,
      sum(profit_abs - notional * (fee_open + fee_close)) AS profit_after_fee_2x,
  sum(profit_abs - notional * 0.002) AS profit_after_20bps, count(*) FILTER (open_date = close_date) AS same_candle,
    sum(profit_abs) FILTER (profit_abs > 0) / sum(-profit_abs) FILTER (profit_abs < 0) AS profit_factor FROM r GROUP BY strategy)"""
MONEY = "profit:1 validation_profit:1 mean_hours median_hours profit_after_top_1:1 profit_after_top_5:1 profit_after_fee_2x:1 profit_after_20bps:1 profit_after_funding:1 profit_factor"
book.add("ledger_summary", lambda s, d: ledger.ledger_summary(trades(s, d), ["strategy"], SPLIT), f"{LEDGER} SELECT strategy, {', '.join(SUMMARY)} FROM ledger", MONEY)


def gate(s, d):
    t = written(trades(s, d), "ledger-trades")
    shares = [ledger.concentration(t, ["strategy"], g).select("strategy", F.col("max_group_share").alias(f"top_{g}_profit_share")) for g in ("pair", "year")]
    df = ledger.ledger_summary(t, ["strategy"], SPLIT)
    for x in shares:
        df = df.join(x, "strategy")
    checks = [("profit", F.col("profit") > 0), ("pair_concentration", F.col("top_pair_profit_share") <= 0.06), ("year_concentration", F.col("top_year_profit_share") <= 0.17), ("fees", F.col("profit_after_fee_2x") > 0)]
    return df.select("strategy", gates.classify_ledger(50, 20, 10, 5, 0.06, 0.17).alias("decision"), gates.failed_checks(checks).alias("failed_checks"))


SHARE = "SELECT strategy, CASE WHEN sum(p) > 0 THEN max(greatest(p, 0)) / sum(p) ELSE 1 END AS share FROM (SELECT strategy, {g}, sum(profit_abs) AS p FROM trades GROUP BY ALL) GROUP BY strategy"
book.add(
    "ledger_gate",
    gate,
    f"""{LEDGER}, a AS ({SHARE.format(g='pair')}), b AS ({SHARE.format(g='year')}), x AS (SELECT ledger.*, a.share AS ps, b.share AS ys FROM ledger JOIN a USING (strategy)
      JOIN b USING (strategy))
    SELECT strategy, CASE WHEN trades < 50 THEN 'INSUFFICIENT_TRADES' WHEN validation_trades < 20 OR validation_profit <= 0 THEN 'VALIDATION_FAIL'
      WHEN active_pairs < 10 OR active_years < 5 THEN 'INSUFFICIENT_BREADTH' WHEN profit_after_top_5 <= 0 THEN 'TOP_TRADE_CONCENTRATED'
      WHEN profit_after_fee_2x <= 0 OR profit_after_20bps <= 0 THEN 'COST_SENSITIVE' WHEN ps > 0.06 OR ys > 0.17 THEN 'CONCENTRATED_EDGE'
        WHEN profit <= 0 THEN 'REJECT_PORTFOLIO' ELSE 'RESEARCH_STRATEGY_CANDIDATE' END AS decision,
      concat_ws(', ', CASE WHEN NOT profit > 0 THEN 'profit' END, CASE WHEN NOT ps <= 0.06 THEN 'pair_concentration' END, CASE
        WHEN NOT ys <= 0.17 THEN 'year_concentration' END, CASE WHEN NOT profit_after_fee_2x > 0 THEN 'fees' END) AS failed_checks FROM x""",
)
book.add("value_counts", lambda s, d: ledger.value_counts(trades(s, d), ["strategy"], "pair", 5), f"{T}, n AS (SELECT strategy, pair, count(*) AS n FROM trades GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY n DESC, pair) AS r FROM n) SELECT strategy, string_agg(pair || ':' || n, ', ' ORDER BY r) AS pair_counts FROM r WHERE r <= 5 GROUP BY strategy")
TYPED = T.replace("p_brand AS pair", "p_type AS pair")
book.add(
    "match_trades",
    lambda s, d: ledger.match_trades(source.trades(s, d, "p_type").withColumn("open_date", F.date_trunc("day", "open_date")), rows.own(frames.rolling(s, d)).where("price_z < -1").select("pair", "ts", "price_z"), "1 DAY")
    .groupBy("pair", "strategy").agg(F.count("*").alias("trades"), F.count("signal_ts").alias("matched"), F.avg("price_z").alias("mean_price_z")),
    f"""{TYPED}, {frames.TICKS}, {frames.rolling_sql()}, g AS (SELECT pair, ts, price_z FROM ind WHERE price_z < -1)
    SELECT trades.pair, strategy, count(*) AS trades, count(g.ts) AS matched, avg(price_z) AS mean_price_z FROM trades LEFT JOIN g ON trades.pair = g.pair
      AND date_trunc('day', open_date) = g.ts + INTERVAL 1 DAY GROUP BY ALL""",
    "mean_price_z",
)
YEAR = ("1996-01-01 00:00:00", "1997-01-01 00:00:00")


def held(s, d):
    bars = source.bars_day(s, d)
    return ledger.buy_hold(bars, bars.select("pair").distinct().union(s.sql("select 'NONE'")), *YEAR)


HELD = f"""WITH {frames.TICKS}, p AS (SELECT DISTINCT pair FROM bars UNION ALL SELECT 'NONE'),
e AS (SELECT pair, first(close ORDER BY ts) AS first_close, last(close ORDER BY ts) AS last_close, count(*) AS bars FROM bars WHERE ts >= '1996-01-01'
      AND ts < '1997-01-01' GROUP BY pair),
held AS (SELECT p.pair, first_close, last_close, bars, CASE WHEN p.pair = 'NONE' THEN 'missing' WHEN bars IS NULL THEN 'no_data' ELSE 'ok' END AS status,
      (last_close / first_close - 1) * 100 AS change_pct FROM p LEFT JOIN e USING (pair))"""
book.add("buy_hold", held, f"{HELD} SELECT * FROM held", "first_close last_close change_pct")
book.add(
    "buy_hold_summary",
    lambda s, d: ledger.buy_hold_summary(held(s, d)),
    f"""{HELD} SELECT count(*) AS pairs, count(*) FILTER (status = 'ok') AS usable_pairs, avg(change_pct) AS mean_change, quantile_cont(change_pct, 0.5) AS median_change,
      arg_max(pair, change_pct) AS best_pair,
    max(change_pct) AS best_change, arg_min(pair, change_pct) AS worst_pair, min(change_pct) AS worst_change FROM held""",
    "mean_change median_change best_change worst_change",
)
book.add("monthly_counts", lambda s, d: trades(s, d).groupBy("pair", "month").agg(F.count("*").alias("trades"), F.sum(F.col("is_short").cast("int")).alias("shorts")), f"{T} SELECT pair, month, count(*) AS trades, CAST(sum(CAST(is_short AS INTEGER)) AS BIGINT) AS shorts FROM trades GROUP BY ALL")

# --- universes
ANCHORS = ("1996-01-01", "2000-10-01")


def covered(s, d, least=0.98):
    return universe.flag_coverage(universe.coverage(source.bars_day(s, d), *ANCHORS, 3, 90, 30, 1440), least)


COVER = f"""WITH {frames.TICKS}, a AS (SELECT unnest(generate_series(TIMESTAMP '{ANCHORS[0]}', TIMESTAMP '{ANCHORS[1]}', INTERVAL 3 MONTH)) AS anchor),
cov AS (SELECT anchor, pair, count(*) FILTER (ts < anchor) AS lookback_bars, count(*) FILTER (ts >= anchor) AS post_bars, min(ts) AS first_bar, max(ts) AS last_bar,
      coalesce(sum((high + low + close) / 3 * volume) FILTER (ts < anchor), 0) AS quote_volume,
  count(*) FILTER (ts < anchor) / 90.0::DOUBLE AS lookback_coverage, count(*) FILTER (ts >= anchor) / 30.0::DOUBLE AS post_coverage FROM bars
    JOIN a ON ts >= anchor - INTERVAL 90 DAY AND ts < anchor + INTERVAL 30 DAY GROUP BY ALL),
flagged AS (SELECT *, CASE WHEN lookback_coverage < 0.98 THEN printf('lookback coverage %.2f < %.2f', lookback_coverage, 0.98::DOUBLE)
      WHEN post_coverage < 0.98 THEN printf('post coverage %.2f < %.2f', post_coverage, 0.98::DOUBLE) ELSE '' END AS exclusion_reason FROM cov),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY quote_volume DESC, round(lookback_coverage, 6) DESC, round(post_coverage, 6) DESC, pair) AS rank
      FROM flagged WHERE exclusion_reason = '')"""
A = "strftime(anchor, '%Y-%m-%d') AS anchor"
day = lambda df: df.withColumn("anchor", F.date_format("anchor", "yyyy-MM-dd"))
book.add("coverage", lambda s, d: day(covered(s, d)).select("anchor", "pair", "lookback_bars", "post_bars", "quote_volume", "lookback_coverage", "post_coverage", "exclusion_reason", "selected"), f"{COVER} SELECT {A}, pair, lookback_bars, post_bars, quote_volume, lookback_coverage, post_coverage, exclusion_reason, exclusion_reason = '' AS selected FROM flagged", "quote_volume:3 lookback_coverage post_coverage")
book.add("snapshot", lambda s, d: day(universe.snapshot(covered(s, d), 3)).select("anchor", "pair", "rank"), f"{COVER} SELECT {A}, pair, rank FROM ranked WHERE rank <= 3")
book.add("snapshot_sensitivity", lambda s, d: day(universe.snapshot_sensitivity(covered(s, d), (2, 4))), f"{COVER} SELECT {A}, k AS top_n, count(*) AS eligible, count(*) FILTER (rank <= k) AS selected_pairs, first(pair ORDER BY rank) AS first_pair, last(pair ORDER BY rank) FILTER (rank <= k) AS last_pair FROM ranked, (VALUES (2), (4)) v(k) GROUP BY anchor, k")
book.add("universe_union", lambda s, d: universe.universe_union(universe.snapshot(covered(s, d), 3)), f"{COVER} SELECT DISTINCT pair FROM ranked WHERE rank <= 3")


def markets(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    onboard = F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_partkey") % 2000)
    return part.select("p_partkey", F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("pair"), F.col("p_brand").alias("base"), (F.col("p_size") > 5).alias("active"), F.when(F.col("p_size") == 7, 0.0).otherwise(F.col("p_retailprice")).alias("quote_volume"), onboard.alias("onboard_date"))


book.add(
    "candidate_universe",
    lambda s, d: universe.candidate_universe(markets(s, d), 50, "1998-01-01 00:00:00").select("pair", "exclusion_reason", "rank", "chosen"),
    """WITH m AS (SELECT concat_ws('#', p_name, CAST(p_partkey AS VARCHAR)) AS pair, p_size > 5 AS active, CASE WHEN p_size = 7 THEN 0.0 ELSE p_retailprice END AS quote_volume,
      TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2000 AS INTEGER)) AS onboard_date FROM part),
    r AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN onboard_date > '1998-01-01' THEN 'listed_late'
      WHEN NOT quote_volume > 0 THEN 'no_volume' END AS exclusion_reason FROM m),
    k AS (SELECT *, CASE WHEN exclusion_reason IS NULL THEN row_number() OVER (PARTITION BY exclusion_reason IS NULL ORDER BY quote_volume DESC, onboard_date,
      pair) END AS rank FROM r) SELECT pair, exclusion_reason, CAST(rank AS INTEGER) AS rank, coalesce(rank <= 50, false) AS chosen FROM k""",
)
book.add(
    "pair_filters",
    lambda s, d: universe.pair_filters(source.bars_day(s, d), "1998-01-01 00:00:00", 5, 30, 5, (0.2, 5.0), (0.1, 2.0), "^PROMO").drop("first_bar"),
    f"""WITH {frames.TICKS}, x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY ts)) AS r, row_number() OVER (PARTITION BY pair ORDER BY ts DESC) AS back
      FROM bars WHERE ts < '1998-01-01'),
    y AS (SELECT pair, min(ts) AS first_bar, sum(close * volume) FILTER (back <= 5) AS quote_volume,
      (max(high) FILTER (back <= 5) - min(low) FILTER (back <= 5)) / min(low) FILTER (back <= 5) AS range_change,
        stddev_samp(r) FILTER (back <= 5) * sqrt(5) AS volatility FROM x GROUP BY pair),
    z AS (SELECT *, row_number() OVER (ORDER BY quote_volume DESC, pair) AS rank FROM y) SELECT pair, quote_volume, range_change, volatility, rank, rank <= 5
      AND first_bar <= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND range_change BETWEEN 0.2 AND 5.0 AND volatility BETWEEN 0.1 AND 2.0 AND NOT starts_with(pair,
        'PROMO') AS passes FROM z""",
    "quote_volume range_change volatility",
)

# --- regimes
book.add(
    "breadth",
    lambda s, d: regime.breadth(signals.breadth_flags(rows.own(frames.features(s, d)), P), ["is_flush", "is_oversold", "is_active"]).withColumn("ts", stamp(F.col("ts"))),
    f"""{WITH}, b AS (SELECT *, coalesce(volume > 0 AND active_pair AND weak_trend_regime AND NOT breakout_block_long AND close < bb_lower AND rsi < {P.rsi_long}
      AND price_z < -{P.price_z}, false) AS fl, coalesce(rsi < {P.rsi_long}, false) OR coalesce(price_z < -{P.price_z}, false) OR coalesce(close < bb_lower, false) AS os
        FROM feat)
    SELECT {TS} AS ts, avg(CAST(fl AS INTEGER)) AS is_flush_share, avg(CAST(os AS INTEGER)) AS is_oversold_share, avg(CAST(active_pair AS INTEGER)) AS is_active_share,
      count(DISTINCT pair) AS universe FROM b GROUP BY ts""",
    "is_flush_share is_oversold_share is_active_share",
)
book.add(
    "regime_summary",
    lambda s, d: regime.regime_summary(regime.trend_label(rows.own(events.forward_returns(frames.features(s, d), (6,)))), ["trend", "weak_trend_regime", "active_pair"], ["forward_6"]),
    f"""{WITH}, f AS (SELECT *, (lead(close, 7) OVER v - lead(open, 1) OVER v) / nullif(lead(open, 1) OVER v, 0) AS forward_6, CASE WHEN close_info > ema50_info
      AND ema50_info > ema200_info THEN 'up' WHEN close_info < ema50_info AND ema50_info < ema200_info THEN 'down' ELSE 'flat' END AS trend FROM feat
        WINDOW v AS (PARTITION BY pair ORDER BY ts)),
    u AS (SELECT 'trend' AS feature, trend AS bucket, forward_6 FROM f UNION ALL SELECT 'weak_trend_regime', CAST(weak_trend_regime AS VARCHAR), forward_6 FROM f
      UNION ALL SELECT 'active_pair', CAST(active_pair AS VARCHAR), forward_6 FROM f) SELECT feature, bucket, count(*) AS rows, avg(forward_6) AS mean_forward_6 FROM u
        GROUP BY ALL""",
    "mean_forward_6",
)

MARKET = "PROMO"


def market(s, d):
    """Breadth of every day with the trend and volatility of one market, in terciles."""
    bars = source.bars_day(s, d)
    week = frames.weekly(bars.where(F.col("pair") == MARKET))
    vol = indicators.realized_vol(bars.where(F.col("pair") == MARKET).withColumn("chunk", F.lit(0)), 30, 10)
    df = regime.market_context(regime.breadth(bars, []), regime.market_trend(week), vol.where("realized_vol is not null").select("ts", "realized_vol"))
    return written(indicators.bucket_three(df.na.fill(0.0, ["realized_vol"]), "realized_vol", "vol_bucket"), "market-context")


MARKET_SQL = f"""mw AS (SELECT *, (ema50 - lag(ema50) OVER (ORDER BY ts)) / nullif(lag(ema50) OVER (ORDER BY ts), 0) AS slope FROM week_rec WHERE pair = '{MARKET}'),
mt AS (SELECT ts, CASE WHEN ema50 > ema200 AND slope > 0 THEN 'market_up' WHEN ema50 < ema200 AND slope < 0 THEN 'market_down' ELSE 'market_neutral' END AS market_trend
      FROM mw),
mr AS (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS x FROM bars WHERE pair = '{MARKET}'),
mv AS (SELECT * FROM (SELECT ts, CASE WHEN count(x) OVER w >= 10 THEN stddev_pop(x) OVER w * sqrt(30) END AS realized_vol FROM mr
      WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE realized_vol IS NOT NULL),
mu AS (SELECT ts, count(DISTINCT pair) AS universe FROM bars GROUP BY ts), m1 AS (SELECT mu.*, market_trend FROM mu ASOF LEFT JOIN mt ON mu.ts >= mt.ts),
      m2 AS (SELECT m1.*, coalesce(realized_vol, 0) AS realized_vol FROM m1 ASOF LEFT JOIN mv ON m1.ts >= mv.ts),
mc AS (SELECT ts, universe, market_trend, realized_vol, CASE least(floor((row_number() OVER (ORDER BY realized_vol, ts) - 1) * 3 / greatest(count(*) OVER () - 1, 1)), 2)
      WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS vol_bucket FROM m2)"""
WEEKLY = frames.WEEK[: frames.WEEK.index(", week_roll AS")]
book.add(
    "market_context",
    lambda s, d: market(s, d).withColumn("ts", stamp(F.col("ts"))),
    f"WITH {frames.TICKS}, {WEEKLY}, {MARKET_SQL} SELECT {TS} AS ts, universe, market_trend, realized_vol, vol_bucket FROM mc",
    "realized_vol",
)


def attributed(s, d, bucket):
    context = market(s, d).select("ts", bucket)
    entered = regime.with_context(flush_events(s, d), context)
    opened = source.trades(s, d, "p_type").select(F.date_trunc("day", "open_date").cast("timestamp_ntz").alias("ts"), "open_date", "close_date", "pair", "profit_abs")
    opened = written(opened, "attributed-trades")
    days = asof.asof_join(opened.select("ts").distinct(), context, "ts", (), (bucket,), period="month")
    opened = opened.join(F.broadcast(written(days, "attributed-days")), "ts")  # a row a day
    return regime.attribution(entered, opened.where(F.col(bucket).isNotNull()), bucket, ["forward_6", "forward_12"])


for bucket in ("market_trend", "vol_bucket"):
    book.add(
        f"attribution_by_{bucket}",
        lambda s, d, bucket=bucket: attributed(s, d, bucket),
        f"""{TYPED}, {EVENT_CTES}, {WEEKLY}, {MARKET_SQL}, sg AS (SELECT {bucket} AS bucket, count(*) AS signals, avg(forward_6) AS mean_forward_6,
      avg(forward_12) AS mean_forward_12 FROM clu LEFT JOIN mc ON clu.ts = mc.ts GROUP BY ALL),
        td AS (SELECT {bucket} AS bucket, t.pair, t.open_date, t.close_date, profit_abs, CAST(round(profit_abs, 2) AS DECIMAL(18, 2)) AS p FROM trades t ASOF
          JOIN mc ON date_trunc('day', t.open_date) >= mc.ts),
        tc AS (SELECT *, sum(p) OVER (PARTITION BY bucket ORDER BY open_date, close_date, pair, p ROWS UNBOUNDED PRECEDING) AS c FROM td), tf AS (SELECT *, c - max(c)
          OVER (PARTITION BY bucket ORDER BY open_date, close_date, pair, p ROWS UNBOUNDED PRECEDING) AS fall FROM tc),
        tr AS (SELECT bucket, count(*) AS trades, avg(CAST(profit_abs > 0 AS DOUBLE)) AS win_rate, sum(profit_abs) AS profit, CAST(abs(min(fall)) AS DOUBLE) AS drawdown
          FROM tf GROUP BY bucket)
        SELECT bucket, signals, mean_forward_6, mean_forward_12, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate, coalesce(profit, 0) AS profit,
          coalesce(drawdown, 0) AS drawdown FROM sg LEFT JOIN tr USING (bucket)""",
        "mean_forward_6 mean_forward_12 win_rate profit:1 drawdown:0",
    )

# --- trades out of signals
HOLD, EXIT_COLUMNS = 10, ["pair", "bar_idx", "exit_idx", "entry_price", "exit_price", "profit_ratio"]


def fixed_exits(bars, mode):
    entered = bars.withColumn("enter_long", flag(F.col("price_z") < -1.3).cast("int"))
    return signals.fixed_exit_trades(entered, mode, HOLD).select(*EXIT_COLUMNS)


def fixed_exits_sql(bars: str, name: str, leaves: str) -> str:
    """``bars``: CTEs that end with ``name``; ``leaves``: the exit test."""
    return f"""WITH RECURSIVE {bars}, x AS (SELECT *, lead(open, 1) OVER v AS entry_price, min(CASE WHEN {leaves} THEN bar_idx END)
      OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {HOLD} FOLLOWING) AS f FROM {name} WINDOW v AS (PARTITION BY pair ORDER BY ts)),
    g AS (SELECT x.pair, x.bar_idx, x.entry_price, coalesce(x.f + 1, x.bar_idx + {HOLD + 1}) AS exit_idx FROM x WHERE price_z < -1.3), e AS (SELECT g.*, y.open AS exit_price
      FROM g JOIN {name} y ON y.pair = g.pair AND y.bar_idx = g.exit_idx),
    nxt AS (SELECT a.pair, a.bar_idx, a.exit_idx, a.entry_price, a.exit_price, (SELECT min(b.bar_idx) FROM e b WHERE b.pair = a.pair
      AND b.bar_idx + 1 >= a.exit_idx) AS follows FROM e a),
    walk AS (SELECT * FROM nxt WHERE (pair, bar_idx) IN (SELECT (pair, min(bar_idx)) FROM e GROUP BY pair) UNION ALL SELECT n.* FROM walk w JOIN nxt n ON n.pair = w.pair
      AND n.bar_idx = w.follows)
    SELECT pair, bar_idx, exit_idx, entry_price, exit_price, (exit_price - entry_price) / nullif(entry_price, 0) AS profit_ratio FROM walk"""


RATES = "entry_price exit_price profit_ratio"
book.add("fixed_exit_trades", lambda s, d: fixed_exits(frames.rolling(s, d), "z0"), fixed_exits_sql(f"{frames.TICKS}, {frames.rolling_sql()}", "ind", "price_z >= 0"), RATES)
#: Exit tests on bars with every indicator; rounded, as the test of a level must not hang on the last digits.
LEAVES = {"z0": "round(price_z, 9) >= 0", "rsi50": "round(rsi, 9) >= 50", "mid": "round(close, 9) >= round(bb_mid, 9)", "time": "false"}
for mode, leaves in LEAVES.items():
    book.add(
        f"fixed_exit_trades_{mode}",
        lambda s, d, mode=mode: fixed_exits(frames.features(s, d).withColumns({c: F.round(c, 9) for c in ("price_z", "rsi", "close", "bb_mid")}), mode),
        fixed_exits_sql(frames.features_sql(), "feat", leaves),
        RATES,
    )

# --- text and checks
book.add(
    "hidden_unicode",
    lambda s, d: quality.hidden_unicode(s.read.parquet(f"{d}/documents.parquet").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.lit("​‮\r")).otherwise(""))), "doc_id", "text"),
    "WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(8203) || chr(8238) || chr(13) ELSE '' END AS text FROM documents), p AS (SELECT unnest([" + ", ".join(map(str, quality.HIDDEN)) + "]) AS code_point), c AS (SELECT doc_id, code_point, length(text) - length(replace(text, chr(code_point), '')) AS n FROM t, p UNION ALL SELECT doc_id, 13, length(replace(text, chr(13) || chr(10), '')) - length(replace(replace(text, chr(13) || chr(10), ''), chr(13), '')) FROM t) SELECT doc_id, CAST(code_point AS INTEGER) AS code_point, CAST(n AS INTEGER) AS n FROM c WHERE n > 0",
)
MARKED = "coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(8203) || chr(8238) || chr(13) ELSE '' END"
book.add(
    "hidden_positions",
    lambda s, d: quality.hidden_positions(s.read.parquet(f"{d}/documents.parquet").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, F.lit("\u200b\u202e\r")).otherwise(""))), "doc_id", "text"),
    f"""WITH t AS (SELECT doc_id, {MARKED} AS text FROM documents), c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(list_append(string_split(text, '')[2:], '')) AS after,
      generate_subscripts(string_split(text, ''), 1) - 1 AS position FROM t WHERE text <> '')
    SELECT doc_id, position, unicode(c) AS code_point FROM c WHERE unicode(c) IN ({", ".join(map(str, quality.HIDDEN))}) OR (c = chr(13) AND after <> chr(10))""",
)
RULES = [("shout", "!!", "nothing"), ("table", r"\|", r"^\|"), ("tail", "the$", "of the$")]
book.add(
    "line_matches",
    lambda s, d: quality.line_matches(s.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", RULES),
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, CAST(line_no AS INTEGER) AS line_no, regexp_matches(line, '{ok}') AS allowed FROM l WHERE regexp_matches(line, '{p}')" for n, p, ok in RULES),
)


CUTS = ("1996-01-01", "2000-01-01", 6)
MARGIN = f"{recursive.WARM_UP} DAYS"
FLAGS = ["enter_long", "enter_short", "exit_long", "exit_short"]


def flagged(ahead):
    """Bars to entry and exit flags; with ``ahead`` an entry also asks for a higher close five bars later, as no signal may."""

    def compute(bars):
        df = indicators.session_vwap(rows.own(frames.features_of(written(bars, "causal-bars"))))
        df = signals.exit_signals(nine_places(df), P)
        df = signals.entry_signals(df, P)
        if ahead:
            later = F.lead("close", 5).over(indicators.line(("pair",)))
            df = df.withColumn("enter_long", F.when(later > F.col("close"), F.col("enter_long")).otherwise(0))
        return df.select("pair", "ts", *FLAGS)

    return compute


def causal(s, d):
    bars, cuts = source.bars_day(s, d), universe.anchors(s, *CUTS).withColumnRenamed("anchor", "cut")
    out = [quality.causality_check(bars, cuts, flagged(ahead), FLAGS[:2], FLAGS[2:], margin=MARGIN).withColumn("variant", F.lit(name)) for name, ahead in (("as_written", False), ("five_bars_ahead", True))]
    return out[0].unionByName(out[1]).withColumn("cut", stamp(F.col("cut")))


def flags_sql(cut: bool) -> str:
    """pair, ts, the entry and exit flags, and the entry that looks ahead."""
    close = {c: f"round({c}, 9)" for c in ("close", "bb_mid", "ema20", "price_z", "rsi")}
    vwap = "round((high + low + close) / 3 * volume / nullif(volume, 0), 9)"
    hit = lambda op, z, r: " OR ".join([*(f"coalesce({close['close']} {op}= {x}, false)" for x in (close["bb_mid"], close["ema20"], vwap)), f"coalesce({close['price_z']} {op} {z}, false)", f"coalesce({close['rsi']} {op} {r}, false)"])
    rounded = f"SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in close.items())}), lead({close['close']}, 5) OVER (PARTITION BY pair ORDER BY ts) AS later FROM feat"
    long_side, short_side = frames.entry_sql()
    return f"""(WITH {frames.features_sql(cut=cut)}, near AS ({rounded}), exits AS (SELECT pair, ts,
      {hit(">", P.exit_z_long, P.exit_rsi_long)} OR trend_expand_against_long OR NOT active_pair AS xl,
        {hit("<", P.exit_z_short, P.exit_rsi_short)} OR trend_expand_against_short OR NOT active_pair AS xs FROM feat)
  SELECT near.pair, near.ts, {long_side} AS el, {short_side} AS es, xl, xs, {long_side} AND coalesce(later > close, false) AS ea FROM near
    JOIN exits ON near.pair = exits.pair AND near.ts = exits.ts)"""


book.add(
    "causality_check",
    causal,
    f"""WITH cuts AS (SELECT unnest(generate_series(TIMESTAMP '{CUTS[0]}', TIMESTAMP '{CUTS[1]}', INTERVAL {CUTS[2]} MONTH)) AS cut),
    whole AS {flags_sql(False)}, part AS {flags_sql(True)},
    parted AS (SELECT split_part(pair, '@', 1) AS pair, strptime(split_part(pair, '@', 2), '%Y%m%d') AS cut, ts, el AS el2, es AS es2, xl AS xl2, xs AS xs2, ea AS ea2
      FROM part),
    both_ AS (SELECT * FROM parted JOIN whole USING (pair, ts) WHERE ts > cut - INTERVAL 60 DAY),
    n AS (SELECT cut, variant, count(*) AS compared, count(*) FILTER ((CASE variant WHEN 'as_written' THEN el ELSE ea END) OR es) AS signals,
      count(*) FILTER ((CASE variant WHEN 'as_written' THEN el <> el2 ELSE ea <> ea2 END) OR es <> es2) AS biased_entries,
        count(*) FILTER (xl <> xl2 OR xs <> xs2) AS biased_exits FROM both_, (VALUES ('as_written'), ('five_bars_ahead')) v(variant) GROUP BY cut, variant)
    SELECT strftime(cut, '%Y-%m-%d %H:%M:%S') AS cut, variant, compared, signals, biased_entries, biased_exits, CASE
      WHEN signals <= 0 THEN 'LOOKAHEAD_NO_SIGNALS_VERIFIED' WHEN biased_entries > 0 OR biased_exits > 0 THEN 'LOOKAHEAD_BIAS_DETECTED' ELSE 'LOOKAHEAD_CLEAN' END AS decision FROM n""",
)
book.add(
    "verify_matrix",
    lambda s, d: quality.verify_matrix(trades(s, d).select("strategy", "month"), trades(s, d).select("strategy").distinct().join(trades(s, d).select("month").distinct()), ["strategy", "month"]),
    f"{T}, e AS (SELECT DISTINCT strategy, m.month FROM trades, (SELECT DISTINCT month FROM trades) m), k AS (SELECT DISTINCT strategy, month FROM trades) SELECT (SELECT count(*) FROM trades) AS rows, (SELECT count(*) FROM k) AS distinct_keys, (SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS missing, CAST(0 AS BIGINT) AS unexpected, (SELECT count(*) FROM trades) - (SELECT count(*) FROM k) AS duplicates",
)
