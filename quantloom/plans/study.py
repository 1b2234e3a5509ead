"""Queries on bars, indicators, signals and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import calendar, stamp
from quantloom.operators import asof, events, indicators, recursive, rows, signals
from quantloom.plans import frames
from quantloom.plans.book import Book
from quantloom.sources import bars as source

book = Book()
P = signals.DAILY
PRICES = "open high low close volume:3"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def out(df, *columns):
    return df.select("pair", stamp(F.col("ts")).alias("ts"), *columns)


# --- bars
book.add("bars_day", lambda s, d: out(source.bars_day(s, d), *"open high low close volume".split()), f"WITH {frames.TICKS} SELECT pair, {TS} AS ts, open, high, low, close, volume FROM bars", PRICES)
book.add(
    "bars_week",
    lambda s, d: out(source.bars_week(source.bars_day(s, d)), *"open high low close volume".split()),
    f"WITH {frames.TICKS}, {frames.WEEK} SELECT pair, {TS} AS ts, open, high, low, close, volume FROM week_bars",
    PRICES,
)
HOURS = """hours AS (SELECT event_type AS pair, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY e.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events e GROUP BY event_type, date_trunc('hour', e.ts))"""
HOURS = HOURS.replace("date_trunc('hour', ts)", "date_trunc('hour', e.ts)")
book.add("bars_hour", lambda s, d: out(source.bars_hour(s, d), *"open high low close volume".split()), f"WITH {HOURS} SELECT pair, {TS} AS ts, open, high, low, close, volume FROM hours", PRICES)

# --- rolling indicators
book.add(
    "rolling_indicators",
    lambda s, d: out(rows.own(frames.rolling(s, d)), "bar_idx", "price_z", "vol_z", "bb_mid", "bb_upper", "bb_lower", "bb_width"),
    f"WITH {frames.TICKS}, {frames.rolling_sql()} SELECT pair, {TS} AS ts, bar_idx, price_z, vol_z, bb_mid, bb_upper, bb_lower, bb_width FROM ind",
    "price_z vol_z bb_mid bb_upper bb_lower bb_width",
)
book.add(
    "session_vwap",
    lambda s, d: out(indicators.session_vwap(source.bars_hour(s, d)), "vwap"),
    f"WITH {HOURS} SELECT pair, {TS} AS ts, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM hours WINDOW w AS (PARTITION BY pair, date_trunc('day', ts) ORDER BY ts)",
    "vwap",
)
book.add(
    "realized_vol",
    lambda s, d: out(rows.own(indicators.realized_vol(rows.chunked(rows.bar_index(source.bars_hour(s, d)), before=289), 288, 72)), "realized_vol"),
    f"WITH {HOURS}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY ts)) AS x FROM hours) SELECT pair, {TS} AS ts, CASE WHEN count(x) OVER w >= 72 THEN stddev_pop(x) OVER w * sqrt(288) END AS realized_vol FROM r WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 287 PRECEDING AND CURRENT ROW)",
    "realized_vol",
)
book.add(
    "recursive_indicators",
    lambda s, d: out(rows.own(recursive.smoothed(rows.chunked(rows.bar_index(source.bars_day(s, d)), before=recursive.WARM_UP), (20, 50, 200), True)), "rsi", "atr", "natr", "ema20", "ema50", "ema200", "adx"),
    f"WITH {frames.TICKS}, {frames.recursive_sql('rec', 'bars', (20, 50, 200), True)} SELECT pair, {TS} AS ts, rsi, atr, natr, ema20, ema50, ema200, adx FROM rec",
    "rsi atr natr ema20 ema50 ema200 adx",
)
book.add(
    "quantile_buckets",
    lambda s, d: out(calendar(indicators.quantile_bucket(indicators.slope(source.bars_day(s, d), "close", "change", ("pair",)), "change", "vol_bucket")), "vol_bucket", "year", "month", "quarter"),
    f"""WITH {frames.TICKS}, x AS (SELECT *, (close - lag(close) OVER v) / nullif(lag(close) OVER v, 0) AS change FROM bars WINDOW v AS (PARTITION BY pair ORDER BY ts)),
    y AS (SELECT *, row_number() OVER (PARTITION BY pair, change IS NOT NULL ORDER BY change, ts) AS r, count(*) OVER (PARTITION BY pair, change IS NOT NULL) AS n FROM x)
    SELECT pair, {TS} AS ts, CAST(CASE WHEN change IS NULL THEN -1 WHEN n = 1 THEN 0 ELSE greatest(ceil((r - 1) * least(n, 5) / (n - 1)),
      1) - 1 END AS INTEGER) AS vol_bucket,
    strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') || 'Q' || quarter(ts) AS quarter FROM y""",
)
book.add(
    "bucket_three",
    lambda s, d: out(indicators.bucket_three(source.bars_hour(s, d), "close", "level", ("pair",)), "level"),
    f"""WITH {HOURS}, y AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY close, ts) AS r, count(*) OVER (PARTITION BY pair) AS n FROM hours)
    SELECT pair, {TS} AS ts, CASE least(floor((r - 1) * 3 / greatest(n - 1, 1)), 2) WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS level FROM y""",
)

# --- larger timeframe and gates
GATES = ["active_pair", "weak_trend_regime", "breakout_block_long", "breakout_block_short", "bullish_reversal", "bearish_reversal", "trend_expand_against_long", "trend_expand_against_short"]
WITH = f"WITH {frames.features_sql()}"
book.add(
    "informative_join",
    lambda s, d: out(asof.attach_informative(source.bars_day(s, d), frames.weekly(source.bars_day(s, d)), frames.INFO, "1 DAY", "7 DAYS"), *frames.INFO_RENAMED),
    f"{WITH} SELECT pair, {TS} AS ts, {', '.join(frames.INFO_RENAMED)} FROM joined",
    " ".join(frames.INFO_RENAMED),
)
book.add("gate_columns", lambda s, d: out(rows.own(frames.features(s, d)), *GATES), f"{WITH} SELECT pair, {TS} AS ts, {', '.join(GATES)} FROM feat")
LONG, SHORT = frames.entry_sql()
ENTRIES = f"{WITH}, sig AS (SELECT *, {LONG} AS is_long, {SHORT} AS is_short FROM feat)"
book.add(
    "entry_signals",
    lambda s, d: out(signals.entry_signals(rows.own(frames.features(s, d)), P), "enter_long", "enter_short", "enter_tag").where("enter_tag <> ''"),
    f"{ENTRIES} SELECT pair, {TS} AS ts, CAST(is_long AS INTEGER) AS enter_long, CAST(is_short AS INTEGER) AS enter_short, CASE WHEN is_short THEN 'mr_short_extreme' ELSE 'mr_long_extreme' END AS enter_tag FROM sig WHERE is_long OR is_short",
)
book.add(
    "entry_signals_long_only",
    lambda s, d: out(signals.entry_signals(rows.own(frames.features(s, d)), P, long_only=True), "enter_long", "enter_short", "enter_tag").where("enter_long = 1"),
    f"{ENTRIES} SELECT pair, {TS} AS ts, 1 AS enter_long, 0 AS enter_short, 'mr_long_extreme' AS enter_tag FROM sig WHERE is_long",
)
FLUSH_LONG, FLUSH_SHORT = frames.entry_sql(reversal=False)
book.add(
    "flush_rebound",
    lambda s, d: out(signals.flush_rebound(rows.own(frames.features(s, d)), P), "enter_long", "enter_tag").where("enter_long = 1"),
    f"{WITH} SELECT pair, {TS} AS ts, 1 AS enter_long, 'flush_rebound_long' AS enter_tag FROM feat WHERE {FLUSH_LONG}",
)
book.add(
    "delayed_confirm",
    lambda s, d: out(rows.own(signals.delayed_confirm(frames.features(s, d), P.but(adx_max=60.0, slope_cap=1.0, rsi_long=50.0))).where("enter_long = 1"), "enter_tag"),
    f"""{WITH}, lagged AS (SELECT *, lag(coalesce(volume > 0 AND active_pair AND weak_trend_regime AND NOT breakout_block_long AND close < bb_lower AND rsi < 50.0
      AND price_z < -{P.price_z}, false)) OVER v AS flushed, lag(rsi) OVER v AS r1, lag(price_z) OVER v AS z1 FROM feat WINDOW v AS (PARTITION BY pair ORDER BY ts))
    SELECT pair, {TS} AS ts, 'delayed_confirm_long' AS enter_tag FROM lagged WHERE flushed AND volume > 0 AND close > open AND close > c1 AND close > bb_lower
      AND close < bb_mid AND rsi > r1 AND price_z > z1""",
)
EXIT_INPUTS = ("close", "bb_mid", "ema20", "vwap", "price_z", "rsi")


def nine_places(df):
    """Bars of one tick have close equal to vwap; the last bit must not decide."""
    return df.withColumns({c: F.round(c, 9) for c in EXIT_INPUTS})


VWAP = f"(SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in EXIT_INPUTS)}) FROM (SELECT *, (high + low + close) / 3 * volume / nullif(volume, 0) AS vwap FROM feat))"  # one bar a day: the session is the bar
book.add(
    "exit_signals",
    lambda s, d: out(signals.exit_signals(nine_places(indicators.session_vwap(rows.own(frames.features(s, d)))), P), "exit_long", "exit_short", "exit_tag"),
    f"""{WITH}, x AS (SELECT *, coalesce(close >= bb_mid, false) OR coalesce(close >= ema20, false) OR coalesce(close >= vwap, false) OR coalesce(price_z > {P.exit_z_long},
      false) OR coalesce(rsi > {P.exit_rsi_long}, false) AS lh,
      coalesce(close <= bb_mid, false) OR coalesce(close <= ema20, false) OR coalesce(close <= vwap, false) OR coalesce(price_z < {P.exit_z_short},
        false) OR coalesce(rsi < {P.exit_rsi_short}, false) AS sh FROM {VWAP}),
    y AS (SELECT *, CASE WHEN lh THEN 'mean_hit' WHEN trend_expand_against_long THEN 'trend_expand' WHEN NOT active_pair THEN 'vol_decay' ELSE '' END AS lr,
      CASE WHEN sh THEN 'mean_hit' WHEN trend_expand_against_short THEN 'trend_expand' WHEN NOT active_pair THEN 'vol_decay' ELSE '' END AS sr FROM x)
    SELECT pair, {TS} AS ts, CAST(lr <> '' AS INTEGER) AS exit_long, CAST(sr <> '' AS INTEGER) AS exit_short, CASE WHEN sr <> '' THEN sr ELSE lr END AS exit_tag FROM y""",
)
LOOSE = signals.Flush(1.0, 50.0, -1.0, 0.01)
TIGHT = signals.Flush(1.5, 45.0, -0.5, 0.02, weak_trend=True, breakout_block=True, below_band=False)


def flush_sql(f, strict=True):
    g = ">" if strict else ">="
    text = f"rsi < {f.rsi} AND price_z < -{f.price_z} AND vol_z {g} {f.vol_z_min} AND bb_width {g} {f.bb_width_min}"
    return f"coalesce({text}{' AND close < bb_lower' if f.below_band else ''}{' AND weak_trend_regime' if f.weak_trend else ''}{' AND NOT breakout_block_long' if f.breakout_block else ''}, false)"


book.add("flush_mask", lambda s, d: out(rows.own(frames.features(s, d)).where(signals.flush_mask(TIGHT)), "price_z", "rsi"), f"{WITH} SELECT pair, {TS} AS ts, price_z, rsi FROM feat WHERE {flush_sql(TIGHT)}", "price_z rsi")
t = TIGHT
BASELINES = {
    f"price_z_lt_m{signals.token(t.price_z)}": f"price_z < -{t.price_z}",
    f"rsi_lt_{signals.token(t.rsi)}": f"rsi < {t.rsi}",
    f"price_z_lt_m{signals.token(t.price_z)}_and_rsi_lt_{signals.token(t.rsi)}": f"price_z < -{t.price_z} AND rsi < {t.rsi}",
    "close_below_bb_lower": "close < bb_lower",
    f"close_below_bb_lower_and_rsi_lt_{signals.token(t.rsi)}": f"close < bb_lower AND rsi < {t.rsi}",
    f"vol_z_gt_{signals.token(t.vol_z_min)}_and_price_z_lt_m{signals.token(t.price_z)}": f"vol_z > {t.vol_z_min} AND price_z < -{t.price_z}",
    f"bb_width_gt_{signals.token(t.bb_width_min)}_and_price_z_lt_m{signals.token(t.price_z)}": f"bb_width > {t.bb_width_min} AND price_z < -{t.price_z}",
}
book.add(
    "baseline_masks",
    lambda s, d: signals.masks_to_rows(rows.own(frames.features(s, d)), signals.baseline_specs(TIGHT), "baseline").groupBy("baseline", "pair").agg(F.count("*").alias("signals")),
    f"{WITH}, b AS ({' UNION ALL '.join(f'''SELECT '{n}' AS baseline, pair FROM feat WHERE {c}''' for n, c in BASELINES.items())}) SELECT baseline, pair, count(*) AS signals FROM b GROUP BY ALL",
)
COMPONENTS = {"original": flush_sql(TIGHT), "no_weak_trend": flush_sql(signals.replace(TIGHT, weak_trend=False)), "no_breakout_block": flush_sql(signals.replace(TIGHT, breakout_block=False)), "z_rsi_only": f"price_z < -{t.price_z} AND rsi < {t.rsi}"}
book.add(
    "component_masks",
    lambda s, d: signals.masks_to_rows(rows.own(frames.features(s, d)), signals.component_masks(TIGHT)).groupBy("component").agg(F.count("*").alias("signals"), F.count_distinct("pair").alias("pairs")),
    f"{WITH}, b AS ({' UNION ALL '.join(f'''SELECT '{n}' AS component, pair FROM feat WHERE {c}''' for n, c in COMPONENTS.items())}) SELECT component, count(*) AS signals, count(DISTINCT pair) AS pairs FROM b GROUP BY ALL",
)
book.add(
    "rebound_events",
    lambda s, d: out(rows.own(signals.rebound_events(frames.features(s, d).withColumn("flush", signals.flush_mask(LOOSE)))), "confirm_delay", "confirm_price", "next_open", "missed_move"),
    f"""{WITH}, u AS (SELECT *, coalesce(close > open AND close > bb_lower, false) AS bounce FROM feat),
    l AS (SELECT *, lead(open, 1) OVER v AS next_open, CASE WHEN lead(bounce, 1) OVER v THEN 1 WHEN lead(bounce, 2) OVER v THEN 2 WHEN lead(bounce, 3)
      OVER v THEN 3 END AS confirm_delay,
      lead(open, 2) OVER v AS o2, lead(open, 3) OVER v AS o3, lead(open, 4) OVER v AS o4 FROM u WINDOW v AS (PARTITION BY pair ORDER BY ts)),
    m AS (SELECT *, CASE confirm_delay WHEN 1 THEN o2 WHEN 2 THEN o3 WHEN 3 THEN o4 END AS confirm_price FROM l WHERE {flush_sql(LOOSE)})
    SELECT pair, {TS} AS ts, confirm_delay, confirm_price, next_open, (confirm_price - next_open) / nullif(next_open, 0) AS missed_move FROM m""",
    "confirm_price next_open missed_move",
)
book.add(
    "near_misses",
    lambda s, d: out(signals.near_misses(rows.own(frames.features(s, d)), P), "side"),
    f"{WITH}, x AS (SELECT *, CASE WHEN {FLUSH_LONG} AND NOT bullish_reversal THEN 'long' WHEN {FLUSH_SHORT} AND NOT bearish_reversal THEN 'short' END AS side FROM feat) SELECT pair, {TS} AS ts, side FROM x WHERE side IS NOT NULL",
)
book.add(
    "first_failed_gate",
    lambda s, d: signals.first_failed_gate(rows.own(frames.features(s, d)), P).groupBy("pair", "first_failed_gate").agg(F.count("*").alias("rows")),
    f"{WITH} SELECT pair, CASE WHEN NOT coalesce(rsi < {P.rsi_long}, false) THEN 'rsi' WHEN NOT coalesce(price_z < -{P.price_z}, false) THEN 'price_z' WHEN NOT bullish_reversal THEN 'bullish_reversal' ELSE 'signal' END AS first_failed_gate, count(*) AS rows FROM feat WHERE volume > 0 AND active_pair AND weak_trend_regime AND NOT breakout_block_long AND close < bb_lower GROUP BY ALL",
)
book.add(
    "event_features",
    lambda s, d: out(rows.own(signals.event_features(frames.features(s, d))).where(signals.flush_mask(LOOSE)), "flush_score", "band_extension", "candle_rebound", "previous_rebound", "rebound_score", "mid_distance"),
    f"""{WITH}, x AS (SELECT *, (close - open) / nullif(open, 0) AS candle_rebound, (close - c1) / nullif(c1, 0) AS previous_rebound FROM feat WHERE {flush_sql(LOOSE)})
    SELECT pair, {TS} AS ts, greatest(-price_z, 0) AS flush_score, greatest((bb_lower - close) / nullif(close, 0), 0) AS band_extension, candle_rebound,
      previous_rebound, greatest(candle_rebound, previous_rebound, 0) AS rebound_score, (bb_mid - close) / nullif(close, 0) AS mid_distance FROM x""",
    "flush_score band_extension candle_rebound previous_rebound rebound_score mid_distance",
)
book.add(
    "candidate_events_any",
    lambda s, d: out(signals.candidate_events(rows.own(frames.features(s, d)), LOOSE, "any"), "close_below_bb_lower"),
    f"{WITH} SELECT pair, {TS} AS ts, coalesce(close < bb_lower, false) AS close_below_bb_lower FROM feat WHERE price_z < -{LOOSE.price_z} OR rsi < {LOOSE.rsi} OR close < bb_lower",
)
PROFILES = [P.but(name=f"p{i}", rsi_long=40.0 + 2 * i, price_z=1.6 - 0.1 * i, vol_z_min=0.5 - 0.25 * i, adx_max=20.0 + 2 * i, slope_cap=0.01 + 0.005 * i) for i in range(9)]


def profile_sql(p):
    return f"volume > 0 AND vol_z > {p.vol_z_min} AND natr > {p.natr_min} AND bb_width > {p.bb_width_min} AND adx_info < {p.adx_max} AND abs(ema50_slope_info) < {p.slope_cap} AND close < bb_lower AND rsi < {p.rsi_long} AND price_z < -{p.price_z} AND bullish_reversal"


SWEEP = " UNION ALL ".join(f"SELECT '{p.name}' AS profile, pair, ts FROM feat WHERE {profile_sql(p)}" for p in PROFILES)
book.add(
    "sweep_summary",
    lambda s, d: signals.profile_sweep(calendar(rows.own(frames.features(s, d))), PROFILES).groupBy("profile", "pair", "month").agg(F.count("*").alias("signals")),
    f"{WITH}, b AS ({SWEEP}) SELECT profile, pair, strftime(ts, '%Y-%m') AS month, count(*) AS signals FROM b GROUP BY ALL",
)


def recommend_profile(s, d, target=6):
    """The least relaxed profile that reaches the target, else the densest."""
    counts = signals.profile_sweep(rows.own(frames.features(s, d)), PROFILES).groupBy("profile").agg(F.count("*").alias("signals"))
    reached = (F.col("signals") >= target).cast("int")
    order = [F.desc(reached), F.when(reached == 1, F.col("profile")), F.desc("signals"), F.col("profile")]
    return counts.orderBy(*order).limit(1)


book.add("recommend_profile", recommend_profile, f"{WITH}, b AS ({SWEEP}), c AS (SELECT profile, count(*) AS signals FROM b GROUP BY profile) SELECT profile, signals FROM c ORDER BY signals >= 6 DESC, CASE WHEN signals >= 6 THEN profile END, signals DESC, profile LIMIT 1")
FUNNEL = [("volume_rows", "volume > 0"), ("active_rows", "active_pair"), ("weak_trend_rows", "weak_trend_regime"), ("unblocked_rows", "NOT breakout_block_long"), ("below_band_rows", "close < bb_lower"), ("rsi_rows", f"rsi < {P.rsi_long}"), ("z_rows", f"price_z < -{P.price_z}"), ("enter_long_rows", "bullish_reversal")]
book.add(
    "signal_funnel",
    lambda s, d: events.signal_funnel(rows.own(frames.features(s, d)), [(n, F.expr(c)) for n, c in FUNNEL]),
    f"{WITH} SELECT coalesce(pair, 'ALL') AS pair, count(*) AS rows, {', '.join(f'''count(*) FILTER ({' AND '.join(f'({c})' for _, c in FUNNEL[: k + 1])}) AS {n}''' for k, (n, _) in enumerate(FUNNEL))} FROM feat GROUP BY ROLLUP (pair)",
)

# --- events
RETURNS = [f"forward_{k}" for k in (1, 3, 6, 12)]
FORWARD = ", ".join(f"(lead(close, {k + 1}) OVER v - lead(open, 1) OVER v) / nullif(lead(open, 1) OVER v, 0) AS forward_{k}" for k in (1, 3, 6, 12))
EVENT_CTES = f"""{frames.TICKS}, {frames.rolling_sql()}, fwd AS (SELECT *, lead(open, 1) OVER v AS entry_price, {FORWARD} FROM ind WINDOW v AS (PARTITION BY pair ORDER BY ts)),
ev AS (SELECT * FROM fwd WHERE price_z < -1.5 AND bb_width > 0.02), brk AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY pair ORDER BY ts) + INTERVAL 5 DAY,
      true) AS is_cluster_first FROM ev),
clu AS (SELECT *, sum(CAST(is_cluster_first AS INTEGER)) OVER (PARTITION BY pair ORDER BY ts) AS cluster_no FROM brk)"""


def flush_events(s, d, sizes=False):
    """Flush events on daily bars, with forward returns and five-day clusters."""
    df = events.forward_returns(frames.rolling(s, d), (1, 3, 6, 12))
    df = rows.own(df).where("price_z < -1.5 and bb_width > 0.02")
    return events.cluster_events(df, ("pair",), "5 DAYS", sizes=sizes)


book.add("forward_returns", lambda s, d: out(rows.own(events.forward_returns(frames.rolling(s, d), (1, 3, 6, 12))), "entry_price", *RETURNS), f"WITH {EVENT_CTES} SELECT pair, {TS} AS ts, entry_price, {', '.join(RETURNS)} FROM fwd", "entry_price " + " ".join(RETURNS))
book.add(
    "cluster_events",
    lambda s, d: out(flush_events(s, d, sizes=True), "cluster_no", stamp(F.col("cluster_start")).alias("cluster_start"), "cluster_size", "is_cluster_first"),
    f"WITH {EVENT_CTES} SELECT pair, {TS} AS ts, CAST(cluster_no AS BIGINT) AS cluster_no, strftime(min(ts) OVER c, '%Y-%m-%d %H:%M:%S') AS cluster_start, count(*) OVER c AS cluster_size, is_cluster_first FROM clu WINDOW c AS (PARTITION BY pair, cluster_no)",
)
SUMMARY = ", ".join(f"avg({c}) AS {c}_mean, quantile_cont({c}, 0.5) AS {c}_median, avg(CASE WHEN {c} IS NOT NULL THEN CAST({c} > 0 AS DOUBLE) END) AS {c}_win_rate" for c in RETURNS)
SUMMARY_COLUMNS = " ".join(f"{c}_{n}" for c in RETURNS for n in ("mean", "median", "win_rate"))
for label, key, sql_key in (("pair", "pair", "pair"), ("year", "year", "strftime(ts, '%Y')")):
    book.add(
        f"event_summary_by_{label}",
        lambda s, d, key=key: events.event_summary(calendar(flush_events(s, d)), [key], RETURNS),
        f"WITH {EVENT_CTES} SELECT {sql_key} AS {key}, count(*) AS signals, count(*) FILTER (is_cluster_first) AS clusters, count(DISTINCT pair) AS pairs, {SUMMARY} FROM clu GROUP BY {sql_key}",
        SUMMARY_COLUMNS,
    )
book.add(
    "excursions",
    lambda s, d: out(rows.own(events.excursions(events.forward_returns(frames.rolling(s, d), (1,)), 24)), "mfe", "mae"),
    f"WITH {EVENT_CTES} SELECT pair, {TS} AS ts, (max(high) OVER w - entry_price) / nullif(entry_price, 0) AS mfe, (min(low) OVER w - entry_price) / nullif(entry_price, 0) AS mae FROM fwd WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 25 FOLLOWING)",
    "mfe mae",
)
book.add(
    "mean_hit",
    lambda s, d: out(rows.own(events.mean_hit(frames.rolling(s, d), 6)), "mean_hit_6"),
    f"WITH {EVENT_CTES} SELECT pair, {TS} AS ts, CASE WHEN count(close) OVER w = 6 AND bb_mid IS NOT NULL THEN CASE WHEN bb_mid >= close THEN max(high) OVER w >= bb_mid ELSE min(low) OVER w <= bb_mid END END AS mean_hit_6 FROM fwd WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)",
)
SHORT_RETURNS = [f"ret_{k}" for k in (1, 3, 6, 12, 24)]
SIDES = f"""{ENTRIES}, nxt AS (SELECT *, {', '.join(f'lead(close, {k}) OVER v AS f{k}' for k in (1, 3, 6, 12, 24))}, max(high) OVER r AS hi, min(low) OVER r AS lo FROM sig
      WINDOW v AS (PARTITION BY pair ORDER BY ts), r AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING)),
sides AS (SELECT *, 'long' AS side, 1 AS sign FROM nxt WHERE is_long UNION ALL SELECT *, 'short', -1 FROM nxt WHERE is_short),
short_events AS (SELECT pair, ts, side, price_z, rsi, {', '.join(f'sign * (f{k} / close - 1) AS ret_{k}' for k in (1, 3, 6, 12, 24))}, CASE
      WHEN side = 'long' THEN hi / close - 1 ELSE close / lo - 1 END AS mfe, CASE WHEN side = 'long' THEN lo / close - 1 ELSE close / hi - 1 END AS mae FROM sides)"""


def short_events(s, d):
    return rows.own(events.signal_events(signals.entry_signals(frames.features(s, d), P)))


book.add("signal_events", lambda s, d: out(short_events(s, d), "side", *SHORT_RETURNS, "mfe", "mae"), f"{SIDES} SELECT pair, {TS} AS ts, side, {', '.join(SHORT_RETURNS)}, mfe, mae FROM short_events", " ".join(SHORT_RETURNS) + " mfe mae")
book.add(
    "study_summary",
    lambda s, d: events.study_summary(calendar(short_events(s, d)), [["side"], ["side", "pair"], ["month"]], SHORT_RETURNS),
    f"{SIDES}, m AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM short_events) SELECT coalesce(side, 'ALL') AS side, coalesce(pair, 'ALL') AS pair, coalesce(month, 'ALL') AS month, CAST(grouping_id(side, pair, month) AS INTEGER) AS level, count(*) AS signals, {', '.join(f'avg({c}) AS mean_{c}' for c in SHORT_RETURNS)} FROM m GROUP BY GROUPING SETS ((side), (side, pair), (month))",
    " ".join(f"mean_{c}" for c in SHORT_RETURNS),
)
book.add(
    "indicator_summary",
    lambda s, d: events.indicator_summary(short_events(s, d), ["side"], ["price_z", "rsi"]),
    f"{SIDES} SELECT side, count(*) AS rows, avg(price_z) AS avg_price_z, avg(rsi) AS avg_rsi FROM short_events GROUP BY side",
    "avg_price_z avg_rsi",
)
book.add("top_share", lambda s, d: events.top_share(calendar(flush_events(s, d)), ["pair"], "year"), f"WITH {EVENT_CTES}, n AS (SELECT pair, strftime(ts, '%Y') AS year, count(*) AS n FROM clu GROUP BY ALL) SELECT pair, max(n) / sum(n) AS top_year_share FROM n GROUP BY pair", "top_year_share")
book.add("positive_groups", lambda s, d: events.positive_groups(calendar(flush_events(s, d)), ["pair"], "year", "forward_6"), f"WITH {EVENT_CTES}, n AS (SELECT pair, strftime(ts, '%Y') AS year, quantile_cont(forward_6, 0.5) AS m FROM clu GROUP BY ALL) SELECT pair, count(*) FILTER (m > 0) AS positive_years FROM n GROUP BY pair")
