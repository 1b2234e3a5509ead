"""Queries on context, signal quality, warm-up, selection and fixed candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import median, stamp
from quantloom.functions.tables import written
from quantloom.operators import events, gates, quality, recursive, regime, rows, signals
from quantloom.plans import frames
from quantloom.plans.book import Book
from quantloom.plans.research import FAR, NEAR, WITH_NULLS, candidates
from quantloom.plans.study import EVENT_CTES, WITH, P, flush_events
from quantloom.sources import bars as source

book = Book()
book.add(
    "context_join",
    lambda s, d: regime.with_context(flush_events(s, d).select("pair", "ts"), regime.breadth(source.bars_day(s, d), [])).withColumn("ts", stamp(F.col("ts"))),
    f"WITH {EVENT_CTES}, u AS (SELECT ts, count(DISTINCT pair) AS universe FROM bars GROUP BY ts) SELECT pair, strftime(clu.ts, '%Y-%m-%d %H:%M:%S') AS ts, universe FROM clu LEFT JOIN u ON clu.ts = u.ts",
)
book.add(
    "signal_quality",
    lambda s, d: regime.signal_quality(signals.first_failed_gate(rows.own(events.forward_returns(frames.features(s, d), (6,))), P), "first_failed_gate", "forward_6"),
    f"""{WITH}, f AS (SELECT *, (lead(close, 7) OVER v - lead(open, 1) OVER v) / nullif(lead(open, 1) OVER v, 0) AS forward_6 FROM feat
      WINDOW v AS (PARTITION BY pair ORDER BY ts)),
    l AS (SELECT *, CASE WHEN NOT coalesce(rsi < {P.rsi_long}, false) THEN 'rsi' WHEN NOT coalesce(price_z < -{P.price_z}, false) THEN 'price_z'
      WHEN NOT bullish_reversal THEN 'bullish_reversal' ELSE 'signal' END AS first_failed_gate FROM f WHERE volume > 0 AND active_pair AND weak_trend_regime
        AND NOT breakout_block_long AND close < bb_lower)
    SELECT first_failed_gate, count(*) AS rows, count(forward_6) AS complete, avg(forward_6) AS mean_forward_6, avg(CASE
      WHEN forward_6 IS NOT NULL THEN CAST(forward_6 > 0 AS DOUBLE) END) AS good_share FROM l GROUP BY ALL""",
    "mean_forward_6 good_share",
)


AFTER = ["forward_3", "forward_6", "forward_12", "mfe", "mae", "mean_hit_6", "natr", "bb_width", "rsi", "price_z"]


def setups(s, d):
    """Bars where the structural long gates hold, with the gate that failed first and what prices did afterwards."""
    df = events.mean_hit(events.excursions(events.forward_returns(frames.features(s, d), (3, 6, 12)), 12), 6)
    return signals.first_failed_gate(rows.own(df), P).select("pair", "ts", "first_failed_gate", *AFTER)


def classes(s, d):
    made = source.trades(s, d, "p_type").where(~F.col("is_short")).withColumn("open_date", F.date_trunc("day", "open_date"))
    return regime.quality_classes(written(setups(s, d), "setups"), made, "1 DAY", "forward_6", "mean_hit_6", AFTER)


SETUPS = f"""{WITH}, o AS (SELECT *, lead(open, 1) OVER v AS entry, {", ".join(f"lead(close, {k + 1}) OVER v AS c{k}" for k in (3, 6, 12))},
      max(high) OVER far AS hi, min(low) OVER far AS lo, CASE WHEN count(close) OVER six = 6 AND bb_mid IS NOT NULL THEN CASE
        WHEN bb_mid >= close THEN max(high) OVER six >= bb_mid ELSE min(low) OVER six <= bb_mid END END AS mean_hit_6 FROM feat
      WINDOW v AS (PARTITION BY pair ORDER BY ts), far AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 13 FOLLOWING),
        six AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
    setups AS (SELECT pair, ts, {", ".join(f"(c{k} - entry) / nullif(entry, 0) AS forward_{k}" for k in (3, 6, 12))}, (hi - entry) / nullif(entry, 0) AS mfe,
      (lo - entry) / nullif(entry, 0) AS mae, CAST(mean_hit_6 AS DOUBLE) AS mean_hit_6, natr, bb_width, rsi, price_z,
      CASE WHEN NOT coalesce(rsi < {P.rsi_long}, false) THEN 'rsi' WHEN NOT coalesce(price_z < -{P.price_z}, false) THEN 'price_z'
        WHEN NOT bullish_reversal THEN 'bullish_reversal' ELSE 'signal' END AS first_failed_gate
      FROM o WHERE volume > 0 AND active_pair AND weak_trend_regime AND NOT breakout_block_long AND close < bb_lower)"""
GOOD = "first_failed_gate <> 'signal' AND (coalesce(forward_6 > 0, false) OR coalesce(mean_hit_6 = 1, false))"
book.add(
    "signal_quality_classes",
    classes,
    f"""{SETUPS}, t AS (SELECT p_type AS pair, o_orderpriority AS strategy, date_trunc('day', least(o_orderdate, l_shipdate)) AS open_date,
      l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit_abs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      WHERE l_returnflag <> 'R'),
    x AS (SELECT 'ALL' AS strategy, unnest(CASE WHEN first_failed_gate = 'signal' THEN ['raw_signal'] WHEN {GOOD} THEN ['near_miss', 'good_near_miss']
        ELSE ['near_miss'] END) AS class, {", ".join(AFTER)}, CAST(NULL AS DOUBLE) AS profit_abs FROM setups
      UNION ALL SELECT strategy, 'realized_trade', {", ".join(f"g.{c}" for c in AFTER)}, profit_abs FROM t
      LEFT JOIN (FROM setups WHERE first_failed_gate = 'signal') g ON t.pair = g.pair AND t.open_date = g.ts + INTERVAL 1 DAY)
    SELECT strategy, class, count(*) AS rows, count(forward_3) AS complete, {", ".join(f"avg({c}) AS mean_{c}" for c in AFTER)}, sum(profit_abs) AS profit,
      avg(CASE WHEN profit_abs IS NOT NULL THEN CAST(profit_abs > 0 AS DOUBLE) END) AS win_rate FROM x GROUP BY strategy, class""",
    " ".join(f"mean_{c}" for c in AFTER) + " profit:1 win_rate",
)
book.add(
    "good_near_miss_blockers",
    lambda s, d: regime.gate_blockers(setups(s, d), "forward_6", "mean_hit_6"),
    f"{SETUPS} SELECT first_failed_gate, count(*) AS rows, avg(forward_6) AS mean_forward_6, avg(mean_hit_6) AS hit_share FROM setups WHERE {GOOD} GROUP BY first_failed_gate",
    "mean_forward_6 hit_share",
)


def warmups(s, d):
    def compute(bars):
        return recursive.smoothed(bars.withColumn("chunk", F.lit(0)), (20,))

    return quality.warmup_variance(rows.bar_index(source.bars_day(s, d)), (60, 120, 240), compute, ["rsi", "natr", "ema20"])


book.add(
    "warmup_variance",
    warmups,
    f"""WITH {frames.TICKS}, {frames.recursive_sql('rec', 'bars', (20,))}, ends AS (SELECT pair, max(i) AS last FROM rec GROUP BY pair),
    cut AS (SELECT rec.pair || '@' || w AS pair, ts, open, high, low, close, volume FROM rec JOIN ends USING (pair), (VALUES (60), (120), (240)) v(w)
      WHERE i > last - w), {frames.recursive_sql('srt', 'cut', (20,))},
    f AS (SELECT pair, rsi, natr, ema20 FROM rec JOIN ends USING (pair) WHERE i = last), e2 AS (SELECT pair, max(i) AS last FROM srt GROUP BY pair),
      g AS (SELECT split_part(srt.pair, '@', 1) AS pair, CAST(split_part(srt.pair, '@', 2) AS INTEGER) AS warmup, rsi, natr, ema20 FROM srt JOIN e2 ON srt.pair = e2.pair
        AND srt.i = e2.last)
    SELECT warmup, count(*) AS pairs, max(abs(f.rsi - g.rsi)) AS max_rsi, max(abs(f.natr - g.natr)) AS max_natr, max(abs(f.ema20 - g.ema20)) AS max_ema20 FROM f
      JOIN g USING (pair) GROUP BY warmup""",
    "max_rsi max_natr max_ema20",
)
book.add(
    "study_readout",
    lambda s, d: candidates(s, d).groupBy("pair").agg(*(median(f"{k}{c}").alias(f"{k}{c}_median") for c in (NEAR, FAR) for k in ("", "excess_"))).withColumn("readout", gates.readout(NEAR, FAR)),
    f"""{WITH_NULLS}, m AS (SELECT pair, {', '.join(f'quantile_cont({k}{c}, 0.5) AS {k}{c}_median' for c in (NEAR, FAR) for k in ('', 'excess_'))} FROM cand GROUP BY pair)
    SELECT *, CASE WHEN {NEAR}_median > 0 AND {FAR}_median > 0 AND excess_{NEAR}_median > 0 AND excess_{FAR}_median > 0 THEN 'raw and excess positive'
      WHEN {NEAR}_median > 0 AND {FAR}_median > 0 THEN 'raw positive, excess not confirmed' ELSE 'not durable' END AS readout FROM m""",
    " ".join(f"{k}{c}_median" for c in (NEAR, FAR) for k in ("", "excess_")),
)


book.add(
    "mean_hit_long",
    lambda s, d: rows.own(events.mean_hit(events.mean_hit(frames.rolling(s, d), 3), 12)).where("price_z < -1").groupBy("pair").agg(*(F.avg(F.col(f"mean_hit_{h}").cast("double")).alias(f"hit_{h}") for h in (3, 12))),
    f"""WITH {EVENT_CTES}, h AS (SELECT *, {', '.join(f"CASE WHEN count(close) OVER w{k} = {k} AND bb_mid IS NOT NULL THEN CASE WHEN bb_mid >= close THEN max(high) OVER w{k} >= bb_mid ELSE min(low) OVER w{k} <= bb_mid END END AS h{k}" for k in (3, 12))} FROM fwd
    WINDOW w3 AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), w12 AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING
      AND 12 FOLLOWING)) SELECT pair, avg(CAST(h3 AS DOUBLE)) AS hit_3, avg(CAST(h12 AS DOUBLE)) AS hit_12 FROM h WHERE price_z < -1 GROUP BY pair""",
    "hit_3 hit_12",
)
