"""Queries on order books, order sizes, cool-downs, experiment matrices and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import stamp
from quantloom.functions.tables import written
from quantloom.operators import compare, signals, surface
from quantloom.plans.accounts import T, trades
from quantloom.plans.book import Book
from quantloom.plans.research import CELLS, GRID, WITH_NULLS, candidates

book = Book()


def books(s, d):
    """A book per order: odd lines are bids, even lines asks."""
    items = s.read.parquet(f"{d}/lineitem.parquet").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    level = lambda sign, test: F.collect_list(F.when(test, F.struct((sign * F.col("price")).alias("k"), F.col("price"), F.col("l_quantity").alias("qty"))))
    odd = F.col("l_linenumber") % 2 == 1
    rows = items.groupBy("l_orderkey").agg(level(-1, odd).alias("bids"), level(1, ~odd).alias("asks"))
    plain = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return rows.select("l_orderkey", plain("bids").alias("bids"), plain("asks").alias("asks"), (F.col("l_orderkey") % 10 / 10000.0).alias("funding_rate"))


book.add(
    "orderbook_features",
    lambda s, d: signals.entry_veto(signals.orderbook_features(books(s, d)), 0.5, -0.2, 0.0007).select("l_orderkey", "spread_ratio", "imbalance", "veto"),
    """WITH x AS (SELECT l_orderkey, l_linenumber % 2 = 1 AS bid, l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, bid ORDER BY CASE WHEN bid THEN -price ELSE price END, qty) AS r FROM x),
    y AS (SELECT l_orderkey, max(price) FILTER (bid AND r = 1) AS b, max(price) FILTER (NOT bid AND r = 1) AS a, coalesce(sum(qty) FILTER (bid AND r <= 5), 0) AS bq,
      coalesce(sum(qty) FILTER (NOT bid AND r <= 5), 0) AS aq FROM r GROUP BY l_orderkey),
    z AS (SELECT l_orderkey, (a - b) / nullif((a + b) / 2, 0) AS spread_ratio, (bq - aq) / nullif(bq + aq, 0) AS imbalance FROM y)
    SELECT *, CASE WHEN NOT coalesce(spread_ratio <= 0.5, false) THEN 'spread' WHEN NOT coalesce(imbalance >= -0.2, false) THEN 'imbalance'
      WHEN l_orderkey % 10 / 10000.0::DOUBLE > 0.0007::DOUBLE THEN 'funding' END AS veto FROM z""",
    "spread_ratio imbalance",
)


def orders(s, d):
    c = F.col("p_size")
    return s.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", (c * 1.37).alias("amount"), F.when(c % 3 == 0, 0.0).otherwise(0.5).alias("qty_step"), F.lit(1.0).alias("min_qty"), F.lit(5000.0).alias("min_notional"), F.col("p_retailprice").alias("rate"), (c / 1000.0).alias("natr"), (c / 300.0).alias("bb_width"), F.lit(10000.0).alias("equity")
    )


SIZES = ["order_amount", "order_valid", "min_stake", "leverage", "risk_stake", "stop_price", "roi"]
book.add(
    "order_sizing",
    lambda s, d: signals.order_sizing(orders(s, d), hot_natr=0.03).select("p_partkey", *SIZES),
    """WITH o AS (SELECT p_partkey, p_size * 1.37::DOUBLE AS amount, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS step, p_retailprice AS rate,
      p_size / 1000.0::DOUBLE AS natr, p_size / 300.0::DOUBLE AS w FROM part),
    q AS (SELECT *, coalesce(floor(amount / step + 1e-12) * step, amount) AS order_amount, CASE WHEN natr > 0.03 OR w > 0.15 THEN 1.0::DOUBLE ELSE 2.0 END AS leverage
      FROM o)
    SELECT p_partkey, order_amount, order_amount >= 1 AND order_amount * rate >= 5000 AS order_valid, greatest(5000, rate) * 1.05 / leverage AS min_stake, leverage,
      10000 * 0.005 / (nullif(1.7 * natr, 0) * leverage) AS risk_stake, rate * (1 - 1.7 * natr) AS stop_price, least(greatest(1.2 * natr, 0.008), 0.035) AS roi FROM q""",
    "order_amount min_stake leverage risk_stake stop_price roi",
)


def cooled(s, d):
    stopped = (F.col("exit_reason") == "F") & (F.col("profit_abs") < 0)
    day = lambda c: F.date_trunc("day", c)
    t = trades(s, d).select("pair", "is_short", day("open_date").alias("ts"), day("close_date").alias("close_date"), F.when(stopped, "stop_loss").otherwise("roi").alias("exit_reason"), F.round("profit_abs", 0).alias("profit_abs"))
    t = written(t, "cooldown-trades")
    at = t.select("pair", "is_short", "ts").distinct()
    return signals.cooldown_flags(t.drop("ts"), at, 86_400, stops=60, stop_bars=3, stop_pause=2, low_bars=10, low_pause=4).withColumn("ts", stamp(F.col("ts")))


book.add(
    "cooldown_flags",
    cooled,
    f"""{T}, t AS (SELECT pair, is_short, date_trunc('day', close_date) AS moment, CASE WHEN exit_reason = 'F' AND profit_abs < 0 THEN 1 ELSE 0 END AS stop, round(profit_abs,
      0) AS p FROM trades),
    s AS (SELECT DISTINCT pair, is_short, CAST(date_trunc('day', open_date) AS TIMESTAMP) AS ts FROM trades),
    sd AS (SELECT is_short, moment, sum(stop) AS n FROM t GROUP BY ALL),
    reach AS (SELECT is_short, moment, sum(n) OVER (PARTITION BY is_short ORDER BY moment RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS n FROM sd),
      side AS (SELECT * FROM reach WHERE n >= 60),
    low AS (SELECT pair, is_short, moment, count(*) OVER w AS n, sum(p) OVER w AS p FROM t WINDOW w AS (PARTITION BY pair,
      is_short ORDER BY moment RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW)),
    lock AS (SELECT DISTINCT pair, is_short, moment FROM low WHERE n >= 2 AND p <= 0),
    a AS (SELECT s.*, coalesce(s.ts < l.moment + INTERVAL 2 DAY, false) AS side_blocked FROM s ASOF LEFT JOIN side l ON s.is_short = l.is_short AND s.ts >= l.moment),
    f AS (SELECT a.*, coalesce(a.ts < l.moment + INTERVAL 4 DAY, false) AS pair_blocked FROM a ASOF LEFT JOIN lock l ON a.pair = l.pair AND a.is_short = l.is_short
      AND a.ts >= l.moment)
    SELECT pair, is_short, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, side_blocked, pair_blocked, side_blocked OR pair_blocked AS blocked FROM f""",
)
EXITS, FEES = ("z0", "rsi50", "mid", "time"), (0.0, 0.0007)
book.add(
    "experiment_matrix",
    lambda s, d: compare.experiment_matrix(surface.fingerprints(candidates(s, d), GRID).where("signals > 0 and not is_duplicate_signal_set").select(F.format_string("RFC_%d", "cell_id").alias("candidate_id")), EXITS, FEES),
    f"""{WITH_NULLS}, {CELLS} SELECT 'RFC_' || cell_id AS candidate_id, exit_mode, fee, 'FlushRFC' || cell_id || upper(exit_mode[1]) || exit_mode[2:] AS class_name,
      false AS collides
    FROM dup, (VALUES ('z0'), ('rsi50'), ('mid'), ('time')) e(exit_mode), (VALUES (0.0::DOUBLE), (0.0007::DOUBLE)) f(fee) WHERE signals > 0
      AND cell_id = canonical_cell_id""",
)
book.add(
    "promotion_rows",
    lambda s, d: compare.promotion_rows(trades(s, d), ["strategy", "pair"], "1999-01-01 00:00:00", 60),
    f"""{T}, n AS (SELECT strategy, pair, count(*) FILTER (open_date < '1999-01-01') AS selection_trades, coalesce(sum(profit_abs) FILTER (open_date < '1999-01-01'),
      0) AS selection_profit, count(*) FILTER (open_date >= '1999-01-01') AS holdout_trades, coalesce(sum(profit_abs) FILTER (open_date >= '1999-01-01'),
        0) AS holdout_profit FROM trades GROUP BY ALL)
    SELECT *, CASE WHEN selection_trades < 60 OR holdout_trades < 60 THEN 'insufficient' WHEN selection_profit <= 0 THEN 'rejected_in_selection'
      WHEN holdout_profit <= 0 THEN 'fails_holdout' ELSE 'stable' END AS verdict FROM n""",
    "selection_profit:1 holdout_profit:1",
)
book.add(
    "event_properties",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "struct<k:int>")["k"].alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("total"), F.max("k").alias("largest")),
    "SELECT event_type, count(*) AS events, CAST(sum(CAST(props->>'k' AS INTEGER)) AS BIGINT) AS total, max(CAST(props->>'k' AS INTEGER)) AS largest FROM events GROUP BY event_type",
)
