"""Queries on ledgers in windows: the validation matrix, promotion and holdout, time stress, the strict gate, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import stamp
from quantloom.functions.tables import written
from quantloom.operators import gates, ledger, removals
from quantloom.plans.accounts import STRESS, T, trades
from quantloom.plans.book import Book

book = Book()
#: Anchors: first, last, months between; and the months of a window. Windows from CUTOFF on are holdouts.
WINDOWS, CUTOFF = ("1996-01-01", "2000-01-01", 12, 6), "1999-01-01 00:00:00"
KEYS = ["strategy"]


def windowed(s, d):
    return written(ledger.in_windows(trades(s, d), *WINDOWS), "windowed-trades")


SIGNATURE = "pair || '|' || strftime(open_date, '%Y-%m-%d %H:%M:%S') || '|' || is_short"
X = f"""{T}, a AS (SELECT unnest(generate_series(TIMESTAMP '{WINDOWS[0]}', TIMESTAMP '{WINDOWS[1]}', INTERVAL {WINDOWS[2]} MONTH)) AS anchor),
x AS (SELECT *, {SIGNATURE} AS signature, anchor >= '{CUTOFF}' AS late FROM trades JOIN a ON open_date >= anchor AND open_date < anchor + INTERVAL {WINDOWS[3]} MONTH)"""


def counted(key: str, column: str, source: str = "x", top: int | None = None) -> str:
    order = f"n DESC, {column}" if top else column
    rank = f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {column}) <= {top}" if top else ""
    return f"SELECT {key}, string_agg({column} || ':' || n, ', ' ORDER BY {order}) AS text FROM (SELECT {key}, {column}, count(*) AS n FROM {source} GROUP BY {key}, {column}{rank}) GROUP BY {key}"


def falls(key: str, source: str = "x") -> str:
    """(key, max_drawdown) of cumulative profit in cents."""
    w = f"PARTITION BY {key} ORDER BY open_date, close_date, pair, p ROWS UNBOUNDED PRECEDING"
    return f"""SELECT {key}, CAST(abs(min(fall)) AS DOUBLE) AS max_drawdown FROM (SELECT *, c - max(c) OVER ({w}) AS fall FROM (SELECT *, sum(p) OVER ({w}) AS c
  FROM (SELECT *, CAST(round(profit_abs, 2) AS DECIMAL(18, 2)) AS p FROM {source}))) GROUP BY {key}"""


book.add(
    "validation_matrix",
    lambda s, d: ledger.validation_matrix(windowed(s, d), KEYS, 150).withColumn("anchor", stamp(F.col("anchor"))),
    f"""{X}, m AS ({counted("anchor, strategy", "month")}), p AS ({counted("anchor, strategy", "pair", top=8)}),
    n AS (SELECT anchor, strategy, count(*) AS trades, count(DISTINCT signature) AS unique_trades, count(DISTINCT pair) AS pairs, sum(profit_abs) AS profit,
      count(*) FILTER (NOT is_short) AS long_trades, count(*) FILTER (is_short) AS short_trades FROM x GROUP BY ALL)
    SELECT strftime(anchor, '%Y-%m-%d %H:%M:%S') AS anchor, strategy, trades, unique_trades, pairs, profit, long_trades, short_trades, m.text AS monthly_distribution,
      p.text AS pair_contribution, trades >= 150 AS usable_sample
    FROM n JOIN m USING (anchor, strategy) JOIN p USING (anchor, strategy)""",
    "profit:2",
)
book.add(
    "variant_totals",
    lambda s, d: ledger.variant_totals(windowed(s, d), KEYS),
    f"{X} SELECT strategy, count(*) AS raw_trades, count(DISTINCT signature) AS unique_trades, sum(profit_abs) AS profit, count(*) FILTER (NOT is_short) AS long_trades, count(*) FILTER (is_short) AS short_trades FROM x GROUP BY strategy",
    "profit:1",
)
book.add(
    "promotion_windows",
    lambda s, d: ledger.promotion_windows(windowed(s, d), KEYS, CUTOFF, 800),
    f"""{X}, y AS (SELECT *, CASE WHEN late THEN 'promotion_holdout' ELSE 'candidate_selection_reference' END AS evidence_role, CASE WHEN late THEN strftime(anchor,
      '%Y-%m-%d %H:%M:%S') ELSE 'selection' END AS "window" FROM x),
    f AS ({falls('anchor, strategy, evidence_role, "window"', "y")}), g AS (SELECT strategy, evidence_role, "window", max(max_drawdown) AS max_drawdown FROM f
      GROUP BY ALL), m AS ({counted('strategy, evidence_role, "window"', "month", "y")}),
    n AS (SELECT strategy, evidence_role, "window", count(DISTINCT anchor) AS windows, count(*) AS trades, count(DISTINCT signature) AS unique_trades,
      sum(profit_abs) AS profit FROM y GROUP BY ALL)
    SELECT n.*, g.max_drawdown, m.text AS monthly_distribution, trades >= 800 AS sample_large_enough FROM n JOIN g USING (strategy, evidence_role, "window")
      JOIN m USING (strategy, evidence_role, "window")""",
    "profit:1 max_drawdown:0",
)
CASES = {"selection_reference": "NOT late", "remove_best_month": "NOT late AND rm > 1", "remove_best_two_months": "NOT late AND rm > 2", "remove_best_anchor_window": "NOT late AND ra > 1", "promotion_holdouts_only": "late"}


def stressed(s, d):
    return ledger.time_stress(windowed(s, d), KEYS, CUTOFF).withColumn("status", gates.time_stress_status(F.col("profit"), F.col("trades"), 2000, 1_000_000.0))


book.add(
    "time_stress",
    stressed,
    f"""{X}, {", ".join(f"r{g[0]} AS (SELECT strategy, {g}, row_number() OVER (PARTITION BY strategy ORDER BY round(sum(profit_abs), 6) DESC, {g}) AS r{g[0]} FROM x WHERE NOT late GROUP BY strategy, {g})" for g in ("month", "anchor"))},
    y AS (SELECT x.*, rm, ra FROM x LEFT JOIN rm USING (strategy, month) LEFT JOIN ra USING (strategy, anchor)),
      z AS ({" UNION ALL ".join(f"SELECT '{n}' AS scenario, y.* FROM y WHERE {c}" for n, c in CASES.items())}),
    zf AS (SELECT * FROM z WHERE NOT late), f AS ({falls("strategy, scenario", "zf")}), n AS (SELECT strategy, scenario, count(*) AS trades, sum(profit_abs) AS profit
      FROM z GROUP BY ALL)
    SELECT n.*, coalesce(max_drawdown, 0) AS max_drawdown, CASE WHEN trades <= 0 OR profit <= 0 THEN 'collapses'
      WHEN trades < 2000 OR profit < 1000000 THEN 'weakens materially' ELSE 'survives' END AS status FROM n LEFT JOIN f USING (strategy, scenario)""",
    "profit:1 max_drawdown:0",
)
FEE, SLIP, BALANCE = 0.0007, 0.0005, 50_000_000.0
LIMITS = gates.STRICT | {"drawdown_pct": 30.0, "month_share": 0.06, "pair_share": 0.06}


def strict(s, d):
    x = windowed(s, d)
    expected = x.select("anchor").distinct().crossJoin(x.select(*KEYS).distinct())  # windows x variants, a few rows
    df = ledger.strict_gate(x, expected, KEYS, FEE, SLIP, BALANCE, 2, 150)
    return df.withColumns({"failed_checks": gates.failed_checks(gates.strict_checks(LIMITS)), "decision": gates.strict_decision(LIMITS)})


SHARES = ", ".join(f"s{g[0]} AS (SELECT strategy, CASE WHEN sum(q) > 0 THEN max(greatest(q, 0)) / sum(q) ELSE 1 END AS max_{g}_profit_share FROM (SELECT strategy, {g}, sum(sp) AS q FROM y GROUP BY ALL) GROUP BY strategy)" for g in ("month", "pair"))
CHECKS = {
    "no_missing_snapshots": "missing_windows = 0", "total_trades": f"total_trades >= {LIMITS['trades']}", "usable_windows": f"usable_windows >= {LIMITS['windows']}", "latest_positive_windows": f"latest_positive_windows >= {LIMITS['latest_positive']}",
    "max_drawdown_pct": f"max_drawdown_pct <= {LIMITS['drawdown_pct']}", "profit_factor": f"profit_factor_stressed >= {LIMITS['profit_factor']}", "avg_stressed_trade": "avg_stressed_trade > 0",
    "month_concentration": f"max_month_profit_share <= {LIMITS['month_share']}", "pair_concentration": f"max_pair_profit_share <= {LIMITS['pair_share']}",
}
book.add(
    "strict_gate",
    strict,
    f"""{X}, y AS (SELECT *, {STRESS.format(f=FEE, s=SLIP)} AS sp FROM x), f AS ({falls("anchor, strategy", "y")}), e AS (SELECT DISTINCT q.anchor, r.strategy FROM x q, x r),
    per AS (SELECT anchor, strategy, count(*) AS n, sum(sp) AS p FROM y GROUP BY ALL), w AS (SELECT e.*, n, p, max_drawdown, row_number() OVER (PARTITION BY strategy,
      n IS NULL ORDER BY anchor DESC) AS back FROM e LEFT JOIN per USING (anchor, strategy) LEFT JOIN f USING (anchor, strategy)),
    v AS (SELECT strategy, count(*) FILTER (n IS NULL) AS missing_windows, count(*) FILTER (n >= 150) AS usable_windows, count(*) FILTER (n IS NOT NULL AND back <= 2
      AND p > 0) AS latest_positive_windows, coalesce(max(max_drawdown), 0) / {BALANCE} * 100 AS max_drawdown_pct FROM w GROUP BY strategy),
    t AS (SELECT strategy, count(*) AS total_trades, sum(sp) AS stressed_profit, avg(sp) AS avg_stressed_trade,
      sum(sp) FILTER (sp > 0) / sum(-sp) FILTER (sp < 0) AS profit_factor_stressed FROM y GROUP BY strategy), {SHARES},
    g AS (SELECT * FROM v JOIN t USING (strategy) JOIN sm USING (strategy) JOIN sp USING (strategy)), h AS (SELECT *, concat_ws(', ',
      {", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in CHECKS.items())}) AS failed_checks FROM g)
    SELECT *, CASE WHEN failed_checks = '' THEN 'PROMOTE_PENDING_BIAS' ELSE 'PARK' END AS decision FROM h""",
    "max_drawdown_pct stressed_profit:1 avg_stressed_trade:4 profit_factor_stressed max_month_profit_share max_pair_profit_share",
)


def profiles(s, d):
    """Every strategy under its own costs ("baseline") and under higher ones."""
    t = trades(s, d)
    rows = ledger.cost_scenarios(t, [("baseline", 0.0, 0.0), ("fee_7bps", 0.0007, 0.0), ("slip_1pct", 0.0007, 0.01), ("slip_20pct", 0.0007, 0.2)], KEYS)
    return rows.withColumnRenamed("scenario", "label")


CASES_COST = [("baseline", 0.0, 0.0), ("fee_7bps", 0.0007, 0.0), ("slip_1pct", 0.0007, 0.01), ("slip_20pct", 0.0007, 0.2)]
book.add(
    "stability_verdict",
    lambda s, d: gates.stability(profiles(s, d), "strategy"),
    f"""{T}, q AS ({" UNION ALL ".join(f"SELECT '{n}' AS label, strategy, count(*) AS trades, sum({STRESS.format(f=f, s=p)}) AS profit FROM trades GROUP BY strategy" for n, f, p in CASES_COST)}),
    b AS (SELECT strategy, trades AS bt, profit AS bp FROM q WHERE label = 'baseline'), n AS (SELECT strategy, count(*) FILTER (label <> 'baseline') AS profiles,
      count(*) FILTER (label <> 'baseline' AND (profit <= 0 OR trades < greatest(5, floor(bt * 0.6)) OR profit < bp * 0.6)) AS weak_profiles FROM q
        JOIN b USING (strategy) GROUP BY strategy)
    SELECT *, CASE WHEN profiles = 0 THEN 'insufficient_data' WHEN weak_profiles > 0 THEN 'fragile' ELSE 'stable' END AS verdict FROM n""",
)


# --- drawdown after removals
def cents(df):
    """Profit in whole cents. Prices have two places and rates two, so no profit lies on the border that is cut at."""
    return df.withColumn("profit_abs", F.floor(100 * F.col("profit_abs") + 0.503).cast("decimal(18,0)"))


def without(df, removed_by):
    """Trades, profit and drawdown after each removal, against the whole."""
    df = removals.removal_drawdowns(df, KEYS, removed_by)
    money = ("profit_after", "drawdown_after", "profit", "max_drawdown")
    df = df.withColumns({c: F.col(c).cast("double") / 100 for c in money})
    status = gates.resilience(F.col("profit_after"), F.col("trades_after"), F.col("profit"), F.col("trades"))
    return df.select("strategy", "removed", "trades_after", "profit_after", "drawdown_after", (F.col("drawdown_after") / F.col("max_drawdown")).alias("drawdown_share"), status.alias("status"))


def without_sql(source: str, names: str) -> str:
    """``source``: trades with p; ``names``: (strategy, removed, r...) and a test ``gone`` of each trade."""
    w = "PARTITION BY strategy, removed ORDER BY open_date, close_date, pair, p ROWS UNBOUNDED PRECEDING"
    return f"""c AS (SELECT {source}.strategy, removed, pair, open_date, close_date, p FROM {source} JOIN ({names}) n ON {source}.strategy = n.strategy AND NOT (gone)
      UNION ALL SELECT strategy, '', pair, open_date, close_date, p FROM {source}),
    f AS (SELECT strategy, removed, count(*) AS n, sum(p) AS total, abs(min(fall)) AS fall FROM (SELECT *, c - max(c) OVER ({w}) AS fall FROM (SELECT *, sum(p) OVER ({w}) AS c FROM c))
      GROUP BY ALL),
    h AS (SELECT k.strategy, k.removed, coalesce(f.n, 0) AS trades_after, coalesce(f.total, 0)::DOUBLE / 100 AS profit_after, coalesce(f.fall, 0)::DOUBLE / 100 AS drawdown_after, b.n AS trades,
      b.total::DOUBLE / 100 AS profit, b.fall::DOUBLE / 100 AS max_drawdown FROM (SELECT DISTINCT strategy, removed FROM ({names})) k LEFT JOIN f ON k.strategy = f.strategy AND k.removed = f.removed
      JOIN f b ON b.strategy = k.strategy AND b.removed = '')
    SELECT strategy, removed, trades_after, profit_after, drawdown_after, drawdown_after / max_drawdown AS drawdown_share, CASE WHEN trades_after <= 0 OR profit_after <= 0 THEN 'collapses'
      WHEN (CASE WHEN profit > 0 THEN profit_after / profit ELSE 0 END) < 0.5 OR trades_after / trades < 0.6 THEN 'weakens materially' ELSE 'survives' END AS status FROM h"""


CENTS = "CAST(floor(100 * profit_abs + 0.503) AS DECIMAL(18, 0)) AS p"
ROUNDED = "profit_after:2 drawdown_after:2 drawdown_share"
for group in ("pair", "month"):
    book.add(
        f"drawdown_without_{group}",
        lambda s, d, group=group: without(cents(trades(s, d)), F.array(group)),
        f"{T}, t AS (SELECT *, {CENTS} FROM trades), {without_sql('t', f'SELECT DISTINCT strategy, {group} AS removed, {group} AS r FROM trades').replace('(gone)', f't.{group} = n.r')}",
        ROUNDED,
    )
book.add(
    "drawdown_without_anchor",
    lambda s, d: without(cents(windowed(s, d)), F.array(stamp(F.col("anchor")))),
    f"{X}, t AS (SELECT * EXCLUDE (anchor), strftime(anchor, '%Y-%m-%d %H:%M:%S') AS anchor, {CENTS} FROM x), "
    f"{without_sql('t', 'SELECT DISTINCT strategy, anchor AS removed, anchor AS r FROM t').replace('(gone)', 't.anchor = n.r')}",
    ROUNDED,
)
book.add(
    "drawdown_without_top_pairs",
    lambda s, d: without(removals.top_labels(written(cents(trades(s, d)).select(*KEYS, "pair", "open_date", "close_date", "profit_abs"), "removal-trades"), KEYS, "pair"), F.col("top_labels")),
    f"""{T}, q AS (SELECT *, {CENTS} FROM trades), g AS (SELECT strategy, pair, row_number() OVER (PARTITION BY strategy ORDER BY sum(p) DESC, pair) AS r FROM q GROUP BY strategy, pair),
    t AS (SELECT q.*, g.r FROM q JOIN g USING (strategy, pair)),
    {without_sql('t', "SELECT DISTINCT strategy, 'top_' || k AS removed, k FROM trades, (VALUES (1), (3), (5)) v(k)").replace('(gone)', 't.r <= n.k')}""",
    ROUNDED,
)
