"""Queries on matched controls, threshold surfaces, comparisons and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import calendar, stamp
from quantloom.functions.tables import written
from quantloom.operators import compare, events, gates, indicators, nulls, rows, signals, surface
from quantloom.plans import frames
from quantloom.plans.book import Book
from quantloom.plans.study import LOOSE, TS, WITH, flush_sql

book = Book()
NEAR, FAR, GAP, SPLIT, DRAWS = "forward_6", "forward_12", "5 DAYS", "1999-01-01 00:00:00", 7
GRID = surface.Grid(price_z=(1.0, 1.3, 1.6, 1.9), rsi=(50.0, 46.0, 42.0), vol_z=(-1.0, -0.5, 0.5), bb_width=(0.01, 0.3))
#: Minima that daily bars can reach, so that every branch occurs.
LIGHT = {"signals": 40, "clusters": 30, "active_pairs": 6, "active_years": 6, "top_pair_share": 0.40, "top_year_share": 0.35}
ROBUST = {"signals": 60, "clusters": 50, "active_pairs": 6, "active_years": 6, "top_pair_share": 0.35, "top_year_share": 0.30, "positive_years": 3, "positive_pairs": 3}


def priced(s, d):
    df = events.forward_returns(frames.features(s, d), (6, 12))
    return calendar(rows.own(events.excursions(df, 24)))


def candidates(s, d):
    """Events inside the loosest level, with matched controls from the same pair and year."""
    df = written(priced(s, d), "priced-bars")
    found = df.where(signals.flush_mask(LOOSE))
    return nulls.matched_null(found, df.where(F.col(FAR).isNotNull()), ["pair", "year"], [NEAR, FAR], DRAWS, GAP)


FORWARD = f"""fw AS (
  SELECT * EXCLUDE (i, g, d, up, down, tr), strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') || 'Q' || quarter(ts) AS quarter, lead(open,
    1) OVER v AS entry_price,
    (lead(close, 7) OVER v - lead(open, 1) OVER v) / nullif(lead(open, 1) OVER v, 0) AS forward_6, (lead(close, 13) OVER v - lead(open, 1) OVER v) / nullif(lead(open, 1)
      OVER v, 0) AS forward_12,
    (max(high) OVER w - lead(open, 1) OVER v) / nullif(lead(open, 1) OVER v, 0) AS mfe, (min(low) OVER w - lead(open, 1) OVER v) / nullif(lead(open, 1) OVER v, 0) AS mae
  FROM feat WINDOW v AS (PARTITION BY pair ORDER BY ts), w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 25 FOLLOWING))"""


def nulls_sql(events: str, out: str, fields: tuple = ("pair", "year"), bars: str = "fw") -> str:
    """``out``: the rows of ``events`` with matched controls, drawn from ``bars``."""
    strata = ", ".join(fields)
    same = " AND ".join(f"{{0}}.{f} = p.{f}" for f in fields)
    return f"""{out}_pool AS (SELECT pair, ts, {", ".join(f for f in fields if f != "pair") or "1 AS one"}, forward_6, forward_12, row_number()
      OVER (PARTITION BY {strata} ORDER BY pair, ts) - 1 AS rank FROM {bars} WHERE forward_12 IS NOT NULL),
{out}_at AS (SELECT DISTINCT pair, ts, {", ".join(f for f in fields if f != "pair") or "1 AS one"} FROM {events}),
{out}_holes AS (SELECT c.*, count(*) FILTER (p.pair < c.pair OR p.pair = c.pair AND p.ts < c.ts - INTERVAL 5 DAY) AS lft,
      count(*) FILTER (p.pair < c.pair OR p.pair = c.pair AND p.ts <= c.ts + INTERVAL 5 DAY) AS rgt, count(*) AS n
  FROM {out}_at c JOIN {out}_pool p ON {same.format("c")} GROUP BY ALL),
{out}_drawn AS (SELECT h.*, CAST('0x' || substr(md5('null-1|' || pair || '|' || {TS} || '|' || draw), 1, 8) AS BIGINT) % (lft + n - rgt) AS slot FROM {out}_holes h,
      range({DRAWS}) AS r(draw) WHERE lft + n - rgt > 0),
{out}_medians AS (SELECT d.pair, d.ts, count(*) AS null_samples, quantile_cont(p.forward_6, 0.5) AS null_forward_6, quantile_cont(p.forward_12, 0.5) AS null_forward_12
  FROM {out}_drawn d JOIN {out}_pool p ON {same.format("d")} AND p.rank = CASE WHEN slot < lft THEN slot ELSE rgt + slot - lft END GROUP BY ALL),
{out} AS (SELECT c.*, coalesce(null_samples, 0) AS null_samples, null_forward_6, null_forward_12, forward_6 - null_forward_6 AS excess_forward_6,
      forward_12 - null_forward_12 AS excess_forward_12
  FROM {events} c LEFT JOIN {out}_medians m ON c.pair = m.pair AND c.ts = m.ts)"""


NULLS = f"{FORWARD}, cand0 AS (SELECT * FROM fw WHERE {flush_sql(LOOSE)}), {nulls_sql('cand0', 'cand')}"
WITH_NULLS = f"{WITH}, {NULLS}"
book.add(
    "matched_null",
    lambda s, d: candidates(s, d).select("pair", stamp(F.col("ts")).alias("ts"), "null_samples", "null_forward_6", "null_forward_12", "excess_forward_6", "excess_forward_12"),
    f"{WITH_NULLS} SELECT pair, {TS} AS ts, null_samples, null_forward_6, null_forward_12, excess_forward_6, excess_forward_12 FROM cand",
    "null_forward_6 null_forward_12 excess_forward_6 excess_forward_12",
)


def by_regime(s, d):
    """Controls of any pair in the same quarter and bucket of volatility."""
    df = written(indicators.quantile_bucket(priced(s, d), "natr", "vol_bucket"), "regime-bars")
    return nulls.matched_null(df.where(signals.flush_mask(LOOSE)), df.where(F.col(FAR).isNotNull()), ["vol_bucket", "quarter"], [NEAR, FAR], DRAWS, GAP)


book.add(
    "matched_null_by_regime",
    lambda s, d: by_regime(s, d).select("pair", stamp(F.col("ts")).alias("ts"), "vol_bucket", "quarter", "null_samples", "null_forward_6", "null_forward_12", "excess_forward_12"),
    f"""{WITH}, {FORWARD}, n_rank AS (SELECT *, row_number() OVER (PARTITION BY pair, natr IS NOT NULL ORDER BY natr, ts) AS r, count(*) OVER (PARTITION BY pair,
      natr IS NOT NULL) AS n FROM fw),
    fb AS (SELECT * EXCLUDE (r, n), CASE WHEN natr IS NULL THEN -1 WHEN n = 1 THEN 0 ELSE greatest(ceil((r - 1) * least(n, 5) / (n - 1)),
      1) - 1 END::INTEGER AS vol_bucket FROM n_rank),
    reg0 AS (SELECT * FROM fb WHERE {flush_sql(LOOSE)}), {nulls_sql("reg0", "reg", ("vol_bucket", "quarter"), "fb")}
    SELECT pair, {TS} AS ts, vol_bucket, quarter, null_samples, null_forward_6, null_forward_12, excess_forward_12 FROM reg""",
    "null_forward_6 null_forward_12 excess_forward_12",
)


def levels(axis, values):
    return f"(SELECT unnest(range(1, {len(values) + 1})) AS level_{axis}, unnest([{', '.join(map(str, values))}]::DOUBLE[]) AS {axis}_threshold)"


CELLS = f"""cells AS (SELECT *, row_number() OVER (ORDER BY level_price_z, level_rsi, level_vol_z, level_bb_width, use_weak_trend, use_breakout_block, use_below_band) AS cell_id
  FROM {', '.join(levels(a, getattr(GRID, a)) for a in surface.AXES)}, (VALUES (false), (true)) a(use_weak_trend), (VALUES (false), (true)) b(use_breakout_block),
    (VALUES (false), (true)) c(use_below_band)),
member AS (SELECT cell_id, e.* FROM cand e JOIN cells ON price_z < -price_z_threshold AND rsi < rsi_threshold AND vol_z > vol_z_threshold
      AND bb_width > bb_width_threshold
  AND (NOT use_weak_trend OR weak_trend_regime) AND (NOT use_breakout_block OR NOT breakout_block_long) AND (NOT use_below_band OR close < bb_lower)),
sets AS (SELECT cells.*, count(member.pair) AS signals, coalesce(md5(string_agg(pair || ts, ',' ORDER BY pair, ts)), 'empty') AS signal_set FROM cells LEFT
      JOIN member USING (cell_id) GROUP BY ALL),
dup AS (SELECT *, min(cell_id) OVER (PARTITION BY signal_set) AS canonical_cell_id, count(*) OVER (PARTITION BY signal_set) AS duplicate_signal_set_count FROM sets)"""


def metrics_sql(source_name: str, key: str) -> str:
    """``metrics``: cell_metrics over (key, event) rows."""
    med = lambda c: f"quantile_cont({c}, 0.5)"
    first = lambda c: f"CASE WHEN is_first THEN {c} END"
    sides = [(k, c) for c in (NEAR, FAR) for k in ("", "null_", "excess_")]
    return f"""marked AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY {key}, pair ORDER BY ts) + INTERVAL 5 DAY, true) AS is_first FROM {source_name}),
{", ".join(f"""{g}_n AS (SELECT {key}, max(n) / sum(n) AS top_{g}_share, max(c) / nullif(sum(c), 0) AS top_{g}_cluster_share
  FROM (SELECT {key}, {g}, count(*) AS n, count(*) FILTER (is_first) AS c FROM marked GROUP BY ALL) GROUP BY {key})""" for g in ("pair", "year"))},
pair_p AS (SELECT {key}, count(*) FILTER (m > 0) AS positive_pairs FROM (SELECT {key}, pair, {med(f"excess_{FAR}")} AS m FROM marked WHERE is_first GROUP BY ALL)
      GROUP BY {key}),
year_p AS (SELECT {key}, count(*) FILTER (m > 0) AS positive_years FROM (SELECT {key}, year, {med(f"excess_{FAR}")} AS m FROM marked WHERE is_first GROUP BY ALL)
      GROUP BY {key}),
split AS (SELECT {key}, count(*) FILTER (ts < '{SPLIT}') AS train_clusters, count(*) FILTER (ts >= '{SPLIT}') AS validation_clusters,
      {med(f"CASE WHEN ts < '{SPLIT}' THEN excess_{FAR} END")} AS train_excess_median,
        {med(f"CASE WHEN ts >= '{SPLIT}' THEN excess_{FAR} END")} AS validation_excess_median FROM marked WHERE is_first GROUP BY {key}),
main AS (SELECT {key}, count(*) AS signals, count(*) FILTER (is_first) AS clusters, count(DISTINCT pair) AS active_pairs, count(DISTINCT year) AS active_years,
      count(DISTINCT month) AS active_months,
  {', '.join(f'{med(k + c)} AS {k}{c}_median' for k, c in sides)}, {', '.join(f'{med(first(k + c))} AS cluster_{k}{c}_median' for k, c in sides if k != 'null_')},
  quantile_cont({first(f"excess_{FAR}")}, 0.25) AS cluster_excess_p25, {med("mfe")} AS mfe_median, {med("mae")} AS mae_median, quantile_cont(mae, 0.1) AS mae_p10,
  avg(CAST({NEAR} > 0 AS DOUBLE)) AS {NEAR}_win_rate, avg(CAST({FAR} > 0 AS DOUBLE)) AS {FAR}_win_rate FROM marked GROUP BY {key}),
metrics AS (SELECT *, coalesce(train_clusters >= 3 AND train_excess_median > 0, false) AS passes_train, coalesce(validation_clusters >= 3
      AND validation_excess_median > 0, false) AS passes_validation
  FROM main JOIN pair_n USING ({key}) JOIN year_n USING ({key}) JOIN pair_p USING ({key}) JOIN year_p USING ({key}) JOIN split USING ({key}))"""


METRICS = ["clusters", "active_pairs", "active_years", "active_months", *(f"{k}{c}_median" for c in (NEAR, FAR) for k in ("", "null_", "excess_", "cluster_", "cluster_excess_")), "cluster_excess_p25", "mfe_median", "mae_median", "mae_p10", f"{NEAR}_win_rate", f"{FAR}_win_rate", "top_pair_share", "top_year_share", "top_pair_cluster_share", "top_year_cluster_share", "positive_pairs", "positive_years", "train_clusters", "validation_clusters", "train_excess_median", "validation_excess_median", "passes_train", "passes_validation"]
DOUBLES = " ".join(c for c in METRICS if c.endswith(("median", "p25", "p10", "rate", "share")))
book.add(
    "surface_fingerprints",
    lambda s, d: surface.fingerprints(candidates(s, d), GRID).select("cell_id", "signals", "canonical_cell_id", "duplicate_signal_set_count", "is_duplicate_signal_set", "price_z_threshold", "use_weak_trend"),
    f"{WITH_NULLS}, {CELLS} SELECT cell_id, signals, canonical_cell_id, duplicate_signal_set_count, cell_id <> canonical_cell_id AS is_duplicate_signal_set, price_z_threshold, use_weak_trend FROM dup",
)


def whole_surface(s, d):
    df = surface.surface(candidates(s, d), GRID, NEAR, FAR, GAP, SPLIT)
    return written(df.withColumn("decision", gates.classify_surface(NEAR, FAR, LIGHT, ROBUST)), "surface")


SURFACE = f"{WITH_NULLS}, {CELLS}, {metrics_sql('member', 'cell_id')}, whole AS (SELECT dup.*, {', '.join('m.' + c for c in METRICS)} FROM dup LEFT JOIN metrics m ON dup.canonical_cell_id = m.cell_id)"
DECISION = f"""CASE WHEN signals < {LIGHT['signals']} OR coalesce(clusters < {LIGHT['clusters']}, true) THEN 'REJECT_LOW_DENSITY'
 WHEN active_pairs < {LIGHT['active_pairs']} OR active_years < {LIGHT['active_years']} OR top_pair_share > {LIGHT['top_pair_share']} OR top_year_share > {LIGHT['top_year_share']} THEN 'REJECT_CONCENTRATED'
 WHEN {NEAR}_median <= 0 OR {FAR}_median <= 0 OR excess_{NEAR}_median <= 0 OR excess_{FAR}_median <= 0 THEN 'REJECT_NO_FORWARD_EDGE'
 WHEN signals >= {ROBUST['signals']} AND clusters >= {ROBUST['clusters']} AND active_pairs >= {ROBUST['active_pairs']} AND active_years >= {ROBUST['active_years']}
   AND top_pair_share <= {ROBUST['top_pair_share']} AND top_year_share <= {ROBUST['top_year_share']}
  AND cluster_excess_{NEAR}_median > 0 AND cluster_excess_{FAR}_median > 0 AND positive_years >= {ROBUST['positive_years']}
    AND positive_pairs >= {ROBUST['positive_pairs']} AND passes_train AND passes_validation THEN 'ROBUST_RESEARCH_CANDIDATE'
 ELSE 'RESEARCH_CANDIDATE_LIGHT' END AS decision"""
book.add("surface_metrics", lambda s, d: whole_surface(s, d).select("cell_id", "signals", *METRICS), f"{SURFACE} SELECT cell_id, signals, {', '.join(METRICS)} FROM whole", DOUBLES)
book.add("surface_decisions", lambda s, d: whole_surface(s, d).select("cell_id", "decision"), f"{SURFACE} SELECT cell_id, {DECISION} FROM whole")
book.add("decision_counts", lambda s, d: whole_surface(s, d).groupBy("decision").agg(F.count("*").alias("cells")), f"{SURFACE}, x AS (SELECT {DECISION} FROM whole) SELECT decision, count(*) AS cells FROM x GROUP BY decision")
SEED = {"price_z_threshold": 1.6, "rsi_threshold": 42.0, "vol_z_threshold": -0.5, "bb_width_threshold": 0.3, "use_weak_trend": True, "use_breakout_block": False, "use_below_band": False}


def manifest(s, d):
    df = whole_surface(s, d).where("not is_duplicate_signal_set and clusters >= 20")
    df = df.withColumns({"cluster_excess_far": F.round(f"cluster_excess_{FAR}_median", 9), "cluster_excess_near": F.round(f"cluster_excess_{NEAR}_median", 9)})
    return surface.freeze_manifest(df, 3, SEED)


def manifest_sql() -> str:
    orders = {**surface.BUCKETS, "nearest_to_seed": (("seed_distance", False), ("cluster_excess_far", True), ("clusters", True))}
    ranks = ", ".join(f"row_number() OVER (ORDER BY {', '.join(f'{c} {"DESC" if down else "ASC"} NULLS LAST' for c, down in order)}, cell_id) AS r{k}" for k, order in enumerate(orders.values()))
    picks = " UNION ALL ".join(f"SELECT *, {k} AS no, '{b}' AS bucket, r{k} AS rank FROM ranked WHERE r{k} <= {1 if b == 'nearest_to_seed' else 3}" for k, b in enumerate(orders))
    distance = " + ".join(f"CAST({c} <> {str(v).lower()} AS DOUBLE)" if isinstance(v, bool) else f"abs({c} - {v})" for c, v in SEED.items())
    score = "CAST(use_weak_trend AS INTEGER) + CAST(use_breakout_block AS INTEGER) + CAST(use_below_band AS INTEGER) + CAST(vol_z_threshold > 0 AS INTEGER) + CAST(bb_width_threshold > 0 AS INTEGER)"
    return f"""{SURFACE}, base AS (SELECT *, round(cluster_excess_{FAR}_median, 9) AS cluster_excess_far, round(cluster_excess_{NEAR}_median, 9) AS cluster_excess_near,
      {score} AS simplicity_score, {distance} AS seed_distance FROM whole WHERE cell_id = canonical_cell_id AND clusters >= 20),
ranked AS (SELECT *, {ranks} FROM base), picked AS ({picks}), firsts AS (SELECT cell_id, first(bucket ORDER BY no, rank) AS selection_bucket, string_agg(bucket,
      ';' ORDER BY no) AS selection_buckets, min(rank) AS selection_rank, any_value(cluster_excess_far) AS cluster_excess_far FROM picked GROUP BY cell_id),
manifest AS (SELECT *, printf('RFC%03d', row_number() OVER (ORDER BY selection_rank, cluster_excess_far DESC, cell_id)) AS candidate_id FROM firsts)"""


book.add("manifest", manifest, f"{manifest_sql()} SELECT cell_id, selection_bucket, selection_buckets, selection_rank, cluster_excess_far, candidate_id FROM manifest", "cluster_excess_far")
book.add("bucket_counts", lambda s, d: surface.bucket_counts(manifest(s, d)), f"{manifest_sql()}, e AS (SELECT candidate_id, unnest(string_split(selection_buckets, ';')) AS bucket FROM manifest) SELECT bucket, count(DISTINCT candidate_id) AS candidates FROM e GROUP BY bucket")

book.add(
    "canonical_manifest",
    lambda s, d: compare.canonical_manifest(surface.fingerprints(candidates(s, d), GRID).where("signals > 0").select("signal_set", F.format_string("C%04d", "cell_id").alias("candidate_id"), F.format_string("Z%d", F.col("level_price_z")).alias("source_id"), (~F.col("use_weak_trend")).alias("is_original"), F.col("signals").cast("double").alias("excess_far"))).drop("signal_set"),
    f"{WITH_NULLS}, {CELLS} SELECT first(printf('C%04d', cell_id) ORDER BY use_weak_trend, cell_id) AS canonical_id, string_agg(printf('C%04d', cell_id), ',' ORDER BY cell_id) AS alias_ids, string_agg(DISTINCT 'Z' || level_price_z, ',' ORDER BY 'Z' || level_price_z) AS source_ids, count(*) AS members FROM dup WHERE signals > 0 GROUP BY signal_set",
)
