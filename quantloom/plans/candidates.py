"""Queries that hold candidates against simple rules, against themselves without a filter and against waiting for a
rebound, and the chain of decisions that follows from it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quantloom.functions.columns import calendar, flag
from quantloom.functions.tables import written
from quantloom.operators import compare, events, gates, nulls, removals, rows, signals, surface
from quantloom.plans import frames
from quantloom.plans.book import Book
from quantloom.plans.research import DOUBLES, DRAWS, FAR, FORWARD, GAP, METRICS, NEAR, SPLIT, metrics_sql, nulls_sql
from quantloom.plans.study import LOOSE, WITH, flush_sql

book = Book()
#: Resamples of the registered queries, and minima that daily bars can reach.
RESAMPLES, LEAST = 200, 30
CANDIDATES = {
    "RFC001": signals.Flush(1.3, 46.0, -0.5, 0.3, weak_trend=True, breakout_block=True),
    "RFC002": signals.Flush(1.0, 50.0, -1.0, 0.01, weak_trend=True),
    "RFC003": signals.Flush(1.6, 42.0, -0.5, 0.3, breakout_block=True),
    "RFC004": signals.Flush(1.9, 46.0, -1.0, 0.01),
    "RFC005": signals.Flush(1.0, 42.0, 0.5, 0.01, below_band=True),
    "RFC007": signals.Flush(1.0, 42.0, 0.5, 0.01, weak_trend=True, breakout_block=True),
    "RFC008": signals.Flush(1.9, 42.0, 0.5, 0.3),
    "RFC006": signals.Flush(1.3, 50.0, -1.0, 0.3, weak_trend=True, breakout_block=True, below_band=True),
}


def specs() -> list:
    """(label, mask) of every component of every candidate, and of every baseline once."""
    own = [(f"{c}:{name}", mask) for c, f in CANDIDATES.items() for name, mask in signals.component_masks(f)]
    return own + list({f"base:{name}": mask for f in CANDIDATES.values() for name, mask in signals.baseline_specs(f)}.items())


def pairs() -> list[tuple[str, str]]:
    """(candidate, label of one of its baselines)"""
    return [(c, f"base:{name}") for c, f in CANDIDATES.items() for name in signals.baseline_names(f)]


def labelled(s, d):
    """(component, event) rows: immediate entries, baselines, and entries after a rebound, with matched controls."""
    df = events.excursions(events.forward_returns(frames.features(s, d), (6, 12)), 24)
    df = written(calendar(rows.own(signals.confirmations(df))), "candidate-bars")
    c = F.col
    broad = flag(c("price_z") < -LOOSE.price_z) | flag(c("rsi") < LOOSE.rsi) | flag(c("close") < c("bb_lower"))
    waiting = signals.masks_to_rows(df.where("confirm_price > 0"), [(k, signals.flush_mask(f)) for k, f in CANDIDATES.items()], "candidate")
    waiting = waiting.select("candidate", "pair", c("confirm_ts").alias("ts"), "confirm_delay", "missed_move")
    later = waiting.select("pair", "ts").distinct().withColumn("_later", F.lit(True))
    needed = df.drop("confirm_delay", "confirm_ts", "confirm_price", "missed_move").withColumn("is_broad", broad)
    needed = needed.join(later, ["pair", "ts"], "left").where("is_broad or _later").drop("_later")
    found = written(nulls.matched_null(needed, df.where(c(FAR).isNotNull()), ["pair", "year"], [NEAR, FAR], DRAWS, GAP), "candidate-events")
    at_once = signals.masks_to_rows(found.where("is_broad"), specs())
    labels = F.array_compact(F.array(*(F.when(c("confirm_delay") <= k, F.concat("candidate", F.lit(f":rebound_{k}"))) for k in (1, 3))))
    after = waiting.withColumn("component", F.explode(labels)).drop("candidate").join(found, ["pair", "ts"])
    return at_once.unionByName(after, allowMissingColumns=True)


def firsts_of(s, d):
    """Cluster-first events of every component, written."""
    return written(events.cluster_events(labelled(s, d), ("component", "pair"), GAP, sizes=False).where("is_cluster_first"), "candidate-firsts")


def evidence(s, d):
    """Metrics of every component and its cluster-first events, both written."""
    found = written(events.cluster_events(labelled(s, d), ("component", "pair"), GAP, sizes=False), "candidate-rows")
    metrics = surface.clustered_metrics(found, ["component"], NEAR, FAR, SPLIT)
    waits = found.groupBy("component").agg(F.percentile("confirm_delay", F.lit(0.5)).alias("confirm_delay_median"), F.percentile("missed_move", F.lit(0.5)).alias("missed_move_median"))
    return written(metrics.join(waits, "component"), "candidate-metrics"), found.where("is_cluster_first")


def drawn(firsts, seed="boot-1"):
    return written(compare.resampled_medians(firsts, ["component"], f"excess_{FAR}", RESAMPLES, seed), "candidate-draws")


def judged(s, d):
    """Metrics of every component, and the medians of its resamples."""
    metrics, firsts = evidence(s, d)
    return metrics, drawn(firsts)


# --- the same in SQL
def mask_sql() -> dict[str, str]:
    own = {}
    for k, f in CANDIDATES.items():
        parts = (("original", f), ("no_weak_trend", replace(f, weak_trend=False)), ("no_breakout_block", replace(f, breakout_block=False)))
        own |= {f"{k}:{name}": flush_sql(part) for name, part in parts}
        own[f"{k}:z_rsi_only"] = f"price_z < -{f.price_z} AND rsi < {f.rsi}"
        z, r = f"price_z < -{f.price_z}", f"rsi < {f.rsi}"
        texts = [z, r, f"{z} AND {r}", "close < bb_lower", f"close < bb_lower AND {r}", f"vol_z > {f.vol_z_min} AND {z}", f"bb_width > {f.bb_width_min} AND {z}"]
        own |= {f"base:{name}": text for name, text in zip(signals.baseline_names(f), texts, strict=True)}
    return own


def resample_sql(out: str, source: str, key: str, value: str, n: int = RESAMPLES, seed: str = "boot-1", where: str = "true") -> str:
    """``out``: (key, draw, med), the twin of resampled_medians."""
    return f"""{out}_p AS (SELECT {key}, CAST({value} AS DOUBLE) AS v, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY {key}) AS size FROM {source}
      WHERE {value} IS NOT NULL AND {where} WINDOW w AS (PARTITION BY {key} ORDER BY ts, pair)),
{out}_d AS (SELECT {key}, draw, CAST('0x' || substr(md5(concat_ws('|', '{seed}', {key}, draw, place)), 1, 8) AS BIGINT) % size AS place FROM {out}_p, range({n}) r(draw)),
{out} AS (SELECT {key}, draw, quantile_cont(v, 0.5) AS med FROM {out}_d JOIN {out}_p USING ({key}, place) GROUP BY {key}, draw)"""


WAITS = [", ".join(f"lead({c}, {k}) OVER v AS {c}_{k}" for k in ks) for c, ks in (("bounce", (1, 2, 3)), ("ts", (1, 2, 3)), ("open", (2, 3, 4)))]
PICK = lambda name, first: f"CASE WHEN bounce_1 THEN {name}_{first} WHEN bounce_2 THEN {name}_{first + 1} WHEN bounce_3 THEN {name}_{first + 2} END"
LABELLED = f"""{WITH}, {FORWARD}, fw2 AS (SELECT *, coalesce(price_z < -{LOOSE.price_z}, false) OR coalesce(rsi < {LOOSE.rsi}, false) OR coalesce(close < bb_lower, false) AS is_broad
      FROM fw),
up AS (SELECT *, coalesce(close > open AND close > bb_lower, false) AS bounce FROM fw), ahead AS (SELECT *, {", ".join(WAITS)} FROM up
      WINDOW v AS (PARTITION BY pair ORDER BY ts)),
conf AS (SELECT *, CASE WHEN bounce_1 THEN 1 WHEN bounce_2 THEN 2 WHEN bounce_3 THEN 3 END AS confirm_delay, {PICK("ts", 1)} AS confirm_ts,
      {PICK("open", 2)} AS confirm_price FROM ahead),
waiting AS ({" UNION ALL ".join(f"SELECT '{k}' AS candidate, pair, confirm_ts, confirm_delay, (confirm_price - entry_price) / nullif(entry_price, 0) AS missed_move FROM conf WHERE confirm_price > 0 AND {flush_sql(f)}" for k, f in CANDIDATES.items())}),
needed AS (SELECT * FROM fw2 WHERE is_broad OR (pair, ts) IN (SELECT (pair, confirm_ts) FROM waiting)),
{nulls_sql("needed", "ev")},
labelled AS ({" UNION ALL ".join(f"SELECT '{n}' AS component, CAST(NULL AS INTEGER) AS confirm_delay, CAST(NULL AS DOUBLE) AS missed_move, ev.* FROM ev WHERE is_broad AND {c}" for n, c in mask_sql().items())}
  {" ".join(f"UNION ALL SELECT candidate || ':rebound_{k}', confirm_delay, missed_move, ev.* FROM waiting JOIN ev ON waiting.pair = ev.pair AND waiting.confirm_ts = ev.ts WHERE confirm_delay <= {k}" for k in (1, 3))}),
{metrics_sql("labelled", "component")},
waits AS (SELECT component, quantile_cont(confirm_delay, 0.5) AS confirm_delay_median, quantile_cont(missed_move, 0.5) AS missed_move_median FROM labelled
      GROUP BY component),
firsts AS (SELECT * FROM marked WHERE is_first)"""
BOOT = f"{LABELLED}, {resample_sql('boot', 'firsts', 'component', f'excess_{FAR}')}, ci AS (SELECT component, quantile_cont(med, 0.025) AS ci_low, quantile_cont(med, 0.975) AS ci_high FROM boot GROUP BY component)"
WAIT_COLUMNS = ["confirm_delay_median", "missed_move_median"]
book.add(
    "component_metrics",
    lambda s, d: evidence(s, d)[0].select("component", "signals", *METRICS, *WAIT_COLUMNS),
    f"{LABELLED} SELECT component, signals, {', '.join(METRICS)}, {', '.join(WAIT_COLUMNS)} FROM metrics JOIN waits USING (component)",
    f"{DOUBLES} {' '.join(WAIT_COLUMNS)}",
)
book.add(
    "bootstrap_median",
    lambda s, d: compare.bootstrap_median_ci(firsts_of(s, d), ["component"], f"excess_{FAR}", RESAMPLES),
    f"{BOOT}, n AS (SELECT component, count(excess_{FAR}) AS n, quantile_cont(excess_{FAR}, 0.5) AS median FROM firsts GROUP BY component) SELECT * FROM n LEFT JOIN ci USING (component)",
    "median ci_low ci_high",
)
SIDES = {"a": "RFC002:original", "b": "base:close_below_bb_lower"}


def sided(s, d):
    side = F.when(F.col("component") == SIDES["a"], "a").when(F.col("component") == SIDES["b"], "b")
    return firsts_of(s, d).withColumn("side", side).where("side is not null")


book.add(
    "bootstrap_delta",
    lambda s, d: compare.bootstrap_delta_ci(sided(s, d), ["pair"], "side", f"excess_{FAR}", RESAMPLES),
    f"""{LABELLED}, sided AS (SELECT *, CASE component WHEN '{SIDES["a"]}' THEN 'a' ELSE 'b' END AS side FROM firsts WHERE component IN ('{SIDES["a"]}', '{SIDES["b"]}')),
    {resample_sql('boot', 'sided', 'pair, side', f'excess_{FAR}')},
    n AS (SELECT pair, count(excess_{FAR}) FILTER (side = 'a') AS n_a, count(excess_{FAR}) FILTER (side = 'b') AS n_b, quantile_cont(excess_{FAR},
      0.5) FILTER (side = 'a') - quantile_cont(excess_{FAR}, 0.5) FILTER (side = 'b') AS delta FROM sided GROUP BY pair),
    ci AS (SELECT a.pair, quantile_cont(a.med - b.med, 0.025) AS ci_low, quantile_cont(a.med - b.med, 0.975) AS ci_high FROM boot a JOIN boot b ON a.pair = b.pair
      AND a.draw = b.draw AND a.side = 'a' AND b.side = 'b' GROUP BY a.pair)
    SELECT * FROM n LEFT JOIN ci USING (pair)""",
    "delta ci_low ci_high",
)


def comparison(s, metrics, resampled):
    """Deltas of every candidate against each of its seven baselines, their interval, and the decision."""
    names = {"clusters": "clusters", "near": f"cluster_excess_{NEAR}_median", "far": f"cluster_excess_{FAR}_median", "validation": "validation_excess_median", "positive_pairs": "positive_pairs", "positive_years": "positive_years"}
    listed = s.createDataFrame([(c, f"{c}:original", b) for c, b in pairs()], "candidate_id string, a string, b string")
    side = lambda k, p: metrics.select(F.col("component").alias(k), *(F.col(c).alias(f"{p}_{n}") for n, c in names.items()))
    df = listed.join(side("a", "candidate"), "a").join(side("b", "baseline"), "b")
    df = df.withColumns({f"delta_{k}": F.col(f"candidate_{k}") - F.col(f"baseline_{k}") for k in ("near", "far", "validation")})
    df = df.join(compare.delta_intervals(resampled, "component", listed, "delta_far_"), ["a", "b"], "left")
    return df.withColumns({"baseline": F.substring_index("b", ":", -1), "decision": gates.classify_baseline(LEAST)})


COMPARE = f"""{BOOT}, listed(candidate_id, a, b) AS (VALUES {", ".join(f"('{c}', '{c}:original', '{b}')" for c, b in pairs())}),
pick AS (SELECT component, clusters, cluster_excess_{NEAR}_median AS near, cluster_excess_{FAR}_median AS far, validation_excess_median AS validation, positive_pairs,
      positive_years FROM metrics),
dci AS (SELECT l.a, l.b, quantile_cont(x.med - y.med, 0.025) AS delta_far_ci_low, quantile_cont(x.med - y.med, 0.975) AS delta_far_ci_high
  FROM (SELECT DISTINCT a, b FROM listed) l JOIN boot x ON x.component = l.a JOIN boot y ON y.component = l.b AND y.draw = x.draw GROUP BY ALL),
compared AS (SELECT candidate_id, split_part(l.b, ':', 2) AS baseline, a.clusters AS candidate_clusters, b.clusters AS baseline_clusters, a.near - b.near AS delta_near,
      a.far - b.far AS delta_far, a.validation - b.validation AS delta_validation,
  delta_far_ci_low, delta_far_ci_high, a.positive_pairs >= b.positive_pairs - 1 AND a.positive_years >= b.positive_years - 1 AS broad
  FROM listed l JOIN pick a ON a.component = l.a JOIN pick b ON b.component = l.b LEFT JOIN dci ON dci.a = l.a AND dci.b = l.b),
judged AS (SELECT *, coalesce(delta_near > 0 AND delta_far > 0 AND delta_validation > 0 AND broad, false) AS beats FROM compared),
decided AS (SELECT *, CASE WHEN candidate_clusters < {LEAST} THEN 'INSUFFICIENT_CANDIDATE_SAMPLE' WHEN baseline_clusters < {LEAST} THEN 'INSUFFICIENT_BASELINE_SAMPLE'
  WHEN delta_near IS NULL OR delta_far IS NULL OR delta_validation IS NULL THEN 'BASELINE_UNDERPERFORMER' WHEN beats AND delta_far_ci_low > 0 THEN 'BASELINE_BEATER_CI'
    WHEN beats THEN 'BASELINE_BEATER_POINT'
  WHEN abs(delta_far) <= 0.0025 AND abs(delta_validation) <= 0.0025 THEN 'BASELINE_EQUIVALENT' ELSE 'BASELINE_UNDERPERFORMER' END AS decision FROM judged)"""
COLUMNS = ["candidate_id", "baseline", "candidate_clusters", "baseline_clusters", "delta_near", "delta_far", "delta_validation", "delta_far_ci_low", "delta_far_ci_high", "decision"]
book.add("baseline_comparison", lambda s, d: comparison(s, *judged(s, d)).select(*COLUMNS), f"{COMPARE} SELECT {', '.join(COLUMNS)} FROM decided", "delta_near delta_far delta_validation delta_far_ci_low delta_far_ci_high")
COUNTED = ", ".join(f"count(*) FILTER (decision = 'BASELINE_{label}') AS {name}" for label, name in (("BEATER_CI", "ci_wins"), ("BEATER_POINT", "point_wins"), ("UNDERPERFORMER", "under"), ("EQUIVALENT", "equivalent")))
SUMMARY = f"""{COMPARE}, counted AS (SELECT candidate_id, count(*) FILTER (NOT starts_with(decision, 'INSUFFICIENT')) AS eligible, {COUNTED},
      min(delta_far) FILTER (NOT starts_with(decision, 'INSUFFICIENT')) AS worst_delta_far FROM decided GROUP BY candidate_id),
summary AS (SELECT *, CASE WHEN eligible < 3 THEN 'INSUFFICIENT_BASELINE_COVERAGE' WHEN ci_wins >= 2 AND under = 0 THEN 'SURVIVES_BASELINES_STRONG'
      WHEN ci_wins + point_wins >= 3 AND under <= 1 THEN 'SURVIVES_BASELINES_WEAK'
  WHEN equivalent >= greatest(2, floor(eligible / 2)) THEN 'BASELINE_EQUIVALENT' ELSE 'FAILS_BASELINES' END AS candidate_decision FROM counted)"""
book.add("baseline_summary", lambda s, d: gates.baseline_summary(comparison(s, *judged(s, d))), f"{SUMMARY} SELECT * FROM summary", "worst_delta_far")


# --- components, recommendations, selection
def components(metrics, resampled):
    """Every component of every candidate against the immediate entry, with the decision."""
    own = metrics.where("component not like 'base:%'").join(compare.interval(resampled, ["component"]), "component", "left")
    own = own.select(F.substring_index("component", ":", 1).alias("candidate_id"), F.substring_index("component", ":", -1).alias("component"), "clusters", "ci_low", F.col(f"cluster_excess_{FAR}_median").alias("excess_far"), F.col("mae_median").alias("mae"), *WAIT_COLUMNS)
    at_once = own.where("component = 'original'").select("candidate_id", *(F.col(c).alias(f"immediate_{c}") for c in ("clusters", "excess_far", "mae")))
    return own.join(at_once, "candidate_id").withColumn("decision", gates.classify_component(LEAST))


PARTS = ["candidate_id", "component", "clusters", "ci_low", "excess_far", "mae", *WAIT_COLUMNS, "decision"]
DIAGNOSED = f"""own AS (SELECT split_part(component, ':', 1) AS candidate_id, split_part(component, ':', 2) AS component, clusters, ci_low, cluster_excess_{FAR}_median AS excess_far,
      mae_median AS mae, {", ".join(WAIT_COLUMNS)}
  FROM metrics JOIN waits USING (component) LEFT JOIN ci USING (component) WHERE component NOT LIKE 'base:%'),
diagnosed AS (SELECT p.*, CASE WHEN p.clusters < {LEAST} THEN 'INSUFFICIENT_COMPONENT_SAMPLE' WHEN p.ci_low <= 0 THEN 'DROP_COMPONENT'
  WHEN starts_with(p.component, 'rebound') AND p.mae > o.mae AND p.excess_far >= o.excess_far - 0.0025 THEN 'KEEP_REBOUND_CONFIRMATION'
  WHEN starts_with(p.component, 'no_') AND p.excess_far >= o.excess_far - 0.0025
    AND p.clusters > o.clusters THEN 'SIMPLIFY_FILTERS' ELSE 'KEEP_IMMEDIATE_FLUSH' END AS decision
  FROM own p JOIN own o ON p.candidate_id = o.candidate_id AND o.component = 'original')"""
book.add("component_decisions", lambda s, d: components(*judged(s, d)).select(*PARTS), f"{BOOT}, {DIAGNOSED} SELECT {', '.join(PARTS)} FROM diagnosed", "ci_low excess_far mae confirm_delay_median missed_move_median")
WIDE = ["original", "no_weak_trend", "no_breakout_block", "z_rsi_only", "rebound_1", "rebound_3"]


def recommended(s, d):
    found = judged(s, d)
    return gates.recommendations(gates.baseline_summary(comparison(s, *found)), components(*found))


RECOMMENDED = f"""{SUMMARY}, {DIAGNOSED}, wide AS (SELECT candidate_id, {", ".join(f"max(decision) FILTER (component = '{c}') AS {c}" for c in WIDE)} FROM diagnosed GROUP BY candidate_id),
dropped AS (SELECT summary.*, wide.* EXCLUDE (candidate_id), concat_ws(';', CASE WHEN no_weak_trend = 'SIMPLIFY_FILTERS' THEN 'DROP_WEAK_TREND_GATE' END, CASE
      WHEN no_breakout_block = 'SIMPLIFY_FILTERS' THEN 'DROP_BREAKOUT_BLOCK' END) AS simplifications
  FROM summary LEFT JOIN wide USING (candidate_id)),
recommended AS (SELECT *, CASE WHEN candidate_decision NOT IN ('SURVIVES_BASELINES_STRONG', 'SURVIVES_BASELINES_WEAK') THEN 'DO_NOT_ADVANCE_BASELINE_GATE'
      WHEN original = 'DROP_COMPONENT' THEN 'REJECT_COMPONENT_FAILURE'
  WHEN rebound_1 = 'KEEP_REBOUND_CONFIRMATION' OR rebound_3 = 'KEEP_REBOUND_CONFIRMATION' THEN 'RETEST_REBOUND_CONFIRMATION'
    WHEN simplifications <> '' THEN 'TEST_SIMPLIFIED_IMMEDIATE_FLUSH'
  WHEN original = 'KEEP_IMMEDIATE_FLUSH' THEN 'KEEP_ORIGINAL_IMMEDIATE_FLUSH'
    WHEN original = 'INSUFFICIENT_COMPONENT_SAMPLE' THEN 'HOLD_FOR_MORE_SAMPLE' ELSE 'NO_RESEARCH_ADVANCE' END AS next_step FROM dropped)"""
book.add(
    "recommendations",
    lambda s, d: recommended(s, d).select("candidate_id", "candidate_decision", *WIDE, "simplifications", "next_step"),
    f"{RECOMMENDED} SELECT candidate_id, candidate_decision, {', '.join(WIDE)}, simplifications, next_step FROM recommended",
)


def ranked(s, d):
    """Candidates in the order in which to go on with them, with the reason; the deciding numbers rounded, so that their last digits do not decide."""
    found = judged(s, d)
    parts = components(*found).withColumns({c: F.round(c, 9) for c in ("ci_low", "excess_far")})
    return gates.ranked_recommendations(gates.recommendations(gates.baseline_summary(comparison(s, *found)), parts), parts)


def order_sql(column: str, names) -> str:
    places = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(names))
    return f"CASE {column} {places} ELSE 99 END"


WHY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gates.RATIONALE.items())
book.add(
    "ranked_recommendations",
    lambda s, d: ranked(s, d).select("candidate_id", "candidate_decision", "next_step", "rationale", "rank"),
    f"""{RECOMMENDED} SELECT candidate_id, candidate_decision, next_step, CASE next_step {WHY} END AS rationale, CAST(row_number() OVER (ORDER BY
      {order_sql("candidate_decision", gates.BASELINE_ORDER)}, {order_sql("next_step", gates.RATIONALE)}, ci_wins DESC, round(o.ci_low, 9) DESC NULLS LAST, round(o.excess_far, 9) DESC NULLS LAST,
      o.clusters DESC NULLS LAST, candidate_id) AS INTEGER) AS rank
    FROM recommended r LEFT JOIN (SELECT candidate_id, ci_low, excess_far, clusters FROM diagnosed WHERE component = 'original') o USING (candidate_id)""",
)
STRONG, WEAK, NEAREST = 2, 2, "RFC006"
GATED = ", ".join(f"('{k}', {str(f.weak_trend).lower()}, {str(f.breakout_block).lower()})" for k, f in CANDIDATES.items())


def selected(s, d):
    known = s.createDataFrame([(k, f.weak_trend, f.breakout_block) for k, f in CANDIDATES.items()], "candidate_id string, use_weak_trend boolean, use_breakout_block boolean")
    ranked = recommended(s, d).withColumn("worst_delta_far", F.round("worst_delta_far", 9)).join(known, "candidate_id")
    return compare.fixed_definitions(compare.select_candidates(ranked, STRONG, WEAK, NEAREST))


book.add(
    "selected_candidates",
    lambda s, d: selected(s, d).select("candidate_id", "place", "fixed_candidate_id", "use_weak_trend", "use_breakout_block", "is_original"),
    f"""{RECOMMENDED}, known(candidate_id, wt, bb) AS (VALUES {GATED}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_decision ORDER BY CASE
      WHEN candidate_decision = 'SURVIVES_BASELINES_STRONG' THEN ci_wins ELSE point_wins END DESC, round(worst_delta_far, 9) DESC, candidate_id) AS r,
      simplifications LIKE '%DROP_WEAK_TREND_GATE%' AS nw, simplifications LIKE '%DROP_BREAKOUT_BLOCK%' AS nb FROM recommended JOIN known USING (candidate_id)),
    placed AS (SELECT *, CASE WHEN candidate_decision = 'SURVIVES_BASELINES_STRONG' AND r <= {STRONG} THEN r WHEN candidate_decision = 'SURVIVES_BASELINES_WEAK'
      AND r <= {WEAK} THEN 1000 + r WHEN candidate_id = '{NEAREST}' THEN 2000 END AS place FROM ranked)
    SELECT candidate_id, CAST(place AS INTEGER) AS place, candidate_id || CASE WHEN nw THEN '_NW' ELSE '' END || CASE
      WHEN nb THEN '_NB' ELSE '' END AS fixed_candidate_id, wt AND NOT nw AS use_weak_trend, bb AND NOT nb AS use_breakout_block,
      NOT nw AND NOT nb AS is_original FROM placed WHERE place IS NOT NULL""",
)


# --- fixed candidates
def originals(firsts):
    return firsts.where("component like '%:original'")


def fixed_report(s, d):
    """Metrics of the fixed candidates with the intervals of all clusters and of the later ones, and the decision."""
    metrics, firsts = evidence(s, d)
    firsts = originals(firsts)
    whole = compare.interval(drawn(firsts), ["component"], prefix="excess_")
    late = compare.interval(drawn(firsts.where(F.col("ts") >= F.lit(SPLIT).cast("timestamp")), "boot-validation"), ["component"], prefix="validation_")
    cost = compare.cost_stress_clusters(firsts, ["component"], FAR, SPLIT, (20,)).select("component", F.col("net_excess_median").alias("net_excess_20"))
    df = metrics.join(cost, "component").join(whole, "component", "left").join(late, "component", "left")
    return df.select("component", "clusters", "net_excess_20", "excess_ci_low", "validation_ci_low", gates.classify_fixed(LEAST).alias("decision"))


book.add(
    "fixed_candidates",
    fixed_report,
    f"""{BOOT}, {resample_sql("late", "firsts", "component", f"excess_{FAR}", seed="boot-validation", where=f"ts >= '{SPLIT}'")}, late_ci AS (SELECT component,
      quantile_cont(med, 0.025) AS validation_ci_low FROM late GROUP BY component),
    cost AS (SELECT component, quantile_cont(excess_{FAR} - 20 / 10000.0::DOUBLE, 0.5) AS net_excess_20 FROM firsts GROUP BY component)
    SELECT component, clusters, net_excess_20, ci_low AS excess_ci_low, validation_ci_low, CASE WHEN clusters < {LEAST} THEN 'REJECT_LOW_DENSITY'
      WHEN ci_low <= 0 THEN 'REJECT_CI_FRAGILITY' WHEN validation_ci_low <= 0 THEN 'RESEARCH_ADVANCE_VALIDATION_WATCH'
      WHEN top_pair_cluster_share > 0.30 OR top_year_cluster_share > 0.40 THEN 'RESEARCH_ADVANCE_CONCENTRATION_WATCH'
        WHEN net_excess_20 <= 0 THEN 'RESEARCH_ADVANCE_COST_WATCH' ELSE 'FIXED_RESEARCH_CANDIDATE' END AS decision
    FROM metrics JOIN cost USING (component) LEFT JOIN ci USING (component) LEFT JOIN late_ci USING (component) WHERE component LIKE '%:original'""",
    "net_excess_20 excess_ci_low validation_ci_low",
)
book.add(
    "cost_stress_clusters",
    lambda s, d: compare.cost_stress_clusters(originals(firsts_of(s, d)), ["component"], FAR, SPLIT, least=LEAST),
    f"""{LABELLED}, n AS (SELECT component, bps AS cost_bps, count(*) AS clusters, quantile_cont({FAR} - bps / 10000.0::DOUBLE, 0.5) AS net_median,
      quantile_cont(excess_{FAR} - bps / 10000.0::DOUBLE, 0.5) AS net_excess_median,
      quantile_cont(CASE WHEN ts >= '{SPLIT}' THEN excess_{FAR} - bps / 10000.0::DOUBLE END, 0.5) AS net_validation_median,
        avg(CAST({FAR} - bps / 10000.0::DOUBLE > 0 AS DOUBLE)) AS net_win_rate
      FROM firsts, (VALUES (0), (10), (20), (40)) c(bps) WHERE component LIKE '%:original' GROUP BY component, bps)
    SELECT *, coalesce(clusters >= {LEAST} AND net_excess_median > 0 AND net_validation_median > 0, false) AS survives_cost FROM n""",
    "net_median net_excess_median net_validation_median net_win_rate",
)
GROUPED = ("pair", "year", "month")
book.add(
    "grouped_concentration",
    lambda s, d: compare.grouped_concentration(originals(firsts_of(s, d)), ["component"], GROUPED, FAR, 5),
    f"""{LABELLED}, n AS ({" UNION ALL ".join(f"SELECT component, '{g}' AS grouped_by, {g} AS value, count(*) AS clusters, quantile_cont({FAR}, 0.5) AS median, quantile_cont(excess_{FAR}, 0.5) AS excess_median FROM firsts WHERE component LIKE '%:original' GROUP BY component, {g}" for g in GROUPED)})
    SELECT *, clusters / sum(clusters) OVER (PARTITION BY component, grouped_by) AS share, CAST(row_number()
      OVER (PARTITION BY component, grouped_by ORDER BY clusters DESC, value) AS INTEGER) AS rank FROM n QUALIFY rank <= 5""",
    "median excess_median share",
)
book.add(
    "removal_concentration",
    lambda s, d: compare.removal_concentration(originals(firsts_of(s, d)), ["component"], FAR, SPLIT),
    f"""{LABELLED}, f AS (SELECT * FROM firsts WHERE component LIKE '%:original'),
      {", ".join(f"r_{g} AS (SELECT component, {g}, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, {g}) AS r FROM f GROUP BY component, {g})" for g in ("pair", "month"))},
    kept AS (SELECT 'remove_top_1_pair' AS analysis, f.*, r > 1 AS keep FROM f JOIN r_pair USING (component, pair)
      UNION ALL BY NAME SELECT 'remove_top_3_pairs' AS analysis, f.*, r > 3 AS keep FROM f JOIN r_pair USING (component, pair)
      UNION ALL BY NAME SELECT 'remove_top_1_month' AS analysis, f.*, r > 1 AS keep FROM f JOIN r_month USING (component, month)),
    n AS (SELECT component, analysis, count(*) FILTER (keep) AS clusters, count(*) FILTER (keep) / count(*) AS cluster_share, quantile_cont(excess_{FAR},
      0.5) FILTER (keep) AS excess_median, quantile_cont(excess_{FAR}, 0.5) FILTER (keep AND ts >= '{SPLIT}') AS validation_median FROM kept GROUP BY ALL)
    SELECT *, CASE WHEN excess_median > 0 AND validation_median > 0 THEN 'survives' ELSE 'weakens' END AS decision FROM n""",
    "cluster_share excess_median validation_median",
)
book.add(
    "leave_one_pair_out",
    lambda s, d: removals.leave_one_out_medians(originals(firsts_of(s, d)), ["component"], "pair", FAR, SPLIT),
    f"""{LABELLED}, f AS (SELECT * FROM firsts WHERE component LIKE '%:original'), p AS (SELECT DISTINCT component, pair FROM f),
    n AS (SELECT p.component, p.pair, count(*) FILTER (f.pair <> p.pair) AS clusters, count(*) FILTER (f.pair <> p.pair) / count(*) AS cluster_share,
      quantile_cont(excess_{FAR}, 0.5) FILTER (f.pair <> p.pair) AS excess_median, quantile_cont({FAR}, 0.5) FILTER (f.pair <> p.pair) AS forward_median,
      quantile_cont(excess_{FAR}, 0.5) FILTER (f.pair <> p.pair AND ts >= '{SPLIT}') AS validation_median FROM p JOIN f ON f.component = p.component GROUP BY ALL)
    SELECT *, CASE WHEN excess_median > 0 AND validation_median > 0 THEN 'survives' ELSE 'weakens' END AS decision FROM n""",
    "cluster_share excess_median forward_median validation_median",
)
