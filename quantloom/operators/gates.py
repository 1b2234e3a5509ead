"""Decision ladders: ordered tests over metric columns, first match wins. Minima are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import flag

#: Fixed research minima of a surface cell, and the stricter ones of a robust cell.
RESEARCH = {"signals": 100, "clusters": 50, "active_pairs": 6, "active_years": 4, "top_pair_share": 0.40, "top_year_share": 0.50}
ROBUST = {"signals": 500, "clusters": 200, "active_pairs": 8, "active_years": 5, "top_pair_share": 0.25, "top_year_share": 0.35, "positive_years": 4, "positive_pairs": 6}


def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for test, label in steps:
        out = F.when(flag(test), label) if out is None else out.when(flag(test), label)
    return out.otherwise(otherwise)


def classify_surface(near: str, far: str, light: dict = RESEARCH, robust: dict = ROBUST) -> Column:
    c = F.col
    # a missing median is no evidence of an edge below zero, but it cannot be robust either
    strong = (c("signals") >= robust["signals"]) & (c("clusters") >= robust["clusters"]) & (c("active_pairs") >= robust["active_pairs"]) & (c("active_years") >= robust["active_years"]) & (c("top_pair_share") <= robust["top_pair_share"]) & (c("top_year_share") <= robust["top_year_share"])
    strong = strong & (c(f"cluster_excess_{near}_median") > 0) & (c(f"cluster_excess_{far}_median") > 0) & (c("positive_years") >= robust["positive_years"]) & (c("positive_pairs") >= robust["positive_pairs"]) & c("passes_train") & c("passes_validation")
    return ladder(
        [
            ((c("signals") < light["signals"]) | F.coalesce(c("clusters") < light["clusters"], F.lit(True)), "REJECT_LOW_DENSITY"),
            ((c("active_pairs") < light["active_pairs"]) | (c("active_years") < light["active_years"]) | (c("top_pair_share") > light["top_pair_share"]) | (c("top_year_share") > light["top_year_share"]), "REJECT_CONCENTRATED"),
            (F.least(f"{near}_median", f"{far}_median", f"excess_{near}_median", f"excess_{far}_median") <= 0, "REJECT_NO_FORWARD_EDGE"),
            (strong, "ROBUST_RESEARCH_CANDIDATE"),
        ],
        "RESEARCH_CANDIDATE_LIGHT",
    )


def classify_baseline(least: int = 200, close: float = 0.0025) -> Column:
    """Candidate against baseline, over delta_near, delta_far, delta_validation and the breadth columns."""
    c = F.col
    known = c("delta_near").isNotNull() & c("delta_far").isNotNull() & c("delta_validation").isNotNull()
    beats = (c("delta_near") > 0) & (c("delta_far") > 0) & (c("delta_validation") > 0) & (c("candidate_positive_pairs") >= c("baseline_positive_pairs") - 1) & (c("candidate_positive_years") >= c("baseline_positive_years") - 1)
    return ladder(
        [
            (c("candidate_clusters") < least, "INSUFFICIENT_CANDIDATE_SAMPLE"),
            (c("baseline_clusters") < least, "INSUFFICIENT_BASELINE_SAMPLE"),
            (~known, "BASELINE_UNDERPERFORMER"),
            (beats & (c("delta_far_ci_low") > 0), "BASELINE_BEATER_CI"),
            (beats, "BASELINE_BEATER_POINT"),
            ((F.abs("delta_far") <= close) & (F.abs("delta_validation") <= close), "BASELINE_EQUIVALENT"),
        ],
        "BASELINE_UNDERPERFORMER",
    )


def baseline_summary(rows: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row per candidate over its baselines: wins, worst delta and a decision."""
    n = lambda label: F.count(F.when(F.col("decision") == label, 1))
    eligible = ~F.col("decision").startswith("INSUFFICIENT")
    out = rows.groupBy(key).agg(
        F.count(F.when(eligible, 1)).alias("eligible"), n("BASELINE_BEATER_CI").alias("ci_wins"), n("BASELINE_BEATER_POINT").alias("point_wins"), n("BASELINE_UNDERPERFORMER").alias("under"), n("BASELINE_EQUIVALENT").alias("equivalent"), F.min(F.when(eligible, F.col("delta_far"))).alias("worst_delta_far")
    )
    decision = ladder(
        [
            (F.col("eligible") < 3, "INSUFFICIENT_BASELINE_COVERAGE"),
            ((F.col("ci_wins") >= 2) & (F.col("under") == 0), "SURVIVES_BASELINES_STRONG"),
            ((F.col("ci_wins") + F.col("point_wins") >= 3) & (F.col("under") <= 1), "SURVIVES_BASELINES_WEAK"),
            (F.col("equivalent") >= F.greatest(F.lit(2), F.floor(F.col("eligible") / 2)), "BASELINE_EQUIVALENT"),
        ],
        "FAILS_BASELINES",
    )
    return out.withColumn("candidate_decision", decision)


def classify_component(least: int = 200, slack: float = 0.0025) -> Column:
    """Over clusters, ci_low, excess_far, mae and the immediate_ columns of the same candidate."""
    c = F.col
    holds = c("excess_far") >= c("immediate_excess_far") - slack
    return ladder(
        [
            (c("clusters") < least, "INSUFFICIENT_COMPONENT_SAMPLE"),
            (c("ci_low") <= 0, "DROP_COMPONENT"),
            (c("component").startswith("rebound") & (c("mae") > c("immediate_mae")) & holds, "KEEP_REBOUND_CONFIRMATION"),
            (c("component").startswith("no_") & holds & (c("clusters") > c("immediate_clusters")), "SIMPLIFY_FILTERS"),
        ],
        "KEEP_IMMEDIATE_FLUSH",
    )


def classify_fixed(least: int = 200) -> Column:
    c = F.col
    return ladder(
        [
            (c("clusters") < least, "REJECT_LOW_DENSITY"),
            (c("excess_ci_low") <= 0, "REJECT_CI_FRAGILITY"),
            (c("validation_ci_low") <= 0, "RESEARCH_ADVANCE_VALIDATION_WATCH"),
            ((c("top_pair_cluster_share") > 0.30) | (c("top_year_cluster_share") > 0.40), "RESEARCH_ADVANCE_CONCENTRATION_WATCH"),
            (c("net_excess_20") <= 0, "RESEARCH_ADVANCE_COST_WATCH"),
        ],
        "FIXED_RESEARCH_CANDIDATE",
    )


def classify_ledger(trades: int, validation: int, pairs: int, years: int, pair_share: float, year_share: float) -> Column:
    c = F.col
    return ladder(
        [
            (c("trades") <= 0, "NO_TRADES"),
            (c("trades") < trades, "INSUFFICIENT_TRADES"),
            ((c("validation_trades") < validation) | (c("validation_profit") <= 0), "VALIDATION_FAIL"),
            ((c("active_pairs") < pairs) | (c("active_years") < years), "INSUFFICIENT_BREADTH"),
            (c("profit_after_top_5") <= 0, "TOP_TRADE_CONCENTRATED"),
            ((c("profit_after_fee_2x") <= 0) | (c("profit_after_20bps") <= 0), "COST_SENSITIVE"),
            ((c("top_pair_profit_share") > pair_share) | (c("top_year_profit_share") > year_share), "CONCENTRATED_EDGE"),
            (c("profit") <= 0, "REJECT_PORTFOLIO"),
        ],
        "RESEARCH_STRATEGY_CANDIDATE",
    )


def failed_checks(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that do not hold, in order, as text; an unknown check fails."""
    return F.concat_ws(", ", *(F.when(~flag(test), F.lit(name)) for name, test in checks))


def resilience(profit: Column, trades: Column, base_profit: Column, base_trades: Column) -> Column:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return ladder([((trades <= 0) | (profit <= 0), "collapses"), ((share(profit, base_profit) < 0.5) | (share(trades, base_trades) < 0.6), "weakens materially")], "survives")


#: Fixed minima and limits of the strict gate.
STRICT = {"trades": 120, "windows": 4, "latest_positive": 2, "drawdown_pct": 10.0, "profit_factor": 1.15, "month_share": 0.35, "pair_share": 0.25}


def strict_checks(limits: dict = STRICT, allow_missing: bool = False) -> list[tuple[str, Column]]:
    """The nine checks of the strict gate over the columns of ``ledger.strict_gate``, in order."""
    c = F.col
    return [
        ("no_missing_snapshots", (c("missing_windows") == 0) | F.lit(allow_missing)),
        ("total_trades", c("total_trades") >= limits["trades"]),
        ("usable_windows", c("usable_windows") >= limits["windows"]),
        ("latest_positive_windows", c("latest_positive_windows") >= limits["latest_positive"]),
        ("max_drawdown_pct", c("max_drawdown_pct") <= limits["drawdown_pct"]),
        ("profit_factor", c("profit_factor_stressed") >= limits["profit_factor"]),
        ("avg_stressed_trade", c("avg_stressed_trade") > 0),
        ("month_concentration", c("max_month_profit_share") <= limits["month_share"]),
        ("pair_concentration", c("max_pair_profit_share") <= limits["pair_share"]),
    ]


def strict_decision(limits: dict = STRICT, allow_missing: bool = False) -> Column:
    return F.when(failed_checks(strict_checks(limits, allow_missing)) == "", "PROMOTE_PENDING_BIAS").otherwise("PARK")


def time_stress_status(profit: Column, trades: Column, least_trades: int = 10, least_profit: float = 100.0) -> Column:
    return ladder([((trades <= 0) | (profit <= 0), "collapses"), ((trades < least_trades) | (profit < least_profit), "weakens materially")], "survives")


def stability(profiles: DataFrame, key: str, label: str = "label", least: int = 5, share: float = 0.6) -> DataFrame:
    """One row per key: whether profiles around the one labelled "baseline" keep its profit and trades. Columns trades, profit."""
    c = F.col
    base = profiles.where(c(label) == "baseline").select(key, c("trades").alias("base_trades"), c("profit").alias("base_profit"))
    rows = profiles.where(c(label) != "baseline").join(base, key)
    bad = (c("profit") <= 0) | (c("trades") < F.greatest(F.lit(least), F.floor(c("base_trades") * share))) | (c("profit") < c("base_profit") * share)
    found = rows.groupBy(key).agg(F.count("*").alias("profiles"), F.count(F.when(bad, 1)).alias("weak_profiles"))
    out = base.select(key).join(found, key, "left").na.fill(0, ["profiles", "weak_profiles"])
    return out.withColumn("verdict", ladder([(c("profiles") == 0, "insufficient_data"), (c("weak_profiles") > 0, "fragile")], "stable"))


def lookahead(signals: Column, biased_entries: Column, biased_exits: Column) -> Column:
    return ladder([(signals <= 0, "LOOKAHEAD_NO_SIGNALS_VERIFIED"), ((biased_entries > 0) | (biased_exits > 0), "LOOKAHEAD_BIAS_DETECTED")], "LOOKAHEAD_CLEAN")


def readout(near: str, far: str) -> Column:
    """How far a strategy summary supports its signal."""
    c = F.col
    raw = (c(f"{near}_median") > 0) & (c(f"{far}_median") > 0)
    return ladder([(raw & (c(f"excess_{near}_median") > 0) & (c(f"excess_{far}_median") > 0), "raw and excess positive"), (raw, "raw positive, excess not confirmed")], "not durable")


SURVIVORS = ("SURVIVES_BASELINES_STRONG", "SURVIVES_BASELINES_WEAK")


def recommendations(summary: DataFrame, components: DataFrame) -> DataFrame:
    """One row per candidate: component decisions as columns, simplifications, the next step and why."""
    names = ["original", "no_weak_trend", "no_breakout_block", "z_rsi_only", "rebound_1", "rebound_3"]
    wide = components.groupBy("candidate_id").pivot("component", names).agg(F.first("decision"))
    c = F.col
    drop = F.concat_ws(";", F.when(flag(c("no_weak_trend") == "SIMPLIFY_FILTERS"), F.lit("DROP_WEAK_TREND_GATE")), F.when(flag(c("no_breakout_block") == "SIMPLIFY_FILTERS"), F.lit("DROP_BREAKOUT_BLOCK")))
    kept = flag(c("rebound_1") == "KEEP_REBOUND_CONFIRMATION") | flag(c("rebound_3") == "KEEP_REBOUND_CONFIRMATION")
    step = ladder(
        [
            (~c("candidate_decision").isin(*SURVIVORS), "DO_NOT_ADVANCE_BASELINE_GATE"),
            (c("original") == "DROP_COMPONENT", "REJECT_COMPONENT_FAILURE"),
            (kept, "RETEST_REBOUND_CONFIRMATION"),
            (c("simplifications") != "", "TEST_SIMPLIFIED_IMMEDIATE_FLUSH"),
            (c("original") == "KEEP_IMMEDIATE_FLUSH", "KEEP_ORIGINAL_IMMEDIATE_FLUSH"),
            (c("original") == "INSUFFICIENT_COMPONENT_SAMPLE", "HOLD_FOR_MORE_SAMPLE"),
        ],
        "NO_RESEARCH_ADVANCE",
    )
    out = summary.join(wide, "candidate_id", "left").withColumn("simplifications", drop).withColumn("next_step", step)
    return out.withColumn("rationale", F.create_map(*(F.lit(x) for pair in RATIONALE.items() for x in pair))[F.col("next_step")])


#: Next steps in the order of the ranking, with the reason that is given for each (fixed values).
RATIONALE = {
    "TEST_SIMPLIFIED_IMMEDIATE_FLUSH": "Dropping a filter kept the edge of the immediate flush with at least the same sample.",
    "KEEP_ORIGINAL_IMMEDIATE_FLUSH": "The immediate flush holds; waiting for a rebound or testing price_z and rsi alone adds nothing.",
    "RETEST_REBOUND_CONFIRMATION": "A rebound confirmation holds in the component diagnostics.",
    "HOLD_FOR_MORE_SAMPLE": "The immediate flush has too few clusters in the component diagnostics.",
    "DO_NOT_ADVANCE_BASELINE_GATE": "The candidate does not hold against its baselines.",
    "REJECT_COMPONENT_FAILURE": "The immediate flush fails the component diagnostics.",
    "NO_RESEARCH_ADVANCE": "No component gives a decision to act on.",
}
#: Decisions against the baselines in the order of the ranking (fixed values).
BASELINE_ORDER = ("SURVIVES_BASELINES_STRONG", "SURVIVES_BASELINES_WEAK", "BASELINE_EQUIVALENT", "INSUFFICIENT_BASELINE_COVERAGE", "FAILS_BASELINES")


def ranked_recommendations(recommended: DataFrame, components: DataFrame) -> DataFrame:
    """Adds ``rank``: by the decision against baselines, the next step, wins with confidence, then the immediate entry's lower bound, excess
    and clusters; unknown values and labels come last. A row a candidate."""
    c = F.col
    at_once = components.where("component = 'original'").select("candidate_id", *(c(k).alias(f"_{k}") for k in ("ci_low", "excess_far", "clusters")))
    place = lambda column, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c(column)), F.lit(0)), F.lit(99))
    order = [place("candidate_decision", BASELINE_ORDER), place("next_step", RATIONALE), F.desc("ci_wins"), F.desc_nulls_last("_ci_low"), F.desc_nulls_last("_excess_far"), F.desc_nulls_last("_clusters"), "candidate_id"]
    return recommended.join(at_once, "candidate_id", "left").withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_ci_low", "_excess_far", "_clusters")
