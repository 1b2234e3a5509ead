"""Every branch of the decision ladders, on rows made for it."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import gates, ledger


def decide(spark, column, base, cases):
    """{label: changes of base that lead to it} -> each row's decision is its label."""
    names = list(base)
    rows = [(label, *(change.get(n, base[n]) for n in names)) for label, changes in cases.items() for change in ([changes] if isinstance(changes, dict) else changes)]
    types = {bool: "boolean", int: "long", float: "double", str: "string"}
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"{n} {types[type(base[n])]}" for n in names)).withColumn("got", column)
    wrong = [(r.label, r.got) for r in df.collect() if r.label != r.got]
    assert not wrong


def test_baseline(spark):
    base = {"candidate_clusters": 300, "baseline_clusters": 300, "delta_near": 0.01, "delta_far": 0.02, "delta_validation": 0.01, "delta_far_ci_low": 0.001, "candidate_positive_pairs": 5, "baseline_positive_pairs": 6, "candidate_positive_years": 4, "baseline_positive_years": 5}
    cases = {
        "INSUFFICIENT_CANDIDATE_SAMPLE": {"candidate_clusters": 199},
        "INSUFFICIENT_BASELINE_SAMPLE": {"baseline_clusters": 199},
        "BASELINE_BEATER_CI": {},
        "BASELINE_BEATER_POINT": [{"delta_far_ci_low": 0.0}, {"delta_far_ci_low": None}],
        "BASELINE_EQUIVALENT": {"delta_near": -0.1, "delta_far": -0.0025, "delta_validation": 0.0025},
        "BASELINE_UNDERPERFORMER": [{"delta_validation": None}, {"delta_near": -0.1}, {"candidate_positive_pairs": 4}, {"candidate_positive_years": 3}],
    }
    decide(spark, gates.classify_baseline(), base, cases)


def test_baseline_summary(spark):
    counts = {"SURVIVES_BASELINES_STRONG": "CCPE", "SURVIVES_BASELINES_WEAK": "CPPU", "BASELINE_EQUIVALENT": "EEUU", "FAILS_BASELINES": "EUUU", "INSUFFICIENT_BASELINE_COVERAGE": "CCII"}
    names = {"C": "BASELINE_BEATER_CI", "P": "BASELINE_BEATER_POINT", "U": "BASELINE_UNDERPERFORMER", "E": "BASELINE_EQUIVALENT", "I": "INSUFFICIENT_BASELINE_SAMPLE"}
    rows = [(label, names[c], 0.1 * k) for label, text in counts.items() for k, c in enumerate(text)]
    got = {r.candidate_id: r.candidate_decision for r in gates.baseline_summary(spark.createDataFrame(rows, "candidate_id string, decision string, delta_far double")).collect()}
    assert got == {k: k for k in counts}


def test_component(spark):
    base = {"component": "original", "clusters": 300, "ci_low": 0.01, "excess_far": 0.05, "mae": -0.2, "immediate_clusters": 250, "immediate_excess_far": 0.05, "immediate_mae": -0.3}
    cases = {
        "INSUFFICIENT_COMPONENT_SAMPLE": {"clusters": 199},
        "DROP_COMPONENT": {"ci_low": 0.0},
        "KEEP_REBOUND_CONFIRMATION": {"component": "rebound_3", "excess_far": 0.0475},
        "SIMPLIFY_FILTERS": {"component": "no_weak_trend", "excess_far": 0.048},
        "KEEP_IMMEDIATE_FLUSH": [{}, {"component": "rebound_1", "mae": -0.4}, {"component": "rebound_1", "excess_far": 0.01}, {"component": "no_breakout_block", "immediate_clusters": 300}, {"ci_low": None}],
    }
    decide(spark, gates.classify_component(), base, cases)


def test_fixed(spark):
    base = {"clusters": 300, "excess_ci_low": 0.01, "validation_ci_low": 0.01, "top_pair_cluster_share": 0.3, "top_year_cluster_share": 0.4, "net_excess_20": 0.01}
    cases = {
        "REJECT_LOW_DENSITY": {"clusters": 199},
        "REJECT_CI_FRAGILITY": {"excess_ci_low": 0.0},
        "RESEARCH_ADVANCE_VALIDATION_WATCH": {"validation_ci_low": -0.1},
        "RESEARCH_ADVANCE_CONCENTRATION_WATCH": [{"top_pair_cluster_share": 0.31}, {"top_year_cluster_share": 0.41}],
        "RESEARCH_ADVANCE_COST_WATCH": {"net_excess_20": 0.0},
        "FIXED_RESEARCH_CANDIDATE": [{}, {"net_excess_20": None}],
    }
    decide(spark, gates.classify_fixed(), base, cases)


def test_recommendations(spark):
    steps = {
        "DO_NOT_ADVANCE_BASELINE_GATE": ("FAILS_BASELINES", {}),
        "REJECT_COMPONENT_FAILURE": ("SURVIVES_BASELINES_STRONG", {"original": "DROP_COMPONENT"}),
        "RETEST_REBOUND_CONFIRMATION": ("SURVIVES_BASELINES_WEAK", {"original": "KEEP_IMMEDIATE_FLUSH", "rebound_1": "KEEP_REBOUND_CONFIRMATION"}),
        "TEST_SIMPLIFIED_IMMEDIATE_FLUSH": ("SURVIVES_BASELINES_WEAK", {"original": "KEEP_IMMEDIATE_FLUSH", "no_weak_trend": "SIMPLIFY_FILTERS", "no_breakout_block": "SIMPLIFY_FILTERS"}),
        "KEEP_ORIGINAL_IMMEDIATE_FLUSH": ("SURVIVES_BASELINES_STRONG", {"original": "KEEP_IMMEDIATE_FLUSH"}),
        "HOLD_FOR_MORE_SAMPLE": ("SURVIVES_BASELINES_STRONG", {"original": "INSUFFICIENT_COMPONENT_SAMPLE"}),
        "NO_RESEARCH_ADVANCE": ("SURVIVES_BASELINES_STRONG", {}),
    }
    summary = spark.createDataFrame([(k, v) for k, (v, _) in steps.items()], "candidate_id string, candidate_decision string")
    parts = spark.createDataFrame([(k, c, v) for k, (_, p) in steps.items() for c, v in p.items()], "candidate_id string, component string, decision string")
    rows = {r.candidate_id: r for r in gates.recommendations(summary, parts).collect()}
    assert {k: r.next_step for k, r in rows.items()} == {k: k for k in steps}
    assert {k: r.rationale for k, r in rows.items()} == gates.RATIONALE
    assert rows["TEST_SIMPLIFIED_IMMEDIATE_FLUSH"].simplifications == "DROP_WEAK_TREND_GATE;DROP_BREAKOUT_BLOCK"


def test_strict_gate(spark):
    base = {"missing_windows": 0, "total_trades": 120, "usable_windows": 4, "latest_positive_windows": 2, "max_drawdown_pct": 10.0, "profit_factor_stressed": 1.15, "avg_stressed_trade": 0.1, "max_month_profit_share": 0.35, "max_pair_profit_share": 0.25}
    worse = {"missing_windows": 1, "total_trades": 119, "usable_windows": 3, "latest_positive_windows": 1, "max_drawdown_pct": 10.1, "profit_factor_stressed": None, "avg_stressed_trade": 0.0, "max_month_profit_share": 0.36, "max_pair_profit_share": 0.26}
    decide(spark, gates.strict_decision(), base, {"PROMOTE_PENDING_BIAS": {}, "PARK": [{k: v} for k, v in worse.items()]})
    names = [n for n, _ in gates.strict_checks()]
    decide(spark, gates.failed_checks(gates.strict_checks()), base, {"": {}, ", ".join(names): worse, names[0]: {"missing_windows": 1}})
    decide(spark, gates.strict_decision(allow_missing=True), base, {"PROMOTE_PENDING_BIAS": {"missing_windows": 3}})


def test_other_ladders(spark):
    decide(spark, gates.time_stress_status(F.col("p"), F.col("n")), {"p": 200.0, "n": 20}, {"collapses": [{"n": 0}, {"p": 0.0}], "weakens materially": [{"n": 9}, {"p": 99.0}], "survives": {}})
    decide(spark, gates.lookahead(F.col("n"), F.col("a"), F.col("b")), {"n": 5, "a": 0, "b": 0}, {"LOOKAHEAD_NO_SIGNALS_VERIFIED": {"n": 0, "a": 1}, "LOOKAHEAD_BIAS_DETECTED": [{"a": 1}, {"b": 1}], "LOOKAHEAD_CLEAN": {}})
    profiles = [("s", "baseline", 100, 10.0), ("s", "up", 60, 6.0), ("f", "baseline", 100, 10.0), ("f", "up", 59, 9.0), ("p", "baseline", 9, 10.0), ("p", "up", 9, 5.0), ("l", "baseline", 9, -1.0), ("l", "up", 9, -1.0), ("i", "baseline", 9, 1.0)]
    got = {r.k: r.verdict for r in gates.stability(spark.createDataFrame(profiles, "k string, label string, trades long, profit double"), "k").collect()}
    assert got == {"s": "stable", "f": "fragile", "p": "fragile", "l": "fragile", "i": "insufficient_data"}


def test_missing_windows_of_the_strict_gate(spark):
    rows = spark.sql("select 'v' as strategy, 'P' as pair, timestamp_ntz'1996-02-01' as open_date, timestamp_ntz'1996-02-02' as close_date, false as is_short, 5D as profit_abs, 1D as amount, 1D as open_rate, 1D as close_rate, 0D as fee_open, 0D as fee_close, timestamp_ntz'1996-01-01' as anchor")
    expected = rows.select("strategy", "anchor").union(spark.sql("select 'v', timestamp_ntz'1997-01-01'")).union(spark.sql("select 'w', timestamp_ntz'1997-01-01'"))
    got = {r.strategy: r for r in ledger.strict_gate(rows, expected, ["strategy"], 0.0, 0.0, 100.0, 2, 1).collect()}
    assert (got["v"].missing_windows, got["v"].usable_windows, got["v"].latest_positive_windows, got["v"].total_trades) == (1, 1, 1, 1)
    assert got["w"].missing_windows == 1 and got["w"].total_trades is None
    assert got["v"].stressed_profit == pytest.approx(5.0)
