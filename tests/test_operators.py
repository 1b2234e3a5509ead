"""Operators on hand-made rows: chunks, blocks, ties, empty frames, and plain-loop twins."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.columns import as_bool, safe_div
from quantloom.operators import asof, compare, events, gates, indicators, ledger, nulls, quality, recursive, regime, rows, signals, surface, universe
from quantloom.plans import frames

SF = "/root/testdata/sf0.001"
BARS = "pair string, ts timestamp, open double, high double, low double, close double, volume double"


def make(spark, n, pair="A", seed=1, price=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = price if price is not None else 10 + rng.random()
        out.append((pair, dt.datetime(2024, 1, 1) + dt.timedelta(days=i + (i // 7)), c, c + 0.1, c - 0.1, c, float(i % 3)))
    return spark.createDataFrame(out, BARS)


def test_chunks_equal_whole(spark):
    def run(chunk):
        df = frames.rolling(spark, SF, chunk=chunk, after=40)
        df = rows.own(events.excursions(events.forward_returns(df, (1, 6)), 24))
        return {(r.pair, r.ts): tuple(None if x is None else round(x, 9) for x in (r.price_z, r.bb_width, r.forward_6, r.mfe, r.mae)) for r in df.collect()}

    whole = run(1_000_000)
    assert run(97) == whole and len(whole) > 4000


def test_recursive_chunks(spark):
    df = rows.bar_index(make(spark, 6000))
    one = rows.own(recursive.smoothed(rows.chunked(df, 1_000_000, recursive.WARM_UP), (20,)))
    many = rows.own(recursive.smoothed(rows.chunked(df, 1500, recursive.WARM_UP), (20,)))
    a, b = ({r.ts: (r.rsi, r.natr, r.ema20) for r in x.collect()} for x in (one, many))
    assert a.keys() == b.keys()
    assert all((p is None and q is None) or p == pytest.approx(q, rel=1e-12) for k in a for p, q in zip(a[k], b[k], strict=True))


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_excursion_blocks(spark, n):
    df = events.forward_returns(rows.chunked(rows.bar_index(make(spark, 60)), after=60), (1,))
    a, b = ({r.ts: (r.mfe, r.mae) for r in events.excursions(df, n, block=k).collect()} for k in (True, False))
    assert a == b


def test_flat_and_short_series(spark):
    df = rows.chunked(rows.bar_index(make(spark, 30, price=5.0)))
    got = indicators.bollinger(indicators.rolling_z(df, "close", "z")).orderBy("ts").collect()
    assert all(r.z is None for r in got) and got[18].bb_mid is None and got[19].bb_width == 0
    empty = make(spark, 1).limit(0)
    assert rows.own(recursive.smoothed(rows.chunked(rows.bar_index(empty)))).count() == 0


def test_missing_prices_are_passed_over(spark):
    df = make(spark, 40).withColumn("close", F.when(F.dayofmonth("ts") == 9, None).otherwise(F.col("close")))
    got = recursive.smoothed(df.withColumn("chunk", F.lit(0))).collect()
    assert len(got) == 40 and sum(r.rsi is None for r in got) >= 15


def test_quantile_buckets_like_pandas(spark):
    import pandas as pd

    for n in (1, 2, 4, 7, 50):
        df = make(spark, n, seed=n)
        got = {r.ts: r.b for r in indicators.quantile_bucket(df, "close", "b").collect()}
        frame = df.toPandas().sort_values(["close", "ts"]).reset_index(drop=True)
        expected = pd.qcut(frame.index, min(n, 5), labels=False)
        assert [got[t.to_pydatetime()] for t in frame["ts"]] == list(expected)


def test_clusters_keep_an_exact_gap(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", t + dt.timedelta(hours=h)) for h in (0, 72, 145, 146)], "pair string, ts timestamp")
    assert [r.cluster_no for r in events.cluster_events(df).orderBy("ts").collect()] == [1, 1, 2, 2]


def test_drawdown_starts_at_first_value(spark):
    t = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    data = [("s", "p", t + dt.timedelta(days=rng.randrange(30)), t + dt.timedelta(days=40), float(rng.randrange(-9, 9))) for _ in range(300)] + [("l", "p", t, t, -5.0)]
    got = {r.k: r.max_drawdown for r in ledger.max_drawdown(spark.createDataFrame(data, "k string, pair string, open_date timestamp, close_date timestamp, profit_abs double"), ["k"]).collect()}
    c = np.cumsum([d[4] for d in sorted(x for x in data if x[0] == "s")])
    assert got == {"s": float(np.max(np.maximum.accumulate(c) - c)), "l": 0.0}


def test_profit_factor_edges(spark):
    df = spark.createDataFrame([("w", 1.0), ("l", -1.0), ("z", 0.0), ("m", 3.0), ("m", -2.0)], "k string, p double")
    got = {r.k: r.f for r in df.groupBy("k").agg(ledger.profit_factor(F.col("p")).alias("f")).collect()}
    assert got == {"w": float("inf"), "l": 0.0, "z": 0.0, "m": 1.5}


@pytest.mark.parametrize("fields", [["pair", "year"], ["year"], ["year", "bucket"], ["bucket"]])
def test_null_draws_keep_the_gap(spark, fields):
    """Draws stay in the stratum, whatever its fields, and away from rows of the event's own pair within the gap; all other rows can be drawn."""
    df = make(spark, 80, "A").union(make(spark, 70, "B", 2)).union(make(spark, 6, "C", 3))
    df = df.withColumns({"year": F.when(F.dayofmonth("ts") > 15, "x").otherwise("y"), "bucket": F.col("volume"), "forward_6": F.col("close")})
    pool, at = df.where("pair <> 'C' or volume > 0"), df.where("volume = 0")
    ranked = nulls.ranked_pool(pool, fields, ["forward_6"])
    picked = nulls.draws(at, ranked, fields, 40, "5 DAYS", "s")
    both = picked.join(ranked.select(*fields, "rank", F.col("ts").alias("drawn"), *([] if "pair" in fields else [F.col("pair").alias("from")])), [*fields, "rank"])
    rows_ = [(r.pair, r.ts, r["from"] if "pair" not in fields else r.pair, r.drawn) for r in both.collect()]
    assert len(rows_) == picked.count() > 0
    near = lambda p, t, q, u: p == q and abs(u - t) <= dt.timedelta(days=5)
    assert not any(near(*r) for r in rows_)
    every = [r.asDict() for r in pool.collect()]
    for e in at.where("pair <> 'C'").collect():
        free = {(r["pair"], r["ts"]) for r in every if all(r[f] == e[f] for f in fields) and not near(e.pair, e.ts, r["pair"], r["ts"])}
        assert {(q, u) for p, t, q, u in rows_ if (p, t) == (e.pair, e.ts)} <= free
    shuffled = nulls.draws(at.repartition(7), ranked.repartition(3), fields, 40, "5 DAYS", "s")
    assert {(r.pair, r.ts, r.draw, r["rank"]) for r in shuffled.collect()} == {(r.pair, r.ts, r.draw, r["rank"]) for r in picked.collect()}


def test_asof_keeps_rows_without_key_or_time(spark):
    start = dt.datetime(2024, 1, 1)
    left = [("a", None, 1), (None, start, 2), (None, start + dt.timedelta(days=70), 3), ("a", start + dt.timedelta(days=400), 4)]
    right = [("a", start, 10), (None, start, 20), (None, None, 30)]
    for period in (None, "month", "year"):
        found = asof.asof_join(spark.createDataFrame(left, "k string, ts timestamp, i int"), spark.createDataFrame(right, "k string, ts timestamp, v int"), "ts", ("k",), ("v",), period=period)
        assert {(r.i, r.v) for r in found.collect()} == {(1, None), (2, 20), (3, 20), (4, 10)}


@pytest.mark.parametrize(("by", "period"), [((), None), ((), "day"), ((), "month"), (("k",), "month"), (("k",), None)])
def test_asof_against_a_loop(spark, by, period):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    left = [(rng.choice("ab"), start + dt.timedelta(hours=rng.randrange(5000)), i) for i in range(120)]
    right = [(rng.choice("ab"), start + dt.timedelta(hours=1000 + 37 * i), i) for i in range(60)]
    found = asof.asof_join(spark.createDataFrame(left, "k string, ts timestamp, i int"), spark.createDataFrame(right, "k string, ts timestamp, v int"), "ts", by, ("v",), period=period)
    known = lambda k, t: [v for q, u, v in sorted(right, key=lambda r: r[1]) if u <= t and (not by or q == k)]
    assert {(r.i, r.v) for r in found.collect()} == {(i, (known(k, t) or [None])[-1]) for k, t, i in left}


def test_positions_by_value(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), float(rng.randrange(40)), i) for i in range(500)]
    for keys, part_rows in (((), 60), (("k",), 20), (("k",), 1000), ((), 1)):
        got = {r.i: (r.place, r["size"]) for r in rows.value_positions(spark.createDataFrame(data, "k string, v double, i int"), keys, "v", "i", part_rows=part_rows).collect()}
        for g in ([None] if not keys else "ab"):
            group = sorted((v, i) for k, v, i in data if g is None or k == g)
            assert [got[i] for _, i in group] == [(n, len(group)) for n in range(len(group))]


def test_smoothing_against_loops():
    x = np.random.default_rng(3).normal(5, 1, 1000)
    for n in (1, 2, 14, 200):
        ema, wilder = [x[:n].mean()], [x[1 : n + 1].mean()]
        for v in x[n:]:
            ema.append(ema[-1] + (v - ema[-1]) * 2 / (n + 1))
        for v in x[n + 1 :]:
            wilder.append(wilder[-1] + (v - wilder[-1]) / n)
        assert np.allclose(recursive.ema(x, n)[n - 1 :], ema, rtol=1e-12) and np.allclose(recursive.wilder(x, n)[n:], wilder, rtol=1e-12)
    assert len(recursive.ema(x[:3], 5)) == 3 and len(recursive.decayed(x[:0], 0.5, 1.0)) == 0


def test_anchors_near_and_complete(spark):
    rng = random.Random(2)
    start = dt.datetime(1995, 11, 1)
    data = [(i, start + dt.timedelta(days=rng.randrange(900))) for i in range(300)]
    got = {}
    for r in ledger.in_windows(spark.createDataFrame(data, "i int, open_date timestamp_ntz"), "1996-01-01", "1997-10-01", 3, 6).collect():
        got.setdefault(r.i, set()).add(r.anchor)
    anchors = [dt.datetime(1996 + k // 4, 1 + k % 4 * 3, 1) for k in range(8)]
    later = lambda a: dt.datetime(a.year + (a.month + 5) // 12, (a.month + 5) % 12 + 1, 1)
    assert got == {i: s for i, t in data if (s := {a for a in anchors if a <= t < later(a)})}
    ends = lambda latest: [str(r.anchor)[:10] for r in universe.complete_anchors(spark, "2022-01-01", 6, latest).collect()]
    assert ends("2023-06") == ["2022-01-01", "2022-07-01", "2023-01-01"] and ends("2023-05") == ["2022-01-01", "2022-07-01"] and ends("2022-05") == []


def test_largest_gains(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), float(rng.randrange(-50, 50))) for _ in range(900)] + [("c", -1.0), ("d", 2.0)]
    got = {r.k: (r.gain_top_1, r.gain_top_5) for r in ledger.largest_gains(spark.createDataFrame(data, "k string, profit_abs double").repartition(7), ["k"]).collect()}
    best = lambda k, n: sum(sorted((v for q, v in data if q == k and v > 0), reverse=True)[:n])
    assert got == {k: (best(k, 1), best(k, 5)) for k in "abd"}


def test_surface_finds_equal_sets(spark):
    df = make(spark, 40).withColumns({"price_z": -F.col("volume") - 0.5, "rsi": F.lit(30.0), "vol_z": F.lit(1.0), "bb_width": F.lit(1.0), "weak_trend_regime": F.lit(True), "breakout_block_long": F.lit(False), "bb_lower": F.lit(0.0)})
    grid = surface.Grid((0.0, 1.0, 9.0), (50.0, 40.0), (0.0,), (0.0,))
    cells = surface.fingerprints(df, grid).collect()
    assert len(cells) == 48 and {r.signals for r in cells} == {40, 26, 0}
    assert {r.canonical_cell_id for r in cells if r.signals == 40} == {1}
    expanded = surface.expand_cells(df, surface.fingerprints(df, grid).where("not is_duplicate_signal_set and signals > 0"), grid)
    assert expanded.groupBy("cell_id").count().count() == 2


def test_bootstrap_against_a_loop(spark):
    """The same hashed positions by a plain loop, whatever the partitions; the interval holds the median."""
    import hashlib

    df = make(spark, 25).union(make(spark, 8, "B", 2))
    n, values = 30, {}
    for r in sorted(df.collect(), key=lambda r: r.ts):
        values.setdefault(r.pair, []).append(r.close)
    expected = {}
    for k, v in values.items():
        number = lambda draw, j: int(hashlib.md5(f"boot-1|{k}|{draw}|{j}".encode()).hexdigest()[:8], 16) % len(v)  # noqa: B023, E731
        expected |= {(k, draw): np.median([v[number(draw, j)] for j in range(len(v))]) for draw in range(n)}
    for parts in (1, 5):
        got = {(r.pair, r.draw): r.resampled for r in compare.resampled_medians(df.repartition(parts), ["pair"], "close", n).collect()}
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    r = compare.bootstrap_median_ci(df.where("pair = 'A'"), ["pair"], "close", 200).first()
    assert r.ci_low <= r.median <= r.ci_high and r.n == 25
    none = compare.bootstrap_median_ci(df.withColumn("close", F.lit(None).cast("double")), ["pair"], "close", 5).collect()
    assert all(r.n == 0 and r.median is None and r.ci_low is None for r in none)


def test_order_book_and_sizes(spark):
    books = spark.sql("select array(struct(10D price, 2D qty)) bids, array(struct(11D price, 1D qty)) asks, 0D funding_rate union all select array(), array(struct(11D price, 1D qty)), 0D")
    got = signals.entry_veto(signals.orderbook_features(books), 0.2, 0.05, 0.0005).collect()
    assert got[0].imbalance == pytest.approx(1 / 3) and got[0].veto is None and got[1].spread_ratio is None and got[1].veto == "spread"


def test_signal_classes_by_hand(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    setups = [("a", day(1), "signal", 0.5, True), ("a", day(2), "rsi", 0.1, False), ("a", day(3), "rsi", -0.1, True), ("b", day(1), "price_z", -0.2, False), ("b", day(2), "price_z", None, None), ("b", day(3), "signal", None, False)]
    trades = [("a", day(2), 4.0, "s"), ("a", day(2), -1.0, "s"), ("a", day(3), 2.0, "s"), ("b", day(4), None, "t")]
    setups = spark.createDataFrame(setups, "pair string, ts timestamp, first_failed_gate string, ret double, hit boolean")
    trades = spark.createDataFrame(trades, "pair string, open_date timestamp, profit_abs double, strategy string")
    found = {(r.strategy, r["class"]): (r.rows, r.complete, r.mean_ret, r.mean_hit, r.profit, r.win_rate) for r in regime.quality_classes(setups, trades, "1 DAY", "ret", "hit", ["ret", "hit"]).collect()}
    assert found[("ALL", "raw_signal")] == (2, 1, 0.5, 0.5, None, None)
    assert found[("ALL", "near_miss")][:2] == (4, 3) and found[("ALL", "near_miss")][3] == pytest.approx(1 / 3)
    assert found[("ALL", "good_near_miss")] == (2, 2, 0.0, 0.5, None, None)
    assert found[("s", "realized_trade")] == (3, 2, 0.5, 1.0, 5.0, pytest.approx(2 / 3))
    assert found[("t", "realized_trade")] == (1, 0, None, 0.0, None, None) and len(found) == 5
    assert [tuple(r) for r in regime.gate_blockers(setups, "ret", "hit").collect()] == [("rsi", 2, 0.0, 0.5)]
    assert regime.quality_classes(setups.limit(0), trades.limit(0), "1 DAY", "ret", "hit", ["ret", "hit"]).count() == 0


def test_causality_on_a_margin(spark):
    """A mean of ten bars: a margin of ten days gives the whole history's answer and reads days times cuts; a shorter one does not."""
    rng, start = random.Random(3), dt.datetime(2020, 1, 1)
    bars = spark.createDataFrame([(p, start + dt.timedelta(days=k), rng.random()) for p in "ab" for k in range(900)], "pair string, ts timestamp_ntz, close double")
    cuts = spark.createDataFrame([(start + dt.timedelta(days=k),) for k in range(400, 900, 50)], "cut timestamp_ntz")
    read = []

    def compute(ahead):
        def run(df):
            read.append(df.count())
            w = Window.partitionBy("pair").orderBy("ts").rowsBetween(-9, ahead)
            return df.select("pair", "ts", (F.avg("close").over(w) < 0.5).cast("int").alias("enter"), F.lit(0).alias("leave"))

        return run

    check = lambda ahead, margin: sorted(map(tuple, quality.causality_check(bars, cuts, compute(ahead), ["enter"], ["leave"], 20, margin).collect()))
    whole = check(0, None)
    assert read == [1800, 2 * sum(range(401, 900, 50))] and {r[1] for r in whole} == {40} and {r[-1] for r in whole} == {"LOOKAHEAD_CLEAN"}
    read.clear()
    assert check(0, "10 DAYS") == whole and read == [1800, 10 * 2 * 30]
    assert any(r[3] for r in check(0, "1 DAYS"))
    assert check(3, "10 DAYS") == check(3, None) and any(r[3] for r in check(3, "10 DAYS"))


def test_hidden_unicode_and_lines(spark):
    df = spark.createDataFrame([(1, "a​b​\r\n\r"), (2, "plain\r\n"), (3, None)], "id int, t string")
    assert {(r.id, r.code_point, r.n) for r in quality.hidden_unicode(df, "id", "t").collect()} == {(1, 0x200B, 2), (1, 13, 1)}
    lines = quality.line_matches(spark.createDataFrame([(1, "x\nshift(-1)\n# shift(-1) ok")], "id int, t string"), "id", "t", [("ahead", r"shift\(-", "^#")]).collect()
    assert [(r.line_no, r.allowed) for r in lines] == [(2, False), (3, True)]


def test_rules_hold_for_each_line_alone(spark):
    texts = [(1, "see the\nend"), (2, "the\r\nend"), (3, "of the\n\nx"), (4, "the\u2028"), (5, None), (6, "")]
    lines = quality.line_matches(spark.createDataFrame(texts, "id int, t string"), "id", "t", [("tail", "the$", "of the$"), ("more", "the.$", "^$")])
    assert sorted(map(tuple, lines.collect())) == [(1, "tail", 1, False), (2, "more", 1, False), (3, "tail", 1, True), (4, "more", 1, False)]


def test_universe_reasons(spark):
    rows_ = [("a", "A", True, 5.0, dt.datetime(2020, 1, 1)), ("b", "é", False, 5.0, None), ("c", "é", True, 0.0, None), ("d", "D", True, 0.0, dt.datetime(2020, 1, 1)), ("e", "E", True, 9.0, None)]
    got = {r.pair: (r.exclusion_reason, r.chosen) for r in universe.candidate_universe(spark.createDataFrame(rows_, "pair string, base string, active boolean, quote_volume double, onboard_date timestamp"), 5, "2021-01-01").collect()}
    assert got == {"a": (None, True), "b": ("inactive", False), "c": ("non_ascii", False), "d": ("no_volume", False), "e": ("listed_late", False)}


def test_columns_and_ladders(spark):
    df = spark.createDataFrame([("Yes", 1.0, 0.0), (None, None, 2.0)], "b string, x double, y double")
    assert [tuple(r) for r in df.select(as_bool(F.col("b")), safe_div(F.col("x"), F.col("y"))).collect()] == [(True, None), (False, None)]
    assert df.select(gates.ladder([(F.col("x") > 5, "a"), (F.col("y") > 1, "b")], "c").alias("d")).collect()[1].d == "b"


def test_works_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quantloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
assert len(e.queries()) > 80 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries() and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
