"""Chains of spans, clusters over periods and cool-downs in slices against plain loops, at any cut."""

import datetime as dt
import random

import pytest

from quantloom.operators import chains, events, signals


def spans(n, seed, longest):
    rng = random.Random(seed)
    out = []
    for key in "ab":
        for at in sorted(rng.sample(range(40 * n), n)):
            out.append((key, at, at + 1 + rng.randrange(longest)))
    return out


def walk(rows):
    picked = set()
    for key in {r[0] for r in rows}:
        free = 0
        for _, at, until in sorted(r for r in rows if r[0] == key):
            if at >= free:
                picked.add((key, at))
                free = until
    return picked


@pytest.mark.parametrize(("size", "fan", "longest"), [(1, 2, 90), (8, 2, 300), (64, 4, 30), (1024, 16, 2500), (7, 3, 2)])
def test_chains_at_any_block(spark, size, fan, longest):
    rows = spans(150, size, longest) + [("c", 5, 9)]
    df = spark.createDataFrame(rows, "pair string, at long, free long").repartition(3)
    assert {(r.pair, r.at) for r in chains.pick_disjoint(df, ["pair"], size, fan).collect()} == walk(rows)


def test_chains_dense_and_empty(spark):
    rows = [("a", k, k + 1) for k in range(300)] + [("b", k, k + 10_000) for k in range(300)]
    df = spark.createDataFrame(rows, "pair string, at long, free long")
    assert {(r.pair, r.at) for r in chains.pick_disjoint(df, ["pair"], 16, 4).collect()} == walk(rows)
    assert chains.pick_disjoint(df.limit(0), ["pair"]).count() == 0


@pytest.mark.parametrize("period", ["day", "month", "year"])
def test_clusters_over_borders(spark, period):
    rng = random.Random(5)
    start = dt.datetime(2023, 11, 20)
    rows = [(k, start + dt.timedelta(hours=rng.choice([12, 24]) * rng.randrange(160))) for k in "ab" for _ in range(70)] + [("c", start)] * 3
    df = spark.createDataFrame(rows, "pair string, ts timestamp").repartition(3)
    got = sorted((r.pair, r.ts, r.cluster_no, r.cluster_start, r.cluster_size) for r in events.cluster_events(df, gap="36 hours", period=period).collect())
    want, firsts = [], 0
    for key in "abc":
        groups = []
        for ts in sorted(t for k, t in rows if k == key):
            if groups and ts - groups[-1][-1] <= dt.timedelta(hours=36):
                groups[-1].append(ts)
            else:
                groups.append([ts])
        firsts += len(groups)
        want += [(key, ts, no, g[0], len(g)) for no, g in enumerate(groups, 1) for ts in g]
    assert got == sorted(want)
    light = events.cluster_events(df, gap="36 hours", period=period, sizes=False)
    assert light.where("is_cluster_first").count() == firsts and "cluster_size" not in light.columns


def test_clusters_use_more_tasks_than_pairs(spark):
    rows = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(days=k)) for k in range(2000)]
    df = spark.createDataFrame(rows, "pair string, ts timestamp")
    plan = events.cluster_events(df, period="month", sizes=False)._jdf.queryExecution().toString()
    assert "_part" in plan and plan.count("hashpartitioning(pair") >= 1
    assert events.cluster_events(df, period="month").select("cluster_no").distinct().count() == 1


@pytest.mark.parametrize("slice_bars", [1, 5, 1000])
def test_cooldowns_in_slices(spark, slice_bars):
    rng = random.Random(slice_bars)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(hours=rng.randrange(300))
    trades = [(rng.choice("PQR"), rng.random() < 0.8, at(), rng.choice(["stop_loss", "roi"]), float(rng.randrange(-5, 5))) for _ in range(150)]
    asked = sorted({(rng.choice("PQR"), rng.random() < 0.5, at()) for _ in range(200)})
    df = signals.cooldown_flags(
        spark.createDataFrame(trades, "pair string, is_short boolean, close_date timestamp, exit_reason string, profit_abs double"), spark.createDataFrame(asked, "pair string, is_short boolean, ts timestamp"),
        3600, stops=3, stop_bars=12, stop_pause=4, low_trades=2, low_bars=10, low_pause=6, slice_bars=slice_bars,
    )
    hours = lambda a, b: (a - b).total_seconds() / 3600

    def blocked(pair, short, ts):
        side = any(t[1] == short and 0 <= hours(ts, t[2]) < 4 and sum(u[1] == short and u[3] == "stop_loss" and 0 <= hours(t[2], u[2]) < 12 for u in trades) >= 3 for t in trades)
        own = [t for t in trades if t[0] == pair and t[1] == short]
        recent = lambda t: [u for u in own if 0 <= hours(t[2], u[2]) < 10]
        low = any(0 <= hours(ts, t[2]) < 6 and len(recent(t)) >= 2 and sum(u[4] for u in recent(t)) <= 0 for t in own)
        return side, low, side or low

    got = {(r.pair, r.is_short, r.ts): (r.side_blocked, r.pair_blocked, r.blocked) for r in df.collect()}
    want = {a: blocked(*a) for a in asked}
    assert got == want and {v[2] for v in want.values()} == {True, False}


def test_cooldowns_read_the_trades_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    start = dt.datetime(2024, 1, 1)
    rows = [("P", k % 2 == 0, start + dt.timedelta(hours=k), "stop_loss", -1.0) for k in range(30)]
    trades = spark.createDataFrame(rows, "pair string, is_short boolean, close_date timestamp, exit_reason string, profit_abs double")
    asked = spark.createDataFrame([("P", True, start + dt.timedelta(hours=31))], "pair string, is_short boolean, ts timestamp")
    got = signals.cooldown_flags(trades.mapInArrow(seen, trades.schema), asked, 3600).collect()
    assert [r.blocked for r in got] == [True] and read.value == 30


def test_attribution_joins_its_trades_once(spark, monkeypatch):
    from quantloom.plans import accounts

    kept = {}
    monkeypatch.setattr(accounts.regime, "attribution", lambda entered, trades, *_: kept.update(trades=trades))
    day = spark.sql("select timestamp_ntz'1995-01-01' as ts, 'up' as market_trend")
    monkeypatch.setattr(accounts, "market", lambda s, d: day)
    monkeypatch.setattr(accounts, "flush_events", lambda s, d: day.select("ts"))
    accounts.attributed(spark, "/root/testdata/sf0.001", "market_trend")
    assert kept["trades"].count() > 0
    assert all("/attributed-" in f for f in kept["trades"].inputFiles())
