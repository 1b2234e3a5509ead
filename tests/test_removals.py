"""Drawdowns and medians after removals against plain loops."""

import random
import statistics
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quantloom.operators import removals

SCHEMA = "run string, pair string, open_date timestamp, close_date timestamp, profit_abs double, by array<string>"


def ledger(n, seed, runs=("a", "b")):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        day = start + timedelta(days=rng.randrange(120))
        pair = rng.choice("PPPPQRS")
        by = [pair, f"{day:%Y-%m}"] + (["half"] if rng.random() < 0.5 else [])
        rows.append((rng.choice(runs), pair, day, day + timedelta(days=rng.randrange(3)), float(rng.randrange(-40, 45)), by))
    return rows


def fall(rows):
    total, peak, deepest = 0.0, None, 0.0
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1], r[4])):
        total += r[4]
        peak = total if peak is None else max(peak, total)
        deepest = min(deepest, total - peak)
    return len(rows), total, -deepest


def plain(rows):
    out = {}
    for run in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == run]
        for name in {b for r in mine for b in r[5] if b}:
            out[run, name] = (*fall([r for r in mine if name not in r[5]]), *fall(mine))
    return out


def found(spark, rows, **options):
    df = removals.removal_drawdowns(spark.createDataFrame(rows, SCHEMA).repartition(3), ["run"], F.col("by"), **options)
    names = ("trades_after", "profit_after", "drawdown_after", "trades", "profit", "max_drawdown")
    return {(r.run, r.removed): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("fan", [2, 5, 16])
def test_drawdowns_at_any_fan(spark, fan):
    rows = ledger(300, 1)
    assert found(spark, rows, fan=fan) == plain(rows)


def test_drawdown_edges(spark):
    day = datetime(2024, 1, 1)
    only = [("a", "P", day, day, -5.0, ["P", "P", None])]
    assert found(spark, only) == {("a", "P"): (0, 0.0, 0.0, 1, -5.0, 0.0)}  # the first trade sets the maximum; nothing is left without it
    none = [("a", "P", day, day, 1.0, []), ("a", "P", day, day, -3.0, [])]
    assert found(spark, none) == {}
    assert found(spark, []) == {}
    hot = [("a", "P", day, day, float(k % 7 - 3), ["P" if k % 3 else "Q"]) for k in range(500)]  # one day, one pair
    assert found(spark, hot) == plain(hot)


@pytest.mark.parametrize(("block", "most"), [(1, 3), (7, 1), (64, 5), (1024, 16384)])
def test_drawdowns_of_short_runs(spark, block, most):
    rows = ledger(300, 2)
    rows = [(*r[:5], [*r[5], f"own-{k % 60}", None]) for k, r in enumerate(rows)]
    assert found(spark, rows, block=block, most=most) == plain(rows)


def test_trades_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = ledger(500, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).mapInArrow(count, SCHEMA)
    removals.removal_drawdowns(df, ["run"], F.col("by")).collect()
    assert seen.value == len(rows)


@pytest.mark.parametrize(("kind", "unit"), [("decimal(18,2)", Decimal(10**14)), ("decimal(38,2)", Decimal(10**30))])
def test_drawdowns_of_large_sums(spark, kind, unit):
    rows = ledger(200, 4)
    large = [(*r[:4], int(r[4]) * unit, r[5]) for r in rows]
    df = spark.createDataFrame(large, SCHEMA.replace("profit_abs double", f"profit_abs {kind}"))
    names = ("trades_after", "profit_after", "drawdown_after", "trades", "profit", "max_drawdown")
    out = removals.removal_drawdowns(df, ["run"], F.col("by"), block=32).collect()
    got = {(r.run, r.removed): tuple(r[n] if k % 3 == 0 else r[n] / unit for k, n in enumerate(names)) for r in out}
    assert got == plain(rows)


def test_top_labels(spark):
    rows = [("a", p, datetime(2024, 1, 1), datetime(2024, 1, 1), v, []) for p, v in (("P", 9.0), ("Q", 5.0), ("R", 1.0), ("Q", 2.0))]
    out = removals.top_labels(spark.createDataFrame(rows, SCHEMA), ["run"], "pair", (1, 2)).collect()
    assert {r.pair: r.top_labels for r in out} == {"P": ["top_1", "top_2"], "Q": ["top_2"], "R": []}


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_medians(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("ab"), rng.choice("PPPPQRS"), rng.choice([None, 0.0, 1.0, float(rng.randrange(50))])) for _ in range(400)] + [("c", "P", 1.0), ("c", "P", 2.0), ("d", "P", None), ("d", "Q", 4.0)]
    df = removals.medians_without(spark.createDataFrame(rows, "k string, pair string, v double").repartition(3), ["k"], "pair", F.col("v"), block=block)
    got = {(r.k, r.pair): r.median_after for r in df.collect()}
    want = {}
    for k, p in {(r[0], r[1]) for r in rows}:
        rest = [r[2] for r in rows if r[0] == k and r[1] != p and r[2] is not None]
        want[k, p] = statistics.median(rest) if rest else None
    assert got == want
