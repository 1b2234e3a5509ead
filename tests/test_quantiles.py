"""Quantiles by ranges, terciles and positions of hidden code points against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import indicators, quality, quantiles, surface


@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_quantiles_by_range(spark, parts):
    rng = random.Random(int(parts))
    rows = [(rng.choice("aaaaab"), rng.choice([None, 0.0, 0.0, float(rng.randrange(100))]), rng.random()) for _ in range(600)] + [("c", None, 1.0), ("d", 2.0, 3.0)]
    measures = {"low": (F.col("v"), 0.1), "mid": (F.col("v"), 0.5), "high": (F.col("w"), 0.975), "last": (F.col("w"), 1.0), "first": (F.when(F.col("w") > 0.5, F.col("v")), 0.0)}
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.k: tuple(r[m] for m in measures) for r in quantiles.quantiles_by_range(df, ["k"], measures).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    q = lambda x, p: float(np.quantile(x, p)) if x else None
    for k in "abcd":
        v, w = [r[1] for r in rows if r[0] == k and r[1] is not None], [r[2] for r in rows if r[0] == k]
        first = [r[1] for r in rows if r[0] == k and r[1] is not None and r[2] > 0.5]
        assert got[k] == pytest.approx((q(v, 0.1), q(v, 0.5), q(w, 0.975), q(w, 1.0), q(first, 0.0)))
    assert len(got) == 4


def test_cell_metrics_do_not_depend_on_the_buffer(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        r = [rng.choice([None, rng.gauss(0, 1)]) for _ in range(8)]
        rows.append((rng.randrange(3), rng.choice("PQ"), f"199{k % 4}", f"199{k % 4}-0{k % 7 + 1}", rng.random() < 0.6, *r, f"199{k % 4}-0{k % 7 + 1}-01"))
    names = ["f_n", "null_f_n", "excess_f_n", "f_f", "null_f_f", "excess_f_f", "mfe", "mae"]
    df = spark.createDataFrame(rows, f"cell int, pair string, year string, month string, is_cluster_first boolean, {', '.join(f'{n} double' for n in names)}, day string").withColumn("ts", F.to_timestamp("day"))
    a, b = (surface.clustered_metrics(df, ["cell"], "f_n", "f_f", "1992-01-01", buffered=n).orderBy("cell").collect() for n in (10**9, 0))
    assert len(a) == 3 and [set(r.asDict()) for r in a] == [set(r.asDict()) for r in b]
    for x, y in zip(a, b, strict=True):
        for c, v in x.asDict().items():
            assert y[c] == (pytest.approx(v) if isinstance(v, float) else v), c


@pytest.mark.parametrize("values", [[1.0] * 5, [1.0, 2.0], [1.0, 1.0, 2.0], [1.0, 2.0, 2.0], [2.0, 1.0, 2.0, 1.0], [3.0, 1.0, 2.0, 5.0], [None, 4.0]])
def test_terciles_need_no_buffer(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "ts int, v double")
    got = [r.b for r in indicators.bucket_three(df, "v", "b").orderBy("ts").collect()]
    known = [v for v in values if v is not None]
    if len(set(known)) < 3:
        assert got == [None if v is None else "high" if v > float(np.median(known)) else "low" for v in values]
    else:
        order = sorted(range(len(values)), key=lambda k: values[k])
        assert got == [("low", "mid", "high")[min(order.index(k) * 3 // (len(values) - 1), 2)] for k in range(len(values))]


def test_hidden_positions(spark):
    rng = random.Random(4)
    alphabet = ["a", "é", "\U0001f600", "\r", "\n", "\r\n", chr(0x200B), chr(0x202E), chr(0xFEFF), chr(0xAD)]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for k in range(200)] + [(900, None), (901, ""), (902, chr(0x200B) * 3000)] + [(903, "x\r")] * 2
    got = sorted(map(tuple, quality.hidden_positions(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()))
    hidden = {*quality.HIDDEN}
    assert got == sorted((i, k, ord(c)) for i, t in rows for k, c in enumerate(t or "") if ord(c) in hidden or (c == "\r" and t[k + 1 : k + 2] != "\n"))
    counts = {(r.id, r.code_point): r.n for r in quality.hidden_unicode(spark.createDataFrame(rows[:200], "id int, text string"), "id", "text").collect()}
    assert counts == {(i, p): sum(1 for j, _, c in got if (j, c) == (i, p)) for i, p in {(i, c) for i, _, c in got if i < 900}}
