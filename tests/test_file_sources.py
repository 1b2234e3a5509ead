"""Bar files and trade exports as data sources: pruning, order, odd files, and exports of any size."""

import datetime as dt
import io
import json
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from quantloom.sources import bar_files, files, trade_files


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(p, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(k), k + 1.0, float("nan") if k == 3 else k - 1.0, k + 0.5, 2.0) for p in ("BTC/USDT:USDT", "ETH/USDT:USDT") for k in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pair string, ts timestamp, open double, high double, low double, close double, volume double")
    bar_files.write_bar_files(df.repartition(5), str(tmp_path), "1h")
    return tmp_path


def test_bar_files_round_trip(spark, folder):
    assert sorted(p.name for p in folder.iterdir() if p.suffix == ".feather") == ["BTC_USDT_USDT-1h-futures.feather", "ETH_USDT_USDT-1h-futures.feather"]
    found = bar_files.read_bar_files(spark, str(folder)).collect()
    assert len(found) == 1000 and {r.timeframe for r in found} == {"1h"}
    assert {(r.ts.hour, r.low) for r in found if r.open == 3.0} == {(3, None)}  # not finite: null


def test_pruned_files_are_not_opened(spark, folder):
    for name in ("DOGE_USDT_USDT-1h-futures.feather", "BTC_USDT_USDT-5m-futures.feather"):
        (folder / name).write_bytes(b"no Feather file at all")
    (folder / "notes.txt").write_text("x")
    bars = bar_files.read_bar_files(spark, str(folder))
    hour = bars.where("timeframe = '1h'")
    assert hour.where("pair = 'BTC/USDT:USDT'").count() == 500
    assert hour.where(F.col("pair").isin("BTC/USDT:USDT", "ETH/USDT:USDT")).count() == 1000
    assert hour.where("pair = 'NONE/USDT:USDT'").count() == 0
    part = hour.where("pair = 'ETH/USDT:USDT'").where((F.col("ts") > F.lit("2024-01-03 00:00:00").cast("timestamp")) & (F.col("ts") <= F.lit("2024-01-05 00:00:00").cast("timestamp")))
    assert part.count() == 48
    with pytest.raises(Exception, match="(?i)arrow|feather|not an"):
        bars.where("timeframe = '5m'").count()


def test_reading_stops_behind_the_last_time(folder):
    reader = bar_files.BarReader(str(folder))
    list(reader.pushFilters([bar_files.LessThan(("ts",), dt.datetime(2023, 1, 1))]))
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [0, 0]


def test_names_that_no_file_can_have(spark, tmp_path):
    df = spark.createDataFrame([("btc", dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], "pair string, ts timestamp, open double, high double, low double, close double, volume double")
    with pytest.raises(Exception, match="no file name"):
        bar_files.write_bar_files(df, str(tmp_path), "1h")


def export(n, seed=0):
    rng = random.Random(seed)
    trade = lambda k: {"pair": f"P{k % 7}/USD:USD", "open_date": "2024-01-31 23:55:00+00:00", "close_date": "2024-02-01 01:00:00+00:00", "is_short": k % 2 == 0, "profit_abs": rng.choice([1, -2.5, None]), "enter_tag": 'a "quoted" {tag} \\ é', "orders": [{"x": [1, {"y": "]"}]}]}
    noise = {"text": "braces } ] { [ \" \\", "list": [1, [2, {"a": None}], "x"], "n": -1.5e3, "t": True}
    return {"metadata": noise, "strategy": {"S": {"before": noise, "trades": [trade(k) for k in range(n)], "after": [noise] * 3}, "E": {"trades": []}, "F": {"trades": [trade(1)], "z": 1}}, "strategy_comparison": [noise]}


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 18])
def test_scanner_at_any_window(window):
    whole = export(20)
    for text in (json.dumps(whole), json.dumps(whole, indent=1, ensure_ascii=False), json.dumps(whole) + "\n" + json.dumps(whole)):
        times = 2 if "\n{" in text and text.count('"metadata"') == 2 else 1
        want = [(s, t) for s, x in whole["strategy"].items() for t in x["trades"]] * times
        assert list(trade_files.trades_of(io.StringIO(text), window=window)) == want
        assert list(trade_files.trades_of(io.StringIO(text), "F", window)) == [w for w in want if w[0] == "F"]
    assert list(trade_files.trades_of(io.StringIO("  \n"), window=window)) == []
    with pytest.raises(ValueError):
        list(trade_files.trades_of(io.StringIO('{"strategy": {"S": {"trades": [{"pair"'), window=window))


def test_exports_of_files_and_archives(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(export(12)))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("meta.txt", "x")
        z.writestr("b.json", json.dumps(export(30, 1)))
    found = files.read_trades(spark, str(tmp_path))
    assert found.count() == 44 and found.where("strategy = 'F'").count() == 2
    assert files.read_trades(spark, str(tmp_path), "S").where("side = 'short' and month = '2024-01'").count() == 21
    assert files.read_trades(spark, str(tmp_path / "a.json")).count() == 13


def test_packed_exports(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(export(12)),), (json.dumps(export(30, 1)),)], "value string")
    lines.coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "lines"))
    assert [p.name[-7:] for p in (tmp_path / "lines").glob("part-*")] == [".txt.gz"]
    assert files.read_trades(spark, str(tmp_path / "lines")).count() == 44
    assert files.read_trades(spark, str(tmp_path / "lines"), "F").count() == 2


def test_a_large_export_takes_little_memory(tmp_path):
    """Over 150 MB in one export, most of it trades, some of it to be stepped over."""
    path, n = tmp_path / "big.json", 700_000
    one = json.dumps({"pair": "P/USD:USD", "open_date": "2024-01-31 23:55:00+00:00", "profit_abs": 1.0, "note": "x" * 160})
    with path.open("w") as f:
        f.write('{"skipped": [' + ",".join(["[1, 2, {\"a\": \"b\"}]"] * 300_000) + '], "strategy": {"S": {"trades": [')
        for k in range(n):
            f.write(one + ("," if k < n - 1 else ""))
        f.write("]}}}")
    assert path.stat().st_size > 150e6
    reader = trade_files.TradeReader(str(path))
    tracemalloc.start()
    seen = sum(b.num_rows for b in reader.read(reader.partitions()[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 60e6, peak
