"""Streams against their batch forms; readers and writers round trip."""

import datetime as dt
import json
import zipfile

import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from quantloom.operators import events, recursive
from quantloom.sources import bars as source
from quantloom.sources import files
from quantloom.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ticks") / "t")
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("event_id").alias("seq"))
    rows.coalesce(1).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_bars(spark, ticks, tmp_path):
    got = streams.run_available(streams.stream_bars(stream(spark, ticks)), "s_bars", str(tmp_path / "c"))
    batch = source.bars_hour(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.pair, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in got.collect()}
    full = {(r.pair, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in batch.collect()}
    assert got and set(got.items()) <= set(full.items()) and len(full) - len(got) < 40  # the last hours stay open


def test_clusters(spark, ticks, tmp_path):
    picked = stream(spark, ticks).where("seq % 40 = 0")
    got = {(r.pair, r.cluster_start, r["size"]) for r in streams.run_available(streams.stream_clusters(picked, "24 hours"), "s_clusters", str(tmp_path / "c")).collect()}
    batch = events.cluster_events(spark.read.parquet(ticks).where("seq % 40 = 0"), ("pair",), "24 hours").where("is_cluster_first")
    full = {(r.pair, r.cluster_start, r.cluster_size) for r in batch.collect()}
    assert got and got <= full


def test_cooldowns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select false is_short, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id) close_date, if(id < 4, 'stop_loss', 'roi') exit_reason from range(60)").coalesce(1).write.parquet(path)
    rows = streams.run_available(streams.stream_cooldowns(stream(spark, path)), "s_cool", str(tmp_path / "c")).collect()
    assert any(r.locked for r in rows) and max(r.stops for r in rows) == 4


def same_as_batch(got, bars):
    batch = recursive.smoothed(bars.withColumn("chunk", F.lit(0)), (20,))
    full = {(r.pair, r.ts): (r.rsi, r.ema20) for r in batch.collect()}
    assert got and got.keys() <= full.keys()
    for k, v in got.items():
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y)) for x, y in zip(v, full[k], strict=True)), k
    return full


def indicators_of(df):
    return {(r.pair, r.ts): (r.rsi, r.ema20) for r in df.collect()}


@pytest.fixture(scope="module")
def hours(spark):
    streams.on_rocks(spark)
    return source.bars_hour(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))


def sentinel(spark, bars):
    """A bar long after all others, which lets the watermark pass them."""
    return spark.createDataFrame([("end", 1.0)], "pair string, x double").select("pair", F.lit("2030-01-01").cast("timestamp").alias("ts"), *(F.col("x").alias(c) for c in bars.columns[2:]))


def test_indicators_out_of_order_and_over_files(spark, hours, tmp_path):
    path = str(tmp_path / "b")
    hours.repartition(5, "volume").write.parquet(path)
    got = indicators_of(streams.emitted(streams.stream_indicators(stream(spark, path)), "t-ind"))
    full = same_as_batch(got, hours)
    last = max(ts for _, ts in full)
    assert got.keys() == {k for k in full if k[1] <= last - dt.timedelta(hours=2)}


def test_indicators_after_a_restart(spark, hours, tmp_path):
    """Rows come in batches that overlap in time; the stream stops and goes on with its state, waiting rows included."""
    path, out = str(tmp_path / "b"), str(tmp_path / "o")
    part = (F.dayofmonth("ts") + F.hour("ts") % 5) / 12
    for k in (0, 1, 2, 3):
        rows = hours.where(F.floor(part) == k) if k < 3 else sentinel(spark, hours)
        rows.write.mode("append").parquet(path)
        query = streams.stream_indicators(stream(spark, path), "5 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
        query.awaitTermination()
    got = indicators_of(spark.read.parquet(out).where("pair != 'end'"))
    assert got.keys() == same_as_batch(got, hours).keys()


def test_indicators_start_from_a_table(spark, hours, tmp_path):
    path, border = str(tmp_path / "b"), F.lit("2024-01-20").cast("timestamp")
    hours.where(F.col("ts") >= border).unionByName(sentinel(spark, hours)).write.parquet(path)
    states = streams.indicator_states(hours.where(F.col("ts") < border))
    got = indicators_of(streams.emitted(streams.stream_indicators(stream(spark, path), initial=states), "t-init").where("pair != 'end'"))
    full = same_as_batch(got, hours)
    assert got.keys() == {k for k in full if k[1] >= dt.datetime(2024, 1, 20)} and all(v[0] is not None for v in got.values())


def test_ticks_to_indicators_in_one_stream(spark, hours, ticks, tmp_path):
    got = indicators_of(streams.emitted(streams.stream_indicators(streams.stream_bars(stream(spark, ticks), closed=True), late=None), "t-chain"))
    full = same_as_batch(got, hours)
    assert len(full) - len(got) < 40


def test_late_rows_are_counted(spark, hours, tmp_path):
    path, last = str(tmp_path / "l"), max(r.ts for r in hours.select("ts").collect())
    late = spark.createDataFrame([("A", last - dt.timedelta(hours=h), 1.0) for h in (0, 1, 2, 3, 30)], "pair string, ts timestamp, x double").select("pair", "ts", *(F.col("x").alias(c) for c in hours.columns[2:]))
    arrivals = [lambda rows=rows: rows.write.mode("append").parquet(f"{path}/in") for rows in (hours, late)]
    found = streams.late_rows(spark, lambda: streams.stream_indicators(spark.readStream.schema(hours.schema).parquet(f"{path}/in")), arrivals, path).where("input_rows > 0")
    assert [(r.input_rows, r.late_rows) for r in found.orderBy("batch").collect()] == [(hours.count(), 0), (5, 3)]


def test_pairs_and_trades(spark, tmp_path):
    (tmp_path / "a.json").write_text('["BTC/USDT:USDT", "ETH/USDT:USDT"]')
    (tmp_path / "b.json").write_text('{"exchange": {"pair_whitelist": ["SOL/USDT:USDT"]}}')
    (tmp_path / "c.json").write_text("[]")
    assert {r.pair for r in files.read_pairs(spark, f"{tmp_path}/*.json").collect()} == {"BTC/USDT:USDT", "ETH/USDT:USDT", "SOL/USDT:USDT"}
    export = {"strategy": {"S": {"trades": [{"pair": "A/B:B", "open_date": "2024-01-31 23:55:00+00:00", "close_date": "2024-02-01 01:00:00+00:00", "is_short": True, "profit_abs": 1.5}]}, "E": {"trades": []}}}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.json", json.dumps(export))
    row = files.read_trades(spark, f"{tmp_path}/x.zip").collect()
    assert len(row) == 1 and (row[0].month, row[0].side, row[0].trade_signature) == ("2024-01", "short", "A/B:B|2024-01-31 23:55:00|true")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "yes", 1), ("b", None, 2)], "k string, ok string, n int")
    files.write_table(df, f"{tmp_path}/t", "csv")
    assert [r.ok for r in files.read_checked(spark, f"{tmp_path}/t", ["k"], ["ok"]).orderBy("k").collect()] == [True, False]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.checked(df, ["k", "z"])
    both = files.stack_sections({"x": df, "y": df.select("k")})
    assert both.count() == 4 and both.where("section = 'y' and n is null").count() == 2
    assert [r.k for r in files.pending_units(df, df.where("k = 'a'"), ["k"]).collect()] == ["b"]
    files.write_snapshot(spark.sql("select '2024' anchor, 2 rank, 'b' pair union all select '2024', 1, 'a'"), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first().pairs == ["a", "b"]


def test_bar_files(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01' date, 1D open, 2D high, double('nan') low, 1D close, 5D volume").toPandas()
    feather.write_feather(rows, str(tmp_path / "BTC_USDT_USDT-5m-futures.feather"))
    feather.write_feather(rows, str(tmp_path / "BTC_USDT_USDT-1h-futures.feather"))
    got = source.read_bars(spark, f"{tmp_path}/*.feather", "5m", "feather").collect()
    assert len(got) == 1 and (got[0].pair, got[0].low, got[0].volume) == ("BTC/USDT:USDT", None, 5.0)
