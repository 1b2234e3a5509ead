"""OHLCV bars: from files, from ticks, and from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import finite

PAIR_FILE = r"([A-Z0-9]+)_([A-Z0-9]+)_([A-Z0-9]+)-([0-9]+[mhdw])-futures\.[a-z]+$"
BAR_SCHEMA = "pair string, ts timestamp, open double, high double, low double, close double, volume double"


def pair_of(path: Column) -> Column:
    """BASE/QUOTE:SETTLE out of a bar file's name; empty parts give null."""
    part = lambda k: F.regexp_extract(path, PAIR_FILE, k)
    return F.when(part(1) != "", F.concat(part(1), F.lit("/"), part(2), F.lit(":"), part(3)))


def read_bars(spark: SparkSession, path: str, timeframe: str, fmt: str = "parquet") -> DataFrame:
    """Bars of many pairs, one file per pair and timeframe; values that are not finite become null."""
    if fmt == "feather":
        rows = _read_feather(spark, path)
    else:
        rows = spark.read.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.where(F.regexp_extract("file", PAIR_FILE, 4) == timeframe)
    numbers = [finite(F.col(c).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select(pair_of(F.col("file")).alias("pair"), F.col("date").cast("timestamp").alias("ts"), *numbers)


def _read_feather(spark: SparkSession, path: str) -> DataFrame:
    import io

    import pyarrow as pa
    import pyarrow.feather as feather

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bars = feather.read_table(io.BytesIO(content)).select(["date", "open", "high", "low", "close", "volume"])
                bars = bars.append_column("file", pa.array([name] * len(bars), pa.string()))
                types = pa.schema([("date", pa.timestamp("us", "UTC")), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume")), ("file", pa.string())])
                yield from bars.cast(types).to_batches()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "date timestamp, open double, high double, low double, close double, volume double, file string")


def resample_bars(ticks: DataFrame, keys: list[str], bucket: Column, price: Column, quantity: Column, order: list[str]) -> DataFrame:
    """Ticks to bars. ``bucket``: the bar's time; ``order``: columns that order the ticks of a bar totally."""
    rank = F.struct(*order)
    return ticks.groupBy(*keys, bucket.alias("ts")).agg(
        F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, rank).alias("close"), F.sum(quantity).cast("double").alias("volume")
    )


def coarser_bars(bars: DataFrame, bucket: Column) -> DataFrame:
    """Bars of a larger timeframe out of bars."""
    return bars.groupBy("pair", bucket.alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the part types; the price is the logarithm of the unit price."""
    items, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    ticks = items.join(part, items.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("pair"), F.date_trunc("day", "l_shipdate").alias("day"), F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_orderkey", "l_linenumber"
    )
    return resample_bars(ticks, ["pair"], F.col("day"), F.col("price"), F.col("l_quantity"), ["l_orderkey", "l_linenumber", "price"])


def bars_week(bars: DataFrame) -> DataFrame:
    return coarser_bars(bars, F.date_trunc("week", "ts"))


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event types; volume is the number of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "pair")
    return resample_bars(events, ["pair"], F.date_trunc("hour", "ts"), F.col("value"), F.lit(1.0), ["ts", "event_id"])


def trades(spark: SparkSession, sf_dir: str, pair: str = "p_brand") -> DataFrame:
    """A trade ledger out of the order tables; with pair p_type its pairs are those of the daily bars."""
    items, orders, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(part, items.l_partkey == part.p_partkey)
    profit = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity") * F.col("p_retailprice")
    return rows.select(
        F.col(pair).alias("pair"),
        F.least("o_orderdate", "l_shipdate").alias("open_date"),
        F.greatest("o_orderdate", "l_shipdate").alias("close_date"),
        (F.col("l_returnflag") == "R").alias("is_short"),
        profit.alias("profit_abs"),
        F.col("l_quantity").alias("amount"),
        F.col("p_retailprice").alias("open_rate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close_rate"),
        (F.col("l_tax") / 100).alias("fee_open"),
        (F.col("l_discount") / 100).alias("fee_close"),
        F.col("l_linestatus").alias("exit_reason"),
        F.col("o_orderpriority").alias("strategy"),
        "l_orderkey",
        "l_linenumber",
    )
