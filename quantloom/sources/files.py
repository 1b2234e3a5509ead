"""Readers and writers of pair lists, trade exports and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import as_bool
from quantloom.sources import trade_files

TRADE = (
    "struct<pair:string,open_date:string,close_date:string,is_short:boolean,profit_abs:double,profit_ratio:double,amount:double,open_rate:double,close_rate:double,"
    "fee_open:double,fee_close:double,stake_amount:double,enter_tag:string,exit_reason:string>"
)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, pair) of pair lists, either a JSON list or an object with exchange.pair_whitelist."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    plain = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    nested = F.from_json("value", "struct<exchange:struct<pair_whitelist:array<string>>>")["exchange"]["pair_whitelist"]
    listed = F.when(F.ltrim("value").startswith("["), plain).otherwise(nested)
    return rows.select("file", F.explode(listed).alias("pair"))


def read_trades(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """Flat trades out of the backtest exports at a path (.json or .txt, plain or as .gz, or .zip with one JSON inside), with signature, month, year and
    side. Files of any size: a task reads its file as a stream."""
    trade_files.register(spark)
    return typed_trades(spark.read.format("trade_files").load(path), strategy)


def flatten_trades(texts: DataFrame, strategy: str | None = None) -> DataFrame:
    """The same out of exports that are strings of a table."""
    parsed = texts.select(F.from_json("value", f"struct<strategy:map<string,struct<trades:array<{TRADE}>>>>").alias("j"))
    return typed_trades(parsed.select(F.explode("j.strategy").alias("strategy", "s")).select("strategy", F.explode("s.trades").alias("t")).select("strategy", "t.*"), strategy)


def typed_trades(rows: DataFrame, strategy: str | None = None) -> DataFrame:
    if strategy:
        rows = rows.where(F.col("strategy") == strategy)
    rows = rows.withColumns({"open_date": F.to_timestamp("open_date"), "close_date": F.to_timestamp("close_date"), "is_short": F.coalesce("is_short", F.lit(False))})
    return rows.withColumns(
        {
            "month": F.date_format("open_date", "yyyy-MM"),
            "year": F.date_format("open_date", "yyyy"),
            "side": F.when(F.col("is_short"), "short").otherwise("long"),
            "trade_signature": F.concat_ws("|", "pair", F.date_format("open_date", "yyyy-MM-dd HH:mm:ss"), F.col("is_short").cast("string")),
        }
    )


def checked(df: DataFrame, required: list[str], bool_cols: list[str] = ()) -> DataFrame:
    """``df`` if it has the required columns, with permissive booleans; else a ValueError that names what is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: as_bool(F.col(c)) for c in bool_cols if c in df.columns})


def read_checked(spark: SparkSession, path: str, required: list[str], bool_cols: list[str] = (), fmt: str = "csv") -> DataFrame:
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    return checked(reader.format(fmt).load(path), required, bool_cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """One JSON line per anchor: the anchor and its pairs in rank order."""
    lists = snapshot.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pair"))), lambda x: x["pair"]).alias("pairs"))
    lists.write.json(path)


def stack_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """Several tables in one, with the section's name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("section", F.lit(name)) for name, df in sections.items()))


def pending_units(matrix: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The units of work that are not done yet."""
    return matrix.join(done.select(*keys).distinct(), keys, "left_anti")
