"""Queries that write tables below spark.checkpoint.dir and read them back through the readers of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import stamp
from quantloom.functions.tables import shared_path
from quantloom.operators import ledger, universe
from quantloom.plans import frames
from quantloom.plans.accounts import COVER, T, covered, trades
from quantloom.plans.book import Book
from quantloom.sources import bar_files, bars, files

book = Book()


def pair_lists(s, d):
    """A JSON list of pairs for each anchor of the snapshots, read back as (file, pair)."""
    path = shared_path(s, "pair-lists")
    chosen = universe.snapshot(covered(s, d), 3).groupBy("anchor").agg(F.to_json(F.sort_array(F.collect_list("pair"))).alias("value"))
    chosen.select("anchor", "value").write.partitionBy("anchor").text(path)
    found = files.read_pairs(s, f"{path}/*/*.txt")
    return found.groupBy("pair").agg(F.count_distinct("file").alias("lists"))


book.add("pair_lists", pair_lists, f"{COVER} SELECT pair, count(DISTINCT anchor) AS lists FROM ranked WHERE rank <= 3 GROUP BY pair")


def exported(s, d):
    """Exports of the ledger, one for each strategy, pair and month, written as a backtest writes them, packed, and read back from the files."""
    t = trades(s, d)
    one = F.struct("pair", stamp(F.col("open_date")).alias("open_date"), stamp(F.col("close_date")).alias("close_date"), "is_short", "profit_abs", "amount", "exit_reason")
    texts = t.groupBy("strategy", "pair", "month").agg(F.collect_list(one).alias("trades"))
    value = F.to_json(F.struct(F.create_map("strategy", F.struct("trades")).alias("strategy")))
    path = shared_path(s, "exports")
    texts.select(value.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return files.read_trades(s, path)


book.add(
    "trade_exports",
    lambda s, d: exported(s, d).groupBy("strategy", "month", "side").agg(F.count("*").alias("trades"), F.count_distinct("trade_signature").alias("signatures"), F.sum("profit_abs").alias("profit")),
    f"""{T} SELECT strategy, month, CASE WHEN is_short THEN 'short' ELSE 'long' END AS side, count(*) AS trades, count(DISTINCT pair || '|' || strftime(open_date,
      '%Y-%m-%d %H:%M:%S') || '|' || is_short) AS signatures,
    sum(profit_abs) AS profit FROM trades GROUP BY ALL""",
    "profit:1",
)


NAMED = "upper(regexp_replace(pair, '[^A-Za-z0-9]', '', 'g')) || '/USD:USD'"


def bar_file_bars(s, d):
    """Daily bars written as Feather files and read back: all pairs after the first year, chosen by time and timeframe."""
    path = shared_path(s, "bar-files")
    pair = F.concat(F.upper(F.regexp_replace("pair", "[^A-Za-z0-9]", "")), F.lit("/USD:USD"))
    bar_files.write_bar_files(bars.bars_day(s, d).withColumns({"pair": pair, "ts": F.col("ts").cast("timestamp")}), path, "1d")
    found = bar_files.read_bar_files(s, path).where((F.col("timeframe") == "1d") & (F.col("ts") >= F.lit("1996-01-01").cast("timestamp")))
    return found.select("pair", stamp(F.col("ts")).alias("ts"), "open", "high", "low", "close", "volume")


book.add(
    "bar_files",
    bar_file_bars,
    f"WITH {frames.TICKS} SELECT {NAMED} AS pair, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM bars WHERE ts >= '1996-01-01'",
    "open high low close",
)


def checked_table(s, d):
    """Contributions as a text table, read back with its columns checked and its flag read."""
    path = shared_path(s, "contributions")
    table = ledger.contribution(trades(s, d), ["pair"]).withColumn("gains", F.when(F.col("profit") > 0, "Yes").otherwise("no"))
    files.write_table(table.select("pair", "trades", "gains", "profit"), path, "csv")
    return files.read_checked(s, path, ["pair", "trades", "gains"], ["gains"]).select("pair", F.col("trades").cast("long").alias("trades"), "gains", F.col("profit").cast("double").alias("profit"))


book.add("checked_table", checked_table, f"{T} SELECT pair, count(*) AS trades, sum(profit_abs) > 0 AS gains, sum(profit_abs) AS profit FROM trades GROUP BY pair", "profit:1")
book.add(
    "stacked_sections",
    lambda s, d: files.stack_sections({"pairs": ledger.contribution(trades(s, d), ["pair"]).select("pair", "trades"), "years": ledger.contribution(trades(s, d), ["year"]).select("year", "trades")}),
    f"{T} SELECT 'pairs' AS section, pair, CAST(NULL AS VARCHAR) AS year, count(*) AS trades FROM trades GROUP BY pair UNION ALL SELECT 'years', NULL, year, count(*) FROM trades GROUP BY year",
)


def pending(s, d):
    """Units of work (strategy, pair, year) whose long side has no trade yet."""
    t = trades(s, d)
    units = ["strategy", "pair", "year"]
    return files.pending_units(t.select(*units).distinct(), t.where("not is_short"), units)


book.add("pending_units", pending, f"{T} SELECT strategy, pair, year FROM trades GROUP BY ALL HAVING count(*) FILTER (NOT is_short) = 0")
