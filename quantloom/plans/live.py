"""Streaming queries over the event table, run to its end. What the watermark has not passed is not emitted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.columns import stamp
from quantloom.functions.tables import shared_path, written
from quantloom.plans import frames
from quantloom.plans.book import Book
from quantloom.plans.study import HOURS, TS
from quantloom.sources import bars as source
from quantloom.streaming import streams

book = Book()


def event_stream(s, d):
    path = f"{d}/events.parquet"
    # a pattern, as a stream of files takes a folder or a pattern, not a file
    events = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def ticks(s, d):
    return event_stream(s, d).select(F.col("event_type").alias("pair"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("event_id").alias("seq"))


PASSED = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"
book.add(
    "stream_bars",
    lambda s, d: streams.emitted(streams.stream_bars(ticks(s, d)), "stream-bars").withColumn("ts", stamp(F.col("ts"))),
    f"""WITH e AS (SELECT *, date_trunc('hour', ts) AS hour FROM events),
    b AS (SELECT event_type AS pair, hour, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
      CAST(count(*) AS DOUBLE) AS volume FROM e GROUP BY ALL)
    SELECT pair, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM b WHERE hour + INTERVAL 1 HOUR <= {PASSED} - INTERVAL 2 HOUR""",
    "open high low close",
)
book.add(
    "stream_clusters",
    lambda s, d: streams.emitted(streams.stream_clusters(event_stream(s, d).select(F.col("user_id").cast("string").alias("pair"), "ts"), "24 hours"), "stream-clusters").withColumns({c: stamp(F.col(c)) for c in ("cluster_start", "last_ts")}),
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS pair, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 24 HOUR, true) AS opens,
      event_id FROM events),
    n AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY pair ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e),
    c AS (SELECT pair, no, min(ts) AS a, max(ts) AS z, count(*) AS size FROM n GROUP BY ALL)
    SELECT pair, strftime(a, '%Y-%m-%d %H:%M:%S') AS cluster_start, strftime(z, '%Y-%m-%d %H:%M:%S') AS last_ts, size FROM c
      WHERE z + INTERVAL 24 HOUR <= {PASSED} - INTERVAL 1 HOUR""",
)
book.add(
    "stream_cooldowns",
    lambda s, d: streams.emitted(
        streams.stream_cooldowns(event_stream(s, d).select((F.col("event_id") % 2 == 1).alias("is_short"), F.col("ts").alias("close_date"), F.when(F.col("value") < 5, "stop_loss").otherwise("roi").alias("exit_reason"))), "stream-cooldowns"
    ).withColumn("at", stamp(F.col("at"))),
    f"""WITH w AS (SELECT event_id % 2 = 1 AS is_short, value, date_trunc('hour', ts) + to_hours(CAST(k + 1 AS INT)) AS until FROM events, range(24) r(k))
    SELECT is_short, strftime(until, '%Y-%m-%d %H:%M:%S') AS "at", count(*) FILTER (value < 5) AS stops, count(*) AS trades, count(*) FILTER (value < 5) >= 3 AS locked
      FROM w WHERE until <= {PASSED} - INTERVAL 1 HOUR GROUP BY is_short, until""",
)


def hour_bars(s, d):
    return source.bars_hour(s, d).withColumn("ts", F.col("ts").cast("timestamp"))


def hour_stream(s, d):
    """The hourly bars, written once in as many files as there are tasks, as a stream: in no order."""
    bars = written(hour_bars(s, d).repartition("ts"), "hour-bars")
    return s.readStream.schema(bars.schema).parquet(bars.inputFiles()[0].rpartition("/")[0])


STREAMED = ["price_z", "vol_z", "bb_mid", "ema20", "rsi"]
INDICATED = f"WITH {HOURS}, {frames.rolling_sql('hours')}, {frames.recursive_sql('rec', 'ind', (20,))} SELECT pair, {TS} AS ts, {', '.join(STREAMED)} FROM rec"


def indicated(s, stream, name):
    streams.on_rocks(s)
    return streams.emitted(stream, name).select("pair", stamp(F.col("ts")).alias("ts"), *STREAMED)


book.add(
    "stream_indicators",
    lambda s, d: indicated(s, streams.stream_indicators(hour_stream(s, d)), "stream-indicators"),
    f"{INDICATED} WHERE ts <= (SELECT max(ts) FROM hours) - INTERVAL 2 HOUR",
    " ".join(STREAMED),
)
book.add(
    "stream_tick_indicators",
    lambda s, d: indicated(s, streams.stream_indicators(streams.stream_bars(ticks(s, d), closed=True), late=None), "stream-tick-indicators"),
    f"{INDICATED} WHERE ts + INTERVAL 1 HOUR <= {PASSED} - INTERVAL 2 HOUR",
    " ".join(STREAMED),
)


def late_bars(s, d):
    """Bars of even hours, then, when the stream is started again where it stopped, those of odd hours: how many come too late a batch."""
    streams.on_rocks(s)
    path, bars = shared_path(s, "late-bars"), hour_bars(s, d)
    halves = F.hour("ts") % 2
    return streams.late_rows(
        s,
        lambda: streams.stream_indicators(s.readStream.schema(bars.schema).parquet(f"{path}/bars")),
        [lambda k=k: bars.where(halves == k).write.mode("append").parquet(f"{path}/bars") for k in (0, 1)],
        path,
    )


book.add(
    "stream_late_rows",
    lambda s, d: late_bars(s, d).where("input_rows > 0").select(F.dense_rank().over(Window.orderBy("batch")).cast("long").alias("start"), "input_rows", "late_rows"),
    f"""WITH {HOURS}, e AS (SELECT CAST(hour(ts) % 2 AS BIGINT) + 1 AS start, ts FROM hours)
    SELECT start, count(*) AS input_rows, count(*) FILTER (start = 2 AND ts <= (SELECT max(ts) FROM e WHERE start = 1) - INTERVAL 2 HOUR) AS late_rows FROM e GROUP BY start""",
)
