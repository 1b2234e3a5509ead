"""Streams over ticks and bars. Rows later than the watermark are dropped and counted; what is still open is not emitted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from quantloom.functions.tables import shared_path
from quantloom.operators.recursive import decayed

STATE = "closes array<double>, volumes array<double>, seen long, last_close double, ups double, downs double, ema double"


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "2 hours", closed: bool = False) -> DataFrame:
    """Closed bars of (pair, ts, price, quantity, seq); append mode emits a bar once the watermark has passed it. ``closed`` adds the last
    moment of each bar, which hands the watermark on to the next stateful operator."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("pair", F.window("ts", every).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume")
    )
    return bars.select("pair", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", *([F.window_time("w").alias("closed")] if closed else []))


def stream_clusters(events: DataFrame, gap: str = "72 hours", late: str = "1 hour") -> DataFrame:
    """Clusters of events (pair, ts) as sessions: a gap of exactly ``gap`` stays in the session."""
    sessions = events.withWatermark("ts", late).groupBy("pair", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("size"), F.max("ts").alias("last_ts"))
    return sessions.select("pair", F.col("w.start").alias("cluster_start"), "last_ts", "size")


def stream_cooldowns(trades: DataFrame, every: str = "1 hour", reach: str = "24 hours", late: str = "1 hour", stops: int = 3) -> DataFrame:
    """Sliding counts of stop exits per side (is_short, close_date, exit_reason); ``locked`` where there are too many."""
    w = F.window("close_date", reach, every)
    counts = trades.withWatermark("close_date", late).groupBy("is_short", w.alias("w")).agg(F.count(F.when(F.col("exit_reason") == "stop_loss", 1)).alias("stops"), F.count("*").alias("trades"))
    return counts.select("is_short", F.col("w.end").alias("at"), "stops", "trades", (F.col("stops") >= stops).alias("locked"))


INDICATORS = "pair string, ts timestamp, price_z double, vol_z double, bb_mid double, ema20 double, rsi double"
BAR = "ts timestamp, close double, volume double"
EMPTY = ([], [], 0, 0.0, 0.0, 0.0, 0.0)


def advance(frame: pd.DataFrame, state: tuple, n: int = 20, wilder: int = 14) -> tuple[pd.DataFrame, tuple]:
    """Indicators of bars (ts, close, volume) in order, that follow the bars summed up in ``state``, and the state after them. The state
    holds the last n - 1 closes and volumes, the number of bars, the last close and the smoothed averages."""

    def averaged(x, before, had, k, rate):
        """Running averages: plain sums of x / k up to the k-th value, then exponential with ``rate``. ``had``: values before these."""
        first = before + np.cumsum(x[: max(0, k - had)] / k)
        return np.append(first, decayed(x[len(first) :] * rate, 1 - rate, first[-1] if len(first) else before))

    closes, volumes, seen, last, up, down, ema = state
    c, v = np.append(closes, frame["close"].to_numpy(float)), np.append(volumes, frame["volume"].to_numpy(float))
    m, held = len(frame), len(closes)
    fresh = c[held:]
    change = np.diff(fresh, prepend=last if seen else fresh[0])[0 if seen else 1 :]
    up, down = (averaged(np.maximum(side * change, 0), before, max(0, seen - 1), wilder, 1 / wilder) for side, before in ((1, up), (-1, down)))
    emas = averaged(fresh, ema, seen, n, 2 / (n + 1))
    place = seen + np.arange(m)
    rows = pd.DataFrame({"ts": frame["ts"].to_numpy(), "price_z": np.nan, "vol_z": np.nan, "bb_mid": np.nan, "ema20": np.where(place >= n - 1, emas, np.nan), "rsi": np.nan})
    if len(c) >= n:  # the last n bars of every row that has them
        at = slice(m - (len(c) - n + 1), None)
        for x, name in ((c, "price_z"), (v, "vol_z")):
            w = np.lib.stride_tricks.sliding_window_view(x, n)
            mean, dev = w.mean(axis=1), w.std(axis=1)
            rows.loc[rows.index[at], name] = np.where(dev > 0, (x[n - 1 :] - mean) / np.where(dev > 0, dev, 1), np.nan)
            if name == "price_z":
                rows.loc[rows.index[at], "bb_mid"] = mean
    total, late = up + down, m - len(change)
    rows.loc[rows.index[late:], "rsi"] = np.where(place[late:] >= wilder, np.where(total > 0, 100 * up / np.where(total > 0, total, 1), 0.0), np.nan)
    ends = [float(x[-1]) if len(x) else 0.0 for x in (up, down)]
    return rows, (c[-(n - 1) :].tolist(), v[-(n - 1) :].tolist(), seen + m, float(fresh[-1]), *ends, float(emas[-1]))


class IndicatorState(StatefulProcessor):
    """A pair's indicators. Bars wait in a list until the watermark has passed them; a timer at the earliest of them takes all that it has
    passed, in order of time, so neither files nor batches need be in order. What is kept besides is a value of fixed size."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BAR)
        self.summary = handle.getValueState("summary", STATE)

    def _take(self, key, bars: list, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ms = lambda ts: int(pd.Timestamp(ts).tz_localize("UTC").timestamp() * 1000)
        ready, rest = [b for b in bars if ms(b[0]) <= passed], [b for b in bars if ms(b[0]) > passed]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(min(ms(b[0]) for b in rest), passed + 1))
        if ready:
            frame = pd.DataFrame(ready, columns=["ts", "close", "volume"]).sort_values("ts")
            rows, state = advance(frame, tuple(self.summary.get()) if self.summary.exists() else EMPTY)
            self.summary.update(state)
            rows.insert(0, "pair", key[0])
            yield rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = list(self.waiting.get())
        for frame in rows:
            bars += [(ts.to_pydatetime(), float(c), float(v)) for ts, c, v in zip(frame["ts"], frame["close"], frame["volume"], strict=True)]
        yield from self._take(key, bars, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._take(key, list(self.waiting.get()), timerValues)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for row in initialState[["closes", "volumes", "seen", "last_close", "ups", "downs", "ema"]].itertuples(index=False):
            self.summary.update((list(map(float, row[0])), list(map(float, row[1])), int(row[2]), *map(float, row[3:])))

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, late: str | None = "2 hours", initial: DataFrame | None = None) -> DataFrame:
    """price_z, vol_z, bb_mid, ema20 and rsi of each closed bar (pair, ts, open, high, low, close, volume) once the watermark has passed
    it. ``late``: the watermark's delay; None where the bars carry a watermark of their own, as those of ``stream_bars`` do.
    ``initial``: states to start from, as ``indicator_states`` makes them out of a table of earlier bars."""
    held = bars.withWatermark("ts", late) if late else bars
    start = initial.groupBy("pair") if initial is not None else None
    return held.groupBy("pair").transformWithStateInPandas(statefulProcessor=IndicatorState(), outputStructType=INDICATORS, outputMode="Append", timeMode="EventTime", initialState=start)


def indicator_states(bars: DataFrame, period: int = 5_000) -> DataFrame:
    """(pair, state) after all bars of a table: what ``stream_indicators`` takes as ``initial``. Averages forget, so a pair's last
    ``period`` bars are enough; only those are gathered."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("ts")))
    recent = bars.withColumn("_back", last).where(F.col("_back") <= period).drop("_back")

    def summed(key, frame: pd.DataFrame) -> pd.DataFrame:
        _, state = advance(frame.sort_values("ts"), EMPTY)
        return pd.DataFrame([(key[0], *state)], columns=["pair", "closes", "volumes", "seen", "last_close", "ups", "downs", "ema"])

    return recent.groupBy("pair").applyInPandas(summed, f"pair string, {STATE}")


def on_rocks(spark: SparkSession) -> None:
    """State with lists, values and timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LateRows(StreamingQueryListener):
    """Writes (query, batch, input_rows, late_rows, watermark) of each batch as a JSON line in ``path``: how many rows came after the watermark
    and were dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = [(str(p.id), int(p.batchId), int(p.numInputRows), int(late), p.eventTime.get("watermark"))]
        self.spark.createDataFrame(row, LATE_ROWS).coalesce(1).write.mode("append").json(self.path)


LATE_ROWS = "query string, batch long, input_rows long, late_rows long, watermark string"


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and return what it emitted, as a table in memory (tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def emitted(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into files below spark.checkpoint.dir and return what it emitted."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def late_rows(spark: SparkSession, stream: Callable[[], DataFrame], arrivals: list[Callable[[], None]], path: str) -> DataFrame:
    """Start a stream after each arrival of files, from where it stopped, and return what its listener wrote of each batch (LATE_ROWS)."""
    listener = LateRows(spark, f"{path}/late")
    spark.streams.addListener(listener)
    try:
        for arrive in arrivals:
            arrive()
            query = stream().writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(LATE_ROWS).json(f"{path}/late")
