"""Feather files of bars, one per pair and timeframe, as a data source.

Each file is a partition; names tell pair and timeframe, so filters on those choose files before any is opened.
A file's record batches are read one at a time, columns as needed, and reading stops behind the last time asked for.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = re.compile(r"([A-Z0-9]+)_([A-Z0-9]+)_([A-Z0-9]+)-([0-9]+[mhdw])-futures\.feather$")
PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = "pair string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class BarFile(InputPartition):
    path: str
    pair: str
    timeframe: str
    value: int = 0  # the base class's own field


class BarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests, self.times = path, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in ("pair", "timeframe") and isinstance(f, EqualTo):
                self.tests.append((column, {f.value}))
            elif column in ("pair", "timeframe") and isinstance(f, In):
                self.tests.append((column, set(f.value)))
            else:
                if column == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    self.times.append((isinstance(f, (LessThan, LessThanOrEqual)), f.value))
                yield f  # times narrow what is read; Spark tests each row

    def partitions(self) -> list[BarFile]:
        from pyarrow import fs

        store, base = filesystem(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            name = NAME.search(info.base_name)
            if name:
                facts = {"pair": f"{name[1]}/{name[2]}:{name[3]}", "timeframe": name[4]}
                if all(facts[c] in allowed for c, allowed in self.tests):
                    out.append(BarFile(info.path, facts["pair"], facts["timeframe"]))
        return out or [BarFile("", "", "")]

    def read(self, partition: BarFile):
        import datetime as dt

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not partition.path:
            return
        utc = lambda t: t if t.tzinfo else t.replace(tzinfo=dt.UTC)
        until = [utc(t) for upper, t in self.times if upper]
        since = [utc(t) for upper, t in self.times if not upper]
        stamp = pa.timestamp("us", "UTC")
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.path) as source, pa.ipc.open_file(source) as file:
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                if not batch.num_rows:
                    continue
                ts = batch.column(batch.schema.get_field_index("date"))
                ts = (pc.assume_timezone(ts, "UTC") if ts.type.tz is None else ts).cast(stamp, safe=False)
                if until and ts[0].as_py() > min(until):
                    return  # a file is in order of time
                if since and ts[-1].as_py() < max(since):
                    continue
                numbers = [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()) for c in PRICES]
                finite = [pa.array(x, mask=~np.isfinite(x)) for x in (c.to_numpy(zero_copy_only=False) for c in numbers)]  # what is not finite becomes null
                same = lambda text: pa.array([text] * len(ts), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(partition.pair), same(partition.timeframe), ts, *finite], ["pair", "timeframe", "ts", *PRICES])


@dataclass
class Written(WriterCommitMessage):
    files: list


class BarWriter(DataSourceArrowWriter):
    """Rows come sorted by pair and time; a file is open at a time, and its final name appears when all tasks are done."""

    def __init__(self, path: str, timeframe: str):
        self.path, self.timeframe = path, timeframe

    def write(self, iterator) -> Written:
        import uuid

        import pyarrow as pa

        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        files, sink, writer, pair = [], None, None, None
        schema = pa.schema([("date", pa.timestamp("us", "UTC")), *((c, pa.float64()) for c in PRICES)])

        def finish():
            if writer:
                writer.close()
                sink.close()

        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            names, begin = rows.column("pair").to_pylist(), 0
            while begin < len(names):
                end = begin
                while end < len(names) and names[end] == names[begin]:
                    end += 1
                if names[begin] != pair:
                    finish()
                    pair = names[begin]
                    final = f"{base}/{re.sub('[/:]', '_', pair)}-{self.timeframe}-futures.feather"
                    if not NAME.search(final):
                        raise ValueError(f"no file name for the pair {pair!r} and the timeframe {self.timeframe!r}")
                    files.append((f"{final}.{uuid.uuid4().hex}", final))
                    sink = store.open_output_stream(files[-1][0])
                    writer = pa.ipc.new_file(sink, schema)
                part = rows.slice(begin, end - begin)
                writer.write_table(pa.table([part.column("ts").cast(schema.field(0).type), *(part.column(c).cast(pa.float64()) for c in PRICES)], schema=schema))
                begin = end
        finish()
        return Written(files)

    def commit(self, messages) -> None:
        store, _ = filesystem(self.path)
        for m in messages:
            for temporary, final in m.files if m else []:
                store.move(temporary, final)

    def abort(self, messages) -> None:
        store, _ = filesystem(self.path)
        for m in messages:
            for temporary, _ in m.files if m else []:
                store.delete_file(temporary)


class BarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BarWriter:
        return BarWriter(self.options["path"], self.options["timeframe"])


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarFiles)


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """(pair, timeframe, ts, open, high, low, close, volume) of the Feather files below a folder; filters on pair and timeframe choose
    files, filters on ts what is read of them."""
    register(spark)
    return spark.read.format("bar_files").load(path)


def write_bar_files(bars: DataFrame, path: str, timeframe: str) -> None:
    """A Feather file for each pair of ``bars`` (pair, ts, open, high, low, close, volume), in order of time."""
    register(bars.sparkSession)
    rows = bars.select("pair", "ts", *PRICES).repartition("pair").sortWithinPartitions("pair", "ts")
    rows.write.format("bar_files").option("timeframe", timeframe).mode("append").save(path)
