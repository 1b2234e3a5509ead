"""Trade exports as a data source: each file is read as a stream, and its trades leave it batch by batch.

An export is one JSON object, {"strategy": {name: {"trades": [...], ...}}, ...}, often much larger than one string may be. The
scanner keeps a window of text: it steps over what is not asked for and decodes one trade at a time. A file may hold
several exports one after another; a .zip file is read from its first .json member, a .gz file is unpacked as it is read.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

TEXTS = ("pair", "open_date", "close_date", "enter_tag", "exit_reason")
NUMBERS = ("profit_abs", "profit_ratio", "amount", "open_rate", "close_rate", "fee_open", "fee_close", "stake_amount")
SCHEMA = "strategy string, is_short boolean, " + ", ".join([f"{c} string" for c in TEXTS] + [f"{c} double" for c in NUMBERS])
#: Characters read at a time, and trades of a batch.
WINDOW, BATCH = 1 << 18, 5_000


class Scanner:
    def __init__(self, source, window: int = WINDOW):
        self.source, self.window = source, window
        self.text, self.at, self.ended = "", 0, False
        self.decode = json.JSONDecoder().raw_decode

    def more(self, size: int | None = None) -> bool:
        """Drop what lies behind and read on; False at the end."""
        read = "" if self.ended else self.source.read(size or self.window)
        self.ended = not read
        self.text, self.at = self.text[self.at :] + read, 0
        return bool(read)

    def peek(self) -> str:
        """The next character that is not white space, "" at the end."""
        while True:
            self.at = re.compile(r"\s*").match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, expected: str) -> None:
        if self.peek() != expected:
            raise ValueError(f"expected {expected!r}, found {self.text[self.at : self.at + 20]!r}")
        self.at += 1

    def value(self):
        """The next value as a whole; it must fit in memory."""
        self.peek()
        size = self.window
        while True:
            try:
                found, end = self.decode(self.text, self.at)
            except json.JSONDecodeError:
                if not self.more(size):
                    raise
                size *= 2  # a long value is not tried over and over
                continue
            if end < len(self.text) or self.ended:
                self.at = end
                return found
            self.more()  # a number at the window's end may go on

    def skip(self) -> None:
        """Step over the next value, however large."""
        if self.peek() not in "{[":
            self.value()
            return
        depth, token = 0, re.compile(r'[{}\[\]]|"(?:[^"\\]|\\.)*"', re.S)
        while True:
            found = token.search(self.text, self.at)
            quote = self.text.find('"', self.at)
            if not found or (0 <= quote < found.start()):  # a string that goes on behind the window
                self.at = quote if quote >= 0 else len(self.text)
                if not self.more():
                    raise ValueError("the export ends inside a value")
                continue
            self.at = found.end()
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(found[0], 0)
            if not depth:
                return

    def members(self) -> Iterator[str]:
        """The keys of an object; its reader takes or skips each value."""
        self.take("{")
        while self.peek() != "}":
            key = self.value()
            self.take(":")
            yield key
            if self.peek() == ",":
                self.at += 1
        self.take("}")

    def elements(self) -> Iterator:
        self.take("[")
        while self.peek() != "]":
            yield self.value()
            if self.peek() == ",":
                self.at += 1
        self.take("]")


def trades_of(source, strategy: str | None = None, window: int = WINDOW) -> Iterator[tuple[str, dict]]:
    """(strategy, trade) of every export in a text stream."""
    scanner = Scanner(source, window)
    while scanner.peek():
        for key in scanner.members():
            if key != "strategy":
                scanner.skip()
                continue
            for name in scanner.members():
                if strategy is not None and name != strategy:
                    scanner.skip()
                    continue
                for part in scanner.members():
                    if part == "trades":
                        for trade in scanner.elements():
                            yield name, trade
                    else:
                        scanner.skip()


@dataclass
class TradeFile(InputPartition):
    path: str
    value: int = 0  # the base class's own field


class TradeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.strategy = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("strategy",) and self.strategy is None:
                self.strategy = f.value
            else:
                yield f

    def partitions(self) -> list[TradeFile]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        one = store.get_file_info(base)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        return [TradeFile(i.path) for i in found if i.type == fs.FileType.File and i.path.endswith((".json", ".zip", ".txt", ".json.gz", ".txt.gz"))] or [TradeFile("")]

    def read(self, partition: TradeFile):
        import gzip
        import io
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        text = lambda x: None if x is None else str(x)
        types = [pa.string(), pa.bool_(), *[pa.string()] * len(TEXTS), *[pa.float64()] * len(NUMBERS)]
        names = ["strategy", "is_short", *TEXTS, *NUMBERS]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        with store.open_input_file(partition.path) as raw:
            if partition.path.endswith(".zip"):
                archive = zipfile.ZipFile(raw)
                raw = archive.open(next(n for n in sorted(archive.namelist()) if n.endswith(".json")))  # noqa: SIM115
            elif partition.path.endswith(".gz"):
                raw = gzip.GzipFile(fileobj=raw)
            rows = []
            for name, t in trades_of(io.TextIOWrapper(raw, encoding="utf-8"), self.strategy):
                number = lambda c: None if t.get(c) is None else float(t[c])  # noqa: B023, E731
                rows.append((name, bool(t.get("is_short")), *(text(t.get(c)) for c in TEXTS), *map(number, NUMBERS)))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class TradeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trade_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TradeReader:
        return TradeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TradeFiles)
