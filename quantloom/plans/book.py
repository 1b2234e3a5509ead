"""A book of queries. Double columns are rounded alike on both sides, so that summing in another order does not show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None, rounded: str = "") -> None:
        """``rounded``: double columns, "name" to 6 places or "name:places"."""
        places = {c.partition(":")[0]: int(c.partition(":")[2] or 6) for c in rounded.split()}

        def run(spark, sf_dir: str) -> DataFrame:
            df = query(spark, sf_dir)
            return df.withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in places.items()}) if places else df

        self.queries[name] = run
        if sql:
            replace = ", ".join(f"round({c}, {k}) + 0.0 AS {c}" for c, k in places.items())
            self.oracles[name] = f"SELECT * REPLACE ({replace}) FROM ({sql})" if places else sql
