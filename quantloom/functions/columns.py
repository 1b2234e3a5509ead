"""Null-safe column helpers. NaN and infinities are turned into nulls where tables are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: Column) -> Column:
    """NaN and infinities as null."""
    big = F.lit(float("inf"))
    return F.when(~F.isnan(column) & (F.abs(column) < big), column)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def flag(condition: Column) -> Column:
    """A condition with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def as_bool(column: Column) -> Column:
    """Permissive booleans of text tables: 1, true, yes and y are true; everything else, null too, is false."""
    return flag(F.lower(F.trim(column.cast("string"))).isin("1", "true", "yes", "y"))


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """year "YYYY", month "YYYY-MM", quarter "YYYYQn" as strings."""
    t = F.col(ts)
    year = F.date_format(t, "yyyy")
    return df.withColumns({"year": year, "month": F.date_format(t, "yyyy-MM"), "quarter": F.concat(year, F.lit("Q"), F.quarter(t))})


def median(column) -> Column:
    return F.percentile(column, F.lit(0.5))


def stamp(ts: Column) -> Column:
    """A timestamp as text, the same in every engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def md5_number(*parts: Column) -> Column:
    """The first 32 bits of an md5 over the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
