"""As-of joins by union and a running last value: one shuffle, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts", by: tuple = (), columns: tuple = (), suffix: str = "", period: str | None = None) -> DataFrame:
    """Adds to each left row the columns of the latest right row with right.on <= left.on (per ``by``).
    With ``period`` (day, month, year) rows are put in order per period only, and the last value before a period is
    carried into it, so that a join without a key, or with a hot one, is many tasks. Null keys and times match each other."""
    empty = lambda rows, c: F.lit(None).cast(rows.select(c.alias("p")).schema["p"].dataType)
    packed, whole = F.struct(*(F.col(c) for c in columns)), F.struct(*left.columns)
    keys = [F.col(k) for k in by]
    a = left.select(*keys, F.col(on).alias("_at"), F.lit(1).alias("_side"), whole.alias("_row"), empty(right, packed).alias("_info"))
    b = right.select(*keys, F.col(on).alias("_at"), F.lit(0).alias("_side"), empty(left, whole).alias("_row"), packed.alias("_info"))
    part = F.date_trunc(period, "_at") if period else F.lit(0)
    seen = a.unionByName(b).withColumn("_part", part)
    w = Window.partitionBy(*by, "_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_info", ignorenulls=True)
    out = seen.withColumn("_last", last.over(w)).where("_side = 1")
    if period:
        ends = seen.groupBy(*by, "_part").agg(F.max_by("_info", F.when(F.col("_side") == 0, F.col("_at"))).alias("_info"))
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a period
        ends = ends.select(*(F.col(k).alias(f"_{k}_") for k in (*by, "_part")), last.over(before).alias("_carried"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in (*by, "_part")]
        out = out.join(ends, same, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return out.select("_row.*", *(F.col(f"_last.{c}").alias(c + suffix) for c in columns))


def attach_informative(base: DataFrame, info: DataFrame, columns: tuple, base_step: str, info_step: str, suffix: str = "_info", period: str | None = "year") -> DataFrame:
    """The last closed bar of the larger timeframe: a bar opened at H is visible from H + info_step - base_step on. A pair's
    bars are put in order per ``period`` (None: as a whole)."""
    visible = info.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {info_step}") - F.expr(f"INTERVAL {base_step}"))
    return asof_join(base, visible, "ts", ("pair",), columns, suffix, period)
