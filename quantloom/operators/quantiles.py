"""Exact quantiles of groups of any size, without a buffer for a group.

Values are partitioned by ranges of (group, measure, value) and numbered inside a range, so a large group is many ranges
and many small groups are one. The first number and the count of each group in each range tell where a rank stands;
only the rows at those places are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.tables import written

#: Up to so many rows a group's values may be buffered by the engine's own percentile.
BUFFERED_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: list[str], enough: int = 0) -> int:
    """Rows of the largest group of a written table, or of the whole table where that has no more than ``enough``."""
    rows = df.count()  # from the files' footers
    return rows if rows <= enough else df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def quantiles_by_range(df: DataFrame, keys: list[str], measures: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per key the quantile q of each measure (out: (value, q)), between neighbours in proportion; null without values."""
    names = list(measures)
    values = F.array(*(F.struct(F.lit(k).alias("_m"), v.cast("double").alias("_v")) for k, (v, _) in enumerate(measures.values())))
    rows = df.select(*keys, F.inline(F.filter(values, lambda x: x["_v"].isNotNull()))).withColumn("_salt", F.monotonically_increasing_id())
    group = [*keys, "_m"]
    ordered = rows.repartitionByRange(*group, "_v", "_salt").sortWithinPartitions(*group, "_v")  # equal values may fall in several ranges
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(ordered.select(*group, "_v", F.spark_partition_id().alias("_range"), number.alias("_at")), "quantile-places")
    runs = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*group)  # a row a range
    runs = runs.withColumns({"_size": F.sum("_n").over(w), "_before": F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    q = F.element_at(F.array(*(F.lit(float(q)) for _, q in measures.values())), F.col("_m") + 1)
    rank, low = q * (F.col("_size") - 1), F.floor(q * (F.col("_size") - 1))
    ends = F.array(F.struct(low.alias("rank"), (1 - (rank - low)).alias("_share")), F.struct((low + 1).alias("rank"), (rank - low).alias("_share")))
    mine = F.filter(ends, lambda e: (e["_share"] > 0) & (e["rank"] >= F.col("_before")) & (e["rank"] < F.col("_before") + F.col("_n")))
    wanted = runs.withColumn("_e", F.explode(mine)).select(*group, "_range", (F.col("_first") + F.col("_e.rank") - F.col("_before")).alias("_at"), "_e._share")
    found = wanted.join(placed.select("_range", "_at", "_v"), ["_range", "_at"])
    wide = found.groupBy(*keys).agg(*(F.sum(F.when(F.col("_m") == k, F.col("_v") * F.col("_share"))).alias(name) for k, name in enumerate(names)))
    return df.select(*keys).distinct().join(wide, keys, "left") if keys else wide
