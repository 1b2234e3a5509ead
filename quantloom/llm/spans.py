"""Positions of regular-expression matches, with built-in functions only.

A text is cut by a pattern into the pieces between its matches; the running length of pieces and matches
gives each match's place in code points. Matches are the leftmost non-overlapping ones, as a scan from
left to right finds them. Patterns are written possessively, so that very long runs need neither
backtracking nor recursion. Only matches, lengths and a little context leave the scan, never the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import text_of

CONTEXT = 40


@dataclass(frozen=True)
class Rule:
    """``gate``: a cheap test that every text with a match passes. ``valid``: of (hit, before, after)."""

    kind: str
    pattern: str
    gate: Column
    valid: Column
    base: bool = True
    context: str = ""
    extra: dict = field(default_factory=dict)


def find_spans(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, kind, start, stop, hit, before, after, valid), one row per match; a document without any has one row with a null kind."""
    text = F.col("t")
    found = [
        F.when(r.gate, F.struct(F.lit(k).alias("kind"), F.arrays_zip(F.split(text, r.pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("hit")).alias("parts")))
        for k, r in enumerate(rules)
    ]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    rows = rows.select("row", "id", F.explode_outer(F.array_compact(F.array(*found))).alias("f"))
    rows = rows.select("row", "id", "f.kind", F.posexplode_outer("f.parts").alias("i", "p"))
    rows = rows.select("row", "id", "kind", "i", F.length("p.piece").alias("gap"), F.left("p.piece", F.lit(CONTEXT)).alias("head"), F.right("p.piece", F.lit(CONTEXT)).alias("before"), F.col("p.hit").alias("hit"))
    rows = rows.where("i is null or i = 0 or hit is not null or gap > 0").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("i")
    size = F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))
    rows = rows.withColumn("stop", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.coalesce(F.lead("head").over(order), F.lit("")))
    rows = rows.withColumn("start", F.col("stop") - F.length("hit"))
    valid = F.lit(False)
    for k, r in reversed(list(enumerate(rules))):
        valid = F.when(F.col("kind") == k, r.valid).otherwise(valid)
    return rows.select("row", "id", "kind", "start", "stop", "hit", "before", "after", (F.col("hit").isNotNull() & F.coalesce(valid, F.lit(False))).alias("valid"))


def score(rules: list[Rule]) -> Column:
    """0.6 for a validated span of a base kind, 0.4 for an added kind; 0.3 more if a context word stands nearby."""
    out = F.lit(0.0)
    for k, r in enumerate(rules):
        near = F.lower(F.concat("before", F.lit(" "), "after")).rlike(r.context) if r.context else F.lit(False)
        out = F.when(F.col("kind") == k, F.lit(0.6 if r.base else 0.4) + F.when(near, 0.3).otherwise(0.0)).otherwise(out)
    return out


def span_digest(spans: DataFrame, rules: list[Rule], id_col: str, more: list[Column] = ()) -> DataFrame:
    """One row per document: a count for each base kind, base_sha256, spans, and ``more`` aggregates."""
    names = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind") + 1)
    label = F.concat_ws(":", names, F.col("start").cast("string"), F.col("stop").cast("string"))
    entry = F.struct("start", "kind", label.alias("label"))
    is_base = F.col("kind").isin([k for k, r in enumerate(rules) if r.base])
    joined = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x["label"]))
    counts = [F.count(F.when(F.col("valid") & (F.col("kind") == k), 1)).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    out = spans.groupBy("row").agg(
        F.first("id").alias(id_col), *counts, F.collect_list(F.when(F.col("valid") & is_base, entry)).alias("b"), F.collect_list(F.when(F.col("valid"), entry)).alias("a"), *more
    )
    out = out.withColumn("base_sha256", F.sha2(joined("b").cast("binary"), 256)).withColumn("spans", joined("a")).drop("row", "a", "b")
    first = [id_col, *(f"n_{r.kind}" for r in rules if r.base), "base_sha256", "spans"]
    return out.select(*first, *(c for c in out.columns if c not in first))
