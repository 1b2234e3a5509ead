"""Checks as data jobs: causality, warm-up, result integrity, text scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.gates import lookahead

#: Invisible and direction-changing code points that are reported (fixed values).
HIDDEN = (0x00AD, 0x061C, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)

#: Cuts of one causality check; their dates are part of its plan.
MOST_CUTS = 1_000


def causality_check(bars: DataFrame, cuts: DataFrame, compute: Callable[[DataFrame], DataFrame], entries: list[str], exits: list[str], days: int = 60, margin: str | None = None) -> DataFrame:
    """Recompute entry and exit flags on history that ends at each cut and compare them with the full run.
    ``cuts``: (cut). Per cut, over its last ``days`` days: rows compared, entry signals of the full run, rows whose entries or
    exits differ, and the decision. A cut's copy of the bars gets its own pair name, so all cuts run in one job. With ``margin`` (an
    interval) a copy holds only the compared days and the margin before them, so that the rows grow with the cuts, not with cuts
    times history; it must be as long as ``compute`` looks back, else a shorter memory shows as a difference."""
    flags = [*entries, *exits]
    full = compute(bars).select("pair", "ts", *flags)
    dates = [r.cut for r in cuts.limit(MOST_CUTS + 1).collect()]
    if len(dates) > MOST_CUTS:
        raise ValueError(f"more than {MOST_CUTS} cuts; check them in parts")
    from_cut = lambda c: c - F.expr(f"INTERVAL {days} DAYS") - F.expr(f"INTERVAL {margin}")
    held = lambda c: (c >= F.col("ts")) & (F.col("ts") > from_cut(c)) if margin else c >= F.col("ts")
    copies = bars.withColumn("cut", F.explode(F.filter(F.sort_array(F.lit(dates)), held)))
    short = compute(copies.withColumn("pair", F.concat_ws("@", "pair", F.date_format("cut", "yyyyMMdd"))).drop("cut"))
    short = short.withColumns({"cut": F.to_date(F.substring_index("pair", "@", -1), "yyyyMMdd").cast("timestamp_ntz"), "pair": F.substring_index("pair", "@", 1)})
    short = short.select("pair", "ts", "cut", *(F.col(c).alias(f"short_{c}") for c in flags))
    both = short.where(F.col("ts") > F.col("cut") - F.expr(f"INTERVAL {days} DAYS")).join(full, ["pair", "ts"])

    def differs(columns):
        out = F.lit(False)
        for c in columns:
            out = out | ~F.col(c).eqNullSafe(F.col(f"short_{c}"))
        return out

    entered = F.greatest(F.lit(0), *(F.col(c).cast("int") for c in entries)) > 0
    out = both.groupBy("cut").agg(F.count("*").alias("compared"), F.count(F.when(entered, 1)).alias("signals"), F.count(F.when(differs(entries), 1)).alias("biased_entries"), F.count(F.when(differs(exits), 1)).alias("biased_exits"))
    return out.withColumn("decision", lookahead(F.col("signals"), F.col("biased_entries"), F.col("biased_exits")))


def verify_matrix(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, duplicates, and keys that are missing or not expected."""
    n = df.agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("distinct_keys"))
    missing = expected.select(*keys).exceptAll(df.select(*keys)).agg(F.count("*").alias("missing"))
    extra = df.select(*keys).distinct().exceptAll(expected.select(*keys).distinct()).agg(F.count("*").alias("unexpected"))
    out = n.join(F.broadcast(missing)).join(F.broadcast(extra))  # one row each
    return out.withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))


def hidden_unicode(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, code_point, n): how often each hidden code point occurs, and bare carriage returns as 13. Counted by
    removal, so a text is never split into characters."""
    t = F.col(text_col)
    chars = "".join(map(chr, HIDDEN))
    rows = df.where(t.rlike(f"[{chars}\r]"))
    bare = F.replace(t, F.lit("\r\n"), F.lit(""))
    counts = [F.struct(F.lit(p).alias("code_point"), (F.length(t) - F.length(F.replace(t, F.lit(chr(p)), F.lit("")))).alias("n")) for p in HIDDEN]
    counts.append(F.struct(F.lit(13).alias("code_point"), (F.length(bare) - F.length(F.replace(bare, F.lit("\r"), F.lit("")))).alias("n")))
    return rows.select(F.col(id_col), F.explode(F.array(*counts)).alias("c")).select(id_col, "c.*").where("n > 0")


def hidden_positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, code_point) of every hidden code point and bare carriage return, positions in code points from 0. One split at
    them gives the lengths between; positions are their running sums, over the hits of a text alone."""
    t, pattern = F.col(text_col), f"[{''.join(map(chr, HIDDEN))}]|\r(?!\n)"
    rows = df.where(t.rlike(pattern)).select(id_col, F.monotonically_increasing_id().alias("_row"), F.split(t, pattern, -1).alias("_parts"), F.regexp_extract_all(t, F.lit(pattern), 0).alias("_hits"))
    found = F.transform("_hits", lambda h, k: F.struct(k.alias("_k"), F.length(F.element_at("_parts", k + 1)).alias("_gap"), F.ascii(h).alias("code_point")))
    hits = rows.select(id_col, "_row", F.inline(found))
    before = F.sum("_gap").over(Window.partitionBy("_row").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return hits.select(id_col, (before + F.col("_k")).alias("position"), "code_point")


def line_matches(df: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, rule, line_no, allowed) for rules (name, pattern, allowed context): matching lines, numbered from 1. Patterns are
    held against each line alone; "\\n" is the only end of a line, so that ``$`` stands behind a carriage return."""
    found = lambda p: F.col("line").rlike(f"(?d){p}")
    lines = df.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    hits = F.array_compact(F.array(*(F.when(found(p), F.struct(F.lit(n).alias("rule"), found(ok).alias("allowed"))) for n, p, ok in rules)))
    return lines.withColumn("h", F.explode(hits)).select(id_col, "h.rule", (F.col("pos") + 1).alias("line_no"), "h.allowed")


def warmup_variance(bars: DataFrame, warmups: tuple, compute: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """How far the last row's values move when only the last ``n`` bars are known; one job for all warm-ups.
    ``bars`` needs bar_idx. Per warm-up: pairs compared and the largest absolute difference of each column."""
    ends = bars.groupBy("pair").agg(F.max("bar_idx").alias("_end"))
    last = F.col("bar_idx") == F.col("_end")
    full = compute(bars).join(ends, "pair").where(last).select("pair", *columns)
    rows = bars.join(ends, "pair").withColumn("warmup", F.explode(F.array(*map(F.lit, warmups)))).where("bar_idx > _end - warmup").drop("_end")
    short = compute(rows.withColumn("pair", F.concat_ws("@", "pair", "warmup")).drop("warmup"))
    short = short.join(ends.select(F.col("pair").alias("_p"), "_end"), (F.substring_index("pair", "@", 1) == F.col("_p")) & last)
    short = short.select(F.col("_p").alias("pair"), F.substring_index("pair", "@", -1).cast("int").alias("warmup"), *(F.col(c).alias(f"short_{c}") for c in columns))
    return short.join(full, "pair").groupBy("warmup").agg(F.count("*").alias("pairs"), *(F.max(F.abs(F.col(c) - F.col(f"short_{c}"))).alias(f"max_{c}") for c in columns))
