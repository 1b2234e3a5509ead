"""What is left after removals that do not add up: drawdowns and medians, without a copy of the rows for each removal.

Drawdown. A run of trades is summed up as (n, total, peak, bottom, fall): its sum, the highest and the lowest of
its running sums, and the deepest fall below an earlier running sum. Two runs join into one by arithmetic. Trades are
dealt by key and month and read in order, ``BLOCK`` at a time; beside its own numbers a run keeps the same five
without the removed trades, for each removal that touches it. A run of a month ends early where it holds ``LABELS``
removals, so a task's memory is bounded. The runs are then joined in a tree, ``FAN`` at a time; a removal that does
not touch a child takes the child's own numbers. So trades are moved once, and a level has a row for each (run, removal that touches it).

Medians. Rows are ranked once. Without a group, the k-th row of the rest stands at place k plus the number of the group's
rows before it, which is a count of the group's rows that have at most k others before them.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from quantloom.functions.columns import flag
from quantloom.functions.tables import written
from quantloom.operators.rows import value_positions

FAN = 16
#: Trades read at a time, removals of a run, and removals of a block worked on at once.
BLOCK, LABELS, AT_ONCE = 1_024, 16_384, 256
#: Whole numbers below EXACT in sum are kept in 64 bits, larger ones as Python's. BIG stands for no running sum yet.
EXACT, BIG, HUGE = 1 << 60, 1 << 61, 1 << 200


def _join(a: Column, b: Column, kind: str) -> Column:
    """The run a followed by the run b; null is a run without trades."""
    total = lambda x, y: (x + y).cast(kind)
    both = F.struct(
        (a["n"] + b["n"]).alias("n"),
        total(a["total"], b["total"]).alias("total"),
        F.greatest(a["peak"], total(a["total"], b["peak"])).alias("peak"),
        F.least(a["bottom"], total(a["total"], b["bottom"])).alias("bottom"),
        F.least(a["fall"], b["fall"], (a["total"] + b["bottom"] - a["peak"]).cast(kind)).alias("fall"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def _run(runs: Column, kind: str) -> Column:
    none = F.lit(None).cast(f"struct<n:bigint,total:{kind},peak:{kind},bottom:{kind},fall:{kind}>")
    return F.aggregate(runs, none, lambda a, b: _join(a, b, kind))


def _big(kind):
    return float("inf") if kind == np.float64 else BIG if kind == np.int64 else HUGE


def _block_runs(values: np.ndarray, gone: np.ndarray) -> list[np.ndarray]:
    """(n, total, peak, bottom, fall) of the trades without those that each row of ``gone`` marks."""
    big = _big(values.dtype)
    sums = np.where(gone, 0, values).cumsum(axis=1)
    peaks = np.maximum.accumulate(np.where(gone, -big, sums), axis=1)
    falls = np.where(gone, 0, sums - peaks)
    return [(~gone).sum(axis=1), sums[:, -1], peaks[:, -1], np.where(gone, big, sums).min(axis=1), falls.min(axis=1)]


def _joined(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    fall = np.minimum(np.minimum(a[4], b[4]), a[1] + b[3] - a[2])
    return [a[0] + b[0], a[1] + b[1], np.maximum(a[2], a[1] + b[2]), np.minimum(a[3], a[1] + b[3]), np.where((a[0] > 0) & (b[0] > 0), fall, np.where(a[0] > 0, a[4], b[4]))]


class _Runs:
    """The run read so far, in place 0, and the same without each removal that touched it."""

    def __init__(self, kind):
        self.kind, self.places, self.size = kind, {None: 0}, 0.0
        self.runs = self.none(1)

    def none(self, n: int) -> list[np.ndarray]:
        big = _big(self.kind)
        return [np.zeros(n, np.int64), *(np.full(n, v, self.kind) for v in (0, -big, big, 0))]

    def add(self, values: np.ndarray, rows: np.ndarray, codes: np.ndarray, labels: list) -> None:
        """One block: row ``rows[k]`` is taken away by the removal ``labels[codes[k]]``."""
        if self.kind != np.float64:
            self.size += float(np.abs(values.astype(np.float64)).sum())
            if self.kind == np.int64 and (values.dtype == object or self.size >= EXACT):
                self.kind = np.dtype(object)
                empty = self.runs[0] == 0
                self.runs = [self.runs[0], *(c.astype(object) for c in self.runs[1:])]
                self.runs[2][empty], self.runs[3][empty] = -HUGE, HUGE
        values = values.astype(self.kind)
        touched, codes = np.unique(codes, return_inverse=True)
        places = [self.places.setdefault(labels[c], len(self.places)) for c in touched]
        new = len(self.places) - len(self.runs[0])
        whole = _block_runs(values, np.zeros((1, len(values)), bool))
        before = [np.concatenate([c, np.repeat(c[:1], new)]) for c in self.runs]
        after = [np.repeat(c, len(self.places)) for c in whole]
        by_code = np.argsort(codes, kind="stable")
        rows, codes, places = rows[by_code], codes[by_code], np.array(places, np.int64)
        for k in range(0, len(touched), AT_ONCE):
            part = slice(*np.searchsorted(codes, [k, k + AT_ONCE]))
            gone = np.zeros((min(AT_ONCE, len(touched) - k), len(values)), bool)
            gone[codes[part] - k, rows[part]] = True
            for column, found in zip(after, _block_runs(values, gone), strict=True):
                column[places[k : k + AT_ONCE]] = found
        self.runs = _joined(before, after)


def _numbers(column, scale: int | None) -> np.ndarray:
    """Doubles, or decimals as whole numbers of their last place; null is 0."""
    import pyarrow as pa

    if scale is None:
        return np.nan_to_num(column.to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf) if column.null_count else column.to_numpy(zero_copy_only=False)
    column = column.cast(pa.decimal128(38, scale))
    halves = np.frombuffer(column.buffers()[1], "<i8")[2 * column.offset : 2 * (column.offset + len(column))].reshape(-1, 2)
    known = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    low, high = (np.where(known, halves[:, k], 0) for k in (0, 1))
    if (high == low >> 63).all():
        return low
    return high.astype(object) * (1 << 64) + low.view(np.uint64).astype(object)


def _read_runs(batches, keys: list[str], scale: int | None, block: int, most: int):
    """Runs of trades that come sorted by ``keys`` (the last is the month): keys, _seq, removed and the run's numbers."""
    import decimal

    import pyarrow as pa

    kind = np.dtype(np.float64 if scale is None else np.int64)
    current, seq, held, types = None, 0, None, None
    number = pa.float64() if scale is None else pa.decimal128(38, scale)

    def told():
        some = np.flatnonzero(held.runs[0] > 0)
        names, n = list(held.places), len(held.places)
        with decimal.localcontext(prec=76):
            value = (lambda v: float(v)) if scale is None else (lambda v: decimal.Decimal(int(v)).scaleb(-scale))
            columns = [[None] * n for _ in range(4)]
            for out, column in zip(columns, held.runs[1:], strict=True):
                for k in some:
                    out[k] = value(column[k])
        arrays = [pa.array([v] * n, t) for v, t in zip(current, types, strict=True)]
        arrays += [pa.array([seq] * n, pa.int64()), pa.array(names, pa.string()), pa.array(held.runs[0], pa.int64()), *(pa.array(c, number) for c in columns)]
        return pa.RecordBatch.from_arrays(arrays, [*keys, "_seq", "removed", "n", "total", "peak", "bottom", "fall"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k) for k in range(len(keys))]
        types = [c.type for c in own]
        values, by = _numbers(batch.column(len(keys)), scale), batch.column(len(keys) + 1)
        ends, flat = np.asarray(by.offsets), by.values.dictionary_encode()
        labels = flat.dictionary.to_pylist()
        codes = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(values)), np.diff(ends))
        changes = [np.flatnonzero(np.diff(c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))) + 1 for c in own]
        cuts = np.unique(np.concatenate([[0, len(values)], *changes]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here = [c[a].as_py() for c in own]
            if held is None or here != current:
                if held is not None:
                    yield told()
                current, seq, held = here, 0, _Runs(kind)
            for i in range(a, b, block):
                j = min(i + block, b)
                part = slice(ends[i] - ends[0], ends[j] - ends[0])
                some = codes[ends[0] :][part] >= 0
                if len(held.places) > most:
                    yield told()
                    seq, held = seq + 1, _Runs(kind)
                held.add(values[i:j], rows[part][some] - i, codes[ends[0] :][part][some], labels)
    if held is not None:
        yield told()


def removal_drawdowns(trades: DataFrame, keys: list[str], removed_by: Column, profit: str = "profit_abs", order: tuple = ("open_date", "close_date", "pair"), fan: int = FAN, block: int = BLOCK, most: int = LABELS) -> DataFrame:
    """Per key and removal: trades_after, profit_after and drawdown_after, beside the whole's trades, profit and max_drawdown.

    ``removed_by``: for each trade, the array of names of the removals that take it away. Drawdown is the deepest fall of
    cumulative profit below its running maximum, which starts at the first trade left. A profit of null counts as 0."""
    held = trades.schema[profit].dataType
    scale = held.scale if isinstance(held, DecimalType) else None
    kind = "double" if scale is None else f"decimal(38,{scale})"
    amount = F.col(profit).alias("_p") if scale is not None else F.col(profit).cast("double").alias("_p")
    period = F.coalesce(F.date_trunc("month", order[0]), F.lit("0001-01-01").cast("timestamp")).alias("_part")
    rows = trades.select(*dict.fromkeys([*keys, *order]), period, amount, F.coalesce(removed_by, F.array().cast("array<string>")).alias("_by"))
    own = [*keys, "_part"]
    rows = rows.repartition(*own).sortWithinPartitions(*own, *order, "_p").select(*own, "_p", "_by")
    shape = StructType([rows.schema[k] for k in own]).add("_seq", "long").add("removed", "string").add("n", "long")
    for c in ("total", "peak", "bottom", "fall"):
        shape = shape.add(c, kind)
    read = partial(_read_runs, keys=own, scale=scale, block=block, most=most)
    placed = written(rows.mapInArrow(read, shape), "removal-runs")
    node = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_seq")) - 1  # a row a run
    numbered = placed.where("removed is null").select(*own, "_seq", node.alias("_node"))
    nodes = numbered.agg(F.max("_node")).first()[0]
    nodes = 0 if nodes is None else nodes + 1
    zero = F.lit(0).cast(kind)
    e = F.when(F.col("n") > 0, F.struct("n", "total", "peak", "bottom", "fall")).alias("e")
    level = written(placed.join(numbered, [*own, "_seq"]).select(*keys, "_node", "removed", e), "removal-nodes")
    while nodes > 1:
        nodes = -(-nodes // fan)
        up = level.groupBy(*keys, F.floor(F.col("_node") / fan).alias("_up"), "removed").agg(F.collect_list(F.struct("_node", "e")).alias("_own"))
        all_of = up.where("removed is null").select(*keys, "_up", F.col("_own").alias("_all"))
        parts = up.join(all_of, [*keys, "_up"])
        touched = F.transform("_own", lambda c: c["_node"])
        children = F.array_sort(F.concat("_own", F.filter("_all", lambda c: ~F.array_contains(touched, c["_node"]))))
        level = written(parts.select(*keys, F.col("_up").alias("_node"), "removed", _run(F.transform(children, lambda r: r["e"]), kind).alias("e")), "removal-level")
    numbers = lambda suffix, fall: (F.coalesce("e.n", F.lit(0)).alias(f"trades{suffix}"), F.coalesce("e.total", zero).alias(f"profit{suffix}"), F.abs(F.coalesce("e.fall", zero)).alias(fall))
    base = level.where("removed is null").select(*keys, *numbers("", "max_drawdown"))
    return level.where("removed is not null").select(*keys, "removed", *numbers("_after", "drawdown_after")).join(base, keys)


def top_labels(trades: DataFrame, keys: list[str], group: str, ns=(1, 3, 5), profit: str = "profit_abs") -> DataFrame:
    """Adds ``top_labels``: top_n for each n whose n best values of ``group`` hold the trade."""
    parts = trades.groupBy(*keys, group).agg(F.sum(profit).alias("_sum"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_sum"), group))  # a row a value of the group
    ranked = written(parts.select(*keys, group, rank.alias("_rank")), "removal-labels")  # a small table is joined without moving the trades
    labels = F.array_compact(F.array(*(F.when(F.col("_rank") <= n, F.lit(f"top_{n}")) for n in ns)))
    return trades.join(ranked, [*keys, group]).withColumn("top_labels", labels).drop("_rank")


def _order_within(ranked: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``_nth``: how many rows of the same keys stand before, by ``_place``; counted per block of places, then added up."""
    parts = ranked.withColumn("_block", F.floor(F.col("_place") / block))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).select(*keys, "_block", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_place")) - 1
    return parts.withColumn("_at", at).join(blocks, [*keys, "_block"]).withColumn("_nth", F.col("_before") + F.col("_at")).drop("_block", "_at", "_before")


def medians_without(df: DataFrame, keys: list[str], group: str, column: Column, out: str = "median_after", block: int = 65_536) -> DataFrame:
    """Per key and value of ``group``: the median of ``column`` over the key's other rows; null where none has a value."""
    known = df.select(*keys, group, column.cast("double").alias("_value")).where("_value is not null")
    ranked = written(value_positions(known, tuple(keys), "_value", group, "_place", "_size"), "removal-ranks")
    of_group = [*keys, group]
    sizes = df.select(*of_group).distinct().join(ranked.groupBy(*of_group).agg(F.count("*").alias("_m")), of_group, "left")
    sizes = sizes.join(ranked.groupBy(*keys).agg(F.count("*").alias("_all")), keys, "left")
    left = F.coalesce("_all", F.lit(0)) - F.coalesce("_m", F.lit(0))
    sizes = sizes.select(*of_group, left.alias("_left"), F.floor((left - 1) / 2).alias("_low"), F.floor(left / 2).alias("_high"))
    others = F.col("_place") - F.col("_nth")  # rows of other groups before this one
    own = _order_within(ranked, of_group, block).join(sizes, of_group)
    skipped = own.groupBy(*of_group).agg(*(F.count_if(others <= F.col(k)).alias(f"{k}_skipped") for k in ("_low", "_high")))
    places = F.explode(F.array(*(F.col(k) + F.coalesce(f"{k}_skipped", F.lit(0)) for k in ("_low", "_high"))))
    wanted = sizes.where("_left > 0").join(skipped, of_group, "left").select(*of_group, places.alias("_place"))
    found = wanted.join(ranked.select(*keys, "_place", "_value"), [*keys, "_place"]).groupBy(*of_group).agg(F.avg("_value").alias(out))
    return sizes.select(*of_group).join(found, of_group, "left")


def leave_one_out_medians(firsts: DataFrame, keys: list[str], group: str, far: str, split: str) -> DataFrame:
    """Per key and value of ``group``: what is left of the key's clusters without it, and whether the edge survives."""
    late = F.col("ts") >= F.lit(split).cast("timestamp")
    excess = F.col(f"excess_{far}")
    n = firsts.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    total = n.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    out = n.join(total, keys).withColumn("clusters", F.col("_total") - F.col("_n")).withColumn("cluster_share", F.col("clusters") / F.col("_total")).drop("_n", "_total")
    columns = {"excess_median": excess, "forward_median": F.col(far), "validation_median": F.when(late, excess)}
    out = reduce(lambda df, c: df.join(medians_without(firsts, keys, group, c[1], c[0]), [*keys, group]), columns.items(), out)
    return out.withColumn("decision", F.when(flag((F.col("excess_median") > 0) & (F.col("validation_median") > 0)), "survives").otherwise("weakens"))
