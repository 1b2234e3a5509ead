"""Benchmark decontamination by template windows, with built-in functions only.

Numbers, units after numbers and capitalised names inside sentences become typed placeholders that carry
their values (``0n12``, ``0ukm``, ``0pmary``); without the values the text is a template. Every window of
eight template words of every document is joined by hash with the benchmark's windows. As capitals tell the
names, a window with names is also joined with them as plain words, so that copies match whatever their case
and line breaks. Matching windows
are aligned by the distance of their positions. A window with the benchmark's own values counts as it is; one
that matches by template alone counts only if the alignment's slots are consistent: one value of the benchmark
always stands for one value of the document. So verbatim copies match, and so do re-parameterised questions,
but not a text that merely shares the shape of a phrase. A window of placeholders alone (a table of numbers)
has no phrase to share: it counts with the benchmark's own values only. Windows that need no alignment, these
and the ones without slots, are joined once for each distinct window of an item, however often it repeats.

Defined cases: null and empty texts match nothing; very long texts are read whole; items shorter than a window
are matched as one window of their own length; items without words are left out; repeated items match each on
its own; every matching row of a repeated document is reported once; an empty table gives an empty result;
other columns are ignored by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, small_side, table, text_of

WINDOW = 8
#: An item counts as present from this share of its windows on, or from this many windows.
SHARE, ENOUGH = 0.5, 6
#: Benchmark windows that may be broadcast.
BROADCAST_WINDOWS = 1_000_000
UNITS = "km|m|cm|mm|mi|miles?|feet|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|l|ml|lit(?:er|re)s?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|kmh|mph|degrees?"


def valued(text: Column) -> Column:
    """Lower-cased words with placeholders that carry their values, one blank apart. A pattern tests the character that decides
    first and looks behind it afterwards; texts without digits skip the patterns of numbers."""
    text = F.regexp_replace(text, r"[\s\p{Z}&&[^\x20]][\s\p{Z}]*+|\x20[\s\p{Z}]++", " ")
    numbers = F.regexp_replace(text, r"([.,])(?<=[0-9][.,])(?=[0-9])", "q")
    numbers = F.regexp_replace(numbers, r"(?<![\p{L}\p{N}])([0-9]+(?:q[0-9]+)*+)", " 0n$1 ")
    numbers = F.regexp_replace(numbers, rf"(0n[0-9q]++ )\s*+((?i:{UNITS}))(?!\p{{L}})", "$1 0u$2 ")
    text = F.when(text.rlike("[0-9]"), numbers).otherwise(text)
    text = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{Ll},;]\x20)(\p{Lu}\p{Ll}++)", "0p$1")
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def template(words: Column) -> Column:
    """A window without the values of its slots."""
    return F.when(words.contains("0"), F.regexp_replace(words, r"(?<![^ ])0([nup])[^ ]*", "0$1")).otherwise(words)


def plain(words: Column) -> Column:
    """A window with its names as words."""
    return F.when(words.contains("0p"), F.regexp_replace(words, r"(?<![^ ])0p", "")).otherwise(words)


def form(words: Column) -> Column:
    """What a window is joined on: (form, aligned). Its template if that has both slots and words; else its own words
    and values, which need no alignment. A word that starts with 0 is a placeholder, as no other word can."""
    aligned = mixed(words)
    return F.struct(F.when(aligned, template(words)).otherwise(words).alias("form"), aligned.alias("aligned"))


def mixed(words: Column) -> Column:
    return (words.startswith("0") | words.contains(" 0")) & words.rlike("(?:^| )[^0]")


def form_hash(words: Column) -> Column:
    """Hash of a window's form, not the same for a template and for words."""
    return F.when(mixed(words), F.xxhash64(template(words), F.lit(True))).otherwise(F.xxhash64(words, F.lit(False)))


def windows(rows: DataFrame, size: Column) -> DataFrame:
    """Explode ``words`` into all windows of ``size`` words: adds pos and window. Each match looks ahead over its window and steps over one word."""
    pattern = F.concat(F.lit(r"(?<![^ ])(?=("), F.repeat(F.lit("[^ ]++ "), size - 1), F.lit(r"[^ ]++))[^ ]++ ?"))
    return rows.select(*(c for c in rows.columns if c != "words"), F.posexplode(F.regexp_extract_all("words", pattern, F.lit(1))).alias("pos", "window"))


def either(window: Column, value) -> Column:
    """``value`` of a window, and of the same with its names as words where it has names."""
    return F.when(window.contains("0p"), F.array(value(window), value(plain(window)))).otherwise(F.array(value(window)))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_row, item, size, n_windows, hash, form, aligned, item_window, places): windows to align one by one, the others once for each item with all their places."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_col).alias("item"), valued(text_of(text_col)).alias("words")).where("words <> ''")
    n = F.size(F.split("words", " "))
    items = items.withColumn("size", F.least(n, F.lit(WINDOW))).withColumn("n_windows", F.greatest(n - WINDOW + 1, F.lit(1)))
    every = windows(items, F.col("size")).withColumn("f", F.explode(either(F.col("window"), form))).select("*", "f.form", "f.aligned")
    which = F.when(F.col("aligned"), F.col("pos")).otherwise(-1)
    held = every.groupBy("item_row", "item", "size", "n_windows", F.xxhash64("form", "aligned").alias("hash"), "form", "aligned", which.alias("which"))
    known = held.agg(F.min("window").alias("item_window"), F.array_sort(F.collect_set("pos")).alias("places"))
    return materialize(known.drop("which"), "leak-windows")


def slots(window: Column, item_window: Column) -> Column:
    """(theirs, ours) of every slot of the benchmark's window."""
    pairs = F.arrays_zip(F.split(item_window, " ").alias("theirs"), F.split(window, " ").alias("ours"))
    pairs = F.filter(pairs, lambda v: v["theirs"].rlike("^0[nup]"))
    return F.transform(pairs, lambda v: F.struct(plain(v["theirs"]).alias("theirs"), plain(v["ours"]).alias("ours")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """One row per (document, item) found: id, item, n_windows, n_matched, n_slots; and ``row``, the document's number in ``docs``."""
    known = benchmark_windows(benchmark, item_col, item_text_col)
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most WINDOW values
    if not sizes:  # no item has words
        nothing = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias(item_col))
        return nothing.select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_windows", "n_matched", "n_slots"))).limit(0)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), valued(text_of(text_col)).alias("words"))
    rows = rows.withColumn("length", F.explode(F.array(*map(F.lit, sizes))))
    item = ["item_row", "item", "n_windows"]
    keys = known.select(*item, "hash", "form", "aligned", "item_window", F.col("places")[0].alias("item_pos"))
    keys = F.broadcast(keys) if known.count() <= BROADCAST_WINDOWS else keys
    window, same = F.col("window"), F.struct("form", "aligned")
    found = windows(rows, F.col("length")).withColumn("hash", F.explode(either(window, form_hash))).join(keys, "hash")
    found = found.where((form(window) == same) | (form(plain(window)) == same))
    lined_only = {"item_pos": F.col("item_pos"), "shift": F.col("pos") - F.col("item_pos"), "window": F.col("window"), "item_window": F.col("item_window")}
    found = found.select("row", "id", *item, "aligned", "hash", *(F.when(F.col("aligned"), c).alias(n) for n, c in lined_only.items()))
    found = materialize(found, "leak-matches")

    key = ["row", "item_row", "shift"]
    lined = found.where("aligned")
    values = lined.select(*key, F.explode(slots(F.col("window"), F.col("item_window"))).alias("v"))
    values = values.groupBy(*key, "v.theirs").agg(F.min("v.ours").alias("a"), F.max("v.ours").alias("b"))
    values = values.groupBy(*key).agg(F.count("*").alias("slots"), F.max((F.col("a") != F.col("b")).cast("int")).alias("clash"))
    same = plain(F.col("window")) == plain(F.col("item_window"))
    lined = lined.groupBy("id", *item, *(k for k in key if k not in item)).agg(F.collect_set("item_pos").alias("all"), F.collect_set(F.when(same, F.col("item_pos"))).alias("verbatim"))
    lined = lined.join(values, key, "left").withColumn("places", F.when(F.coalesce("clash", F.lit(0)) == 0, F.col("all")).otherwise(F.col("verbatim")))
    single = found.where("not aligned").select("row", "id", *item, "hash").distinct()
    single = single.join(small_side(known.where("not aligned").select("item_row", "hash", "places"), BROADCAST_WINDOWS), ["item_row", "hash"])
    places = lined.select("row", "id", *item, "places", "slots").union(single.select("row", "id", *item, "places", F.lit(0).cast("long")))
    places = places.groupBy("row", "id", *item).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"), F.coalesce(F.max("slots"), F.lit(0)).alias("n_slots"))
    need = F.least(F.ceil(F.col("n_windows") * SHARE), F.lit(ENOUGH))
    return places.where(F.col("n_matched") >= need).select("row", F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n_windows").cast("long"), "n_matched", "n_slots")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """``docs`` without the documents in which an item was found, all columns kept. Documents of one id and text go or stay together."""
    text = text_of(text_col)
    handles = [F.xxhash64(text), F.xxhash64(text, F.lit(1))]
    keyed = docs.select(F.struct(*(h.alias(f"h{k}") for k, h in enumerate(handles))).alias("key"), text.alias("text"))
    found = contamination(keyed, benchmark, "key", "text", item_col, item_text_col)
    gone = materialize(found.select(F.col("key.h0").alias("_gone0"), F.col("key.h1").alias("_gone1")).distinct(), "leak-gone")
    on = (handles[0] == F.col("_gone0")) & (handles[1] == F.col("_gone1"))
    return docs.join(small_side(gone), on, "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
