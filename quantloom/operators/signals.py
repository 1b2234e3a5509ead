"""Entry and exit signals as projections over indicator columns. Parameters are rows, not classes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import flag, safe_div
from quantloom.functions.tables import written
from quantloom.operators import chains
from quantloom.operators.indicators import line
from quantloom.operators.rows import KEYS, sliced


@dataclass(frozen=True)
class Profile:
    """Fixed default levels of the mean-reversion signals."""

    name: str = "default"
    rsi_long: float = 30.0
    rsi_short: float = 70.0
    price_z: float = 1.8
    vol_z_min: float = 2.0
    natr_min: float = 0.025
    bb_width_min: float = 0.04
    adx_max: float = 20.0
    slope_cap: float = 0.004
    exit_rsi_long: float = 52.0
    exit_rsi_short: float = 48.0
    exit_z_long: float = 0.2
    exit_z_short: float = -0.2

    def but(self, **changes) -> Profile:
        return replace(self, **changes)


#: Levels for daily bars of log prices, where moves are larger and trends stronger than on candles.
DAILY = Profile("daily", rsi_long=50.0, rsi_short=50.0, price_z=1.0, vol_z_min=-1.0, natr_min=0.01, bb_width_min=0.02, adx_max=35.0, slope_cap=0.05)


def _long(p: Profile) -> list[Column]:
    c = F.col
    return [c("volume") > 0, c("active_pair"), c("weak_trend_regime"), ~c("breakout_block_long"), c("close") < c("bb_lower"), c("rsi") < p.rsi_long, c("price_z") < -p.price_z]


def _short(p: Profile) -> list[Column]:
    c = F.col
    return [c("volume") > 0, c("active_pair"), c("weak_trend_regime"), ~c("breakout_block_short"), c("close") > c("bb_upper"), c("rsi") > p.rsi_short, c("price_z") > p.price_z]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return flag(out)


def entry_signals(df: DataFrame, p: Profile, long_only: bool = False) -> DataFrame:
    long_side = _all([*_long(p), F.col("bullish_reversal")])
    short_side = F.lit(False) if long_only else _all([*_short(p), F.col("bearish_reversal")])
    tag = F.when(short_side, "mr_short_extreme").when(long_side, "mr_long_extreme").otherwise("")
    return df.withColumns({"enter_long": long_side.cast("int"), "enter_short": short_side.cast("int"), "enter_tag": tag})


def flush_rebound(df: DataFrame, p: Profile) -> DataFrame:
    """The long entry without a reversal candle."""
    hit = _all(_long(p))
    return df.withColumns({"enter_long": hit.cast("int"), "enter_tag": F.when(hit, "flush_rebound_long").otherwise("")})


def delayed_confirm(df: DataFrame, p: Profile, keys=KEYS) -> DataFrame:
    """The bar before flushed and this bar reclaims part of the fall."""
    before = lambda name: F.lag(name).over(line(keys))
    c = F.col
    flushed = F.lag(_all(_long(p))).over(line(keys))
    reclaim = (c("volume") > 0) & (c("close") > c("open")) & (c("close") > before("close")) & (c("close") > c("bb_lower")) & (c("close") < c("bb_mid")) & (c("rsi") > before("rsi")) & (c("price_z") > before("price_z"))
    hit = flag(flushed) & flag(reclaim)
    return df.withColumns({"enter_long": hit.cast("int"), "enter_tag": F.when(hit, "delayed_confirm_long").otherwise("")})


def exit_signals(df: DataFrame, p: Profile) -> DataFrame:
    """Exit flags and reasons, mean_hit before trend_expand before vol_decay; on a bar with both sides the short tag stays."""
    c = F.col
    long_hit = flag(c("close") >= c("bb_mid")) | flag(c("close") >= c("ema20")) | flag(c("close") >= c("vwap")) | flag(c("price_z") > p.exit_z_long) | flag(c("rsi") > p.exit_rsi_long)
    short_hit = flag(c("close") <= c("bb_mid")) | flag(c("close") <= c("ema20")) | flag(c("close") <= c("vwap")) | flag(c("price_z") < p.exit_z_short) | flag(c("rsi") < p.exit_rsi_short)

    def reason(hit, trend):
        return F.when(hit, "mean_hit").when(c(trend), "trend_expand").when(~c("active_pair"), "vol_decay").otherwise("")

    a, b = reason(long_hit, "trend_expand_against_long"), reason(short_hit, "trend_expand_against_short")
    return df.withColumns({"exit_long": (a != "").cast("int"), "exit_short": (b != "").cast("int"), "exit_tag": F.when(b != "", b).otherwise(a)})


@dataclass(frozen=True)
class Flush:
    """Thresholds of a parametric flush; one row of a grid."""

    price_z: float
    rsi: float
    vol_z_min: float
    bb_width_min: float
    weak_trend: bool = False
    breakout_block: bool = False
    below_band: bool = False


def flush_mask(f: Flush, strict: bool = True) -> Column:
    """Surface form (``strict``: > on volume and width) or strategy form (>=)."""
    c = F.col
    wide = (c("vol_z") > f.vol_z_min) & (c("bb_width") > f.bb_width_min) if strict else (c("vol_z") >= f.vol_z_min) & (c("bb_width") >= f.bb_width_min)
    out = (c("rsi") < f.rsi) & (c("price_z") < -f.price_z) & wide
    if f.below_band:
        out = out & (c("close") < c("bb_lower"))
    if f.weak_trend:
        out = out & c("weak_trend_regime")
    if f.breakout_block:
        out = out & ~c("breakout_block_long")
    return flag(out)


def token(x: float) -> str:
    """A number as part of a name: 2.50 -> 2p5, -1 -> m1."""
    return f"{x:g}".replace("-", "m").replace(".", "p")


def baseline_names(f: Flush) -> list[str]:
    """Seven simple rules that a candidate has to beat, named after their levels."""
    z, r = f"price_z_lt_m{token(f.price_z)}", f"rsi_lt_{token(f.rsi)}"
    below = "close_below_bb_lower"
    return [z, r, f"{z}_and_{r}", below, f"{below}_and_{r}", f"vol_z_gt_{token(f.vol_z_min)}_and_{z}", f"bb_width_gt_{token(f.bb_width_min)}_and_{z}"]


def baseline_specs(f: Flush) -> list[tuple[str, Column]]:
    """The seven rules by name."""
    c = F.col
    z, r, below = c("price_z") < -f.price_z, c("rsi") < f.rsi, c("close") < c("bb_lower")
    masks = [z, r, z & r, below, below & r, (c("vol_z") > f.vol_z_min) & z, (c("bb_width") > f.bb_width_min) & z]
    return [(name, flag(mask)) for name, mask in zip(baseline_names(f), masks, strict=True)]


def component_masks(f: Flush) -> list[tuple[str, Column]]:
    """The candidate with one filter taken away at a time."""
    return [
        ("original", flush_mask(f)),
        ("no_weak_trend", flush_mask(replace(f, weak_trend=False))),
        ("no_breakout_block", flush_mask(replace(f, breakout_block=False))),
        ("z_rsi_only", flag((F.col("price_z") < -f.price_z) & (F.col("rsi") < f.rsi))),
    ]


def masks_to_rows(df: DataFrame, specs: list[tuple[str, Column]], name: str = "component") -> DataFrame:
    """One row per (row, mask that holds), in a single pass."""
    hits = F.array_compact(F.array(*(F.when(mask, F.lit(label)) for label, mask in specs)))
    return df.withColumn(name, F.explode(hits))


def confirmations(df: DataFrame, most: int = 3, keys=KEYS) -> DataFrame:
    """Per row the first of the next ``most`` bars that closes up and above the lower band: confirm_delay and confirm_ts,
    the price at the open after it, and the move missed against entering at once."""
    w = line(keys)
    up = flag((F.col("close") > F.col("open")) & (F.col("close") > F.col("bb_lower")))
    df = df.withColumn("_up", up).withColumn("next_open", F.lead("open", 1).over(w))
    first = lambda value: F.coalesce(*(F.when(flag(F.lead("_up", k).over(w)), value(k)) for k in range(1, most + 1)))
    found = {"confirm_delay": first(F.lit), "confirm_ts": first(lambda k: F.lead("ts", k).over(w)), "confirm_price": first(lambda k: F.lead("open", k + 1).over(w))}
    df = df.withColumns(found)
    return df.withColumn("missed_move", safe_div(F.col("confirm_price") - F.col("next_open"), F.col("next_open"))).drop("_up")


def rebound_events(df: DataFrame, most: int = 3, keys=KEYS) -> DataFrame:
    """Flush rows (``flush``) with their confirmations."""
    return confirmations(df, most, keys).where(flag(F.col("flush")))


def near_misses(df: DataFrame, p: Profile) -> DataFrame:
    """Rows where every long or short gate but the reversal holds."""
    long_side, short_side = _all(_long(p)) & ~F.col("bullish_reversal"), _all(_short(p)) & ~F.col("bearish_reversal")
    return df.withColumn("side", F.when(long_side, "long").when(short_side, "short")).where("side is not null")


def first_failed_gate(df: DataFrame, p: Profile) -> DataFrame:
    """Rows that pass the five structural long gates, with the first of rsi, price_z, reversal that fails."""
    passed = df.where(_all(_long(p)[:5]))
    label = F.when(~flag(F.col("rsi") < p.rsi_long), "rsi").when(~flag(F.col("price_z") < -p.price_z), "price_z").when(~F.col("bullish_reversal"), "bullish_reversal").otherwise("signal")
    return passed.withColumn("first_failed_gate", label)


def breadth_flags(df: DataFrame, p: Profile) -> DataFrame:
    c = F.col
    oversold = flag(c("rsi") < p.rsi_long) | flag(c("price_z") < -p.price_z) | flag(c("close") < c("bb_lower"))
    return df.withColumns({"is_flush": _all(_long(p)), "is_oversold": oversold, "is_active": c("active_pair")})


def candidate_events(df: DataFrame, loosest: Flush, mode: str = "all") -> DataFrame:
    """Rows inside the loosest grid level (``all``), or in the broad union of its tests (``any``)."""
    c = F.col
    tests = [c("price_z") < -loosest.price_z, c("rsi") < loosest.rsi, c("vol_z") > loosest.vol_z_min, c("bb_width") > loosest.bb_width_min]
    keep = flag(tests[0] & tests[1] & tests[2] & tests[3]) if mode == "all" else flag(tests[0]) | flag(tests[1]) | flag(c("close") < c("bb_lower"))
    return df.withColumn("close_below_bb_lower", flag(c("close") < c("bb_lower"))).where(keep)


def event_features(df: DataFrame, keys=KEYS) -> DataFrame:
    """Depth and rebound measures; a missing input leaves the measure missing."""
    c = F.col
    before = F.lag("close").over(line(keys))
    positive = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    candle, previous = safe_div(c("close") - c("open"), c("open")), safe_div(c("close") - before, before)
    return df.withColumns(
        {
            "flush_score": positive(-c("price_z")),
            "band_extension": positive(safe_div(c("bb_lower") - c("close"), c("close"))),
            "candle_rebound": candle,
            "previous_rebound": previous,
            "rebound_score": F.when(candle.isNotNull() & previous.isNotNull(), F.greatest(candle, previous, F.lit(0.0))),
            "mid_distance": safe_div(c("bb_mid") - c("close"), c("close")),
        }
    )


def exit_mode_flag(mode: str) -> Column:
    """Exit test of a fixed-exit mode; "time" never fires before its time."""
    tests = {"z0": F.col("price_z") >= 0, "rsi50": F.col("rsi") >= 50, "mid": F.col("close") >= F.col("bb_mid"), "time": F.lit(False)}
    return flag(tests[mode])


def profile_sweep(df: DataFrame, profiles: list[Profile], spark=None) -> DataFrame:
    """(profile, row) for every profile whose relaxed long entry holds, over indicators computed once."""
    c = F.col
    specs = []
    for p in profiles:
        mask = (c("volume") > 0) & (c("vol_z") > p.vol_z_min) & (c("natr") > p.natr_min) & (c("bb_width") > p.bb_width_min) & (c("adx_info") < p.adx_max) & (F.abs("ema50_slope_info") < p.slope_cap) & (c("close") < c("bb_lower")) & (c("rsi") < p.rsi_long) & (c("price_z") < -p.price_z) & c("bullish_reversal")
        specs.append((p.name, flag(mask)))
    return masks_to_rows(df, specs, "profile")


def fixed_exit_trades(df: DataFrame, mode: str, hold: int, size: int = chains.SIZE) -> DataFrame:
    """Signals (``enter_long``) to trades: in at the next open, out at the open after the first exit flag or after
    ``hold`` bars; one open trade per pair. ``df``: bars in chunks that hold copies of at least ``hold`` + 1 bars after
    them. A signal whose exit bar is not there yet makes no trade."""
    w = line()
    flagged = F.when(exit_mode_flag(mode), F.col("bar_idx"))
    df = df.withColumn("exit_flag_idx", F.min(flagged).over(w.rowsBetween(1, hold)))
    df = df.withColumns({"entry_idx": F.col("bar_idx") + 1, "entry_price": F.lead("open", 1).over(w)}).where("own")
    exit_idx = F.coalesce(F.col("exit_flag_idx") + 1, F.col("bar_idx") + hold + 1)
    signals = df.where("enter_long = 1").withColumn("exit_idx", exit_idx).select("pair", "ts", "bar_idx", "entry_idx", "entry_price", "exit_idx")
    prices = df.select("pair", F.col("bar_idx").alias("exit_idx"), F.col("open").alias("exit_price"))
    signals = written(signals.join(prices, ["pair", "exit_idx"]), "exit-signals")
    spans = signals.select("pair", F.col("bar_idx").alias("at"), (F.col("exit_idx") - 1).alias("free"))
    picked = signals.join(chains.pick_disjoint(spans, ["pair"], size).withColumnRenamed("at", "bar_idx"), ["pair", "bar_idx"])
    return picked.withColumn("profit_ratio", safe_div(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")))


def orderbook_features(books: DataFrame, depth: int = 5) -> DataFrame:
    """Spread against the middle and imbalance of the first levels; bids and asks are arrays of (price, qty)."""
    top = lambda side: F.try_element_at(side, F.lit(1))["price"]
    total = lambda side: F.aggregate(F.slice(side, 1, depth), F.lit(0.0), lambda a, x: a + x["qty"])
    bid, ask, b, a = top(F.col("bids")), top(F.col("asks")), total(F.col("bids")), total(F.col("asks"))
    return books.withColumns({"spread_ratio": safe_div(ask - bid, (ask + bid) / 2), "imbalance": safe_div(b - a, b + a)})


def entry_veto(df: DataFrame, spread: float, imbalance: float, funding: float) -> DataFrame:
    """The first limit that a long entry breaks, null if none; a missing spread or imbalance blocks too."""
    c = F.col
    veto = F.when(~flag(c("spread_ratio") <= spread), "spread").when(~flag(c("imbalance") >= imbalance), "imbalance").when(flag(F.abs("funding_rate") > funding), "funding")
    return df.withColumn("veto", veto)


def order_sizing(df: DataFrame, risk: float = 0.005, buffer: float = 1.05, stop_mult: float = 1.7, roi_mult: float = 1.2, leverage: float = 2.0, hot_natr: float = 0.05, hot_width: float = 0.15) -> DataFrame:
    """Amounts floored to the lot step, least stake, stake by risk, leverage cut on hot markets, stop and target."""
    c = F.col
    step = F.nullif(c("qty_step"), F.lit(0.0))
    amount = F.coalesce(F.floor(c("amount") / step + 1e-12) * step, c("amount"))
    valid = (amount >= F.coalesce("min_qty", F.lit(0.0))) & (amount * c("rate") >= F.coalesce("min_notional", F.lit(0.0)))
    stop_ratio = F.nullif(stop_mult * c("natr"), F.lit(0.0))
    lev = F.when(flag(c("natr") > hot_natr) | flag(c("bb_width") > hot_width), 1.0).otherwise(leverage)
    return df.withColumns(
        {
            "order_amount": amount,
            "order_valid": flag(valid),
            "min_stake": F.greatest(F.coalesce("min_notional", F.lit(0.0)), F.coalesce(c("min_qty") * c("rate"), F.lit(0.0))) * buffer / lev,
            "leverage": lev,
            "risk_stake": c("equity") * risk / (stop_ratio * lev),
            "stop_price": c("rate") * (1 - stop_mult * c("natr")),
            "roi": F.least(F.greatest(roi_mult * c("natr"), F.lit(0.008)), F.lit(0.035)),
        }
    )


def cooldown_flags(trades: DataFrame, signals: DataFrame, bar_seconds: int, stops: int = 3, stop_bars: int = 24, stop_pause: int = 8, low_trades: int = 2, low_bars: int = 48, low_pause: int = 12, slice_bars: int = 1000) -> DataFrame:
    """Signals (pair, is_short, ts) with ``blocked``: the side after too many stops anywhere, or the pair's side
    after recent trades that brought nothing. Trades: pair, is_short, close_date, exit_reason, profit_abs.

    Counts reach back a fixed time and so do locks, so both are found in slices of ``slice_bars`` that also hold copies of the rows
    shortly before them: the tasks grow with time, whatever the sides. The trades are read once, into a row a pair, side and time."""
    at = F.col("close_date").cast("timestamp").cast("long")
    reach = lambda *k, bars: Window.partitionBy(*k, "_slice").orderBy("at").rangeBetween(-(bars - 1) * bar_seconds, 0)
    cut = lambda df, bars: sliced(df, "at", bars * bar_seconds, max(slice_bars, bars) * bar_seconds)
    moments = trades.groupBy("pair", "is_short", at.alias("at")).agg(F.count("*").alias("n"), F.sum("profit_abs").alias("p"), F.count_if(F.col("exit_reason") == "stop_loss").alias("stops"))
    moments = written(moments, "cooldown-moments")
    stopped = moments.groupBy("is_short", "at").agg(F.sum("stops").alias("n"))
    side = cut(stopped, stop_bars).withColumn("n", F.sum("n").over(reach("is_short", bars=stop_bars))).where(F.col("_own") & (F.col("n") >= stops))
    low = cut(moments, low_bars).withColumns({c: F.sum(c).over(reach("pair", "is_short", bars=low_bars)) for c in ("n", "p")})
    pair = low.where(F.col("_own") & (F.col("n") >= low_trades) & (F.col("p") <= 0))
    s = signals.withColumn("at", F.col("ts").cast("timestamp").cast("long"))

    def locked(left: DataFrame, locks: DataFrame, keys: list[str], pause: int, out: str) -> DataFrame:
        both = left.withColumn("_side", F.lit(1)).unionByName(locks.select(*keys, "at", F.lit(0).alias("_side")), allowMissingColumns=True)
        recent = Window.partitionBy(*keys, "_slice").orderBy("at").rangeBetween(-pause * bar_seconds + 1, 0)
        return cut(both, pause).withColumn(out, F.min("_side").over(recent) == 0).where("_own and _side = 1").drop("_side", "_slice", "_own")

    s = locked(locked(s, side, ["is_short"], stop_pause, "side_blocked"), pair, ["pair", "is_short"], low_pause, "pair_blocked")
    return s.withColumn("blocked", F.col("side_blocked") | F.col("pair_blocked")).drop("at")
