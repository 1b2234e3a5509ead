"""Frames that several queries start from, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.tables import written
from quantloom.operators import asof, indicators, recursive, rows, signals
from quantloom.sources import bars as source

#: Width of the bands in standard deviations; narrower than usual, so that daily bars reach every branch.
BAND = 1.0
INFO = ("close", "bb_lower", "bb_upper", "ema50", "ema200", "ema50_slope", "adx")
INFO_RENAMED = tuple(f"{c}_info" for c in INFO)


def rolling(spark: SparkSession, sf_dir: str, chunk: int = rows.CHUNK_ROWS, after: int = 64) -> DataFrame:
    """Daily bars with z-scores and bands, still in chunks."""
    df = rows.chunked(rows.bar_index(source.bars_day(spark, sf_dir)), chunk, 20, after)
    df = indicators.rolling_z(indicators.rolling_z(df, "close", "price_z"), "volume", "vol_z")
    return indicators.bollinger(df, k=BAND)


def weekly(day: DataFrame) -> DataFrame:
    """The larger timeframe's indicators."""
    week = source.bars_week(day).withColumn("chunk", F.lit(0))
    week = indicators.bollinger(recursive.smoothed(week, (50, 200), with_adx=True), k=BAND)
    return indicators.slope(week, "ema50", "ema50_slope")


def features_of(day: DataFrame, profile=signals.DAILY, chunk: int = rows.CHUNK_ROWS, after: int = 64) -> DataFrame:
    """Bars with every indicator and gate, still in chunks (keep ``own`` rows at the end). ``day`` is read twice."""
    df = asof.attach_informative(day, weekly(day), INFO, "1 DAY", "7 DAYS")
    df = rows.chunked(rows.bar_index(df), chunk, recursive.WARM_UP, after)
    df = recursive.smoothed(df, (20,))
    df = indicators.rolling_z(indicators.rolling_z(df, "close", "price_z"), "volume", "vol_z")
    return indicators.gates(indicators.reversals(indicators.bollinger(df, k=BAND)), profile)


def features(spark: SparkSession, sf_dir: str, profile=signals.DAILY, chunk: int = rows.CHUNK_ROWS, after: int = 64) -> DataFrame:
    """Daily bars with every indicator and gate, still in chunks."""
    return features_of(written(source.bars_day(spark, sf_dir), "daily-bars"), profile, chunk, after)


TICKS = """
ticks AS (
  SELECT p_type AS pair, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, ln(l_extendedprice / l_quantity) AS price, l_quantity AS qty, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey
), bars AS (
  SELECT pair, ts, first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY l_orderkey, l_linenumber, price) AS close, sum(qty) AS volume
  FROM ticks GROUP BY pair, ts
)"""


def full20(column: str, value: str) -> str:
    w = "(PARTITION BY pair ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {w} = 20 THEN {value.replace('@', w)} END"


def rolling_sql(source_name: str = "bars") -> str:
    z = lambda c: full20(c, f"({c} - avg({c}) OVER @) / nullif(stddev_pop({c}) OVER @, 0)")
    return f"""rolled AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS bar_idx, {z("close")} AS price_z, {z("volume")} AS vol_z,
         {full20("close", "avg(close) OVER @")} AS bb_mid, {full20("close", "stddev_pop(close) OVER @")} AS bb_std
  FROM {source_name}
), ind AS (
  SELECT *, bb_mid + {BAND} * bb_std AS bb_upper, bb_mid - {BAND} * bb_std AS bb_lower, ((bb_mid + {BAND} * bb_std) - (bb_mid - {BAND} * bb_std)) / nullif(bb_mid,
    0) AS bb_width FROM rolled
)"""


def ema_sql(x: str, n: int) -> str:
    q, a = f"({n - 1}.0 / {n + 1}.0)", f"(2.0 / {n + 1}.0)"
    return f"CASE WHEN i >= {n - 1} THEN pow({q}, i - {n - 1}) * avg(CASE WHEN i < {n} THEN {x} END) OVER (PARTITION BY pair) + coalesce({a} * pow({q}, i) * sum(CASE WHEN i >= {n} THEN {x} * pow({q}, -i) END) OVER (PARTITION BY pair ORDER BY i), 0) END"


def wilder_sql(x: str, n: int = 14, first: int = 1) -> str:
    """Seeded with the mean of the n values from ``first`` on."""
    q, at = f"({n - 1}.0 / {n}.0)", first + n - 1
    return f"CASE WHEN i >= {at} THEN pow({q}, i - {at}) * avg(CASE WHEN i BETWEEN {first} AND {at} THEN {x} END) OVER (PARTITION BY pair) + coalesce(pow({q}, i) / {n}.0 * sum(CASE WHEN i > {at} THEN {x} * pow({q}, -i) END) OVER (PARTITION BY pair ORDER BY i), 0) END"


def total_sql(x: str, n: int = 14) -> str:
    q = f"({n - 1}.0 / {n}.0)"
    return f"CASE WHEN i >= {n} THEN pow({q}, i - {n - 1}) * sum(CASE WHEN i BETWEEN 1 AND {n - 1} THEN {x} END) OVER (PARTITION BY pair) + pow({q}, i) * sum(CASE WHEN i >= {n} THEN {x} * pow({q}, -i) END) OVER (PARTITION BY pair ORDER BY i) END"


def recursive_sql(out: str, source_name: str, emas: tuple = (20,), with_adx: bool = False) -> str:
    """rsi, atr, natr, ema<n> (and adx) in closed form: a seed and a geometrically weighted running sum."""
    p = out
    text = f"""{p}_0 AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS i, lag(close) OVER (PARTITION BY pair ORDER BY ts) AS c1,
         lag(high) OVER (PARTITION BY pair ORDER BY ts) AS h1, lag(low) OVER (PARTITION BY pair ORDER BY ts) AS l1 FROM {source_name}
), {p}_1 AS (
  SELECT *, greatest(high, c1) - least(low, c1) AS tr, greatest(close - c1, 0) AS up, greatest(c1 - close, 0) AS down,
         CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END AS pdm,
         CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END AS mdm FROM {p}_0
), {p}_2 AS (
  SELECT *, {wilder_sql("up")} AS g, {wilder_sql("down")} AS d, {wilder_sql("tr")} AS atr{"".join(f", {ema_sql('close', n)} AS ema{n}" for n in emas)}
         {f", {total_sql('pdm')} AS ps, {total_sql('mdm')} AS ms" if with_adx else ""} FROM {p}_1
)"""
    last = f"{p}_2"
    if with_adx:
        text += f""", {p}_3 AS (SELECT *, CASE WHEN i >= 14 THEN CASE WHEN ps + ms > 0 THEN 100 * abs(ps - ms) / (ps + ms) ELSE 0 END END AS dx FROM {p}_2),
{p}_4 AS (SELECT *, {wilder_sql("dx", 14, 14)} AS adx FROM {p}_3)"""
        last = f"{p}_4"
    return text + f", {out} AS (SELECT *, CASE WHEN g + d > 0 THEN 100 * g / (g + d) WHEN g IS NOT NULL THEN 0 END AS rsi, atr / nullif(close, 0) AS natr FROM {last})"


WEEK = f"""
week_bars AS (
  SELECT pair, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
    sum(volume) AS volume
  FROM bars GROUP BY pair, date_trunc('week', ts)
), {recursive_sql("week_rec", "week_bars", (50, 200), True)}, week_roll AS (
  SELECT *, {full20("close", "avg(close) OVER @")} AS mid, {full20("close", "stddev_pop(close) OVER @")} AS dev, lag(ema50)
    OVER (PARTITION BY pair ORDER BY ts) AS ema50_1 FROM week_rec
), week AS (
  SELECT pair, ts + INTERVAL 6 DAY AS seen, close AS close_info, mid - {BAND} * dev AS bb_lower_info, mid + {BAND} * dev AS bb_upper_info, ema50 AS ema50_info,
    ema200 AS ema200_info,
         (ema50 - ema50_1) / nullif(ema50_1, 0) AS ema50_slope_info, adx AS adx_info FROM week_roll
)"""


def gates_sql(p) -> str:
    strong, cap = p.adx_max + 5, p.slope_cap
    f = lambda c: f"coalesce({c}, false)"
    return f"""feat AS (
  SELECT *, {f(f"vol_z > {p.vol_z_min} AND natr > {p.natr_min} AND bb_width > {p.bb_width_min}")} AS active_pair,
    {f(f"adx_info < {p.adx_max} AND abs(ema50_slope_info) < {cap}")} AS weak_trend_regime,
    {f(f"adx_info > {strong} AND ema50_info < ema200_info AND ema50_slope_info < -{cap} AND close_info < bb_lower_info")} AS breakout_block_long,
    {f(f"adx_info > {strong} AND ema50_info > ema200_info AND ema50_slope_info > {cap} AND close_info > bb_upper_info")} AS breakout_block_short,
    {f(f"adx_info > {strong} AND ema50_slope_info < -{cap}")} AS trend_expand_against_long,
    {f(f"adx_info > {strong} AND ema50_slope_info > {cap}")} AS trend_expand_against_short,
    {f("close > open AND close > c1")} AS bullish_reversal, {f("close < open AND close < c1")} AS bearish_reversal
  FROM joined
)"""


CUT = """, bars AS (
  SELECT pair || '@' || strftime(cut, '%Y%m%d') AS pair, ts, open, high, low, close, volume FROM all_bars JOIN cuts ON ts <= cut
)"""


def features_sql(p=signals.DAILY, cut: bool = False) -> str:
    """``feat``: daily bars with every indicator and gate; with ``cut`` of the history up to each row of ``cuts`` (cut)."""
    ticks = TICKS.replace("), bars AS (", "), all_bars AS (") + CUT if cut else TICKS
    return f"""{ticks}, {WEEK}, {rolling_sql()}, {recursive_sql("rec", "ind")},
joined AS (SELECT rec.*, week.* EXCLUDE (pair, seen) FROM rec ASOF LEFT JOIN week ON rec.pair = week.pair AND rec.ts >= week.seen), {gates_sql(p)}"""


def entry_sql(p=signals.DAILY, reversal: bool = True) -> tuple[str, str]:
    """The long and the short entry condition."""
    a = f"volume > 0 AND active_pair AND weak_trend_regime AND NOT breakout_block_long AND close < bb_lower AND rsi < {p.rsi_long} AND price_z < -{p.price_z}"
    b = f"volume > 0 AND active_pair AND weak_trend_regime AND NOT breakout_block_short AND close > bb_upper AND rsi > {p.rsi_short} AND price_z > {p.price_z}"
    return (f"coalesce({a} AND bullish_reversal, false)", f"coalesce({b} AND bearish_reversal, false)") if reversal else (f"coalesce({a}, false)", f"coalesce({b}, false)")
