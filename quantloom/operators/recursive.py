"""Recursively smoothed indicators (EMA, RSI, ATR, ADX), per pair and chunk in one numpy pass.

A chunk starts with copies of the 2,400 bars before it: 14- and 20-bar smoothing forgets its start far below
double precision in so many bars, so chunks agree with an unbroken run. 200-bar averages do not forget so
fast; they are meant for the larger timeframe, whose bars fit one chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quantloom.operators.rows import KEYS

WARM_UP = 2_400


BLOCK = 128


def decayed(x: np.ndarray, q: float, before: float) -> np.ndarray:
    """y[i] = q * y[i - 1] + x[i] with ``before`` ahead of the first. Blocks are weighed by powers of q at once; the
    blocks' ends follow the same rule with the power of a block's length."""
    n = min(BLOCK, max(1, len(x)))
    step = np.arange(n)
    inside = np.where(step[:, None] >= step, q ** np.maximum(step[:, None] - step, 0.0), 0.0)
    local = np.pad(x, (0, -len(x) % n)).reshape(-1, n) @ inside.T
    ends = np.array([before]) if len(local) <= 1 else np.append(before, decayed(local[:-1, -1], q**n, before))
    return (local + ends[:, None] * q ** (step + 1.0)).ravel()[: len(x)]


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential average, seeded with the mean of the first n values."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        out[n:] = decayed(x[n:] * 2 / (n + 1), (n - 1) / (n + 1), out[n - 1])
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average of x[1:], seeded with the mean of the first n of them."""
    out = np.full(len(x), np.nan)
    if len(x) > n:
        out[n] = x[1 : n + 1].mean()
        out[n + 1 :] = decayed(x[n + 1 :] / n, (n - 1) / n, out[n])
    return out


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    change = np.diff(close, prepend=close[:1])
    up, down = wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)
    total = up + down
    return np.where(np.isnan(total), np.nan, np.where(total > 0, 100 * up / np.where(total > 0, total, 1), 0.0))


def true_range(high, low, close) -> np.ndarray:
    before = np.concatenate([close[:1], close[:-1]])
    return np.maximum(high, before) - np.minimum(low, before)


def adx(high, low, close, n: int = 14) -> np.ndarray:
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)

    def total(x):  # a running sum that sheds an n-th at each step
        out = np.full(len(x), np.nan)
        if len(x) > n:
            out[n:] = decayed(x[n:], (n - 1) / n, x[1:n].sum())
        return out

    rng, p, m = total(true_range(high, low, close)), total(plus), total(minus)
    with np.errstate(divide="ignore", invalid="ignore"):
        both = p + m
        dx = np.where((rng > 0) & (both > 0), 100 * np.abs(p - m) / both, 0.0)
    out = np.full(len(close), np.nan)
    if len(close) >= 2 * n:
        out[2 * n - 1] = dx[n : 2 * n].mean()
        out[2 * n :] = decayed(dx[2 * n :] / n, (n - 1) / n, out[2 * n - 1])
    return out


def smoothed(df: DataFrame, emas: tuple = (20,), with_adx: bool = False, n: int = 14, keys=KEYS) -> DataFrame:
    """Adds rsi, atr, natr, ema<n> and, if asked, adx. Bars without all prices are passed over."""
    names = ["rsi", "atr", "natr", *(f"ema{k}" for k in emas), *(["adx"] if with_adx else [])]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts").reset_index(drop=True)
        ok = frame[["high", "low", "close"]].notna().all(axis=1).to_numpy()
        high, low, close = (frame.loc[ok, c].to_numpy(float) for c in ("high", "low", "close"))
        values = {"rsi": rsi(close, n), "atr": wilder(true_range(high, low, close), n)} if len(close) else {"rsi": close, "atr": close}
        values["natr"] = values["atr"] / np.where(close == 0, np.nan, close)
        values |= {f"ema{k}": ema(close, k) for k in emas}
        if with_adx:
            values["adx"] = adx(high, low, close, n) if len(close) else close
        for name in names:
            column = np.full(len(frame), np.nan)
            column[ok] = values[name]
            frame[name] = column
        return frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {name} double" for name in names)
    return df.groupBy(*keys).applyInPandas(run, schema)
