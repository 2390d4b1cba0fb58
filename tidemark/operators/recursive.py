"""Indicators that depend on their own last value, one symbol's series at a time in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _ema(x: pd.Series, span: int) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def moving_averages(bars: DataFrame) -> DataFrame:
    """(symbol, ts, close, ema_9 ... ema_50, macd, macd_signal, macd_hist): exponential averages that start at the first close."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        out = rows[["symbol", "ts", "close"]].copy()
        for span in (9, 12, 26, 30, 50):
            out[f"ema_{span}"] = _ema(rows["close"], span)
        out["macd"] = out["ema_12"] - out["ema_26"]
        out["macd_signal"] = _ema(out["macd"], 9)
        out["macd_hist"] = out["macd"] - out["macd_signal"]
        return out

    columns = "ema_9 double, ema_12 double, ema_26 double, ema_30 double, ema_50 double, macd double, macd_signal double, macd_hist double"
    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(one, f"symbol long, ts timestamp_ntz, close double, {columns}")


def directional_index(bars: DataFrame, span: int = 14) -> DataFrame:
    """(symbol, ts, plus_di, minus_di, adx): directional movement, smoothed exponentially."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        up, down = rows["high"].diff(), -rows["low"].diff()
        before = rows["close"].shift()
        true_range = pd.concat([rows["high"] - rows["low"], (rows["high"] - before).abs(), (rows["low"] - before).abs()], axis=1).max(axis=1)
        atr = _ema(true_range, span)
        plus = 100 * _ema(pd.Series(np.where((up > down) & (up > 0), up, 0.0), rows.index), span) / atr
        minus = 100 * _ema(pd.Series(np.where((down > up) & (down > 0), down, 0.0), rows.index), span) / atr
        both = plus + minus
        dx = 100 * (plus - minus).abs() / both.where(both != 0)
        return pd.DataFrame({"symbol": rows["symbol"], "ts": rows["ts"], "plus_di": plus, "minus_di": minus, "adx": _ema(dx, span)})

    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(one, "symbol long, ts timestamp_ntz, plus_di double, minus_di double, adx double")


def wilder_indicators(bars: DataFrame, span: int = 14, band: int = 20) -> DataFrame:
    """(symbol, ts, rsi, atr, bb_middle, bb_upper, bb_lower): Wilder's smoothing of gains, losses and ranges; bands of the population deviation."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        change, before = rows["close"].diff().fillna(0.0), rows["close"].shift()
        smooth = lambda x: x.ewm(alpha=1 / span, adjust=False).mean()
        gain, loss = smooth(change.clip(lower=0)), smooth(-change.clip(upper=0))
        true_range = pd.concat([rows["high"] - rows["low"], (rows["high"] - before).abs(), (rows["low"] - before).abs()], axis=1).max(axis=1)
        middle, spread = rows["close"].rolling(band).mean(), rows["close"].rolling(band).std(ddof=0)
        rsi = 100 - 100 / (1 + gain / loss.where(loss > 0))
        return pd.DataFrame({"symbol": rows["symbol"], "ts": rows["ts"], "rsi": rsi, "atr": smooth(true_range), "bb_middle": middle, "bb_upper": middle + 2 * spread, "bb_lower": middle - 2 * spread})

    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(one, "symbol long, ts timestamp_ntz, rsi double, atr double, bb_middle double, bb_upper double, bb_lower double")
