"""Indicators whose value depends on the one before (exponential means, Wilder's smoothing, adaptive means, parabolic stops).

recursive() is one grouped map a symbol: Spark shuffles by symbol as for the windows, and a task holds one symbol's series. First-order linear
recurrences are evaluated in blocks of array operations; only the truly nonlinear ones walk bar by bar. core_by_blocks() gives the linear
ones for series of any length, with the bars of one symbol in many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans import scan

_BLOCK = 64


def affine(x: np.ndarray, a: float, seed: float) -> np.ndarray:
    """y[t] = (1 - a) * y[t-1] + a * x[t], with y[-1] = seed. x has no gaps."""
    n, keep = len(x), 1.0 - a
    out = np.empty(n)
    powers = keep ** np.arange(1, _BLOCK + 1)
    lower = np.tril(keep ** np.maximum(0, np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK)))) * a
    for lo in range(0, n, _BLOCK):
        part = x[lo : lo + _BLOCK]
        k = len(part)
        out[lo : lo + k] = lower[:k, :k] @ part + powers[:k] * seed
        seed = out[lo + k - 1]
    return out


def _seeded(x: np.ndarray, n: int, a: float, first: int | None = None) -> np.ndarray:
    """Recurrence seeded with the mean of n values, the last of them at index `first` (default: the n-th valid one)."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) < n:
        return out
    first = ok[0] + n - 1 if first is None else max(first, ok[0] + n - 1)
    if first >= len(x):
        return out
    out[first] = x[first - n + 1 : first + 1].mean()
    out[first + 1 :] = affine(x[first + 1 :], a, out[first])
    return out


def ema(x: np.ndarray, n: int, first: int | None = None) -> np.ndarray:
    return _seeded(x, n, 2.0 / (n + 1), first)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return _seeded(x, n, 1.0 / n)


def ema_adjusted(x: np.ndarray, n: int) -> np.ndarray:
    """Exponentially weighted mean whose weights sum to one from the first bar on."""
    a = 2.0 / (n + 1)
    return affine(x, a, 0.0) / affine(np.ones(len(x)), a, 0.0)


def _rolling(x: np.ndarray, n: int, f) -> np.ndarray:
    return getattr(pd.Series(x).rolling(n), f)().to_numpy()


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def kama(x: np.ndarray, n: int = 20, fast: int = 2, slow: int = 30) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    move = np.abs(np.diff(x, prepend=np.nan))
    path = _rolling(move, n, "sum")
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    y = x[n - 1]
    for t in range(n, len(x)):
        er = abs(x[t] - x[t - n]) / path[t] if path[t] else 0.0
        y += (er * (f - s) + s) ** 2 * (x[t] - y)
        out[t] = y
    return out


def t3(x: np.ndarray, n: int = 10, v: float = 0.7) -> np.ndarray:
    e, chain = x, []
    for _ in range(6):
        e = ema(e, n)
        chain.append(e)
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2
    return c1 * chain[5] + c2 * chain[4] + c3 * chain[3] + c4 * chain[2]


def sar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse; the first side follows the larger of the first two directional moves."""
    n = len(high)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    up = not (low[0] - low[1] > max(high[1] - high[0], 0))
    stop, best, a = (low[0], high[1], step) if up else (high[0], low[1], step)
    for t in range(1, n):
        if up:
            if low[t] <= stop:
                up, stop = False, max(best, high[t], high[t - 1])
                out[t] = stop
                best, a = low[t], step
                stop = max(stop + a * (best - stop), high[t], high[t - 1])
                continue
            out[t] = stop
            if high[t] > best:
                best, a = high[t], min(most, a + step)
            stop = min(stop + a * (best - stop), low[t], low[t - 1])
        else:
            if high[t] >= stop:
                up, stop = True, min(best, low[t], low[t - 1])
                out[t] = stop
                best, a = high[t], step
                stop = min(stop + a * (best - stop), low[t], low[t - 1])
                continue
            out[t] = stop
            if low[t] < best:
                best, a = low[t], min(most, a + step)
            stop = max(stop + a * (best - stop), high[t], high[t - 1])
    return out


def cycle(price: np.ndarray, fast: float = 0.5, slow: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mama, fama, trendline) from the phase and period of a homodyne discriminator on smoothed prices."""
    n = len(price)
    mama, fama, trend = (np.full(n, np.nan) for _ in range(3))
    sm, de, q1, i1, ji, jq, i2, q2, re, im, period, smooth_p, phase = (np.zeros(n) for _ in range(13))
    line = np.zeros(n)

    def hilbert(x: np.ndarray, t: int, p: float) -> float:
        return (0.0962 * x[t] + 0.5769 * x[t - 2] - 0.5769 * x[t - 4] - 0.0962 * x[t - 6]) * (0.075 * p + 0.54)

    m = f = price[0] if n else 0.0
    for t in range(n):
        if t < 6:
            sm[t] = price[t]
            m = f = price[t]
            line[t] = price[t]
            continue
        sm[t] = (4 * price[t] + 3 * price[t - 1] + 2 * price[t - 2] + price[t - 3]) / 10
        p = period[t - 1]
        de[t] = hilbert(sm, t, p)
        q1[t] = hilbert(de, t, p)
        i1[t] = de[t - 3]
        ji[t], jq[t] = hilbert(i1, t, p), hilbert(q1, t, p)
        i2[t] = 0.2 * (i1[t] - jq[t]) + 0.8 * i2[t - 1]
        q2[t] = 0.2 * (q1[t] + ji[t]) + 0.8 * q2[t - 1]
        re[t] = 0.2 * (i2[t] * i2[t - 1] + q2[t] * q2[t - 1]) + 0.8 * re[t - 1]
        im[t] = 0.2 * (i2[t] * q2[t - 1] - q2[t] * i2[t - 1]) + 0.8 * im[t - 1]
        new = 360 / np.degrees(np.arctan(im[t] / re[t])) if im[t] and re[t] else p
        new = min(max(min(max(new, 0.67 * p), 1.5 * p), 6), 50) if p else min(max(new, 6), 50)
        period[t] = 0.2 * new + 0.8 * p
        smooth_p[t] = 0.33 * period[t] + 0.67 * smooth_p[t - 1]
        phase[t] = np.degrees(np.arctan(q1[t] / i1[t])) if i1[t] else 0.0
        a = max(slow, fast / max(1.0, phase[t - 1] - phase[t]))
        m = a * price[t] + (1 - a) * m
        f = 0.5 * a * m + (1 - 0.5 * a) * f
        k = max(1, int(smooth_p[t] + 0.5))
        line[t] = price[max(0, t - k + 1) : t + 1].mean()
        if t >= 32:
            mama[t], fama[t] = m, f
        if t >= 63:
            trend[t] = (4 * line[t] + 3 * line[t - 1] + 2 * line[t - 2] + line[t - 3]) / 10
    return mama, fama, trend


def compute(pdf: pd.DataFrame) -> pd.DataFrame:
    """All recursive columns of one symbol, rows in order of ts."""
    g = pdf.sort_values("ts")
    h, lo, c, v = (g[x].to_numpy(float) for x in ("high", "low", "close", "volume"))
    n = len(g)
    out = {"symbol": g["symbol"], "ts": g["ts"]}
    for k in (5, 10, 20, 50, 100):
        out[f"ema_{k}"] = ema(c, k)
        out[f"ema_{k}_adj"] = ema_adjusted(c, k)
    e1 = out["ema_20"]
    e2 = ema(e1, 20)
    out["dema_20"], out["tema_20"] = 2 * e1 - e2, 3 * e1 - 3 * e2 + ema(e2, 20)
    out["kama_20"], out["t3_10"] = kama(c), t3(c)
    out["mama"], out["fama"], out["ht_trendline"] = cycle(c)
    out["sar"] = sar(h, lo)
    out["sar_signal"] = np.where(c > np.nan_to_num(out["sar"], nan=np.inf), 1, -1)
    out["ema_cross_10_20"] = np.where(np.nan_to_num(out["ema_10"] - out["ema_20"], nan=-1.0) > 0, 1, -1)
    d = np.diff(c, prepend=np.nan)
    gain, loss = np.where(np.isnan(d), np.nan, np.maximum(d, 0)), np.where(np.isnan(d), np.nan, np.maximum(-d, 0))
    for k, name in ((14, "rsi"), (7, "rsi_7"), (21, "rsi_21")):
        a, b = wilder(gain, k), wilder(loss, k)
        out[name] = 100 * _ratio(a, a + b)
        if k == 14:
            out["cmo"] = 100 * _ratio(a - b, a + b)
    slow, fast = ema(c, 26), ema(c, 12, 25)
    macd = fast - slow
    out["macd"], out["macd_signal"] = macd, ema(macd, 9)
    out["macd_hist"] = macd - out["macd_signal"]
    fk = pd.Series(out["rsi"]).rolling(5)
    out["stoch_rsi_k"] = 100 * _ratio(out["rsi"] - fk.min().to_numpy(), (fk.max() - fk.min()).to_numpy())
    out["stoch_rsi_d"] = _rolling(out["stoch_rsi_k"], 3, "mean")
    e3 = ema(ema(ema(c, 15), 15), 15)
    out["trix"] = 100 * np.r_[np.nan, _ratio(np.diff(e3), e3[:-1])] if n else e3
    last = np.r_[np.nan, c[:-1]] if n else c
    tr = np.where(np.isnan(last), np.nan, np.maximum(h - lo, np.maximum(np.abs(h - last), np.abs(lo - last))))
    for k, name in ((14, "atr"), (7, "atr_7"), (21, "atr_21")):
        out[name] = wilder(tr, k)
    out["natr"] = 100 * _ratio(out["atr"], c)
    up, down = np.diff(h, prepend=np.nan), -np.diff(lo, prepend=np.nan)
    plus, minus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0)), np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    out["plus_di"], out["minus_di"] = 100 * _ratio(wilder(plus, 14), out["atr"]), 100 * _ratio(wilder(minus, 14), out["atr"])
    out["dx"] = 100 * _ratio(np.abs(out["plus_di"] - out["minus_di"]), out["plus_di"] + out["minus_di"])
    out["adx"] = wilder(out["dx"], 14)
    out["adxr"] = (out["adx"] + np.r_[np.full(min(13, n), np.nan), out["adx"][:-13]]) / 2
    money = np.divide(2 * c - h - lo, h - lo, out=np.zeros(n), where=h != lo) * v
    ad = np.cumsum(money)
    f3, s10 = (affine(ad[1:], 2 / (k + 1), ad[0]) if n else ad for k in (3, 10))
    out["adosc"] = np.r_[np.full(min(9, n), np.nan), (np.r_[ad[:1], f3] - np.r_[ad[:1], s10])[9:]]
    lagged = lambda x, k: x - np.r_[np.full(min(k, n), np.nan), x[:-k]]
    out["rsi_slope"], out["macd_hist_slope"] = lagged(out["rsi"], 5), lagged(out["macd_hist"], 3)
    out["price_slope"] = _ratio(lagged(c, 5), c - lagged(c, 5))
    signs = np.sign(out["rsi_slope"]), np.sign(out["price_slope"])
    out["rsi_divergence"] = (signs[0] != signs[1]).astype(int)
    atr50 = _rolling(out["atr"], 50, "mean")
    out["high_volatility"] = (np.nan_to_num(out["atr"] - 1.5 * atr50, nan=-1.0) > 0).astype(int)
    out["strong_trend"], out["very_strong_trend"] = (np.nan_to_num(out["adx"]) > 25).astype(int), (np.nan_to_num(out["adx"]) > 40).astype(int)
    return pd.DataFrame(out)[["symbol", "ts", *COLUMNS]]


FLAGS = ["sar_signal", "ema_cross_10_20", "rsi_divergence", "high_volatility", "strong_trend", "very_strong_trend"]
COLUMNS = [*[f"ema_{k}{x}" for k in (5, 10, 20, 50, 100) for x in ("", "_adj")], *"dema_20 tema_20 kama_20 t3_10 mama fama ht_trendline sar rsi rsi_7 rsi_21 cmo macd macd_signal macd_hist stoch_rsi_k stoch_rsi_d trix atr atr_7 atr_21 natr plus_di minus_di dx adx adxr adosc rsi_slope price_slope macd_hist_slope".split(), *FLAGS]
SCHEMA = "symbol string, ts timestamp, " + ", ".join(f"{x} {'int' if x in FLAGS else 'double'}" for x in COLUMNS)


def with_macd_hist(b: DataFrame) -> DataFrame:
    """M2 by adjusted exponential means: adds macd_hist_adj, the 12-26 difference less its own mean over 9. Windows only, on the panel's own
    dealing by symbol. b: symbol, ts, seq, close."""
    b = scan.smoothed(b, {"_fast": scan.adjusted("close", 12), "_slow": scan.adjusted("close", 26)})
    b = scan.smoothed(b.withColumn("_macd", F.col("_fast") - F.col("_slow")), {"_mean": scan.adjusted("_macd", 9)})
    return b.withColumn("macd_hist_adj", F.col("_macd") - F.col("_mean")).drop("_fast", "_slow", "_macd", "_mean")


def core_by_blocks(bars: DataFrame, block: int = scan.BLOCK, seconds: int = 1 << 22) -> DataFrame:
    """(symbol, ts) with the exponential means, MACD (line, signal, histogram), RSI, CMO, true ranges, directional index and its mean of
    recursive(), for series that are too long for a task: the bars of one symbol are dealt out by blocks."""
    b = scan.numbered(bars.select("symbol", "ts", "high", "low", "close"), seconds=seconds)
    c, h, lo, last = (F.col(x) for x in ("close", "high", "low", "last_close"))
    up, down = h - F.col("last_high"), F.col("last_low") - lo
    b = b.withColumns({
        "_gain": F.greatest(c - last, F.lit(0.0)), "_loss": F.greatest(last - c, F.lit(0.0)), "_tr": F.when(last.isNotNull(), F.greatest(h - lo, F.abs(h - last), F.abs(lo - last))),
        "_plus": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_minus": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    }).drop("last_high", "last_low", "last_close", "high", "low")
    b = b.withColumns({x: F.when(F.col("seq") > 1, F.col(x)) for x in ("_gain", "_loss")})
    chains = {f"ema_{n}": scan.ema("close", n) for n in (5, 10, 20, 50, 100)} | {f"ema_{n}_adj": scan.adjusted("close", n) for n in (5, 10, 20, 50, 100)}
    chains |= {"_fast": scan.ema("close", 12, 26), "_slow": scan.ema("close", 26)}
    chains |= {f"_{x}{n}": scan.wilder(f"_{x}", n, n + 1) for x in ("gain", "loss", "tr") for n in (7, 14, 21)} | {f"_{x}14": scan.wilder(f"_{x}", 14, 15) for x in ("plus", "minus")}
    b = scan.by_blocks(b, chains, block).drop("_gain", "_loss", "_tr", "_plus", "_minus")
    share = lambda x, y: 100 * F.try_divide(x, y)
    for n, name in ((14, ""), (7, "_7"), (21, "_21")):
        b = b.withColumns({f"rsi{name}": share(F.col(f"_gain{n}"), F.col(f"_gain{n}") + F.col(f"_loss{n}")), f"atr{name}": F.col(f"_tr{n}")})
    b = b.withColumns({
        "macd": F.col("_fast") - F.col("_slow"), "cmo": share(F.col("_gain14") - F.col("_loss14"), F.col("_gain14") + F.col("_loss14")), "natr": share(F.col("atr"), F.col("close")),
        "plus_di": share(F.col("_plus14"), F.col("atr")), "minus_di": share(F.col("_minus14"), F.col("atr")),
    })
    b = b.withColumn("dx", share(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    b = scan.by_blocks(b.drop(*[x for x in chains if x.startswith("_")]), {"macd_signal": scan.ema("macd", 9, 34), "adx": scan.wilder("dx", 14, 28)}, block)
    return b.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).select("symbol", "ts", *BLOCKED)


BLOCKED = [*[f"ema_{n}{x}" for n in (5, 10, 20, 50, 100) for x in ("", "_adj")], *"macd macd_signal macd_hist rsi rsi_7 rsi_21 cmo atr atr_7 atr_21 natr plus_di minus_di dx adx".split()]


def recursive(bars: DataFrame) -> DataFrame:
    """(symbol, ts) with every recursive column. NaN never leaves: what is not defined is null."""
    raw = bars.select("symbol", "ts", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(compute, SCHEMA)
    return raw.select("symbol", "ts", *[F.col(x) if x in FLAGS else F.when(~F.isnan(x), F.col(x)).alias(x) for x in COLUMNS])
