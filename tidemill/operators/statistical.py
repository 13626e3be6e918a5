"""Statistical and advanced features of a panel: rolling moments, ratios, regimes, chaos proxies, order flow, levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.windows import c, change, corr, div, flag, frame, full, island_place, kurt, norm_cdf, past, prev, rank_share, run_length, skew, win

EPS = 1e-8
YEAR = 252**0.5


def rolling(b: DataFrame, n: int) -> DataFrame:
    """R1-R7 over the last n bars."""
    p = f"rolling_{n}_"
    q = lambda x: full("close", n, lambda v: F.percentile(v, x))
    b = b.withColumns({p + "mean": full("close", n), p + "std": full("close", n, F.stddev_samp), p + "var": full("close", n, F.var_samp), p + "min": full("close", n, F.min), p + "max": full("close", n, F.max), p + "median": q(0.5), p + "q25": q(0.25), p + "q75": q(0.75), p + "return_mean": full("r", n), p + "return_std": full("r", n, F.stddev_samp), p + "skew": skew("r", n), p + "kurt": kurt("r", n)})
    return b.withColumns({p + "range": c(p + "max") - c(p + "min"), p + "range_pct": (c("close") - c(p + "min")) / (c(p + "max") - c(p + "min") + EPS), p + "cv": c(p + "std") / (c(p + "mean") + EPS), p + "iqr": c(p + "q75") - c(p + "q25")})


def rolling_names(n: int) -> list[str]:
    return [f"rolling_{n}_{x}" for x in "mean std var min max median q25 q75 return_mean return_std skew kurt range range_pct cv iqr".split()]


def _drawdown(n: int) -> Column:
    """Deepest fall from the running peak inside the window, the peak starting at its second bar."""
    seen = F.collect_list("close").over(win(n))
    start = F.struct(F.element_at(seen, 2).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, v: Column) -> Column:
        peak = F.greatest(s["peak"], v)
        return F.struct(peak.alias("peak"), F.least(s["worst"], v / peak - 1).alias("worst"))

    # the window is full of closes and holds at least one return before it
    return F.when((F.count("close").over(win(n)) == n) & (F.size(seen) == n), F.aggregate(F.slice(seen, 2, n - 1), start, step)["worst"])


def ratios(b: DataFrame) -> DataFrame:
    """Z-scores, percentile rank, Sharpe, Sortino, drawdown, Calmar."""
    out = {}
    for n in (10, 20, 50):
        out[f"zscore_eps_{n}"] = (c("close") - full("close", n)) / (full("close", n, F.stddev_samp) + EPS)
        out[f"volume_zscore_{n}"] = (c("volume") - full("volume", n)) / (full("volume", n, F.stddev_samp) + EPS)
    for n in (20, 50):
        out[f"sharpe_ratio_{n}"] = full("r", n) / (full("r", n, F.stddev_samp) + EPS) * YEAR
        out[f"rolling_max_drawdown_{n}"] = _drawdown(n)
    b = b.withColumns(out | {"_neg": F.least("r", F.when(c("r").isNotNull(), 0.0)), "return_percentile_20": rank_share("r", 20)})
    b = b.withColumns({f"sortino_ratio_{n}": full("r", n) / (full("_neg", n, F.stddev_samp) + EPS) * YEAR for n in (20, 50)} | {"calmar_ratio_50": full("r", 50) * 252 / (F.abs("rolling_max_drawdown_50") + EPS)})
    return b.drop("_neg")


def extremes(b: DataFrame) -> DataFrame:
    """Z-scores of the close and whether they lie beyond 2 on either side."""
    b = b.withColumns({f"zscore_{n}": (c("close") - full("close", n)) / (full("close", n, F.stddev_samp) + EPS) for n in (10, 20, 50)})
    return b.withColumns({f"zscore_{n}_extreme_{s}": F.coalesce(x, F.lit(False)).cast("int") for n in (10, 20, 50) for s, x in (("high", c(f"zscore_{n}") > 2), ("low", c(f"zscore_{n}") < -2))})


EXTREMES = [*[f"zscore_{n}" for n in (10, 20, 50)], *[f"zscore_{n}_extreme_{s}" for n in (10, 20, 50) for s in ("high", "low")]]
RATIOS = [*[f"{x}_{n}" for n in (10, 20, 50) for x in ("zscore_eps", "volume_zscore")], *[f"{x}_{n}" for n in (20, 50) for x in ("sharpe_ratio", "sortino_ratio", "rolling_max_drawdown")], "return_percentile_20", "calmar_ratio_50"]


def _corr(x: str, y: str, n: int, pairs: int | None = None) -> Column:
    both = F.when(c(x).isNotNull() & c(y).isNotNull(), 1)
    return F.when(F.count(both).over(win(n)) == (pairs or n), corr(x, y, win(n)))


def relations(b: DataFrame) -> DataFrame:
    """Correlations, regimes, lags and runs."""
    b = b.withColumns({"_vc": change("volume"), "_rg": c("high") - c("low"), "_rp": div(c("high") - c("low"), "close"), **{f"_r{k}": prev("r", k) for k in (1, 2, 3, 5, 10)}, "volume_ratio": div("volume", full("volume", 20)), "_std20": full("r", 20, F.stddev_samp), "_std50": full("r", 50, F.stddev_samp), "_std100": full("r", 100, F.stddev_samp), "_up": (c("r") > 0).cast("double")})
    ma = {n: full("close", n) for n in (20, 50, 100)}
    relation = [c("close") > ma[20], c("close") > ma[50], c("close") > ma[100], ma[20] > ma[50], ma[50] > ma[100]]
    b = b.withColumns({
        "price_volume_corr": _corr("r", "_vc", 20), "range_volume_corr": _corr("_rg", "volume", 20),
        **{f"return_autocorr_lag{k}": F.when(F.count(F.when(c("r").isNotNull() & c(f"_r{k}").isNotNull(), 1)).over(frame(-(19 - k), 0)) == 20 - k, corr("r", f"_r{k}", frame(-(19 - k), 0))) for k in (1, 5, 10)},
        "volatility_ratio_20_50": c("_std20") / (c("_std50") + EPS), "volatility_ratio_20_100": c("_std20") / (c("_std100") + EPS),
        "_share100": rank_share("_std20", 100),
        "trend_regime": sum(flag(x) for x in relation), "mean_reversion_score": F.abs((c("close") - ma[50]) / (c("_std50") * 50**0.5 + EPS)),
        "momentum_regime": full("_up", 20), "range_trend_ratio": full("_rg", 20) / (full("tr", 20) + EPS),
        **{f"return_lag_{k}": c(f"_r{k}") for k in (1, 2, 3, 5, 10)}, **{f"volume_ratio_lag_{k}": prev("volume_ratio", k) for k in (1, 2, 3)}, **{f"range_lag_{k}": prev("_rp", k) for k in (1, 2, 3)},
        **{f"cum_return_{k}d": change("close", k) for k in (3, 5, 10)}, "return_acceleration": c("r") - c("_r1"),
        "_ui": run_length(c("r") > 0)[0], "_di": run_length(c("r") < 0)[0],
    })
    s = c("_share100")
    b = b.withColumns({"volatility_regime": F.when(s <= 0.25, 0).when(s <= 0.5, 1).when(s <= 0.75, 2).when(s.isNotNull(), 3), "consecutive_up": island_place(c("r") > 0, c("_ui")), "consecutive_down": island_place(c("r") < 0, c("_di"))})
    return b.drop(*[x for x in b.columns if x.startswith("_")])


RELATIONS = ["price_volume_corr", "range_volume_corr", *[f"return_autocorr_lag{k}" for k in (1, 5, 10)], "volatility_ratio_20_50", "volatility_ratio_20_100", "volatility_regime", "trend_regime", "mean_reversion_score", "momentum_regime", "range_trend_ratio", *[f"return_lag_{k}" for k in (1, 2, 3, 5, 10)], *[f"volume_ratio_lag_{k}" for k in (1, 2, 3)], *[f"range_lag_{k}" for k in (1, 2, 3)], *[f"cum_return_{k}d" for k in (3, 5, 10)], "return_acceleration", "consecutive_up", "consecutive_down"]


def regimes(b: DataFrame) -> DataFrame:
    """Return regimes and the percentile of volatility."""
    b = b.withColumns({**{f"regime_score_{n}": full("r", n) / (full("r", n, F.stddev_samp) + EPS) for n in (20, 50)}, **{f"trend_strength_{n}": full(c("high") - c("low"), n) / c("close") for n in (20, 50)}, "_std": full("r", 20, F.stddev_samp)})
    marks = {f"regime_{k}_{n}": flag(test(c(f"regime_score_{n}"))) for n in (20, 50) for k, test in (("bull", lambda s: s > 0.5), ("bear", lambda s: s < -0.5), ("sideways", lambda s: F.abs(s) <= 0.5))}
    b = b.withColumns(marks | {"vol_regime_percentile": 100 * rank_share("_std", 252)})
    b = b.withColumns({"high_vol_regime": flag(c("vol_regime_percentile") > 80), "low_vol_regime": flag(c("vol_regime_percentile") < 20), "regime_change": sum(F.coalesce(F.abs(c(f"regime_{k}_20") - prev(f"regime_{k}_20")), F.lit(0)) for k in ("bull", "bear"))})
    return b.drop("_std")


REGIMES = [*[f"{x}_{n}" for n in (20, 50) for x in ("regime_score", "trend_strength", "regime_bull", "regime_bear", "regime_sideways")], "vol_regime_percentile", "high_vol_regime", "low_vol_regime", "regime_change"]


def rescaled_range(n: int, sample: bool = False) -> Column:
    """log(R/S)/log(n) of the last n closes, clipped to 0..1; 0.5 where spread or range is 0."""
    seen = F.collect_list("close").over(win(n))
    mean, std = F.avg("close").over(win(n)), (F.stddev_samp if sample else F.stddev_pop)("close").over(win(n))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))
    packed = F.struct(seen.alias("x"), mean.alias("m"), std.alias("d"))

    def walk(p: Column) -> Column:
        def step(a: Column, v: Column) -> Column:
            s = a["s"] + v - p["m"]
            return F.struct(s.alias("s"), F.greatest(a["hi"], s).alias("hi"), F.least(a["lo"], s).alias("lo"))

        got = F.aggregate(p["x"], zero, step)
        return F.when((p["d"] > 0) & (got["hi"] > got["lo"]), F.least(F.greatest(F.log((got["hi"] - got["lo"]) / p["d"]) / F.log(F.lit(float(n))), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)

    return F.when(F.count("close").over(win(n)) == n, F.element_at(F.transform(F.array(packed), walk), 1))


def chaos(b: DataFrame) -> DataFrame:
    """Rescaled range, divergence of returns, entropy of the density of 20 returns in ten bins of their range."""
    bins = 10
    seen, lo, hi = F.collect_list("r").over(win(20)), F.min("r").over(win(20)), F.max("r").over(win(20))
    low, high = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    b = b.withColumns({"_dr": F.log(F.abs(c("r") - prev("r")) + 1e-10), "_e": F.struct(seen.alias("x"), low.alias("lo"), high.alias("hi"))})
    e = c("_e")
    place = F.transform(e["x"], lambda v: F.least(F.floor((v - e["lo"]) / ((e["hi"] - e["lo"]) / bins)), F.lit(bins - 1)))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(place, lambda v: v == k)) / (20.0 * (e["hi"] - e["lo"]) / bins))
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p + 1e-10)).otherwise(0.0))
    b = b.withColumns({**{f"hurst_proxy_{n}": rescaled_range(n) for n in (20, 50, 100)}, "lyapunov_proxy": F.when(F.count("r").over(win(50)) == 50, F.avg("_dr").over(frame(-48, 0))), "price_entropy": F.when(F.size(e["x"]) == 20, entropy)})
    return b.drop("_dr", "_e")


CHAOS = ["hurst_proxy_20", "hurst_proxy_50", "hurst_proxy_100", "lyapunov_proxy", "price_entropy"]


def flow(b: DataFrame) -> DataFrame:
    """Order-flow proxies."""
    up, down = flag(c("close") > c("last")), flag(c("close") < c("last"))
    mid = (c("high") + c("low")) / 2
    b = b.withColumns({"buying_pressure": up * c("volume"), "selling_pressure": down * c("volume"), "_pv": c("r") * c("volume"), "_rg": c("high") - c("low"), "_mid": mid, "_cm": full("close", 20), "_vm": full("volume", 20), "intraday_intensity": (2 * c("close") - c("high") - c("low")) / (c("high") - c("low") + 1e-10) * c("volume")})
    b = b.withColumns({"volume_delta": c("buying_pressure") - c("selling_pressure"), "pvt": F.sum("_pv").over(past()), "ease_of_movement": div(c("_mid") - prev("_mid"), c("volume") / 1e6 / (c("_rg") + 1e-10)), "vpci": F.signum(c("_cm") - prev("_cm")) * F.signum(c("_vm") - prev("_vm")), "ii_cumsum": full("intraday_intensity", 20, F.sum)})
    b = b.withColumns({"cum_volume_delta": F.sum("volume_delta").over(past()), **{f"volume_delta_ma_{n}": full("volume_delta", n) for n in (5, 10, 20)}, "pvt_signal": full("pvt", 20), "eom_ma": full("ease_of_movement", 14)})
    b = b.withColumns({f"volume_delta_divergence_{n}": c("volume_delta") - c(f"volume_delta_ma_{n}") for n in (5, 10, 20)})
    return b.drop("_pv", "_rg", "_mid", "_cm", "_vm")


FLOW = ["buying_pressure", "selling_pressure", "volume_delta", "cum_volume_delta", *[f"volume_delta_{x}_{n}" for n in (5, 10, 20) for x in ("ma", "divergence")], "pvt", "pvt_signal", "ease_of_movement", "eom_ma", "vpci", "intraday_intensity", "ii_cumsum"]


def levels(b: DataFrame) -> DataFrame:
    """Strict local extrema (and, without look-ahead, when they are confirmed), distances up to resistances and down to supports and the
    pivot, place in the range of 20 bars."""
    k = 5
    around = lambda x, agg: (agg(x).over(frame(-k, -1)), agg(x).over(frame(1, k)))
    (h0, h1), (l0, l1) = around("high", F.max), around("low", F.min)
    b = b.withColumns({"is_resistance": flag((c("high") > h0) & (c("high") > h1)), "is_support": flag((c("low") < l0) & (c("low") < l1)), "pivot": (prev("high") + prev("low") + prev("close")) / 3, "_ph": prev("high"), "_pl": prev("low"), "_lo": full("low", 20, F.min), "_hi": full("high", 20, F.max)})
    b = b.withColumns({"is_resistance_confirmed": F.coalesce(prev("is_resistance", k), F.lit(0)), "is_support_confirmed": F.coalesce(prev("is_support", k), F.lit(0)), "_r": F.last(F.when(c("is_resistance") == 1, c("high")), True).over(past()), "_s": F.last(F.when(c("is_support") == 1, c("low")), True).over(past()), "r1": 2 * c("pivot") - c("_pl"), "s1": 2 * c("pivot") - c("_ph"), "r2": c("pivot") + (c("_ph") - c("_pl")), "s2": c("pivot") - (c("_ph") - c("_pl")), "price_position": (c("close") - c("_lo")) / (c("_hi") - c("_lo") + 1e-10)})
    near = lambda x: div(c(x) - c("close"), "close")
    b = b.withColumns({"dist_to_resistance": near("_r"), "dist_to_support": -near("_s"), "dist_to_pivot": -near("pivot"), "dist_to_r1": near("r1"), "dist_to_s1": -near("s1")})
    return b.drop("_ph", "_pl", "_lo", "_hi", "_r", "_s")


LEVELS = "is_resistance is_support is_resistance_confirmed is_support_confirmed pivot r1 s1 r2 s2 price_position dist_to_resistance dist_to_support dist_to_pivot dist_to_r1 dist_to_s1".split()


def reversion(b: DataFrame) -> DataFrame:
    """Z-scores with their tail chance, mean-reversion speed, divergence, extreme moves."""
    b = b.withColumns({**{f"zscore_{n}": (c("close") - full("close", n)) / (full("close", n, F.stddev_samp) + 1e-10) for n in (10, 20, 50, 100)}, "_d": c("close") - c("last"), "_gain": F.greatest(F.coalesce(c("close") - c("last"), F.lit(0.0)), F.lit(0.0)), "_loss": F.greatest(F.coalesce(c("last") - c("close"), F.lit(0.0)), F.lit(0.0))})

    def theta(n: int) -> Column:
        w = frame(-n, -1)
        pairs = F.count(F.when(c("_d").isNotNull() & c("last").isNotNull(), 1)).over(w)
        return F.when(pairs >= 10, F.coalesce(-F.regr_slope("_d", "last").over(w), F.lit(0.0))).otherwise(0.0)

    b = b.withColumns({**{f"mr_probability_{n}": 1 - norm_cdf(F.abs(c(f"zscore_{n}"))) for n in (10, 20, 50, 100)}, **{f"ou_theta_{n}": theta(n) for n in (50, 100)}, "rsi_14": 100 - 100 / (1 + full("_gain", 14) / (full("_loss", 14) + 1e-10)), "extreme_move": flag(F.abs("r") > 2 * full("r", 50, F.stddev_samp))})
    top, low = full("close", 20, F.max), full("close", 20, F.min)
    b = b.withColumns({"bearish_divergence": flag((c("close") == top) & (c("rsi_14") < full("rsi_14", 20, F.max))), "bullish_divergence": flag((c("close") == low) & (c("rsi_14") > full("rsi_14", 20, F.min)))})
    return b.drop("_d", "_gain", "_loss")


REVERSION = [*[f"zscore_{n}" for n in (10, 20, 50, 100)], *[f"mr_probability_{n}" for n in (10, 20, 50, 100)], "ou_theta_50", "ou_theta_100", "rsi_14", "bearish_divergence", "bullish_divergence", "extreme_move"]


def factors(b: DataFrame) -> DataFrame:
    """Momentum factors."""
    b = b.withColumns({"momentum_12_1": div(prev("close", 21), prev("close", 252)) - 1, "momentum_6m": change("close", 126), "momentum_1m": change("close", 21), **{f"ts_momentum_{n}": div("close", full("close", n)) - 1 for n in (20, 50, 100, 200)}, "_pos": flag(c("r") > 0).cast("double"), "_hi": full("close", 252, F.max), "_lo": full("close", 252, F.min)})
    b = b.withColumns({**{f"momentum_quality_{n}": full("_pos", n) for n in (20, 50)}, "momentum_acceleration": c("momentum_1m") - prev("momentum_1m"), "pct_from_52w_high": div(c("close") - c("_hi"), "_hi"), "pct_from_52w_low": div(c("close") - c("_lo"), "_lo"), "momentum_breadth": sum(flag(c("close") > full("close", n)) for n in (20, 50, 100, 200)) / 4.0})
    return b.drop("_pos", "_hi", "_lo")


FACTORS = ["momentum_12_1", "momentum_6m", "momentum_1m", *[f"ts_momentum_{n}" for n in (20, 50, 100, 200)], "momentum_quality_20", "momentum_quality_50", "momentum_acceleration", "pct_from_52w_high", "pct_from_52w_low", "momentum_breadth"]


def volatilities(b: DataFrame) -> DataFrame:
    """Range-based estimators, volatility of volatility, term structure, skew of up and down bars."""
    hl, co = F.log(div("high", "low")), F.log(div("close", "open"))
    std = lambda n: full("r", n, F.stddev_samp)
    b = b.withColumns({"_pk": hl * hl, "_gk": 0.5 * hl * hl - (2 * 0.6931471805599453 - 1) * co * co, "_v5": std(5), "_v20": std(20), "_v60": std(60), "_sign": F.signum("r")})
    w = Window.partitionBy("symbol", "_sign").orderBy("ts")
    side = F.when(F.count("r").over(w.rowsBetween(-19, 0)) == 20, F.stddev_samp("r").over(w.rowsBetween(-19, 0)))
    gk = full("_gk", 20)
    b = b.withColumns({"parkinson_volatility": F.sqrt(full("_pk", 20) / (4 * 0.6931471805599453)), "gk_volatility": F.when(gk >= 0, F.sqrt(gk)), "vol_of_vol": full("_v20", 20, F.stddev_samp), "vol_term_5_20": c("_v5") / (c("_v20") + 1e-10), "vol_term_20_60": c("_v20") / (c("_v60") + 1e-10), "_side": side, "_vz": (c("_v20") - full("_v20", 50)) / (full("_v20", 50, F.stddev_samp) + 1e-10), })
    keep = lambda s: F.last(F.when(c("_sign") == s, c("_side")), True).over(past())
    b = b.withColumns({"vol_skew": keep(1) - keep(-1), "vol_persistence": full("_v20", 5) / (full("_v20", 50) + 1e-10), "vol_jump": flag(c("_vz") > 2)})
    return b.drop("_pk", "_gk", "_v5", "_v20", "_v60", "_sign", "_side", "_vz")


VOLATILITIES = "parkinson_volatility gk_volatility vol_of_vol vol_term_5_20 vol_term_20_60 vol_skew vol_persistence vol_jump".split()


def proxies(b: DataFrame) -> DataFrame:
    """Option-like and macro-like proxies from prices alone."""
    std = lambda n: full("r", n, F.stddev_samp)
    b = b.withColumns({"_rv": std(20) * YEAR, "_down": (flag(c("r") < 0) * flag(c("volume") > full("volume", 20))).cast("double"), "_neg": F.coalesce(F.least("r", F.lit(0.0)), F.lit(0.0)), "_pos": F.coalesce(F.greatest("r", F.lit(0.0)), F.lit(0.0)), "_v20": std(20), "_tv": c("tp") * c("volume"), "_v60": std(60), "_dd": c("close") / F.max("close").over(past()) - 1, })
    b = b.withColumns({"iv_proxy": full("_rv", 252, lambda v: F.percentile(v, 0.75)), "put_call_proxy": full("_down", 10), "skew_proxy": full("_neg", 20, F.stddev_samp) / (full("_pos", 20, F.stddev_samp) + 1e-10), "max_pain_proxy": div(full("_tv", 20, F.sum), full("volume", 20, F.sum)), "economic_proxy": change("close", 60), "inflation_proxy": 100 * rank_share("_v60", 252), "credit_stress_proxy": -full("_dd", 20, F.min), "liquidity_proxy": full("volume", 20) / (c("_v20") * c("close") + 1e-10)})
    b = b.withColumns({"vol_risk_premium": c("iv_proxy") / (c("_rv") + 1e-10), "dist_to_max_pain": div(c("close") - c("max_pain_proxy"), "close"), "_ep": flag(c("economic_proxy") < 0).cast("double")})
    return b.withColumn("recession_proxy", full("_ep", 3)).drop("_rv", "_down", "_neg", "_pos", "_v20", "_tv", "_v60", "_dd", "_ep")


PROXIES = "iv_proxy vol_risk_premium put_call_proxy skew_proxy max_pain_proxy dist_to_max_pain economic_proxy recession_proxy inflation_proxy credit_stress_proxy liquidity_proxy".split()


def box_dimension(b: DataFrame, n: int = 30, sizes: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """X7 as intended: slope of log(boxes) against log(1/size) of the closes of n bars scaled to the unit square, cut to 1..2."""
    seen, lo, hi = F.collect_list("close").over(win(n)), F.min("close").over(win(n)), F.max("close").over(win(n))
    b = b.withColumn("_b", F.struct(seen.alias("x"), lo.alias("lo"), hi.alias("hi")))
    e = c("_b")
    cells = lambda k: F.size(F.array_distinct(F.transform(e["x"], lambda v, i: F.floor(i * F.lit(k) / F.lit(n)) * 1000 + F.least(F.floor(F.try_divide(v - e["lo"], e["hi"] - e["lo"]) * k), F.lit(k - 1)))))
    xs = [math.log(k) for k in sizes]
    mean = sum(xs) / len(xs)
    slope = sum((x - mean) * F.log(cells(k).cast("double")) for x, k in zip(xs, sizes, strict=True)) / sum((x - mean) ** 2 for x in xs)
    return b.withColumn("fractal_dimension", F.when((F.size(e["x"]) == n) & (e["hi"] > e["lo"]), F.least(F.greatest(slope, F.lit(1.0)), F.lit(2.0)))).drop("_b")
