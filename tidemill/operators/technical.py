"""Technical indicators that are plain window expressions. Each function adds its columns to a panel of bars.

Plain names follow the common library meaning; the suffix _sma marks the variant that uses simple means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.windows import c, change, div, flag, frame, full, past, prev, rank_share, sign, true_range, win  # noqa: F401


def base(bars: DataFrame) -> DataFrame:
    """Bars with the columns that several groups share: seq, last, r (return), tr, tp (typical price)."""
    from tidemill.plans.windows import series

    return bars.select("*", F.row_number().over(series()).alias("seq"), prev("close").alias("last"), change("close").alias("r"), true_range().alias("tr"), ((c("high") + c("low") + c("close")) / 3).alias("tp"))


def trend(b: DataFrame) -> DataFrame:
    """Means, triangular and weighted means, directional index by means, Aroon, crosses."""
    up, down = c("high") - prev("high"), prev("low") - c("low")
    b = b.withColumns({f"sma_{n}": full("close", n) for n in (5, 10, 20, 50, 100, 200)})
    b = b.withColumns({"_s10": full("close", 10), "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_up": F.greatest(up, F.lit(0.0))})
    b = b.withColumn("_minus", F.when((down > F.col("_plus")) & (down > 0), down).otherwise(0.0))
    weights = sum(F.lag("close", k).over(frame_order()) * (20 - k) if k else c("close") * 20 for k in range(20)) / 210
    hi, lo = F.max_by("seq", F.struct("high", "seq")).over(win(26)), F.max_by("seq", F.struct(-c("low"), c("seq"))).over(win(26))
    whole = F.count("close").over(win(26)) == 26
    b = b.withColumns({
        "trima_20": full("_s10", 11), "wma_20": weights,
        "plus_di_sma": 100 * div(full("_plus", 14), full("tr", 14)), "minus_di_sma": 100 * div(full("_minus", 14), full("tr", 14)),
        "aroon_up": F.when(whole, 100 * (25 - (c("seq") - hi)) / 25.0), "aroon_down": F.when(whole, 100 * (25 - (c("seq") - lo)) / 25.0),
        "sma_cross_20_50": sign(c("sma_20") > c("sma_50")),
    })
    b = b.withColumns({"aroon_osc": c("aroon_up") - c("aroon_down"), "_dx": 100 * div(F.abs(c("plus_di_sma") - c("minus_di_sma")), c("plus_di_sma") + c("minus_di_sma"))})
    return b.withColumn("adx_sma", full("_dx", 14)).drop("_s10", "_plus", "_up", "_minus", "_dx")


def frame_order():
    from tidemill.plans.windows import series

    return series()


TREND = [*[f"sma_{n}" for n in (5, 10, 20, 50, 100, 200)], "trima_20", "wma_20", "plus_di_sma", "minus_di_sma", "adx_sma", "aroon_up", "aroon_down", "aroon_osc", "sma_cross_20_50"]


def momentum(b: DataFrame) -> DataFrame:
    """Oscillators on windows."""
    b = b.withColumns({"_d": F.coalesce(c("close") - c("last"), F.lit(0.0)), "_hi": full("high", 14, F.max), "_lo": full("low", 14, F.min)})
    b = b.withColumns({"_gain": F.greatest(c("_d"), F.lit(0.0)), "_loss": F.greatest(-c("_d"), F.lit(0.0)), "stoch_fastk": 100 * div(c("close") - c("_lo"), c("_hi") - c("_lo")), "_mf": c("tp") * c("volume"), "_ltp": prev("tp"), "_bp": c("close") - F.least("low", "last"), "_tr": F.when(c("last").isNotNull(), c("tr"))})
    gain, loss = full("_gain", 14), full("_loss", 14)
    b = b.withColumns({"_pos": F.when(c("_ltp").isNotNull(), F.when(c("tp") > c("_ltp"), c("_mf")).otherwise(0.0)), "_neg": F.when(c("_ltp").isNotNull(), F.when(c("tp") < c("_ltp"), c("_mf")).otherwise(0.0)), "_bp": F.when(c("last").isNotNull(), c("_bp"))})
    tp = F.collect_list("tp").over(win(20))
    mean = F.avg("tp").over(win(20))
    tp14, mean14 = F.collect_list("tp").over(win(14)), F.avg("tp").over(win(14))
    b = b.withColumns({
        "rsi_sma": F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - 100 / (1 + div(gain, loss))),
        "stoch_k": full("stoch_fastk", 3), "stoch_fastd": full("stoch_fastk", 3),
        "_m20": F.struct(mean.alias("m"), tp.alias("x")), "_m14": F.struct(mean14.alias("m"), tp14.alias("x")),
        "mom_10": c("close") - prev("close", 10), "mom_20": c("close") - prev("close", 20),
        "roc": 100 * change("close", 10), "rocp": change("close", 10), "rocr": div("close", prev("close", 10)),
        "willr": -100 * div(c("_hi") - c("close"), c("_hi") - c("_lo")),
        "ultosc": 100 * (4 * div(full("_bp", 7, F.sum), full("_tr", 7, F.sum)) + 2 * div(full("_bp", 14, F.sum), full("_tr", 14, F.sum)) + div(full("_bp", 28, F.sum), full("_tr", 28, F.sum))) / 7,
        "bop": F.coalesce(div(c("close") - c("open"), c("high") - c("low")), F.lit(0.0)),
        "apo": full("close", 12) - full("close", 26), "ppo": 100 * div(full("close", 12) - full("close", 26), full("close", 26)),
        "mfi": 100 * div(full("_pos", 14, F.sum), full("_pos", 14, F.sum) + full("_neg", 14, F.sum)),
    })

    def cci(n: int):
        s = c(f"_m{n}")
        spread = F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + F.abs(v - s["m"])) / n
        return F.when(F.size(s["x"]) == n, div(c("tp") - s["m"], 0.015 * spread))

    b = b.withColumns({"cci": cci(20), "cci_14": cci(14), "stoch_d": full("stoch_k", 3), "rsi_overbought": flag(c("rsi_sma") > 70), "rsi_oversold": flag(c("rsi_sma") < 30)})
    return b.drop("_d", "_hi", "_lo", "_gain", "_loss", "_mf", "_ltp", "_bp", "_tr", "_pos", "_neg", "_m20", "_m14")


MOMENTUM = "rsi_sma stoch_k stoch_d stoch_fastk stoch_fastd cci cci_14 mom_10 mom_20 roc rocp rocr willr ultosc bop apo ppo mfi rsi_overbought rsi_oversold".split()


def volatility(b: DataFrame) -> DataFrame:
    """True range, its mean, Bollinger bands with population and sample deviation."""
    mid, pop, samp = full("close", 20), full("close", 20, F.stddev_pop), full("close", 20, F.stddev_samp)
    b = b.withColumns({"trange": F.when(c("last").isNotNull(), c("tr")), "atr_sma": full("tr", 14), "bb_middle": mid, "bb_upper": mid + 2 * pop, "bb_lower": mid - 2 * pop, "bb_upper_sma": mid + 2 * samp, "bb_lower_sma": mid - 2 * samp})
    return b.withColumns({"bb_width": div(c("bb_upper") - c("bb_lower"), "bb_middle"), "bb_pct": div(c("close") - c("bb_lower"), c("bb_upper") - c("bb_lower")), "natr_sma": 100 * div("atr_sma", "close"), "high_volatility_sma": flag(c("atr_sma") > 1.5 * full("atr_sma", 50))})


VOLATILITY = "trange atr_sma bb_middle bb_upper bb_lower bb_upper_sma bb_lower_sma bb_width bb_pct natr_sma high_volatility_sma".split()


def volume(b: DataFrame) -> DataFrame:
    """On-balance volume (seeded with the first volume, and with 0), accumulation line, volume means."""
    step = F.coalesce(F.signum(c("close") - c("last")), F.lit(0.0)) * c("volume")
    flow = F.coalesce(div((c("close") - c("low")) - (c("high") - c("close")), c("high") - c("low")), F.lit(0.0)) * c("volume")
    b = b.withColumns({"obv_sma": F.sum(step).over(past()), "ad": F.sum(flow).over(past()), "volume_sma_20": full("volume", 20)})
    return b.withColumns({"obv": c("obv_sma") + F.first("volume").over(past()), "volume_ratio": div("volume", "volume_sma_20"), "volume_trend": div(full("volume", 5), full("volume", 20))})


VOLUME = "obv obv_sma ad volume_sma_20 volume_ratio volume_trend".split()


def derived(b: DataFrame) -> DataFrame:
    """Returns, volatility of returns, distance to means."""
    b = b.withColumns({f"returns_{n}d": change("close", n) for n in (1, 5, 20)} | {"log_returns_1d": F.log(div("close", "last"))})
    b = b.withColumns({f"volatility_{n}d": full("returns_1d", n, F.stddev_samp) for n in (20, 60)})
    return b.withColumns({f"dist_sma_{n}": div(c("close") - full("close", n), full("close", n)) for n in (20, 50, 200)})


DERIVED = "returns_1d returns_5d returns_20d log_returns_1d volatility_20d volatility_60d dist_sma_20 dist_sma_50 dist_sma_200".split()
