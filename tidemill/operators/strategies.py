"""Rule-based strategies as struct columns (direction, strength, confidence, stop_loss, take_profit), one pass over the panel instead of one
call a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.statistical import rescaled_range
from tidemill.plans.windows import c, div, frame, full, prev

YEAR = 252**0.5


def pack(direction: Column, strength: Column, confidence: Column, stop: Column, take: Column) -> Column:
    return F.struct(direction.cast("int").alias("direction"), strength.cast("double").alias("strength"), confidence.cast("double").alias("confidence"), stop.cast("double").alias("stop_loss"), take.cast("double").alias("take_profit"))


def neutral(confidence: float = 0.5) -> Column:
    """No direction; stop and target are the price."""
    return pack(F.lit(0), F.lit(0.0), F.lit(confidence), c("close"), c("close"))


def slice_range(n: int = 14) -> Column:
    """Y2: mean true range of the n bars before the current one, taken by themselves (the first has high less low); 2 % of the close where
    there are fewer."""
    return F.when(c("seq") <= n, 0.02 * c("close")).otherwise((F.sum("tr").over(frame(-(n - 1), -1)) + prev(c("high") - c("low"), n)) / n)


def momentum(b: DataFrame, periods: tuple[int, ...] = (21, 63, 126, 252), vol_target: float = 0.15) -> DataFrame:
    """Mean of the past returns that exist, each without its last five bars, scaled by volatility and trend strength."""
    b = b.withColumns({f"_m{p}": div(prev("close", 5), prev("close", p)) - 1 for p in periods} | {"_vol": F.stddev_samp("r").over(frame(-63, -1)) * YEAR, "_atr": slice_range()})
    live = F.filter(F.array(*[c(f"_m{p}") for p in periods]), lambda x: x.isNotNull())
    n = F.size(live)
    b = b.withColumns({"_n": n, "_mean": F.aggregate(live, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))})
    b = b.withColumns({"_d": F.when(c("_mean") > 0.02, 1).when(c("_mean") < -0.02, -1).otherwise(0), "_agree": F.size(F.filter(live, lambda x: F.signum(x) == F.signum("_mean"))) / F.greatest(n, F.lit(1))})
    scale = F.coalesce(F.least(F.greatest(div(F.lit(vol_target), c("_vol")), F.lit(0.5)), F.lit(2.0)), F.lit(1.0))
    weak = F.when(F.coalesce(c("adx_sma") < 15, F.lit(False)), 0.5).otherwise(1.0) if "adx_sma" in b.columns else F.lit(1.0)
    strength = F.when(c("_d") == 0, 0.0).otherwise(F.least(10 * F.abs("_mean"), F.lit(1.0)) * scale * weak)
    out = F.when(c("_n") == 0, neutral()).otherwise(pack(c("_d"), strength, c("_agree"), c("close") - 2 * c("_d") * c("_atr"), c("close") + 4 * c("_d") * c("_atr")))
    return b.withColumn("momentum", out).drop("_vol", "_atr", "_n", "_mean", "_d", "_agree", *[f"_m{p}" for p in periods])


def mean_reversion(b: DataFrame, n: int = 50, entry: float = 2.0) -> DataFrame:
    """Fades a z-score beyond the entry that the RSI confirms, unless the series is trending (Hurst exponent over 0.6)."""
    change = F.coalesce(c("close") - prev("close"), F.lit(0.0))
    b = b.withColumns({"_u": F.greatest(change, F.lit(0.0)), "_w": F.greatest(-change, F.lit(0.0)), "_mu": full("close", n + 1), "_sd": full("close", n + 1, F.stddev_samp), "_h": rescaled_range(n + 1, sample=True)})
    gain, loss = full("_u", 14), full("_w", 14)
    b = b.withColumns({"_z": div(c("close") - c("_mu"), "_sd"), "_rsi": F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + div(gain, loss)))})
    b = b.withColumn("_d", F.when((c("_z") < -entry) & (c("_rsi") < 30), 1).when((c("_z") > entry) & (c("_rsi") > 70), -1).otherwise(0))
    confidence = ((F.abs("_z") > entry).cast("int") + (c("_d") != 0).cast("int") + (c("_h") < 0.5).cast("int")) / 3.0
    strength = F.when(c("_d") == 0, 0.0).otherwise(F.least(F.abs("_z") / 3, F.lit(1.0)))
    out = F.when(c("_z").isNull() | F.coalesce(c("_h") > 0.6, F.lit(False)), neutral()).otherwise(pack(c("_d"), strength, confidence, c("close") - 3 * c("_d") * c("_sd"), c("_mu")))
    return b.withColumn("mean_reversion", out).drop("_u", "_w", "_mu", "_sd", "_h", "_z", "_rsi", "_d")


def breakout(b: DataFrame, n: int = 20, volume: float = 1.5) -> DataFrame:
    """Close beyond the channel of the bars before; volume confirms it, a preceding squeeze of the ranges strengthens it."""
    b = b.withColumns({"_hi": F.max("high").over(frame(-n, -1)), "_lo": F.min("low").over(frame(-n, -1)), "_vr": div("volume", F.avg("volume").over(frame(-n, -1))), "_atr": slice_range(), "_a10": slice_range(10), "_a20": slice_range(20)})
    loud, tight = F.coalesce(c("_vr") > volume, F.lit(False)), F.coalesce(c("_a10") < 0.8 * c("_a20"), F.lit(False))
    b = b.withColumns({"_loud": loud, "_tight": tight, "_d": F.when(c("close") > c("_hi"), 1).when(c("close") < c("_lo"), -1).otherwise(0)})
    strength = F.when(c("_d") == 0, 0.0).when(~c("_loud"), 0.3).when(c("_tight"), 0.8).otherwise(0.6)
    confidence = F.when(c("_d") == 0, 0.0).otherwise(F.lit(0.3) + F.when(c("_loud"), 0.4).otherwise(0.0) + F.when(c("_tight"), 0.3).otherwise(0.0))
    out = F.when(c("seq") <= n, neutral()).otherwise(pack(c("_d"), strength, confidence, c("close") - 2 * c("_d") * c("_atr"), c("close") + 4 * c("_d") * c("_atr")))
    return b.withColumn("breakout", out).drop("_hi", "_lo", "_vr", "_atr", "_a10", "_a20", "_loud", "_tight", "_d")


def regime(b: DataFrame) -> DataFrame:
    """Label of the bars before the current one: volatility against its year, Hurst exponent, and trend of the means of 50 and 200."""
    before = lambda x, n, agg=F.avg: F.when(c("seq") > n, agg(c(x)).over(frame(-n, -1)))
    b = b.withColumns({"_v20": before("r", 20, F.stddev_samp) * YEAR, "_v252": before("r", 252, F.stddev_samp) * YEAR, "_h": rescaled_range(100, sample=True), "_s50": before("close", 50), "_s200": before("close", 200)})
    b = b.withColumns({"_vh": F.coalesce("_v252", "_v20"), "_h100": prev("_h"), "_s200": F.coalesce("_s200", "_s50")})
    score = (c("_v20") - 0.5 * c("_vh")) / (0.5 * c("_vh") + 0.01)
    up, down = (c("close") > c("_s50")) & (c("_s50") > c("_s200")), (c("close") < c("_s50")) & (c("_s50") < c("_s200"))
    label = F.when(c("seq") <= 100, "unknown").when(score > 0.5, "high_volatility").when(score < -0.3, "low_volatility").when(c("_h100") < 0.45, "mean_reverting").when(up, "bull_trend").when(down, "bear_trend").otherwise("neutral")
    return b.withColumn("regime", label).drop("_v20", "_v252", "_vh", "_h", "_h100", "_s50", "_s200")


def switched(b: DataFrame) -> DataFrame:
    """The strategy that suits the regime."""
    m, r, k = c("momentum"), c("mean_reversion"), c("breakout")
    bear = F.when(m["direction"] == 0, pack(F.lit(-1), F.lit(0.3), m["confidence"], m["stop_loss"], m["take_profit"])).otherwise(m)
    calm = pack(m["direction"], m["strength"] * 0.3, m["confidence"], m["stop_loss"], m["take_profit"])
    out = F.when(c("regime") == "bull_trend", m).when(c("regime") == "bear_trend", bear).when(c("regime") == "mean_reverting", r).when(c("regime") == "low_volatility", k).when(c("regime") == "high_volatility", calm).otherwise(neutral(0.3))
    return b.withColumn("regime_switch", out)


def ensemble(b: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Sign of the votes weighted by confidence, weighted means of strength and confidence, and the levels of the switching strategy."""
    weights = weights or dict.fromkeys(("momentum", "mean_reversion", "breakout", "regime_switch"), 0.25)
    total = sum(weights.values())
    vote = F.round(sum(c(k)["direction"] * c(k)["confidence"] * w for k, w in weights.items()) / total, 9)
    mean = lambda x: sum(c(k)[x] * w for k, w in weights.items()) / total
    return b.withColumn("ensemble", pack(F.signum(vote), mean("strength"), mean("confidence"), c("regime_switch")["stop_loss"], c("regime_switch")["take_profit"]))


def strategy_weights(pnl: DataFrame, last: int = 50, least: int = 10, temperature: float = 0.5) -> DataFrame:
    """Softmax of the strategies' Sharpe ratios over their last results. pnl: strategy, ts, pnl."""
    recent = pnl.withColumn("_i", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("ts")))).where(c("_i") <= last)
    s = recent.groupBy("strategy").agg(F.when(F.count("*") < least, 1.0).otherwise(F.avg("pnl") / (F.stddev_pop("pnl") + 0.01)).alias("sharpe"))
    e = s.withColumn("_e", F.exp((c("sharpe") - F.max("sharpe").over(Window.partitionBy())) / temperature))
    return e.withColumn("weight", c("_e") / F.sum("_e").over(Window.partitionBy())).drop("_e")


def strategies(b: DataFrame) -> DataFrame:
    return ensemble(switched(regime(breakout(mean_reversion(momentum(b))))))
