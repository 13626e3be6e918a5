"""Rule-based signals: a technical score, its combination, confidence, five levels, stops, filters, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.windows import c, flag, full, past, prev, series, win


@dataclass(frozen=True)
class SignalConfig:
    strong_buy: float = 0.58
    buy: float = 0.52
    sell: float = 0.48
    strong_sell: float = 0.42
    ml_weight: float = 0.5
    sentiment_weight: float = 0.2
    technical_weight: float = 0.3
    min_confidence: float = 0.25
    stop_loss: float = 0.02
    bullish: float = 0.1
    bearish: float = -0.1
    confirm_trend: bool = False
    confirm_volume: bool = False
    first_bar: int = 50


def sentiment_of(columns: list[str]) -> Column:
    """The first of sentiment_mean, sentiment_weighted and sentiment (scored from the day's news) that the panel has, else 0."""
    have = [x for x in ("sentiment_mean", "sentiment_weighted", "sentiment") if x in columns]
    return F.coalesce(c(have[0]), F.lit(0.0)) if have else F.lit(0.0)


def scored(b: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """G1-G3 on the columns of prepared(); ml_probability (0.5 if null or absent) and a sentiment where present. Returns both with the scores,
    the sentiment as sentiment_score."""
    step = lambda up, down, w: F.when(F.coalesce(up, F.lit(False)), w).when(F.coalesce(down, F.lit(False)), -w).otherwise(0.0)
    ml = F.coalesce(c("ml_probability"), F.lit(0.5)) if "ml_probability" in b.columns else F.lit(0.5)
    mood = sentiment_of(b.columns)
    strong, rising = F.coalesce(c("adx_sma") > 25, F.lit(False)), F.coalesce(c("plus_di_sma") > c("minus_di_sma"), F.lit(False))
    base = 0.5 + step(strong & rising, strong & ~rising, 0.1) + step(c("rsi_sma") < 30, c("rsi_sma") > 70, 0.1) + step(c("macd_hist_adj") > 0, c("macd_hist_adj") < 0, 0.05) + step(c("bb_pct_sma") < 0.1, c("bb_pct_sma") > 0.9, 0.1)
    base = base + F.when(F.coalesce(c("sma_20") > c("sma_50"), F.lit(False)), 0.05).otherwise(-0.05)
    # to nine digits, so that sums of tenths do not pass 0.5 by rounding errors
    b = b.withColumn("_s", F.round(base, 9))
    amplified = c("_s") + F.when(F.coalesce(c("volume_ratio") > 1.5, F.lit(False)), F.when(c("_s") > 0.5, 0.05).when(c("_s") < 0.5, -0.05).otherwise(0.0)).otherwise(0.0)
    b = b.withColumns({"technical_score": F.round(F.least(F.greatest(amplified, F.lit(0.0)), F.lit(1.0)), 9), "_ml": ml, "_mood": mood})
    b = b.withColumn("combined", cfg.ml_weight * c("_ml") + cfg.sentiment_weight * (c("_mood") + 1) / 2 + cfg.technical_weight * c("technical_score"))
    side = lambda x: F.when(c(x) > 0.5, 1).otherwise(-1)
    agree = F.abs(side("_ml") + F.signum("_mood") + side("technical_score")) / 3.0
    calm = F.greatest(F.lit(0.0), 1 - 20 * F.try_divide(c("atr_sma"), c("close")))
    four = F.abs(c("_ml") - 0.5) * 2 + F.abs("_mood") + F.abs(c("technical_score") - 0.5) * 2 + agree
    b = b.withColumn("confidence", F.when(c("atr_sma").isNull(), four / 4).otherwise((four + calm) / 5))
    return b.withColumns({"ml_probability": c("_ml"), "sentiment_score": c("_mood")}).drop("_s", "_ml", "_mood")


def levelled(b: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Level -2..2, stop, target and their ratio; the first bars of a symbol are left out.

    confirm_trend: no buy without sma_20 over sma_50, no sale with it, none under an index of 20. confirm_volume: strong levels need 0.8
    of the mean volume, else they become plain ones.
    """
    s = c("combined")
    level = F.when(F.round("confidence", 9) < cfg.min_confidence, 0).when(s >= cfg.strong_buy, 2).when(s >= cfg.buy, 1).when(s <= cfg.strong_sell, -2).when(s <= cfg.sell, -1).otherwise(0)
    b = b.withColumn("signal_value", level)
    if cfg.confirm_trend:
        rising = F.coalesce(c("sma_20") > c("sma_50"), F.lit(False))
        against = (c("signal_value") > 0) & ~rising | (c("signal_value") < 0) & rising | F.coalesce(c("adx_sma") < 20, F.lit(False))
        b = b.withColumn("signal_value", F.when(against, 0).otherwise(c("signal_value")))
    if cfg.confirm_volume:
        b = b.withColumn("signal_value", F.when((F.abs("signal_value") == 2) & ~F.coalesce(c("volume_ratio") > 0.8, F.lit(False)), F.signum("signal_value").cast("int")).otherwise(c("signal_value")))
    b = b.withColumns({"_lo": F.min("low").over(win(20)), "_hi": F.max("high").over(win(20))})
    up, down = c("signal_value") > 0, c("signal_value") < 0
    risk = F.coalesce(2 * c("atr_sma"), cfg.stop_loss * c("close"))
    b = b.withColumns({"stop_loss": F.when(up, F.greatest(c("close") - risk, c("_lo") * 0.99)).when(down, F.least(c("close") + risk, c("_hi") * 1.01)), "take_profit": F.when(up, c("close") + 2 * risk).when(down, c("close") - 2 * risk)})
    b = b.withColumns({"risk_reward_ratio": F.try_divide(F.abs(c("take_profit") - c("close")), F.abs(c("close") - c("stop_loss"))), "signal": F.element_at(F.array(*[F.lit(x) for x in ("STRONG_SELL", "SELL", "HOLD", "BUY", "STRONG_BUY")]), c("signal_value") + 3)})
    return b.where(c("seq") > cfg.first_bar).drop("_lo", "_hi")


def notes(b: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Explanations of a signal: the model beyond 0.7 and 0.3, the news beyond its thresholds, an index over 70 or under 30, a trend over
    40 or else over 25. An unknown value gives no note."""
    say = lambda x, *cases: F.coalesce(*[F.when(cond, F.format_string(text, x)) for cond, text in cases])
    ml, mood, rsi, adx = 100 * c("ml_probability"), c("sentiment_score"), c("rsi_sma"), c("adx_sma")
    # The wording of the notes.
    found = [
        say(ml, (c("ml_probability") > 0.7, "Strong ML bullish signal (%.2f%%)"), (c("ml_probability") < 0.3, "Strong ML bearish signal (%.2f%%)")),
        say(mood, (mood > cfg.bullish, "Positive news sentiment (%+.2f)"), (mood < cfg.bearish, "Negative news sentiment (%+.2f)")),
        say(rsi, (rsi < 30, "RSI oversold (%.1f)"), (rsi > 70, "RSI overbought (%.1f)")),
        say(adx, (adx > 40, "Very strong trend (ADX=%.1f)"), (adx > 25, "Strong trend (ADX=%.1f)")),
    ]
    return b.withColumn("notes", F.array_compact(F.array(*found)))


def prepared(b: DataFrame) -> DataFrame:
    """The panel columns that scored() needs."""
    from tidemill.operators import recursive, technical

    b = technical.volatility(technical.momentum(technical.trend(recursive.with_macd_hist(b))))
    return b.withColumns({"bb_pct_sma": F.try_divide(c("close") - c("bb_lower_sma"), c("bb_upper_sma") - c("bb_lower_sma")), "volume_ratio": F.try_divide(c("volume"), full("volume", 20))})


def _summed(groups) -> DataFrame:
    v = c("signal_value")
    out = groups.agg(F.count("*").alias("total"), F.count_if(v > 0).alias("buys"), F.count_if(v < 0).alias("sells"), F.count_if(v == 0).alias("holds"), F.count_if(F.abs(v) == 2).alias("strong"), F.avg("confidence").alias("avg_confidence"), F.avg("ml_probability").alias("avg_ml_probability"), F.avg("sentiment_score").alias("avg_sentiment"), F.count_if(c("confidence") > 0.7).alias("high_confidence"), F.avg("combined").alias("avg_combined"), F.avg("technical_score").alias("avg_technical"), F.avg("risk_reward_ratio").alias("avg_risk_reward"))
    return out.withColumns({"buy_pct": 100 * c("buys") / c("total"), "sell_pct": 100 * c("sells") / c("total"), "hold_pct": 100 * c("holds") / c("total")})


def summary(signals: DataFrame) -> DataFrame:
    """One row a symbol."""
    return _summed(signals.groupBy("symbol"))


def rolled_up(signals: DataFrame) -> DataFrame:
    """A7 by symbol and year, by symbol (year null) and in all (both null); level is 0, 1 and 3. Totals are taken over the signals, not over
    the years' means; Spark adds the signals up before the shuffle, once for each level."""
    by_year = signals.withColumn("year", F.year("ts"))
    return _summed(_Levels(by_year.rollup("symbol", "year")))


class _Levels:
    """A rollup whose aggregates carry the level of their row."""

    def __init__(self, groups) -> None:
        self.groups = groups

    def agg(self, *columns: Column) -> DataFrame:
        return self.groups.agg(F.grouping_id().cast("int").alias("level"), *columns)


def distribution(signals: DataFrame) -> DataFrame:
    """A14."""
    return signals.groupBy("signal").agg(F.count("*").alias("n"))


def latest(signals: DataFrame) -> DataFrame:
    """The newest signal of each symbol, kept by a maximum that combines before the shuffle."""
    return signals.groupBy("symbol").agg(F.max_by(F.struct(*[x for x in signals.columns if x != "symbol"]), "ts").alias("s")).select("symbol", "s.*")


def filtered(b: DataFrame, column: str = "score") -> DataFrame:
    """Position from a score by +-0.35; no position where model and strategy disagree (column agree, if present), no buy over an
    RSI of 70 and no sale under 30, no sale in an uptrend and no buy in a downtrend."""
    known = lambda x: F.coalesce(x, F.lit(False))
    p = F.when(c(column) > 0.35, 1).when(c(column) < -0.35, -1).otherwise(0)
    if "agree" in b.columns:
        p = F.when(known(c("agree") == 0), 0).otherwise(p)
    b = b.withColumn("_p", p)
    up, down = (c("close") > c("sma_50")) & (c("sma_20") > c("sma_50")), (c("close") < c("sma_50")) & (c("sma_20") < c("sma_50"))
    no_buy, no_sale = known(c("rsi_sma") > 70) | known(down), known(c("rsi_sma") < 30) | known(up)
    return b.withColumn("position", F.when((c("_p") > 0) & no_buy | (c("_p") < 0) & no_sale, 0).otherwise(c("_p"))).drop("_p")


def minimum_hold(b: DataFrame, bars: int = 5, column: str = "position") -> DataFrame:
    """Accepts a signal only if the last accepted one is at least `bars` bars back. Folds the ordered signal positions of a symbol."""
    # no filter: it would be pushed below the steps of the signal and repeat their expressions
    hits = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.when(c(column) != 0, c("seq")))).alias("s"))
    start = F.struct(F.lit(-(10**9)).alias("last"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, v: F.when(v - a["last"] >= bars, F.struct(v.alias("last"), F.concat(a["kept"], F.array(v)).alias("kept"))).otherwise(a)
    kept = hits.select("symbol", F.explode(F.aggregate("s", start, step)["kept"]).alias("seq"), F.lit(True).alias("_ok"))
    return b.join(kept, ["symbol", "seq"], "left").withColumn(column, F.when(c("_ok"), c(column)).otherwise(0)).drop("_ok")
