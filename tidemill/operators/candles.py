"""Candlestick patterns from published definitions, as expressions over the last bars.

A body is long or short, and a shadow short, against the mean body or range of the ten bars before. Values are 100 for bullish, -100 for
bearish and 0 for no pattern. All columns come from one window over the symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.windows import c, frame, prev, series

# Sizes of candle parts, as shares.
DOJI, NEAR, FAR, SHORT_SHADOW, LONG_SHADOW, EQUAL = 0.1, 0.2, 0.6, 0.1, 1.0, 0.05


class Bars:
    """Parts of the bar k places back, as columns prepared by parts()."""

    def __init__(self, k: int):
        g = lambda x: c(f"_{x}{k}")
        self.o, self.h, self.l, self.c = g("o"), g("h"), g("l"), g("c")
        self.body, self.range = F.abs(self.c - self.o), self.h - self.l
        self.top, self.low = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.upper, self.lower = self.h - self.top, self.low - self.l
        self.white, self.black = self.c >= self.o, self.c < self.o
        self.mean_body, self.mean_range = g("mb"), g("mr")
        self.long, self.short = self.body > self.mean_body, self.body < self.mean_body
        self.doji = self.body <= DOJI * self.mean_range
        self.no_upper, self.no_lower = self.upper < SHORT_SHADOW * self.mean_range, self.lower < SHORT_SHADOW * self.mean_range
        self.equal, self.near, self.far = EQUAL * self.mean_range, NEAR * self.mean_range, FAR * self.mean_range


def parts(bars: DataFrame, depth: int = 7) -> DataFrame:
    full = F.count("close").over(frame(-10, -1)) == 10
    b = bars.withColumns({"_mb": F.when(full, F.avg(F.abs(c("close") - c("open"))).over(frame(-10, -1))), "_mr": F.when(full, F.avg(c("high") - c("low")).over(frame(-10, -1)))})
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "mb": "_mb", "mr": "_mr"}
    return b.select("*", *[(prev(x, k) if k else c(x)).alias(f"_{short}{k}") for k in range(depth) for short, x in names.items()])


def _up_gap(a: Bars, b: Bars) -> Column:
    return a.low > b.top


def _down_gap(a: Bars, b: Bars) -> Column:
    return a.top < b.low


def _near(a: Column, b: Column, d: Column) -> Column:
    return F.abs(a - b) <= d


def definitions() -> dict[str, tuple[Column | None, Column | None]]:
    """Pattern: (bullish condition, bearish condition). x is the newest bar, then y, z, u, v."""
    x, y, z, u, v = (Bars(k) for k in range(5))
    inside = lambda a, b: (a.top < b.top) & (a.low > b.low)
    engulf = lambda a, b: (a.top >= b.top) & (a.low <= b.low) & (a.body > b.body)
    marubozu = lambda a: a.long & a.no_upper & a.no_lower
    in_body = lambda p, a: (p > a.low) & (p < a.top)
    small = x.short & ~x.doji
    star_up, star_down = _up_gap(y, z), _down_gap(y, z)
    hammer = x.short & (x.lower > LONG_SHADOW * 2 * x.body) & x.no_upper
    inverted = x.short & (x.upper > LONG_SHADOW * 2 * x.body) & x.no_lower
    falls = lambda a, b, d: (a.c < b.c) & (b.c < d.c)
    rises = lambda a, b, d: (a.c > b.c) & (b.c > d.c)
    three_up = x.white & y.white & z.white & rises(x, y, z)
    three_down = x.black & y.black & z.black & falls(x, y, z)
    none = None
    return {
        "belthold": (x.long & x.white & x.no_lower, x.long & x.black & x.no_upper),
        "closingmarubozu": (x.long & x.white & x.no_upper, x.long & x.black & x.no_lower),
        "doji": (x.doji, none),
        "dragonflydoji": (x.doji & x.no_upper & ~x.no_lower, none),
        "gravestonedoji": (x.doji & x.no_lower & ~x.no_upper, none),
        "highwave": (x.short & x.white & (x.upper > 2 * x.body) & (x.lower > 2 * x.body), x.short & x.black & (x.upper > 2 * x.body) & (x.lower > 2 * x.body)),
        "longleggeddoji": (x.doji & ((x.upper > x.body) | (x.lower > x.body)) & ~(x.no_upper & x.no_lower), none),
        "longline": (x.long & x.white & (x.upper < x.body / 2) & (x.lower < x.body / 2), x.long & x.black & (x.upper < x.body / 2) & (x.lower < x.body / 2)),
        "marubozu": (marubozu(x) & x.white, marubozu(x) & x.black),
        "rickshawman": (x.doji & (x.upper > x.body) & (x.lower > x.body) & _near((x.h + x.l) / 2, (x.o + x.c) / 2, x.near), none),
        "shortline": (small & x.white & (x.upper < x.body) & (x.lower < x.body), small & x.black & (x.upper < x.body) & (x.lower < x.body)),
        "spinningtop": (x.short & x.white & (x.upper > x.body) & (x.lower > x.body), x.short & x.black & (x.upper > x.body) & (x.lower > x.body)),
        "takuri": (x.doji & x.no_upper & (x.lower > 3 * x.mean_range / 2), none),
        "counterattack": (y.long & x.long & y.black & x.white & _near(x.c, y.c, y.equal), y.long & x.long & y.white & x.black & _near(x.c, y.c, y.equal)),
        "darkcloudcover": (none, y.long & y.white & x.black & (x.o > y.h) & (x.c < y.c - y.body / 2) & (x.c > y.o)),
        "dojistar": (y.long & y.black & x.doji & _down_gap(x, y), y.long & y.white & x.doji & _up_gap(x, y)),
        "engulfing": (x.white & y.black & engulf(x, y), x.black & y.white & engulf(x, y)),
        "hammer": (hammer & (x.low <= y.l + x.near), none),
        "hangingman": (none, hammer & (x.low >= y.h - x.near)),
        "harami": (y.long & y.black & x.short & inside(x, y), y.long & y.white & x.short & inside(x, y)),
        "haramicross": (y.long & y.black & x.doji & inside(x, y), y.long & y.white & x.doji & inside(x, y)),
        "homingpigeon": (y.long & y.black & x.short & x.black & inside(x, y), none),
        "inneck": (none, y.long & y.black & x.white & (x.o < y.l) & (x.c >= y.c) & (x.c <= y.c + y.equal)),
        "invertedhammer": (inverted & _down_gap(x, y), none),
        "kicking": (marubozu(y) & marubozu(x) & y.black & x.white & (x.l > y.h), marubozu(y) & marubozu(x) & y.white & x.black & (x.h < y.l)),
        "kickingbylength": (marubozu(y) & marubozu(x) & (((y.black & x.white & (x.l > y.h)) & (x.body > y.body)) | ((y.white & x.black & (x.h < y.l)) & (y.body > x.body))), marubozu(y) & marubozu(x) & (((y.black & x.white & (x.l > y.h)) & (y.body > x.body)) | ((y.white & x.black & (x.h < y.l)) & (x.body > y.body)))),
        "matchinglow": (y.black & x.black & _near(x.c, y.c, y.equal), none),
        "onneck": (none, y.long & y.black & x.white & (x.o < y.l) & _near(x.c, y.l, y.equal)),
        "piercing": (y.long & x.long & y.black & x.white & (x.o < y.l) & (x.c < y.o) & (x.c > y.c + y.body / 2), none),
        "separatinglines": (y.black & x.white & x.long & x.no_lower & _near(x.o, y.o, y.equal), y.white & x.black & x.long & x.no_upper & _near(x.o, y.o, y.equal)),
        "shootingstar": (none, inverted & _up_gap(x, y)),
        "thrusting": (none, y.long & y.black & x.white & (x.o < y.l) & (x.c > y.c + y.equal) & (x.c <= y.c + y.body / 2)),
        "2crows": (none, z.long & z.white & y.black & _up_gap(y, z) & x.black & in_body(x.o, y) & in_body(x.c, z)),
        "3blackcrows": (none, three_down & x.no_lower & y.no_lower & z.no_lower & in_body(x.o, y) & in_body(y.o, z) & u.white & (z.c < u.h)),
        "3inside": (z.long & z.black & y.short & inside(y, z) & x.white & (x.c > z.o), z.long & z.white & y.short & inside(y, z) & x.black & (x.c < z.o)),
        "3outside": (z.black & y.white & engulf(y, z) & (x.c > y.c), z.white & y.black & engulf(y, z) & (x.c < y.c)),
        "3starsinsouth": (z.black & y.black & x.black & z.long & (z.lower > z.body) & (y.body < z.body) & (y.l > z.l) & (y.l < z.c) & marubozu_short(x) & (x.l > y.l) & (x.h < y.h), none),
        "3whitesoldiers": (three_up & x.no_upper & y.no_upper & z.no_upper & in_body(x.o, y) & in_body(y.o, z) & ~x.short, none),
        "abandonedbaby": (z.long & z.black & y.doji & (y.h < z.l) & x.white & (x.l > y.h) & (x.c > z.c + z.body * 0.3), z.long & z.white & y.doji & (y.l > z.h) & x.black & (x.h < y.l) & (x.c < z.c - z.body * 0.3)),
        "advanceblock": (none, three_up & in_body(x.o, y) & in_body(y.o, z) & z.long & (x.body < y.body) & (y.body < z.body) & ((x.upper > x.body) | (y.upper > y.body))),
        "eveningdojistar": (none, z.long & z.white & y.doji & star_up & x.black & (x.c < z.c - z.body * 0.3)),
        "eveningstar": (none, z.long & z.white & y.short & star_up & x.black & ~x.short & (x.c < z.c - z.body * 0.3)),
        "gapsidesidewhite": (_up_gap(y, z) & _up_gap(x, z) & x.white & y.white & _near(x.o, y.o, y.equal) & _near(x.body, y.body, y.near), _down_gap(y, z) & _down_gap(x, z) & x.white & y.white & _near(x.o, y.o, y.equal) & _near(x.body, y.body, y.near)),
        "hikkake": ((y.h < z.h) & (y.l > z.l) & (x.h < y.h) & (x.l < y.l), (y.h < z.h) & (y.l > z.l) & (x.h > y.h) & (x.l > y.l)),
        "identical3crows": (none, three_down & x.no_lower & y.no_lower & z.no_lower & _near(y.o, z.c, z.equal) & _near(x.o, y.c, y.equal)),
        "morningdojistar": (z.long & z.black & y.doji & star_down & x.white & (x.c > z.c + z.body * 0.3), none),
        "morningstar": (z.long & z.black & y.short & star_down & x.white & ~x.short & (x.c > z.c + z.body * 0.3), none),
        "stalledpattern": (none, three_up & z.long & y.long & y.no_upper & in_body(y.o, z) & x.short & (x.o >= y.c - x.body - y.near)),
        "sticksandwich": (z.black & y.white & x.black & (y.l > z.c) & _near(x.c, z.c, z.equal), none),
        "tasukigap": (z.white & y.white & _up_gap(y, z) & x.black & in_body(x.o, y) & (x.c < y.o) & (x.c > z.top), z.black & y.black & _down_gap(y, z) & x.white & in_body(x.o, y) & (x.c > y.o) & (x.c < z.low)),
        "tristar": (x.doji & y.doji & z.doji & _down_gap(y, z) & (x.low > y.low), x.doji & y.doji & z.doji & _up_gap(y, z) & (x.top < y.top)),
        "unique3river": (z.long & z.black & y.black & inside(y, z) & (y.l < z.l) & x.short & x.white & (x.o > y.l), none),
        "upsidegap2crows": (none, z.long & z.white & y.short & y.black & _up_gap(y, z) & x.black & (x.o > y.o) & (x.c < y.c) & (x.c > z.c)),
        "xsidegap3methods": (z.white & y.white & x.black & _up_gap(y, z) & in_body(x.o, y) & in_body(x.c, z), z.black & y.black & x.white & _down_gap(y, z) & in_body(x.o, y) & in_body(x.c, z)),
        "3linestrike": (u.white & z.white & y.white & (y.c > z.c) & (z.c > u.c) & x.black & (x.o > y.c) & (x.c < u.o), u.black & z.black & y.black & (y.c < z.c) & (z.c < u.c) & x.white & (x.o < y.c) & (x.c > u.o)),
        "concealbabyswall": (u.black & z.black & y.black & x.black & marubozu(u) & marubozu(z) & _down_gap(y, z) & (y.h > z.c) & (x.h > y.h) & (x.l < y.l), none),
        "hikkakemod": ((z.h < u.h) & (z.l > u.l) & (y.h < z.h) & (y.l > z.l) & (y.c <= y.l + y.near) & (x.h < y.h) & (x.l < y.l), (z.h < u.h) & (z.l > u.l) & (y.h < z.h) & (y.l > z.l) & (y.c >= y.h - y.near) & (x.h > y.h) & (x.l > y.l)),
        "breakaway": (v.long & v.black & u.black & _down_gap(u, v) & (z.h < u.h) & (z.l < u.l) & y.black & (y.h < z.h) & (y.l < z.l) & x.white & (x.c > u.o) & (x.c < v.c), v.long & v.white & u.white & _up_gap(u, v) & (z.h > u.h) & (z.l > u.l) & y.white & (y.h > z.h) & (y.l > z.l) & x.black & (x.c < u.o) & (x.c > v.c)),
        "ladderbottom": (v.black & u.black & z.black & (v.o > u.o) & (u.o > z.o) & (v.c > u.c) & (u.c > z.c) & y.black & (y.upper > y.body * DOJI) & x.white & (x.o > y.o) & (x.c > y.h), none),
        "mathold": (v.long & v.white & u.black & _up_gap(u, v) & z.short & y.short & (z.low < v.c) & (y.low < v.c) & (y.low > v.c - v.body / 2) & (z.top < u.o) & (y.top < z.top) & x.white & (x.o > y.c) & (x.c > F.greatest(u.h, z.h, y.h)), none),
        "risefall3methods": (v.long & v.white & u.short & z.short & y.short & (u.low > v.l) & (z.low > v.l) & (y.low > v.l) & (u.top < v.h) & (z.top < v.h) & (y.top < v.h) & falls(y, z, u) & x.long & x.white & (x.c > v.c), v.long & v.black & u.short & z.short & y.short & (u.top < v.h) & (z.top < v.h) & (y.top < v.h) & (u.low > v.l) & (z.low > v.l) & (y.low > v.l) & rises(y, z, u) & x.long & x.black & (x.c < v.c)),
    }


def marubozu_short(x: Bars) -> Column:
    return x.short & x.no_upper & x.no_lower


def candles(bars: DataFrame) -> DataFrame:
    """(symbol, ts), a column cdl_<pattern> for each pattern, and the counts of bullish and bearish ones."""
    known = definitions()

    def value(bull: Column | None, bear: Column | None) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for cond, v in ((bull, 100), (bear, -100)):
            if cond is not None:
                out = out.when(F.coalesce(cond, F.lit(False)), F.lit(v))
        return out.otherwise(0)

    found = parts(bars).select("symbol", "ts", *[value(*d).alias(f"cdl_{name}") for name, d in known.items()])
    count = lambda test: sum(F.when(test(F.col(f"cdl_{name}")), 1).otherwise(0) for name in known)
    return found.select("*", count(lambda v: v > 0).alias("bullish_pattern_count"), count(lambda v: v < 0).alias("bearish_pattern_count"))


def confirmed(bars: DataFrame, most: int = 3) -> DataFrame:
    """(symbol, ts, cdl_hikkake, cdl_hikkakemod) with their confirmations: 200 or -200 at the first bar, of the `most` after a pattern, whose
    close passes the high (a bullish one) or the low of the bar before the pattern's last. A new pattern takes the place of an open one.

    An automaton with three states, by windows: the last pattern before a bar says what is open and up to when; it is still open if no bar
    since has passed its level."""
    found = candles(bars).select("symbol", "ts", "cdl_hikkake", "cdl_hikkakemod").join(bars.select("symbol", "ts", "high", "low", "close"), ["symbol", "ts"])
    found = found.withColumn("_seq", F.row_number().over(series()))
    before = frame(Window.unboundedPreceding, -1)
    for name in ("cdl_hikkake", "cdl_hikkakemod"):
        one = F.when(c(name) != 0, F.struct(c("_seq").alias("at"), F.signum(name).cast("int").alias("side"), F.when(c(name) > 0, prev("high")).otherwise(prev("low")).alias("level")))
        found = found.withColumn("_one", one)
        found = found.withColumn("_open", F.last("_one", True).over(before))
        passes = (c(name) == 0) & (c("_seq") - c("_open.at") <= most) & (c("_open.side") * (c("close") - c("_open.level")) > 0)
        found = found.withColumn("_hit", F.coalesce(passes, F.lit(False)))
        again = F.lit(False)
        for k in range(1, most):  # an earlier bar has confirmed the same pattern
            again = again | F.coalesce(prev("_hit", k) & (prev("_open", k)["at"] == c("_open.at")), F.lit(False))
        found = found.withColumn("_again", again).withColumn(name, F.when(c("_hit") & ~c("_again"), 200 * c("_open.side")).otherwise(c(name)))
    return found.select("symbol", "ts", "cdl_hikkake", "cdl_hikkakemod")
