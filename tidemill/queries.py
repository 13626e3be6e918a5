"""The registered queries of the market operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import technical
from tidemill.sources import bars as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Added before rounding: prices often end in an exact half of the last digit, which engines round differently.
NUDGE = 1.3e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and counts as long, so that results compare across engines."""
    return df.select([F.round(F.col(x.name) + NUDGE, 1 if x.name.endswith("_var") else digits).alias(x.name) if isinstance(x.dataType, T.DoubleType) else F.col(x.name) for x in df.schema])


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL pieces
LINES = "SELECT p.p_brand AS symbol, date_trunc('week', l_shipdate) AS ts, l_extendedprice / nullif(l_quantity, 0) AS p, l_quantity AS q, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem JOIN part p ON p_partkey = l_partkey"
ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
OHLCV = f"SELECT symbol, ts, first(p {ORDER}) AS open, max(p) AS high, min(p) AS low, last(p {ORDER}) AS close, sum(q) AS volume"
BRAND = f"bars AS ({OHLCV} FROM ({LINES}) GROUP BY symbol, ts)"
ROW = "PARTITION BY symbol ORDER BY ts"
BASE = f"""{BRAND}, base AS (SELECT *, row_number() OVER w AS seq, lag(close) OVER w AS last, close / nullif(lag(close) OVER w, 0) - 1 AS r,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, (high + low + close) / 3 AS tp FROM bars WINDOW w AS ({ROW}))"""


def over(lo: int | str, hi: int | str = 0) -> str:
    edge = lambda k: "UNBOUNDED PRECEDING" if k == "all" else "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"OVER ({ROW} ROWS BETWEEN {edge(lo)} AND {edge(hi)})"


def full(x: str, n: int, agg: str = "avg") -> str:
    return f"CASE WHEN count({x}) {over(1 - n)} = {n} THEN {agg}({x}) {over(1 - n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({ROW})"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def q(name: str) -> str:
    return f'"{name}"' if name == "pivot" else name


def sql(ctes: list[str], columns: list[str], source: str, digits: int = 6, ints: tuple[str, ...] = (), head: str = BASE) -> str:
    """WITH base, the stages; then symbol, ts and the columns, rounded."""
    shown = ", ".join(f"CAST({x} AS INTEGER) AS {x}" if x in ints else f"round({q(x)} + {NUDGE}, {1 if x.endswith('_var') else digits}) AS {q(x)}" for x in columns)
    return f"WITH {', '.join([head, *ctes])} SELECT symbol, ts, {shown} FROM {source}"


def stage(name: str, source: str, **columns: str) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{v} AS {q(k)}' for k, v in columns.items())} FROM {source})"


# ---------------------------------------------------------------- bars
def _bars_sql(head: str) -> str:
    return f"WITH {head} SELECT symbol, ts, " + ", ".join(f"round({x} + {NUDGE}, 6) AS {x}" for x in ("open", "high", "low", "close", "volume")) + " FROM bars"


@register("bars_brand_week", _bars_sql(BRAND))
def bars_brand_week(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.brand_week(spark, d))


@register("bars_supplier_week", _bars_sql(f"bars AS ({OHLCV} FROM (SELECT *, CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('week', l_shipdate) AS ts, l_extendedprice / nullif(l_quantity, 0) AS p, l_quantity AS q FROM lineitem) GROUP BY symbol, ts)"))
def bars_supplier_week(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.supplier_week(spark, d))


@register("bars_event_hour", _bars_sql("bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"))
def bars_event_hour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.event_hour(spark, d))


def based(spark: SparkSession, d: str) -> DataFrame:
    return technical.base(B.brand_week(spark, d))


def shown(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return rounded(df.select("symbol", "ts", *columns), digits)


# ---------------------------------------------------------------- technical indicators
_dm = stage("d1", "base", up=f"high - {lag('high')}", dn=f"{lag('low')} - low", s10=full("close", 10))
_dm2 = stage("d2", "d1", plus="CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END")
_dm3 = stage("d3", "d2", minus="CASE WHEN dn > plus AND dn > 0 THEN dn ELSE 0.0::DOUBLE END")
_dm4 = stage(
    "d4", "d3",
    **{f"sma_{n}": full("close", n) for n in (5, 10, 20, 50, 100, 200)},
    trima_20=full("s10", 11),
    wma_20="(" + " + ".join(f"{lag('close', k)} * {20 - k}" if k else "close * 20" for k in range(20)) + ") / 210",
    plus_di_sma=f"100 * {ratio(full('plus', 14), full('tr', 14))}", minus_di_sma=f"100 * {ratio(full('minus', 14), full('tr', 14))}",
    hs=f"list(high) {over(-25)}", ls=f"list(low) {over(-25)}",
)
_dm5 = stage(
    "d5", "d4",
    dx="100 * abs(plus_di_sma - minus_di_sma) / nullif(plus_di_sma + minus_di_sma, 0)",
    aroon_up="CASE WHEN len(hs) = 26 THEN 100 * (25 - list_position(list_reverse(hs), list_max(hs)) + 1) / 25.0::DOUBLE END",
    aroon_down="CASE WHEN len(ls) = 26 THEN 100 * (25 - list_position(list_reverse(ls), list_min(ls)) + 1) / 25.0::DOUBLE END",
    sma_cross_20_50="CASE WHEN coalesce(sma_20 > sma_50, false) THEN 1 ELSE -1 END",
)
_dm6 = stage("d6", "d5", adx_sma=full("dx", 14), aroon_osc="aroon_up - aroon_down")


@register("trend_windows", sql([_dm, _dm2, _dm3, _dm4, _dm5, _dm6], technical.TREND, "d6", ints=("sma_cross_20_50",)))
def trend_windows(spark: SparkSession, d: str) -> DataFrame:
    return shown(technical.trend(based(spark, d)), technical.TREND)


_m1 = stage("m1", "base", d="coalesce(close - last, 0)", hi=full("high", 14, "max"), lo=full("low", 14, "min"), mf="tp * volume", ltp=lag("tp"), bp="CASE WHEN last IS NOT NULL THEN close - least(low, last) END", rtr="CASE WHEN last IS NOT NULL THEN tr END")
_m2 = stage("m2", "m1", gain="greatest(d, 0)", loss="greatest(-d, 0)", stoch_fastk="100 * (close - lo) / nullif(hi - lo, 0)", pos="CASE WHEN ltp IS NOT NULL THEN CASE WHEN tp > ltp THEN mf ELSE 0.0::DOUBLE END END", neg="CASE WHEN ltp IS NOT NULL THEN CASE WHEN tp < ltp THEN mf ELSE 0.0::DOUBLE END END", x20=f"list(tp) {over(-19)}", x14=f"list(tp) {over(-13)}")
_m3 = stage(
    "m3", "m2",
    g=full("gain", 14), l=full("loss", 14), stoch_k=full("stoch_fastk", 3), stoch_fastd=full("stoch_fastk", 3),
    cci="CASE WHEN len(x20) = 20 THEN (tp - list_avg(x20)) / nullif(0.015::DOUBLE * list_avg(list_transform(x20, lambda v: abs(v - list_avg(x20)))), 0) END",
    cci_14="CASE WHEN len(x14) = 14 THEN (tp - list_avg(x14)) / nullif(0.015::DOUBLE * list_avg(list_transform(x14, lambda v: abs(v - list_avg(x14)))), 0) END",
    mom_10=f"close - {lag('close', 10)}", mom_20=f"close - {lag('close', 20)}",
    roc=f"100 * (close / nullif({lag('close', 10)}, 0) - 1)", rocp=f"close / nullif({lag('close', 10)}, 0) - 1", rocr=f"close / nullif({lag('close', 10)}, 0)",
    willr="-100 * (hi - close) / nullif(hi - lo, 0)",
    ultosc="100 * (4 * " + ratio(full("bp", 7, "sum"), full("rtr", 7, "sum")) + " + 2 * " + ratio(full("bp", 14, "sum"), full("rtr", 14, "sum")) + " + " + ratio(full("bp", 28, "sum"), full("rtr", 28, "sum")) + ") / 7",
    bop="coalesce((close - open) / nullif(high - low, 0), 0)",
    apo=f"({full('close', 12)}) - ({full('close', 26)})", ppo=f"100 * (({full('close', 12)}) - ({full('close', 26)})) / nullif({full('close', 26)}, 0)",
    mfi="100 * " + ratio(full("pos", 14, "sum"), f"({full('pos', 14, 'sum')}) + ({full('neg', 14, 'sum')})"),
)
_m4 = stage("m4", "m3", rsi_sma="CASE WHEN l = 0 AND g > 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + g / nullif(l, 0)) END", stoch_d=full("stoch_k", 3))
_m5 = stage("m5", "m4", rsi_overbought="coalesce(rsi_sma > 70, false)", rsi_oversold="coalesce(rsi_sma < 30, false)")


@register("momentum_windows", sql([_m1, _m2, _m3, _m4, _m5], technical.MOMENTUM, "m5", ints=("rsi_overbought", "rsi_oversold")))
def momentum_windows(spark: SparkSession, d: str) -> DataFrame:
    return shown(technical.momentum(based(spark, d)), technical.MOMENTUM)


_v1 = stage("v1", "base", trange="CASE WHEN last IS NOT NULL THEN tr END", atr_sma=full("tr", 14), bb_middle=full("close", 20), sp=full("close", 20, "stddev_pop"), ss=full("close", 20, "stddev_samp"))
_v2 = stage("v2", "v1", bb_upper="bb_middle + 2 * sp", bb_lower="bb_middle - 2 * sp", bb_upper_sma="bb_middle + 2 * ss", bb_lower_sma="bb_middle - 2 * ss", bb_width="4 * sp / nullif(bb_middle, 0)", bb_pct="(close - bb_middle + 2 * sp) / nullif(4 * sp, 0)", natr_sma="100 * atr_sma / nullif(close, 0)", high_volatility_sma=f"coalesce(atr_sma > 1.5 * ({full('atr_sma', 50)}), false)")


@register("volatility_windows", sql([_v1, _v2], technical.VOLATILITY, "v2", ints=("high_volatility_sma",)))
def volatility_windows(spark: SparkSession, d: str) -> DataFrame:
    return shown(technical.volatility(based(spark, d)), technical.VOLATILITY)


_u1 = stage("u1", "base", step="coalesce(sign(close - last), 0) * volume", flow="coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume")
_u2 = stage("u2", "u1", obv_sma=f"sum(step) {over('all')}", ad=f"sum(flow) {over('all')}", volume_sma_20=full("volume", 20), first_volume=f"first_value(volume) {over('all')}", volume_trend=ratio(full("volume", 5), full("volume", 20)))
_u3 = stage("u3", "u2", obv="obv_sma + first_volume", volume_ratio="volume / nullif(volume_sma_20, 0)")


@register("volume_windows", sql([_u1, _u2, _u3], technical.VOLUME, "u3"))
def volume_windows(spark: SparkSession, d: str) -> DataFrame:
    return shown(technical.volume(based(spark, d)), technical.VOLUME)


_e1 = stage("e1", "base", **{f"returns_{n}d": f"close / nullif({lag('close', n)}, 0) - 1" for n in (1, 5, 20)}, log_returns_1d="ln(close / nullif(last, 0))", **{f"dist_sma_{n}": f"(close - ({full('close', n)})) / nullif({full('close', n)}, 0)" for n in (20, 50, 200)})
_e2 = stage("e2", "e1", **{f"volatility_{n}d": full("returns_1d", n, "stddev_samp") for n in (20, 60)})


@register("derived_windows", sql([_e1, _e2], technical.DERIVED, "e2"))
def derived_windows(spark: SparkSession, d: str) -> DataFrame:
    return shown(technical.derived(based(spark, d)), technical.DERIVED)


# ---------------------------------------------------------------- statistical and advanced features
from tidemill.operators import statistical as S  # noqa: E402


def rank_sql(x: str, n: int, where: str) -> str:
    """Percentile share of the last of n values; where: the stage that has list x as {x}_list."""
    return f"CASE WHEN count({x}) {over(1 - n)} = {n} THEN (len(list_filter(list({x}) {over(1 - n)}, lambda v: v < {x})) + len(list_filter(list({x}) {over(1 - n)}, lambda v: v <= {x})) + 1) / {2.0 * n} END"


def ranked(prefix: str, source: str, new: str, x: str, n: int, scale: float = 1.0) -> list[str]:
    """Two stages: the list of the last n values, then the share below the last; nulls are left out of the list."""
    return [
        stage(f"{prefix}a", source, **{f"{new}_l": f"list({x}) FILTER (WHERE {x} IS NOT NULL) {over(1 - n)}"}),
        stage(f"{prefix}b", f"{prefix}a", **{new: f"CASE WHEN len({new}_l) = {n} AND {x} IS NOT NULL THEN {scale} * (len(list_filter({new}_l, lambda v: v < {x})) + len(list_filter({new}_l, lambda v: v <= {x})) + 1) / {2.0 * n} END"}),
    ]


def _rolling_sql(n: int) -> str:
    q = lambda x: full("close", n, "quantile_cont").replace("quantile_cont(close)", f"quantile_cont(close, {x})")
    p = f"rolling_{n}_"
    one = stage("s1", "base", **{p + "mean": full("close", n), p + "std": full("close", n, "stddev_samp"), p + "var": full("close", n, "var_samp"), p + "min": full("close", n, "min"), p + "max": full("close", n, "max"), p + "median": q(0.5), p + "q25": q(0.25), p + "q75": q(0.75), p + "return_mean": full("r", n), p + "return_std": full("r", n, "stddev_samp"), p + "skew": full("r", n, "skewness"), p + "kurt": full("r", n, "kurtosis")})
    two = stage("s2", "s1", **{p + "range": f"{p}max - {p}min", p + "range_pct": f"(close - {p}min) / ({p}max - {p}min + 1e-8)", p + "cv": f"{p}std / ({p}mean + 1e-8)", p + "iqr": f"{p}q75 - {p}q25"})
    return sql([one, two], S.rolling_names(n), "s2", 4)


for _n in (5, 10, 20, 50):
    register(f"rolling_{_n}", _rolling_sql(_n))(lambda spark, d, n=_n: shown(S.rolling(based(spark, d), n), S.rolling_names(n), 4))

_q1 = stage("q1", "base", neg="least(r, 0.0::DOUBLE)", **{f"dd{n}": f"list(close) {over(1 - n)}" for n in (20, 50)}, **{f"zscore_eps_{n}": f"(close - ({full('close', n)})) / (({full('close', n, 'stddev_samp')}) + 1e-8)" for n in (10, 20, 50)}, **{f"volume_zscore_{n}": f"(volume - ({full('volume', n)})) / (({full('volume', n, 'stddev_samp')}) + 1e-8)" for n in (10, 20, 50)}, **{f"sharpe_ratio_{n}": f"({full('r', n)}) / (({full('r', n, 'stddev_samp')}) + 1e-8) * sqrt(252)" for n in (20, 50)})
_q1 = _q1.replace("least(r, 0.0::DOUBLE)", "CASE WHEN r IS NOT NULL THEN least(r, 0.0::DOUBLE) END")
_q2 = stage("q2", "q1", **{f"sortino_ratio_{n}": f"({full('r', n)}) / (({full('neg', n, 'stddev_samp')}) + 1e-8) * sqrt(252)" for n in (20, 50)}, **{f"rolling_max_drawdown_{n}": f"CASE WHEN len(dd{n}) = {n} THEN least(0.0::DOUBLE, list_min(list_transform(range(2, {n} + 1), lambda i: dd{n}[i] / list_max(dd{n}[2:i]) - 1))) END" for n in (20, 50)})
_q3 = stage("q3", "q2", calmar_ratio_50=f"({full('r', 50)}) * 252 / (abs(rolling_max_drawdown_50) + 1e-8)")


@register("risk_ratios", sql([_q1, _q2, _q3, *ranked("q4", "q3", "return_percentile_20", "r", 20)], S.RATIOS, "q4b"))
def risk_ratios(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.ratios(based(spark, d)), S.RATIOS)


def corr_sql(x: str, y: str, lo: int, pairs: int) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {over(lo)} = {pairs} THEN corr({x}, {y}) {over(lo)} END"


_l1 = stage("l1", "base", vc=f"volume / nullif({lag('volume')}, 0) - 1", rg="high - low", rp="(high - low) / nullif(close, 0)", **{f"r{k}": lag("r", k) for k in (1, 2, 3, 5, 10)}, volume_ratio=ratio("volume", full("volume", 20)), std20=full("r", 20, "stddev_samp"), std50=full("r", 50, "stddev_samp"), std100=full("r", 100, "stddev_samp"), up="CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS DOUBLE) END", ui=f"sum(CASE WHEN coalesce(r > 0, false) THEN 0 ELSE 1 END) {over('all')}", di=f"sum(CASE WHEN coalesce(r < 0, false) THEN 0 ELSE 1 END) {over('all')}", **{f"m{n}": full("close", n) for n in (20, 50, 100)})
_l2 = stage(
    "l2", "l1", price_volume_corr=corr_sql("r", "vc", -19, 20), range_volume_corr=corr_sql("rg", "volume", -19, 20), **{f"return_autocorr_lag{k}": corr_sql("r", f"r{k}", -(19 - k), 20 - k) for k in (1, 5, 10)},
    volatility_ratio_20_50="std20 / (std50 + 1e-8)", volatility_ratio_20_100="std20 / (std100 + 1e-8)",
    trend_regime=" + ".join(f"CAST(coalesce({x}, false) AS INTEGER)" for x in ("close > m20", "close > m50", "close > m100", "m20 > m50", "m50 > m100")),
    mean_reversion_score="abs((close - m50) / (std50 * sqrt(50) + 1e-8))", momentum_regime=full("up", 20), range_trend_ratio=f"({full('rg', 20)}) / (({full('tr', 20)}) + 1e-8)",
    **{f"return_lag_{k}": f"r{k}" for k in (1, 2, 3, 5, 10)}, **{f"volume_ratio_lag_{k}": lag("volume_ratio", k) for k in (1, 2, 3)}, **{f"range_lag_{k}": lag("rp", k) for k in (1, 2, 3)},
    **{f"cum_return_{k}d": f"close / nullif({lag('close', k)}, 0) - 1" for k in (3, 5, 10)}, return_acceleration="r - r1",
    consecutive_up="sum(CAST(coalesce(r > 0, false) AS INTEGER)) OVER (PARTITION BY symbol, ui ORDER BY ts)", consecutive_down="sum(CAST(coalesce(r < 0, false) AS INTEGER)) OVER (PARTITION BY symbol, di ORDER BY ts)",
)
_l4 = stage("l4", "l3b", volatility_regime="CASE WHEN share <= 0.25 THEN 0 WHEN share <= 0.5 THEN 1 WHEN share <= 0.75 THEN 2 WHEN share IS NOT NULL THEN 3 END")


@register("return_relations", sql([_l1, _l2, *ranked("l3", "l2", "share", "std20", 100), _l4], S.RELATIONS, "l4", ints=("volatility_regime", "trend_regime", "consecutive_up", "consecutive_down")))
def return_relations(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.relations(based(spark, d)), S.RELATIONS)


_r1 = stage("r1", "base", rg="high - low", std=full("r", 20, "stddev_samp"))
_r2 = stage("r2", "r1", **{f"regime_score_{n}": f"({full('r', n)}) / (({full('r', n, 'stddev_samp')}) + 1e-8)" for n in (20, 50)}, **{f"trend_strength_{n}": f"({full('rg', n)}) / close" for n in (20, 50)})
_r3 = stage("r3", "r2", **{f"regime_{k}_{n}": f"CAST(coalesce({t.format(f'regime_score_{n}')}, false) AS INTEGER)" for n in (20, 50) for k, t in (("bull", "{} > 0.5"), ("bear", "{} < -0.5"), ("sideways", "abs({}) <= 0.5"))})
_r5 = stage("r5", "r4b", high_vol_regime="CAST(coalesce(vol_regime_percentile > 80, false) AS INTEGER)", low_vol_regime="CAST(coalesce(vol_regime_percentile < 20, false) AS INTEGER)", regime_change=f"coalesce(abs(regime_bull_20 - {lag('regime_bull_20')}), 0) + coalesce(abs(regime_bear_20 - {lag('regime_bear_20')}), 0)")
_flags = tuple(x for x in S.REGIMES if x.startswith("regime_b") or x.startswith("regime_s") and "score" not in x or x.endswith("_regime") or x == "regime_change")


@register("return_regimes", sql([_r1, _r2, _r3, *ranked("r4", "r3", "vol_regime_percentile", "std", 252, 100.0), _r5], S.REGIMES, "r5", ints=_flags))
def return_regimes(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.regimes(based(spark, d)), S.REGIMES)


def hurst_sql(n: int, std: str = "stddev_pop") -> tuple[str, str]:
    """(first-stage columns as one struct, expression over it)."""
    first = f"CASE WHEN count(close) {over(1 - n)} = {n} THEN {{'x': list(close) {over(1 - n)}, 'm': avg(close) {over(1 - n)}, 's': {std}(close) {over(1 - n)}}} END"
    walk = f"list_transform(range(1, {n} + 1), lambda i: list_sum(h{n}.x[1:i]) - i * h{n}.m)"
    return first, f"CASE WHEN h{n} IS NOT NULL THEN CASE WHEN h{n}.s > 0 AND list_max({walk}) > list_min({walk}) THEN least(greatest(ln((list_max({walk}) - list_min({walk})) / h{n}.s) / ln({n}), 0), 1) ELSE 0.5::DOUBLE END END"


_h1 = stage("h1", "base", dr=f"ln(abs(r - {lag('r')}) + 1e-10)", x=f"list(r) FILTER (WHERE r IS NOT NULL) {over(-19)}", **{f"h{n}": hurst_sql(n)[0] for n in (20, 50, 100)})
_h2 = stage("h2", "h1", lo="CASE WHEN list_min(x) = list_max(x) THEN list_min(x) - 0.5 ELSE list_min(x) END", hi="CASE WHEN list_min(x) = list_max(x) THEN list_max(x) + 0.5 ELSE list_max(x) END")
_h3 = stage("h3", "h2", place="list_transform(x, lambda v: least(floor((v - lo) / ((hi - lo) / 10)), 9))")
_h4 = stage("h4", "h3", share="list_transform(range(0, 10), lambda k: len(list_filter(place, lambda v: v = k)) / (20.0::DOUBLE * (hi - lo) / 10))")
_h5 = stage("h5", "h4", price_entropy="CASE WHEN len(x) = 20 THEN -list_sum(list_transform(share, lambda p: CASE WHEN p > 0 THEN p * log2(p + 1e-10) ELSE 0 END)) END", lyapunov_proxy=f"CASE WHEN count(r) {over(-49)} = 50 THEN avg(dr) {over(-48)} END", **{f"hurst_proxy_{n}": hurst_sql(n)[1] for n in (20, 50, 100)})


@register("chaos_proxies", sql([_h1, _h2, _h3, _h4, _h5], S.CHAOS, "h5"))
def chaos_proxies(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.chaos(based(spark, d)), S.CHAOS)


_f1 = stage("f1", "base", buying_pressure="CASE WHEN close > last THEN volume ELSE 0.0::DOUBLE END", selling_pressure="CASE WHEN close < last THEN volume ELSE 0.0::DOUBLE END", pv="r * volume", rg="high - low", mid="(high + low) / 2", cm=full("close", 20), vm=full("volume", 20), intraday_intensity="(2 * close - high - low) / (high - low + 1e-10) * volume")
_f2 = stage("f2", "f1", volume_delta="buying_pressure - selling_pressure", pvt=f"sum(pv) {over('all')}", ease_of_movement=f"(mid - {lag('mid')}) / nullif(volume / 1e6 / (rg + 1e-10), 0)", vpci=f"sign(cm - {lag('cm')}) * sign(vm - {lag('vm')})", ii_cumsum=full("intraday_intensity", 20, "sum"))
_f3 = stage("f3", "f2", cum_volume_delta=f"sum(volume_delta) {over('all')}", pvt_signal=full("pvt", 20), eom_ma=full("ease_of_movement", 14), **{f"volume_delta_ma_{n}": full("volume_delta", n) for n in (5, 10, 20)})
_f4 = stage("f4", "f3", ease_of_movement_m="ease_of_movement / 1e6", eom_ma_m="eom_ma / 1e6", **{f"volume_delta_divergence_{n}": f"volume_delta - volume_delta_ma_{n}" for n in (5, 10, 20)})


# movement by volume is shown in millions
_FLOW = [f"{x}_m" if x in ("ease_of_movement", "eom_ma") else x for x in S.FLOW]


@register("order_flow", sql([_f1, _f2, _f3, _f4], _FLOW, "f4", 5))
def order_flow(spark: SparkSession, d: str) -> DataFrame:
    b = S.flow(based(spark, d))
    return shown(b.withColumns({f"{x}_m": F.col(x) / 1e6 for x in ("ease_of_movement", "eom_ma")}), _FLOW, 5)


_k1 = stage("k1", "base", is_resistance=f"CAST(coalesce(high > max(high) {over(-5, -1)} AND high > max(high) {over(1, 5)}, false) AS INTEGER)", is_support=f"CAST(coalesce(low < min(low) {over(-5, -1)} AND low < min(low) {over(1, 5)}, false) AS INTEGER)", ph=lag("high"), pl=lag("low"), pivot=f"({lag('high')} + {lag('low')} + {lag('close')}) / 3", lo=full("low", 20, "min"), hi=full("high", 20, "max"))
_k2 = stage("k2", "k1", is_resistance_confirmed=f"coalesce({lag('is_resistance', 5)}, 0)", is_support_confirmed=f"coalesce({lag('is_support', 5)}, 0)", lr=f"last_value(CASE WHEN is_resistance = 1 THEN high END IGNORE NULLS) {over('all')}", ls=f"last_value(CASE WHEN is_support = 1 THEN low END IGNORE NULLS) {over('all')}", r1="2 * \"pivot\" - pl", s1="2 * \"pivot\" - ph", r2='"pivot" + ph - pl', s2='"pivot" - ph + pl', price_position="(close - lo) / (hi - lo + 1e-10)")
_k3 = stage("k3", "k2", **{k: f"({v}) / nullif(close, 0)" for k, v in {"dist_to_resistance": "lr - close", "dist_to_support": "close - ls", "dist_to_pivot": 'close - "pivot"', "dist_to_r1": "r1 - close", "dist_to_s1": "close - s1"}.items()})


@register("levels_pivots", sql([_k1, _k2, _k3], S.LEVELS, "k3", ints=tuple(x for x in S.LEVELS if x.startswith("is_"))))
def levels_pivots(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.levels(based(spark, d)), S.LEVELS)


_erf = "0.254829592 + t{0} * (-0.284496736 + t{0} * (1.421413741 + t{0} * (-1.453152027 + t{0} * 1.061405429)))"
_z1 = stage("z1", "base", d="close - last", gain="greatest(coalesce(close - last, 0), 0)", loss="greatest(coalesce(last - close, 0), 0)", **{f"zscore_{n}": f"(close - ({full('close', n)})) / (({full('close', n, 'stddev_samp')}) + 1e-10)" for n in (10, 20, 50, 100)})
_z2 = stage("z2", "z1", **{f"t{n}": f"1 / (1 + 0.3275911::DOUBLE * abs(zscore_{n}) / sqrt(2))" for n in (10, 20, 50, 100)}, rsi_14=f"100 - 100 / (1 + ({full('gain', 14)}) / (({full('loss', 14)}) + 1e-10))", extreme_move=f"coalesce(abs(r) > 2 * ({full('r', 50, 'stddev_samp')}), false)", **{f"ou_theta_{n}": f"CASE WHEN count(d) {over(-n, -1)} >= 10 THEN coalesce(-regr_slope(d, last) {over(-n, -1)}, 0) ELSE 0.0::DOUBLE END" for n in (50, 100)})
_z3 = stage("z3", "z2", **{f"mr_probability_{n}": f"1 - (2 - t{n} * ({_erf.format(n)}) * exp(-zscore_{n} * zscore_{n} / 2)) / 2" for n in (10, 20, 50, 100)}, bearish_divergence=f"coalesce(close = ({full('close', 20, 'max')}) AND rsi_14 < ({full('rsi_14', 20, 'max')}), false)", bullish_divergence=f"coalesce(close = ({full('close', 20, 'min')}) AND rsi_14 > ({full('rsi_14', 20, 'min')}), false)")


@register("mean_reversion", sql([_z1, _z2, _z3], S.REVERSION, "z3", 5, ints=("bearish_divergence", "bullish_divergence", "extreme_move")))
def mean_reversion(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.reversion(based(spark, d)), S.REVERSION, 5)


_w1 = stage("w1", "base", pos="CAST(coalesce(r > 0, false) AS DOUBLE)", hi=full("close", 252, "max"), lo=full("close", 252, "min"), momentum_12_1=f"{lag('close', 21)} / nullif({lag('close', 252)}, 0) - 1", momentum_6m=f"close / nullif({lag('close', 126)}, 0) - 1", momentum_1m=f"close / nullif({lag('close', 21)}, 0) - 1", **{f"ts_momentum_{n}": f"close / nullif({full('close', n)}, 0) - 1" for n in (20, 50, 100, 200)}, momentum_breadth="(" + " + ".join(f"CAST(coalesce(close > ({full('close', n)}), false) AS INTEGER)" for n in (20, 50, 100, 200)) + ") / 4.0::DOUBLE")
_w2 = stage("w2", "w1", momentum_acceleration=f"momentum_1m - {lag('momentum_1m')}", pct_from_52w_high="(close - hi) / nullif(hi, 0)", pct_from_52w_low="(close - lo) / nullif(lo, 0)", **{f"momentum_quality_{n}": full("pos", n) for n in (20, 50)})


@register("momentum_factors", sql([_w1, _w2], S.FACTORS, "w2"))
def momentum_factors(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.factors(based(spark, d)), S.FACTORS)


_t1 = stage("t1", "base", pk="pow(ln(high / nullif(low, 0)), 2)", gk="0.5 * pow(ln(high / nullif(low, 0)), 2) - (2 * ln(2) - 1) * pow(ln(close / nullif(open, 0)), 2)", v5=full("r", 5, "stddev_samp"), v20=full("r", 20, "stddev_samp"), v60=full("r", 60, "stddev_samp"), sg="sign(r)")
_t2 = stage("t2", "t1", parkinson_volatility=f"sqrt(({full('pk', 20)}) / (4 * ln(2)))", gkm=full("gk", 20), vol_of_vol=full("v20", 20, "stddev_samp"), vol_term_5_20="v5 / (v20 + 1e-10)", vol_term_20_60="v20 / (v60 + 1e-10)", vz=f"(v20 - ({full('v20', 50)})) / (({full('v20', 50, 'stddev_samp')}) + 1e-10)", side="CASE WHEN count(r) OVER (PARTITION BY symbol, sg ORDER BY ts ROWS 19 PRECEDING) = 20 THEN stddev_samp(r) OVER (PARTITION BY symbol, sg ORDER BY ts ROWS 19 PRECEDING) END")
_t3 = stage("t3", "t2", gk_volatility="CASE WHEN gkm >= 0 THEN sqrt(gkm) END", vol_skew=f"last_value(CASE WHEN sg = 1 THEN side END IGNORE NULLS) {over('all')} - last_value(CASE WHEN sg = -1 THEN side END IGNORE NULLS) {over('all')}", vol_persistence=f"({full('v20', 5)}) / (({full('v20', 50)}) + 1e-10)", vol_jump="coalesce(vz > 2, false)")


@register("volatility_estimators", sql([_t1, _t2, _t3], S.VOLATILITIES, "t3", ints=("vol_jump",)))
def volatility_estimators(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.volatilities(based(spark, d)), S.VOLATILITIES)


_p1 = stage("p1", "base", rv=f"({full('r', 20, 'stddev_samp')}) * sqrt(252)", down=f"CAST(coalesce(r < 0 AND volume > ({full('volume', 20)}), false) AS DOUBLE)", neg="coalesce(least(r, 0), 0)", pos="coalesce(greatest(r, 0), 0)", v20=full("r", 20, "stddev_samp"), vm20=full("volume", 20), tv="tp * volume", v60=full("r", 60, "stddev_samp"), dd=f"close / max(close) {over('all')} - 1", economic_proxy=f"close / nullif({lag('close', 60)}, 0) - 1")
_p2 = stage("p2", "p1", iv_proxy=full("rv", 252, "quantile_cont").replace("quantile_cont(rv)", "quantile_cont(rv, 0.75)"), put_call_proxy=full("down", 10), skew_proxy=f"({full('neg', 20, 'stddev_samp')}) / (({full('pos', 20, 'stddev_samp')}) + 1e-10)", max_pain_proxy=ratio(full("tv", 20, "sum"), full("volume", 20, "sum")), credit_stress_proxy=f"-({full('dd', 20, 'min')})", liquidity_proxy="vm20 / (v20 * close + 1e-10)", ep="CAST(coalesce(economic_proxy < 0, false) AS DOUBLE)")
_p3 = stage("p3", "p2", vol_risk_premium="iv_proxy / (rv + 1e-10)", dist_to_max_pain="(close - max_pain_proxy) / nullif(close, 0)", recession_proxy=full("ep", 3))


@register("macro_option_proxies", sql([_p1, _p2, _p3, *ranked("p4", "p3", "inflation_proxy", "v60", 252, 100.0)], S.PROXIES, "p4b"))
def macro_option_proxies(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.proxies(based(spark, d)), S.PROXIES)


# ---------------------------------------------------------------- recursive indicators and candles
from tidemill.operators import candles as K  # noqa: E402
from tidemill.operators import recursive as R  # noqa: E402


def _recursive_sql() -> str:
    """Exponential means, MACD, Wilder's RSI and ATR by a recursive query over the bars of each symbol."""
    seeds = stage("seeds", "base", g="greatest(close - last, 0)", lo="greatest(last - close, 0)", t="CASE WHEN last IS NOT NULL THEN tr END")
    means = stage("means", "seeds", **{f"m{n}": full("close", n) for n in (5, 10, 12, 20, 26, 50, 100)}, **{f"g{n}": full("g", n) for n in (7, 14, 21)}, **{f"l{n}": full("lo", n) for n in (7, 14, 21)}, **{f"t{n}": full("t", n) for n in (7, 14, 21)})
    cols, first, step = [], [], []
    for n in (5, 10, 20, 50, 100):
        cols.append(f"ema_{n}")
        first.append("NULL::DOUBLE")
        step.append(f"CASE WHEN b.seq = {n} THEN b.m{n} ELSE s.ema_{n} + (b.close - s.ema_{n}) * 2 / {n + 1}.0::DOUBLE END")
    for n, name in ((12, "fast"), (26, "slow")):
        cols.append(name)
        first.append("NULL::DOUBLE")
        step.append(f"CASE WHEN b.seq = 26 THEN b.m{n} ELSE s.{name} + (b.close - s.{name}) * 2 / {n + 1}.0::DOUBLE END")
    for k in (7, 14, 21):
        for x in ("g", "l", "t"):
            cols.append(f"w{x}{k}")
            first.append("NULL::DOUBLE")
            step.append(f"CASE WHEN b.seq = {k + 1} THEN b.{x}{k} ELSE (s.w{x}{k} * {k - 1} + b.{'lo' if x == 'l' else x}) / {k} END")
    scan = f"scan AS (SELECT symbol, ts, seq, close, {', '.join(f'{v} AS {k}' for k, v in zip(cols, first, strict=True))} FROM means WHERE seq = 1 UNION ALL SELECT b.symbol, b.ts, b.seq, b.close, {', '.join(step)} FROM scan s JOIN means b ON b.symbol = s.symbol AND b.seq = s.seq + 1)"
    shown_ = [f"ema_{n}" for n in (5, 10, 20, 50, 100)] + ["macd", "rsi", "rsi_7", "rsi_21", "cmo", "atr", "atr_7", "atr_21", "natr"]
    out = "out AS (SELECT *, fast - slow AS macd, 100 * wg14 / nullif(wg14 + wl14, 0) AS rsi, 100 * wg7 / nullif(wg7 + wl7, 0) AS rsi_7, 100 * wg21 / nullif(wg21 + wl21, 0) AS rsi_21, 100 * (wg14 - wl14) / nullif(wg14 + wl14, 0) AS cmo, wt14 AS atr, wt7 AS atr_7, wt21 AS atr_21, 100 * wt14 / close AS natr FROM scan)"
    return sql([seeds, means, scan, out], shown_, "out", 5).replace("WITH ", "WITH RECURSIVE ", 1)


RECURSIVE_SHOWN = [f"ema_{n}" for n in (5, 10, 20, 50, 100)] + ["macd", "rsi", "rsi_7", "rsi_21", "cmo", "atr", "atr_7", "atr_21", "natr"]


@register("recursive_core", _recursive_sql())
def recursive_core(spark: SparkSession, d: str) -> DataFrame:
    return shown(R.recursive(B.brand_week(spark, d)), RECURSIVE_SHOWN, 5)


@register("recursive_all")
def recursive_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.recursive(B.brand_week(spark, d)))


_cp = stage("cp", "base", o1=lag("open"), h1=lag("high"), l1=lag("low"), c1=lag("close"), body="abs(close - open)", rng="high - low", up="high - greatest(open, close)", dn="least(open, close) - low")
_cm = stage("cm", "cp", mb=f"CASE WHEN count(body) {over(-10, -1)} = 10 THEN avg(body) {over(-10, -1)} END", mr=f"CASE WHEN count(rng) {over(-10, -1)} = 10 THEN avg(rng) {over(-10, -1)} END")
_cm2 = stage("cm2", "cm", mb1=lag("mb"), mr1=lag("mr"), body1=lag("body"))


def _pick(bull: str | None, bear: str | None = None) -> str:
    out = "CASE"
    for cond, v in ((bull, 100), (bear, -100)):
        out += f" WHEN coalesce({cond}, false) THEN {v}" if cond else ""
    return out + " ELSE 0 END"


_CANDLE_SQL = {
    "cdl_doji": _pick("body <= 0.1 * mr"),
    "cdl_marubozu": _pick("close >= open AND body > mb AND up < 0.1 * mr AND dn < 0.1 * mr", "close < open AND body > mb AND up < 0.1 * mr AND dn < 0.1 * mr"),
    "cdl_spinningtop": _pick("close >= open AND body < mb AND up > body AND dn > body", "close < open AND body < mb AND up > body AND dn > body"),
    "cdl_longline": _pick("close >= open AND body > mb AND up < body / 2 AND dn < body / 2", "close < open AND body > mb AND up < body / 2 AND dn < body / 2"),
    "cdl_engulfing": _pick("close >= open AND c1 < o1 AND close >= o1 AND open <= c1 AND body > body1", "close < open AND c1 >= o1 AND open >= c1 AND close <= o1 AND body > body1"),
    "cdl_harami": _pick("body1 > mb1 AND c1 < o1 AND body < mb AND greatest(open, close) < o1 AND least(open, close) > c1", "body1 > mb1 AND c1 >= o1 AND body < mb AND greatest(open, close) < c1 AND least(open, close) > o1"),
    "cdl_matchinglow": _pick("c1 < o1 AND close < open AND abs(close - c1) <= 0.05 * mr1"),
    "cdl_piercing": _pick("body1 > mb1 AND body > mb AND c1 < o1 AND close >= open AND open < l1 AND close < o1 AND close > c1 + body1 / 2"),
}


@register("candles_core", sql([_cp, _cm, _cm2, stage("cc", "cm2", **_CANDLE_SQL)], list(_CANDLE_SQL), "cc", ints=tuple(_CANDLE_SQL)))
def candles_core(spark: SparkSession, d: str) -> DataFrame:
    return K.candles(B.brand_week(spark, d)).select("symbol", "ts", *_CANDLE_SQL)


@register("candles_all")
def candles_all(spark: SparkSession, d: str) -> DataFrame:
    return K.candles(B.brand_week(spark, d))


# ---------------------------------------------------------------- cleaning
from tidemill.operators import cleaning as C  # noqa: E402
from tidemill.operators import joins as J  # noqa: E402
from tidemill.operators import signals as G  # noqa: E402


def holed(spark: SparkSession, d: str) -> DataFrame:
    """The brand bars with gaps: every seventh and eleventh close is missing."""
    b = based(spark, d)
    return b.select("symbol", "ts", "seq", F.when((F.col("seq") % 7 != 0) & (F.col("seq") % 11 != 0) & (F.col("seq") > 2), F.col("close")).alias("close"))


HOLED = f"{BASE}, holed AS (SELECT symbol, ts, seq, CASE WHEN seq % 7 <> 0 AND seq % 11 <> 0 AND seq > 2 THEN close END AS close FROM base)"
_after = f"OVER ({ROW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_g1 = stage("g1", "holed", f=f"last_value(close IGNORE NULLS) {over('all')}", n=f"first_value(close IGNORE NULLS) {_after}", sp=f"last_value(CASE WHEN close IS NOT NULL THEN seq END IGNORE NULLS) {over('all')}", sn=f"first_value(CASE WHEN close IS NOT NULL THEN seq END IGNORE NULLS) {_after}", mn="avg(close) OVER (PARTITION BY symbol)", md="median(close) OVER (PARTITION BY symbol)")
_g2 = stage("g2", "g1", ffill="coalesce(f, n)", bfill="coalesce(n, f)", interpolate="coalesce(close, f + (n - f) * (seq - sp) / nullif(sn - sp, 0), n, f)", mean="coalesce(close, mn)", median="coalesce(close, md)", zero="coalesce(close, 0)")
_FILLS = ["ffill", "bfill", "interpolate", "mean", "median", "zero"]


@register("fill_methods", sql([_g1, _g2], _FILLS, "g2", head=HOLED))
def fill_methods(spark: SparkSession, d: str) -> DataFrame:
    b = holed(spark, d).withColumn("_seq", F.col("seq"))
    return shown(b.withColumns({m: C.filled("close", m) for m in _FILLS}), _FILLS)


_o1 = stage("o1", "base", m="avg(close) OVER (PARTITION BY symbol)", s="stddev_pop(close) OVER (PARTITION BY symbol)", q1="quantile_cont(close, 0.25) OVER (PARTITION BY symbol)", q3="quantile_cont(close, 0.75) OVER (PARTITION BY symbol)", md="median(close) OVER (PARTITION BY symbol)")
_o2 = stage("o2", "o1", mad="median(abs(close - md)) OVER (PARTITION BY symbol)")
_o3 = stage("o3", "o2", zscore="coalesce(abs((close - m) / nullif(s, 0)) > 3, false)", iqr="coalesce(close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1), false)", mad_="coalesce(abs(0.6745 * (close - md) / nullif(mad, 0)) > 3, false)")


@register("outlier_marks", f"WITH {BASE}, {_o1}, {_o2}, {_o3} SELECT symbol, ts, CAST(zscore AS INTEGER) AS zscore, CAST(iqr AS INTEGER) AS iqr, CAST(mad_ AS INTEGER) AS mad FROM o3")
def outlier_marks(spark: SparkSession, d: str) -> DataFrame:
    b = based(spark, d).select("symbol", "ts", "close")
    for method, k in (("zscore", 3.0), ("iqr", 1.5), ("mad", 3.0)):
        b = C.outlier_marks(b, ["close"], method, k).withColumn(method, F.col("close_outlier").cast("int")).drop("close_outlier")
    return b.drop("close")


_b1 = stage("b1", "bars", hi="greatest(high, low)", lo="least(high, low)")
_b2 = stage("b2", "b1", o="least(greatest(open, lo), hi)", cl="least(greatest(close, lo), hi)")
_z = lambda x: f"CASE WHEN abs(({x} - avg({x}) OVER (PARTITION BY symbol)) / nullif(stddev_pop({x}) OVER (PARTITION BY symbol), 0)) > 5 THEN NULL ELSE {x} END"
_b3 = f"b3 AS (SELECT symbol, ts, volume, {_z('o')} AS o, {_z('hi')} AS h, {_z('lo')} AS l, {_z('cl')} AS c FROM b2)"
_b4 = stage("b4", "b3", **{k: f"last_value({v} IGNORE NULLS) {over('all')}" for k, v in {"open": "o", "high": "h", "low": "l", "close": "c"}.items()})


@register("clean_bars", sql([_b1, _b2, _b3, _b4], ["open", "high", "low", "close", "volume"], "b4", head=BRAND))
def clean_bars(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.clean_bars(B.brand_week(spark, d)), ["open", "high", "low", "close", "volume"])


@register("target_returns", f"WITH {BASE} SELECT symbol, ts, round(ln(close / nullif(last, 0)) + {NUDGE}, 6) AS returns, CAST(lead(close) OVER ({ROW}) > close AS INTEGER) AS target FROM base")
def target_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.target(C.returns(B.brand_week(spark, d))).select("symbol", "ts", "returns", "target"))


# ---------------------------------------------------------------- joins
_EVENTS = "bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"


@register("align_inner", f"WITH {_EVENTS}, k AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)) SELECT symbol, ts, close FROM bars JOIN k USING (ts)")
def align_inner(spark: SparkSession, d: str) -> DataFrame:
    return J.align(B.event_hour(spark, d)).select("symbol", "ts", "close")


@register("align_outer", f"WITH {_EVENTS} SELECT s.symbol, t.ts, b.close FROM (SELECT DISTINCT ts FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts")
def align_outer(spark: SparkSession, d: str) -> DataFrame:
    return J.align(B.event_hour(spark, d), "outer").select("symbol", "ts", "close")


@register("asof_orders", "SELECT l.event_id, o.o_orderkey FROM (SELECT *, user_id % 50 AS k FROM events) l ASOF LEFT JOIN (SELECT o_custkey % 50 AS k, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON l.k = o.k AND l.ts >= o.o_orderdate")
def asof_orders(spark: SparkSession, d: str) -> DataFrame:
    events = B.load(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("k"))
    orders = B.load(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return J.asof(events, orders, ["k"], "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


MKT = "Brand#11"
_j0 = f"{BASE}, ref AS (SELECT ts, close AS x FROM bars WHERE symbol = (SELECT min(symbol) FROM bars)), j0 AS (SELECT base.*, x FROM base LEFT JOIN ref USING (ts))"
_j1 = stage("j1", "j0", mkt=f"last_value(x IGNORE NULLS) {over('all')}")
_j2 = stage("j2", "j1", mr=f"mkt / nullif({lag('mkt')}, 0) - 1", rel="close / nullif(mkt, 0)")
_j3 = stage("j3", "j2", a="CASE WHEN r IS NOT NULL AND mr IS NOT NULL THEN r END", b="CASE WHEN r IS NOT NULL AND mr IS NOT NULL THEN mr END")
_j4 = stage("j4", "j3", **{f"beta_{n}": f"CASE WHEN count(a) {over(1 - n)} = {n} THEN covar_samp(a, b) {over(1 - n)} / (var_samp(b) {over(1 - n)} + 1e-10) END" for n in (20, 60)}, relative_strength="rel", rs_momentum=f"rel / nullif({lag('rel', 20)}, 0) - 1", market_correlation=f"CASE WHEN count(a) {over(-19)} = 20 THEN corr(a, b) {over(-19)} END")
_j5 = stage("j5", "j4", alpha_60=f"({full('a', 60)}) - beta_60 * ({full('b', 60)})")


@register("market_features", sql([_j1, _j2, _j3, _j4, _j5, *ranked("j6", "j5", "market_percentile", "mkt", 100)], J.MARKET, "j6b", head=_j0))
def market_features(spark: SparkSession, d: str) -> DataFrame:
    bars = B.brand_week(spark, d)
    first = bars.agg(F.min("symbol")).first()[0]
    return shown(J.market_features(bars, bars, first), J.MARKET)


@register("symbol_correlations", f"WITH {BASE}, x AS (SELECT symbol, ts, r FROM base WHERE r IS NOT NULL) SELECT a.symbol AS a, b.symbol AS b, round(corr(a.r, b.r) + {NUDGE}, 6) AS corr, count(*) AS n, corr(a.r, b.r) > 0.7 AS above FROM x a JOIN x b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2")
def symbol_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.correlations(B.brand_week(spark, d)))


TYPES = ["click", "error", "purchase", "signup", "view"]


@register("pivot_closes", f"WITH {_EVENTS} SELECT ts, " + ", ".join(f"max(close) FILTER (WHERE symbol = '{x}') AS {x}" for x in TYPES) + " FROM bars GROUP BY ts")
def pivot_closes(spark: SparkSession, d: str) -> DataFrame:
    return J.pivot_panel(B.event_hour(spark, d), "close", TYPES)


# ---------------------------------------------------------------- signals
_sg = [_dm, _dm2, _dm3, _dm4, _dm5, _dm6, _m1.replace("FROM base", "FROM d6"), _m2, _m3.replace("m2", "m2", 1), _m4, stage("x1", "m4", ss=full("close", 20, "stddev_samp"), vr=ratio("volume", full("volume", 20)), atr_sma=full("tr", 14), lo20=f"min(low) {over(-19)}", hi20=f"max(high) {over(-19)}"), stage("x2", "x1", bbp="(close - sma_20 + 2 * ss) / nullif(4 * ss, 0)")]


def _ew(x: str, k: int) -> str:
    """Exponentially weighted mean of a list, by its weights."""
    keep = f"pow({k - 1} / {k + 1}.0::DOUBLE, len({x}) - i)"
    return f"(list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {keep})) / list_sum(list_transform(range(1, len({x}) + 1), lambda i: {keep})))"


def _signal_stages(trend: bool = False, volume: bool = False) -> list[str]:
    score = "CASE WHEN adx_sma > 25 THEN CASE WHEN plus_di_sma > minus_di_sma THEN 1 ELSE -1 END ELSE 0 END * 0.1::DOUBLE + CASE WHEN rsi_sma < 30 THEN 0.1::DOUBLE WHEN rsi_sma > 70 THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN macd_hist > 0 THEN 0.05::DOUBLE WHEN macd_hist < 0 THEN -0.05::DOUBLE ELSE 0 END + CASE WHEN bbp < 0.1 THEN 0.1::DOUBLE WHEN bbp > 0.9 THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN sma_20 > sma_50 THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END"
    level = "CASE WHEN round(confidence, 9) < 0.25 THEN 0 WHEN combined >= 0.58 THEN 2 WHEN combined >= 0.52 THEN 1 WHEN combined <= 0.42 THEN -2 WHEN combined <= 0.48 THEN -1 ELSE 0 END"
    if trend:
        level = f"CASE WHEN adx_sma < 20 THEN 0 WHEN coalesce(sma_20 > sma_50, false) THEN greatest({level}, 0) ELSE least({level}, 0) END"
    if volume:
        level = f"CASE WHEN vr > 0.8 THEN {level} ELSE greatest(least({level}, 1), -1) END"
    return [
        stage("n1", "x2", closes=f"list(close) {over('all')}"), stage("n2", "n1", macd=f"{_ew('closes', 12)} - {_ew('closes', 26)}"), stage("n3", "n2", macds=f"list(macd) {over('all')}"), stage("n4", "n3", macd_hist=f"macd - {_ew('macds', 9)}"),
        stage("x3", "n4", s0=f"round(0.5::DOUBLE + {score}, 9)"),
        stage("x4", "x3", technical_score="round(least(greatest(s0 + CASE WHEN vr > 1.5 THEN 0.05::DOUBLE * sign(s0 - 0.5) ELSE 0 END, 0), 1), 9)"),
        stage("x4b", "x4", ml="coalesce(stoch_k / 100, 0.5)", mood="coalesce(least(greatest(10 * r, -1), 1), 0)"),
        stage("x5", "x4b", combined="0.5 * ml + 0.2::DOUBLE * (mood + 1) / 2 + 0.3::DOUBLE * technical_score", four="abs(ml - 0.5) * 2 + abs(mood) + abs(technical_score - 0.5) * 2 + abs(CASE WHEN ml > 0.5 THEN 1 ELSE -1 END + sign(mood) + CASE WHEN technical_score > 0.5 THEN 1 ELSE -1 END) / 3.0::DOUBLE"),
        stage("x6", "x5", confidence="CASE WHEN atr_sma IS NULL THEN four / 4 ELSE (four + greatest(0, 1 - 20 * atr_sma / nullif(close, 0))) / 5 END"),
        stage("x6b", "x6", signal_value=level),
        stage("x7", "x6b", stop_loss="CASE WHEN signal_value > 0 THEN greatest(close - 2 * atr_sma, lo20 * 0.99::DOUBLE) WHEN signal_value < 0 THEN least(close + 2 * atr_sma, hi20 * 1.01::DOUBLE) END", take_profit="CASE WHEN signal_value > 0 THEN close + 4 * atr_sma WHEN signal_value < 0 THEN close - 4 * atr_sma END"),
        "x8 AS (SELECT *, abs(take_profit - close) / nullif(abs(close - stop_loss), 0) AS risk_reward_ratio, CASE signal_value WHEN -2 THEN 'STRONG_SELL' WHEN -1 THEN 'SELL' WHEN 0 THEN 'HOLD' WHEN 1 THEN 'BUY' ELSE 'STRONG_BUY' END AS signal FROM x7 WHERE seq > 50)",
    ]


_inputs = _sg
_sg = [*_inputs, *_signal_stages()]
_SIGNALS = ["technical_score", "combined", "confidence", "signal_value", "stop_loss", "take_profit", "risk_reward_ratio"]


def judged(panel: DataFrame) -> DataFrame:
    """The prepared panel with scores; the stochastic stands for a model's probability and the last return for the news."""
    b = panel.withColumns({"ml_probability": F.col("stoch_k") / 100, "sentiment": F.least(F.greatest(10 * F.col("r"), F.lit(-1.0)), F.lit(1.0))})
    return G.scored(b)


def signalled(spark: SparkSession, d: str) -> DataFrame:
    return G.levelled(judged(G.prepared(based(spark, d))))


@register("signals", sql(_sg, _SIGNALS, "x8", 5, ints=("signal_value",)))
def signals(spark: SparkSession, d: str) -> DataFrame:
    return shown(signalled(spark, d), _SIGNALS, 5)


@register("confirmed_signals", sql([*_inputs, *_signal_stages(True, True)], _SIGNALS, "x8", 5, ints=("signal_value",)))
def confirmed_signals(spark: SparkSession, d: str) -> DataFrame:
    return shown(G.levelled(judged(G.prepared(based(spark, d))), G.SignalConfig(confirm_trend=True, confirm_volume=True)), _SIGNALS, 5)


_head = f"WITH {', '.join([BASE, *_sg])}"
_counts = "count(*) AS total, count(*) FILTER (WHERE signal_value > 0) AS buys, count(*) FILTER (WHERE signal_value < 0) AS sells, count(*) FILTER (WHERE signal_value = 0) AS holds, count(*) FILTER (WHERE abs(signal_value) = 2) AS strong"


@register("signal_summary", f"{_head} SELECT symbol, {_counts}, round(avg(confidence) + {NUDGE}, 6) AS avg_confidence, round(avg(ml) + {NUDGE}, 6) AS avg_ml_probability, round(avg(mood) + {NUDGE}, 6) AS avg_sentiment, round(100.0 * count(*) FILTER (WHERE signal_value = 0) / count(*) + {NUDGE}, 6) AS hold_pct, count(*) FILTER (WHERE confidence > 0.7) AS high_confidence, round(avg(combined) + {NUDGE}, 6) AS avg_combined, round(avg(technical_score) + {NUDGE}, 6) AS avg_technical, round(avg(risk_reward_ratio) + {NUDGE}, 6) AS avg_risk_reward, round(100.0 * count(*) FILTER (WHERE signal_value > 0) / count(*) + {NUDGE}, 6) AS buy_pct, round(100.0 * count(*) FILTER (WHERE signal_value < 0) / count(*) + {NUDGE}, 6) AS sell_pct FROM x8 GROUP BY symbol")
def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.summary(signalled(spark, d)))


@register("signal_distribution", f"{_head} SELECT signal, count(*) AS n FROM x8 GROUP BY signal")
def signal_distribution(spark: SparkSession, d: str) -> DataFrame:
    return G.distribution(signalled(spark, d))


@register("latest_signal", f"{_head} SELECT symbol, ts, signal, CAST(signal_value AS INTEGER) AS signal_value, round(close + {NUDGE}, 6) AS close FROM x8 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def latest_signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.latest(signalled(spark, d).select("symbol", "ts", "signal", "signal_value", "close")))


_hold = """, hits AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i FROM x8 WHERE signal_value <> 0),
  walk AS (SELECT symbol, seq, i, seq AS last, true AS kept FROM hits WHERE i = 1 UNION ALL SELECT h.symbol, h.seq, h.i, CASE WHEN h.seq - w.last >= 5 THEN h.seq ELSE w.last END, h.seq - w.last >= 5 FROM walk w JOIN hits h ON h.symbol = w.symbol AND h.i = w.i + 1)"""


@register("minimum_hold", f"{_head.replace('WITH ', 'WITH RECURSIVE ', 1)}{_hold} SELECT x8.symbol, x8.ts, CAST(CASE WHEN walk.kept THEN signal_value ELSE 0 END AS INTEGER) AS signal_value FROM x8 LEFT JOIN walk ON walk.symbol = x8.symbol AND walk.seq = x8.seq")
def minimum_hold(spark: SparkSession, d: str) -> DataFrame:
    return G.minimum_hold(signalled(spark, d), 5, "signal_value").select("symbol", "ts", "signal_value")


# ---------------------------------------------------------------- positions and performance
from tidemill.operators import backtest as P  # noqa: E402

_pa = "pa AS (SELECT symbol, ts, seq, close, sign(signal_value) AS s, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r2 FROM x8)"
_pb = f"pb AS (SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) {over('all')}, 0) AS position FROM pa)"
_pc = f"pc AS (SELECT *, coalesce({lag('position')}, 0) AS before FROM pb)"
_pd = "pd AS (SELECT *, CAST(position <> before AS INTEGER) AS entry, greatest(coalesce(before * r2, 0), -0.99::DOUBLE) AS strategy_return FROM pc)"
_pe = f"pe AS (SELECT *, 100000 * exp(sum(ln(1 + strategy_return)) {over('all')}) AS equity FROM pd)"
_pf = f"pf AS (SELECT *, equity / max(equity) {over('all')} - 1 AS drawdown FROM pe)"
_PATH = f"{_head}, {_pa}, {_pb}, {_pc}, {_pd}, {_pe}, {_pf}"


def pathed(spark: SparkSession, d: str) -> DataFrame:
    return P.with_equity(P.position_path(signalled(spark, d).select("symbol", "ts", "seq", "close", "signal_value")))


@register("position_path", f"{_PATH} SELECT symbol, ts, CAST(position AS INTEGER) AS position, entry, round(strategy_return + {NUDGE}, 6) AS strategy_return, round(equity + {NUDGE}, 3) AS equity, round(drawdown + {NUDGE}, 6) AS drawdown FROM pf")
def position_path(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pathed(spark, d).select("symbol", "ts", "position", "entry", "strategy_return", F.round(F.col("equity") + NUDGE, 3).alias("equity"), "drawdown"))


def _r(x: str, name: str, digits: int = 5) -> str:
    return f"round({x} + {NUDGE}, {digits}) AS {name}"


# the first bar has no return; a ratio without deviation is 0
_SHARPE = "CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(252) ELSE 0 END"
_SORTINO = "CASE WHEN stddev_samp({0}) FILTER (WHERE {0} < 0) > 0 THEN avg({0}) / stddev_samp({0}) FILTER (WHERE {0} < 0) * sqrt(252) ELSE 0 END"


@register("performance", f"""{_PATH},
  isl AS (SELECT symbol, ts, equity, drawdown, CASE WHEN lag(ts) OVER ({ROW}) IS NOT NULL THEN strategy_return END AS sr, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) {over('all')} AS i FROM pf),
  lg AS (SELECT symbol, max(n) AS n FROM (SELECT symbol, i, count(*) AS n FROM isl WHERE drawdown < 0 GROUP BY 1, 2) GROUP BY 1),
  ag AS (SELECT symbol, count(*) AS bars, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS tr, {_SHARPE.format('sr')} AS sharpe, {_SORTINO.format('sr')} AS sortino, stddev_samp(sr) AS sd, min(drawdown) AS dd FROM isl GROUP BY symbol)
  SELECT ag.symbol, bars, {_r('tr', 'total_return')}, {_r('sharpe', 'sharpe')}, {_r('sortino', 'sortino')}, {_r('dd', 'max_drawdown')}, {_r('sd * sqrt(252)', 'volatility')},
    CAST(coalesce(n, 0) AS BIGINT) AS max_drawdown_bars, {_r('tr * 252 / bars', 'annual_return')}, {_r('tr * 252 / bars / nullif(abs(dd), 0)', 'calmar')} FROM ag LEFT JOIN lg ON lg.symbol = ag.symbol""")
def performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.performance(pathed(spark, d)), 5)


_tr = f"{_PATH}, mk AS (SELECT *, sum(entry) {over('all')} AS t, lead(close) OVER ({ROW}) AS nx, lead(ts) OVER ({ROW}) AS nts FROM pf), td AS (SELECT symbol, t, min(ts) AS entry_ts, max(coalesce(nts, ts)) AS exit_ts, arg_min(position, ts) * (arg_max(coalesce(nx, close), ts) - arg_min(close, ts)) AS pnl FROM mk WHERE position <> 0 GROUP BY symbol, t)"


@register("trade_stats", f"""{_tr},
  sm AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_ts) AS s FROM td),
  fa AS (SELECT *, greatest(max(s) OVER (PARTITION BY symbol ORDER BY entry_ts), 0) - s AS fall FROM sm),
  st AS (SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS won, count(*) FILTER (WHERE pnl < 0) AS lost,
    coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0) AS avg_loss, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS w, coalesce(abs(sum(pnl) FILTER (WHERE pnl < 0)), 1) AS l,
    avg(pnl) AS expectancy, coalesce(floor(avg(epoch(exit_ts) - epoch(entry_ts)) FILTER (WHERE pnl > 0) / 86400), 0) AS days, sum(pnl) / nullif(max(fall), 0) AS recovery FROM fa GROUP BY symbol)
  SELECT symbol, trades, won, lost, {_r('avg_win', 'avg_win', 4)}, {_r('avg_loss', 'avg_loss', 4)}, {_r('expectancy', 'expectancy', 4)}, {_r('won::DOUBLE / trades', 'win_rate', 4)}, {_r('w / l', 'profit_factor', 4)}, {_r('recovery', 'recovery_factor', 4)},
    CAST(days AS BIGINT) AS avg_win_days, {_r('won::DOUBLE / trades - (1 - won::DOUBLE / trades) / nullif(avg_win / nullif(abs(avg_loss), 0), 0)', 'kelly', 4)} FROM st""")
def trade_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.trade_stats(P.trades(pathed(spark, d))), 4)


@register("var_cvar", f"{_PATH}, vq AS (SELECT symbol, quantile_cont(strategy_return, 0.05) AS v, avg(strategy_return) - 1.645::DOUBLE * stddev_samp(strategy_return) AS vn FROM pf GROUP BY symbol) SELECT pf.symbol, {_r('any_value(v)', 'var95', 6)}, {_r('avg(CASE WHEN strategy_return <= v THEN strategy_return END)', 'cvar95', 6)}, {_r('any_value(vn)', 'var95_normal', 6)} FROM pf JOIN vq ON vq.symbol = pf.symbol GROUP BY pf.symbol")
def var_cvar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.var_cvar(pathed(spark, d)))


@register("monthly_returns", f"{_PATH} SELECT symbol, CAST(year(ts) AS INTEGER) AS year, " + ", ".join(f"round(exp(sum(ln(1 + strategy_return)) FILTER (WHERE month(ts) = {m})) - 1 + {NUDGE}, 6) AS m{m}" for m in range(1, 13)) + " FROM pf GROUP BY 1, 2")
def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    m = P.monthly(pathed(spark, d))
    return rounded(m.select("symbol", "year", *[F.col(str(k)).alias(f"m{k}") for k in range(1, 13)]))


_wf = f"{_PATH}, sq AS (SELECT symbol, ts, strategy_return, row_number() OVER ({ROW}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM pf), wn AS (SELECT sq.*, w.id AS window_id, CASE WHEN p >= w.id * 21 AND p < w.id * 21 + 126 THEN 'train' WHEN p >= w.id * 21 + 126 AND p < w.id * 21 + 168 THEN 'test' END AS split FROM sq JOIN (SELECT unnest(range(0, 1000)) AS id) w ON w.id * 21 + 168 <= n AND p >= w.id * 21 AND p < w.id * 21 + 168), wm AS (SELECT symbol, window_id, split, count(*) AS bars, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, exp(sum(ln(1 + strategy_return))) - 1 AS total_return, {_SHARPE.format('strategy_return')} AS sharpe FROM wn GROUP BY 1, 2, 3)"


def walked(spark: SparkSession, d: str) -> DataFrame:
    from tidemill.plans.windows import series

    p = pathed(spark, d).withColumn("seq", F.row_number().over(series()))
    return P.window_metrics(P.windows(p, 126, 42, 21))


@register("wf_windows", f"{_wf} SELECT symbol, CAST(window_id AS INTEGER) AS window_id, split, bars, first_day, last_day, {_r('total_return', 'total_return')}, {_r('sharpe', 'sharpe')} FROM wm")
def wf_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(walked(spark, d), 5)


@register("wf_summary", f"""{_wf},
  bo AS (SELECT symbol, window_id, max(total_return) FILTER (WHERE split = 'train') AS a, max(total_return) FILTER (WHERE split = 'test') AS b, max(sharpe) FILTER (WHERE split = 'test') AS sb, max(last_day - first_day) FILTER (WHERE split = 'test') AS days FROM wm GROUP BY 1, 2),
  su AS (SELECT symbol, count(*) AS windows, product(1 + b) - 1 AS total, greatest(sum(days) / 252, 1 / 252) AS years, coalesce(avg(CASE WHEN sb <> 0 THEN sb END), 0) AS sharpe, avg(CAST(b > 0 AS DOUBLE)) AS up,
    coalesce((avg(a) - avg(b)) / nullif(abs(avg(a)), 0), 0) AS over_ratio, CASE WHEN count(*) > 2 THEN coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) ELSE 0 END AS c FROM bo GROUP BY symbol)
  SELECT symbol, windows, {_r('total', 'total_return')}, {_r('sharpe', 'avg_sharpe')}, {_r('up', 'positive_windows')}, {_r('over_ratio', 'overfitting_ratio')}, {_r('c', 'train_test_corr')}, {_r('pow(1 + total, 1 / years) - 1', 'annual_return')} FROM su""")
def wf_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.walk_forward_summary(walked(spark, d)), 5)


_TRADES = f"{_tr}, tn AS (SELECT symbol, min(ts) AS entry_ts, row_number() OVER (PARTITION BY symbol ORDER BY min(ts)) AS i, count(*) OVER (PARTITION BY symbol) AS n, arg_min(position, ts) * (arg_max(coalesce(nx, close), ts) - arg_min(close, ts)) AS pnl FROM mk WHERE position <> 0 GROUP BY symbol, t)"
_drawn = lambda *x: "CAST('0x' || substr(md5(" + " || '|' || ".join(x) + "), 1, 8) AS BIGINT)"


@register("bootstrap", f"""{_TRADES},
  dr AS (SELECT symbol, sim, {_drawn('symbol', 'sim', 'i', '42')} % n + 1 AS j FROM tn, (SELECT unnest(range(1, 1001)) AS sim)),
  su AS (SELECT dr.symbol, sim, sum(pnl) AS total FROM dr JOIN tn ON tn.symbol = dr.symbol AND tn.i = dr.j GROUP BY 1, 2),
  og AS (SELECT symbol, sum(pnl) AS original, count(*) > 1 AS enough FROM tn GROUP BY 1),
  ci AS (SELECT symbol, avg(total) AS mean, stddev_pop(total) AS std, quantile_cont(total, 0.025) AS low, quantile_cont(total, 0.975) AS high, avg(CAST(total <= 0 AS DOUBLE)) AS under, avg(CAST(total >= 0 AS DOUBLE)) AS above FROM su GROUP BY symbol)
  SELECT symbol, {_r('CASE WHEN enough THEN original END', 'original', 3)}, {_r('CASE WHEN enough THEN mean END', 'mean', 3)}, {_r('CASE WHEN enough THEN std END', 'std', 3)}, {_r('CASE WHEN enough THEN low ELSE 0 END', 'low', 3)}, {_r('CASE WHEN enough THEN high ELSE 0 END', 'high', 3)},
    {_r('CASE WHEN NOT enough THEN 1 WHEN original > 0 THEN under ELSE above END', 'p_value', 3)}, enough AND (original > 0 AND low > 0 OR original < 0 AND high < 0) AS significant FROM ci JOIN og USING (symbol)""")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.bootstrap(P.trades(pathed(spark, d))), 3)


@register("shuffle_test", f"""{_TRADES},
  sm AS (SELECT symbol, sim, pnl, entry_ts, {_drawn('symbol', 'sim', 'CAST(epoch(entry_ts) AS BIGINT)', '42')} AS o FROM tn, (SELECT unnest(range(1, 501)) AS sim)),
  pk AS (SELECT symbol, sim, entry_ts, o, sum(pnl) OVER w AS s FROM sm WINDOW w AS (PARTITION BY symbol, sim ORDER BY o, entry_ts)),
  fa AS (SELECT symbol, sim, max((m - s) / greatest(m, 1)) AS fall FROM (SELECT *, max(s) OVER (PARTITION BY symbol, sim ORDER BY o, entry_ts) AS m FROM pk) GROUP BY 1, 2),
  ac AS (SELECT symbol, max((m - s) / greatest(m, 1)) AS actual, count(*) AS n FROM (SELECT *, max(s) OVER (PARTITION BY symbol ORDER BY entry_ts) AS m FROM (SELECT symbol, entry_ts, sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_ts) AS s FROM tn)) GROUP BY 1),
  bt AS (SELECT symbol, any_value(actual) AS actual, avg(fall) AS mean, any_value(n) AS n FROM fa JOIN ac USING (symbol) GROUP BY symbol),
  dp AS (SELECT *, CASE WHEN n > 1 THEN (actual - mean) / greatest(mean, 0.001) ELSE 0 END AS dependency FROM bt)
  SELECT symbol, {_r('actual', 'actual', 3)}, {_r('mean', 'avg_shuffled', 3)}, {_r('dependency', 'dependency', 3)}, abs(dependency) < 0.5 AS is_robust, 0.0::DOUBLE AS sharpe_std FROM dp""")
def shuffle_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.shuffle_test(P.trades(pathed(spark, d)), 500), 3)


# ---------------------------------------------------------------- text and alternative data
from tidemill.operators import text as X  # noqa: E402

def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Words of three to six letters that at least one document in a hundred holds: valence by length, odd lengths negative.

    Each row's own distinct words are counted, so that tasks hold a row a word, not one a document and word; only if ids repeat, words are told
    apart by id first. At most a hundred times the mean number of a document's words come out, whatever the number of documents: small enough
    to broadcast.
    """
    docs = B.load(spark, d, "documents")
    ids = docs.agg(F.count("*").alias("t"), F.countDistinct("doc_id").alias("d")).first()
    n = F.length("word")
    own = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}']+)"), 1)), lambda w: F.length(w).between(3, 6))
    w = docs.select("doc_id", F.explode(own).alias("word"))
    if ids["t"] != ids["d"]:
        w = w.where("doc_id is not null").distinct()
    common = w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") * 100 >= ids["t"])
    return F.broadcast(common.select("word", F.when(n % 2 == 0, n / 4.0).otherwise(-n / 4.0).alias("valence")))


_TOK = "tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}'']+') AS w FROM documents))"
_LEX = "lex AS (SELECT word, CASE WHEN length(word) % 2 = 0 THEN length(word) / 4.0::DOUBLE ELSE -length(word) / 4.0::DOUBLE END AS valence FROM (SELECT word, count(DISTINCT doc_id) AS n FROM tok WHERE length(word) BETWEEN 3 AND 6 GROUP BY word) WHERE n * 100 >= (SELECT count(*) FROM documents))"
_SCO = "ng AS (SELECT *, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos) IN ('not', 'no', 'never'), false) AS neg FROM tok), sc AS (SELECT d.doc_id, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS compound, coalesce(p, 0) AS polarity, coalesce(h, 0) AS hits FROM documents d LEFT JOIN (SELECT doc_id, sum(v) AS s, avg(v) AS p, count(*) AS h FROM (SELECT doc_id, CASE WHEN neg THEN valence * -0.74::DOUBLE ELSE valence END AS v FROM ng JOIN lex USING (word)) GROUP BY 1) x ON x.doc_id = d.doc_id)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return X.lexicon_scores(B.load(spark, d, "documents"), _lexicon(spark, d))


@register("doc_sentiment", f"WITH {_TOK}, {_LEX}, {_SCO} SELECT doc_id, round(compound + {NUDGE}, 6) AS compound, round(polarity + {NUDGE}, 6) AS polarity, hits FROM sc")
def doc_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scored(spark, d))


_NEWS = "nw AS (SELECT doc_id, doc_id % 5 AS symbol, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day, compound AS score, abs(compound) AS confidence FROM sc), nx AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY symbol, day) AS n FROM nw)"


@register("news_daily", f"WITH {_TOK}, {_LEX}, {_SCO}, {_NEWS}, ag AS (SELECT symbol, day, avg(score) AS mean, coalesce(sum(score * confidence) / nullif(sum(confidence), 0), avg(score)) AS weighted, median(score) AS median, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, count(*) FILTER (WHERE score > 0.15) AS bullish, count(*) FILTER (WHERE score < -0.15) AS bearish, count(*) FILTER (WHERE abs(score) <= 0.15) AS neutral, avg(confidence) AS avg_confidence, count(*) AS articles, coalesce(avg(score) FILTER (WHERE i > floor(n / 2)) - avg(score) FILTER (WHERE i <= floor(n / 2)), 0) AS momentum FROM nx GROUP BY symbol, day) SELECT symbol, day, " + ", ".join(f"round({x} + {NUDGE}, 6) AS {y}" for x, y in [(k, k) for k in ("mean", "weighted", "median", "std", "min", "max", "avg_confidence", "momentum")] + [("max - min", "range"), ("bullish::DOUBLE / articles", "bullish_ratio"), ("bearish::DOUBLE / articles", "bearish_ratio")]) + ", bullish, bearish, neutral, articles FROM ag")
def news_daily(spark: SparkSession, d: str) -> DataFrame:
    news = _scored(spark, d).select("doc_id", (F.col("doc_id") % 5).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"), F.col("compound").alias("score"), F.abs("compound").alias("confidence"))
    return rounded(X.daily_sentiment(news))


_STOP = "[" + ", ".join(f"'{x}'" for x in X.NOT_TICKERS) + "]"
_MEN = f"men AS (SELECT doc_id, source, length(text) AS score, unnest(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '\\$?[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '\\$[A-Z]{{1,5}}|[A-Z]{{2,5}}')), lambda t: ltrim(t, '$')), lambda x: NOT list_contains({_STOP}, x)))) AS symbol FROM documents)"


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    docs = B.load(spark, d, "documents").select("doc_id", "text", F.col("source").alias("community"), F.char_length("text").cast("long").alias("score"))
    return X.mentions(docs, keep=("doc_id", "community", "score"))


@register("ticker_mentions", f"WITH {_MEN} SELECT symbol, count(*) AS n, count(DISTINCT doc_id) AS docs FROM men GROUP BY symbol")
def ticker_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentioned(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@register("trending", f"WITH {_TOK}, {_LEX}, {_SCO}, {_MEN} SELECT symbol, count(*) AS mentions, CAST(sum(score) AS BIGINT) AS score, count(DISTINCT source) AS communities, round(avg(CAST(compound > 0.05 AS DOUBLE)) + {NUDGE}, 6) AS bullish_ratio, round(avg(compound) + {NUDGE}, 6) AS avg_sentiment, round(stddev_pop(compound) + {NUDGE}, 6) AS sentiment_std, round(count(*) * ln(1 + sum(score)) + {NUDGE}, 6) AS trend FROM men JOIN sc USING (doc_id) GROUP BY symbol HAVING count(*) >= 3 ORDER BY count(*) * ln(1 + sum(score)) DESC, symbol LIMIT 20")
def trending(spark: SparkSession, d: str) -> DataFrame:
    m = _mentioned(spark, d).join(_scored(spark, d).select("doc_id", F.col("compound").alias("sentiment")), "doc_id")
    return rounded(X.trending(m))


_BALANCE = "CASE WHEN {0} + {1} > 0 THEN ({0} - {1}) / ({0} + {1}) ELSE 0 END"


@register("insider_activity", f"""
  WITH t AS (SELECT o_custkey AS filer, CASE o_orderstatus WHEN 'F' THEN 'Buy' WHEN 'O' THEN 'Sell' ELSE 'Other' END AS kind, CAST(floor(o_totalprice / 100) AS BIGINT) AS shares, o_totalprice AS value, left(o_orderpriority, 1) IN ('1', '2') AS top FROM orders),
  a AS (SELECT filer, count(*) AS transactions, count(*) FILTER (WHERE kind = 'Buy') AS buys, count(*) FILTER (WHERE kind = 'Sell') AS sells,
    CAST(coalesce(sum(shares) FILTER (WHERE kind = 'Buy'), 0) AS BIGINT) AS bs, CAST(coalesce(sum(shares) FILTER (WHERE kind = 'Sell'), 0) AS BIGINT) AS ss, coalesce(sum(value) FILTER (WHERE kind = 'Buy'), 0) AS bv, coalesce(sum(value) FILTER (WHERE kind = 'Sell'), 0) AS sv,
    count(*) FILTER (WHERE top AND kind = 'Buy') AS executive_buys, count(*) FILTER (WHERE top AND kind = 'Sell') AS executive_sells FROM t GROUP BY filer)
  SELECT filer, transactions, buys, sells, bs AS buy_shares, ss AS sell_shares, bs - ss AS net_shares, executive_buys, executive_sells, {_r('bv', 'buy_value', 4)}, {_r('sv', 'sell_value', 4)}, {_r('bv - sv', 'net_value', 4)}, {_r(_BALANCE.format('bv', 'sv'), 'sentiment', 4)} FROM a""")
def insider_activity(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    tx = B.load(spark, d, "orders").select(F.col("o_custkey").alias("filer"), F.when(F.col("o_orderstatus") == "F", "Buy").when(F.col("o_orderstatus") == "O", "Sell").otherwise("Other").alias("kind"), F.floor(F.col("o_totalprice") / 100).alias("shares"), F.col("o_totalprice").alias("value"), F.when(p.startswith("1"), "CEO").when(p.startswith("2"), "CFO").otherwise("Director").alias("relation"))
    return rounded(X.insider_activity(tx), 4)


@register("holdings_change", "WITH h AS (SELECT o_custkey AS holder, o_custkey % 40 AS symbol, year(o_orderdate) AS y, CAST(sum(floor(o_totalprice)) AS BIGINT) AS shares FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL), j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.shares AS a, b.shares AS b FROM (SELECT * FROM h WHERE y = 1997) a FULL JOIN (SELECT * FROM h WHERE y = 1996) b ON a.holder = b.holder AND a.symbol = b.symbol) SELECT symbol, count(*) FILTER (WHERE b IS NULL) AS new, count(*) FILTER (WHERE a IS NULL) AS closed, count(*) FILTER (WHERE a > b) AS increased, count(*) FILTER (WHERE a < b) AS decreased, CAST(coalesce(sum(a), 0) - coalesce(sum(b), 0) AS BIGINT) AS net_change FROM j GROUP BY symbol")
def holdings_change(spark: SparkSession, d: str) -> DataFrame:
    o = B.load(spark, d, "orders").withColumn("y", F.year("o_orderdate")).where(F.col("y").isin(1996, 1997))
    h = o.groupBy(F.col("o_custkey").alias("holder"), (F.col("o_custkey") % 40).alias("symbol"), "y").agg(F.sum(F.floor("o_totalprice")).cast("long").alias("shares"))
    return X.holdings_change(h.where("y = 1997"), h.where("y = 1996"))


@register("page_words", "SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^ \\t\\n\\r]+')) AS words, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS chars FROM pages")
def page_words(spark: SparkSession, d: str) -> DataFrame:
    t = X.strip_html(F.col("html"))
    return B.load(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(t, F.lit(r"([^ \t\n\r]+)"), 1)).cast("long").alias("words"), F.char_length(t).cast("long").alias("chars"))


# ---------------------------------------------------------------- strategies, learning, further operators
from tidemill.operators import learning as E  # noqa: E402
from tidemill.operators import strategies as Y  # noqa: E402


def _strategic(spark: SparkSession, d: str) -> DataFrame:
    return Y.strategies(technical.momentum(technical.trend(based(spark, d))))


LEVELS = ["direction", "strength", "confidence", "stop_loss", "take_profit"]


def _unpacked(b: DataFrame, name: str) -> DataFrame:
    return rounded(b.select("symbol", "ts", *[f"{name}.{x}" for x in LEVELS]), 5)


def _slice_range(n: int) -> str:
    """Mean true range of the n bars before, from their lists alone."""
    return f"CASE WHEN seq <= {n} THEN 0.02::DOUBLE * close ELSE list_avg(list_transform(range(1, {n + 1}), lambda i: greatest(h{n}[i] - l{n}[i], coalesce(abs(h{n}[i] - c{n}[i - 1]), 0), coalesce(abs(l{n}[i] - c{n}[i - 1]), 0)))) END"


def _hurst(x: str) -> str:
    path = f"list_transform(range(1, len({x}) + 1), lambda i: list_sum({x}[1:i]) - i * list_avg({x}))"
    rs = f"(list_max({path}) - list_min({path})) / nullif(list_aggregate({x}, 'stddev_samp'), 0)"
    return f"CASE WHEN coalesce({rs}, 0) = 0 THEN 0.5::DOUBLE ELSE greatest(0, least(1, ln({rs}) / ln(len({x})))) END"


_s1 = stage(
    "s1", "d6",
    **{f"{v}{n}": f"list({x}) {over(-n, -1)}" for n in (10, 14, 20) for v, x in (("h", "high"), ("l", "low"), ("c", "close"))},
    **{f"y{p}": f"{lag('close', 5)} / nullif({lag('close', p)}, 0) - 1" for p in (21, 63, 126, 252)},
    x51=f"list(close) {over(-50)}", x100=f"list(close) {over(-100, -1)}", vol=f"stddev_samp(r) {over(-63, -1)} * sqrt(252)",
    gain=f"avg(CASE WHEN close > last THEN close - last ELSE 0 END) {over(-13)}", loss=f"avg(CASE WHEN close < last THEN last - close ELSE 0 END) {over(-13)}",
    top=f"max(high) {over(-20, -1)}", bottom=f"min(low) {over(-20, -1)}", vmean=f"avg(volume) {over(-20, -1)}",
    v20=f"stddev_samp(r) {over(-20, -1)} * sqrt(252)", v252=f"stddev_samp(r) {over(-252, -1)} * sqrt(252)", m50=f"avg(close) {over(-50, -1)}", m200=f"avg(close) {over(-200, -1)}",
)
_s2 = stage("s2", "s1", atr14=_slice_range(14), atr10=_slice_range(10), atr20=_slice_range(20), lv="list_filter([y21, y63, y126, y252], lambda x: x IS NOT NULL)", h51=_hurst("x51"), h100=_hurst("x100"), z="(close - list_avg(x51)) / nullif(list_aggregate(x51, 'stddev_samp'), 0)", sd="list_aggregate(x51, 'stddev_samp')", mu="list_avg(x51)", rsi="CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END", loud="coalesce(volume / nullif(vmean, 0) > 1.5, false)")
_s3 = stage("s3", "s2", mean="list_avg(lv)", tight="atr10 < 0.8 * atr20")
_s4 = stage(
    "s4", "s3",
    mdirection="CASE WHEN mean > 0.02 THEN 1 WHEN mean < -0.02 THEN -1 ELSE 0 END",
    rdirection="CASE WHEN seq < 51 OR z IS NULL OR h51 > 0.6 THEN 0 WHEN z < -2 AND rsi < 30 THEN 1 WHEN z > 2 AND rsi > 70 THEN -1 ELSE 0 END",
    kdirection="CASE WHEN seq < 21 THEN 0 WHEN close > top THEN 1 WHEN close < bottom THEN -1 ELSE 0 END",
    dv="CASE WHEN seq > 100 THEN (v20 - 0.5 * CASE WHEN seq > 252 THEN v252 ELSE v20 END) / (0.5 * CASE WHEN seq > 252 THEN v252 ELSE v20 END + 0.01::DOUBLE) END", far="CASE WHEN seq > 200 THEN m200 ELSE m50 END",
)
_s5 = stage(
    "s5", "s4",
    mstrength="CASE WHEN mdirection = 0 THEN 0 ELSE least(10 * abs(mean), 1) * CASE WHEN vol > 0 THEN least(greatest(0.15::DOUBLE / vol, 0.5), 2) ELSE 1 END * CASE WHEN adx_sma < 15 THEN 0.5::DOUBLE ELSE 1 END END",
    mconfidence="CASE WHEN len(lv) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(lv, lambda x: sign(x) = sign(mean)))::DOUBLE / len(lv) END", mstop_loss="close - 2 * mdirection * atr14", mtake_profit="close + 4 * mdirection * atr14",
    rstrength="CASE WHEN rdirection = 0 THEN 0 ELSE least(abs(z) / 3, 1) END", rconfidence="CASE WHEN seq < 51 OR z IS NULL OR h51 > 0.6 THEN 0.5::DOUBLE ELSE (CAST(abs(z) > 2 AS INTEGER) + abs(rdirection) + CAST(h51 < 0.5 AS INTEGER)) / 3.0::DOUBLE END",
    rstop_loss="CASE WHEN seq < 51 OR z IS NULL OR h51 > 0.6 THEN close ELSE close - 3 * rdirection * sd END", rtake_profit="CASE WHEN seq < 51 OR z IS NULL OR h51 > 0.6 THEN close ELSE mu END",
    kstrength="CASE WHEN kdirection = 0 THEN 0 WHEN loud AND tight THEN 0.8::DOUBLE WHEN loud THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END", kconfidence="CASE WHEN seq < 21 THEN 0.5::DOUBLE WHEN kdirection = 0 THEN 0 ELSE 0.3::DOUBLE + CASE WHEN loud THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN tight THEN 0.3::DOUBLE ELSE 0 END END",
    kstop_loss="close - 2 * kdirection * atr14", ktake_profit="close + 4 * kdirection * atr14",
    regime="CASE WHEN seq < 101 THEN 'unknown' WHEN dv > 0.5 THEN 'high_volatility' WHEN dv < -0.3 THEN 'low_volatility' WHEN h100 < 0.45 THEN 'mean_reverting' WHEN close > m50 AND m50 > far THEN 'bull_trend' WHEN close < m50 AND m50 < far THEN 'bear_trend' ELSE 'neutral' END",
)
_pick = lambda x, other, bear=None, high=None: f"CASE regime WHEN 'bull_trend' THEN m{x} WHEN 'bear_trend' THEN {bear or 'm' + x} WHEN 'mean_reverting' THEN r{x} WHEN 'low_volatility' THEN k{x} WHEN 'high_volatility' THEN {high or 'm' + x} ELSE {other} END"
_s6 = stage("s6", "s5", wdirection=_pick("direction", "0", "CASE WHEN mdirection = 0 THEN -1 ELSE mdirection END"), wstrength=_pick("strength", "0", "CASE WHEN mdirection = 0 THEN 0.3::DOUBLE ELSE mstrength END", "0.3::DOUBLE * mstrength"), wconfidence=_pick("confidence", "0.3::DOUBLE"), wstop_loss=_pick("stop_loss", "close"), wtake_profit=_pick("take_profit", "close"))
_s7 = stage("s7", "s6", edirection="sign(round((mdirection * mconfidence + rdirection * rconfidence + kdirection * kconfidence + wdirection * wconfidence) / 4, 9))", estrength="(mstrength + rstrength + kstrength + wstrength) / 4", econfidence="(mconfidence + rconfidence + kconfidence + wconfidence) / 4", estop_loss="wstop_loss", etake_profit="wtake_profit")
_STRATEGY = [_dm, _dm2, _dm3, _dm4, _dm5, _dm6, _s1, _s2, _s3, _s4, _s5, _s6, _s7]


def _strategy_sql(prefix: str, more: str = "") -> str:
    return sql([*_STRATEGY, "fin AS (SELECT symbol, ts, regime AS regime_label, " + ", ".join(f"{prefix}{x} AS {x}" for x in LEVELS) + " FROM s7)"], LEVELS, "fin", 5, ints=("direction",)).replace("SELECT symbol, ts, CAST(direction", f"SELECT symbol, ts,{more} CAST(direction")


@register("strategy_momentum", _strategy_sql("m"))
def strategy_momentum(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(Y.momentum(technical.trend(based(spark, d))), "momentum")


@register("strategy_mean_reversion", _strategy_sql("r"))
def strategy_mean_reversion(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(Y.mean_reversion(based(spark, d)), "mean_reversion")


@register("strategy_breakout", _strategy_sql("k"))
def strategy_breakout(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(Y.breakout(based(spark, d)), "breakout")


@register("strategy_regime", _strategy_sql("w", " regime_label AS regime,"))
def strategy_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_strategic(spark, d).select("symbol", "ts", "regime", *[f"regime_switch.{x}" for x in LEVELS]), 5)


@register("strategy_ensemble", _strategy_sql("e", " regime_label AS regime,"))
def strategy_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_strategic(spark, d).select("symbol", "ts", "regime", *[f"ensemble.{x}" for x in LEVELS]), 5)


@register("model_scores")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    b = technical.derived(technical.momentum(based(spark, d)))
    names = ["rsi_sma", "stoch_k", "willr", "mfi", "returns_1d", "returns_5d", "returns_20d", "volatility_20d"]
    ready = b.withColumn("target", (F.lead("close").over(B_SERIES()) > F.col("close")).cast("int")).select("symbol", "ts", "seq", "target", *names).where("target is not null").na.fill(0)
    out, _ = E.stacked(ready, names, n_folds=3)
    return rounded(E.classification_metrics(out.where("not is_train"), keys=("symbol",)))


def B_SERIES():
    from tidemill.plans.windows import series

    return series()


_CLS = f"WITH {BASE}, {_m1}, {_m2}, {_m3}, {_m4}, cl AS (SELECT symbol, round(rsi_sma / 100, 3) AS p, CAST(lead(close) OVER ({ROW}) > close AS INTEGER) AS y FROM m4), ck AS (SELECT * FROM cl WHERE p IS NOT NULL AND y IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0::DOUBLE AS r FROM ck), ag AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, sum(r) FILTER (WHERE y = 1) AS sr, count(*) FILTER (WHERE y = 1) AS n1 FROM rk GROUP BY symbol)"


@register("confusion_auc", f"{_CLS} SELECT symbol, n, tp, fp, fn, tn, round((tp + tn)::DOUBLE / n + {NUDGE}, 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) + {NUDGE}, 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + {NUDGE}, 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + {NUDGE}, 6) AS f1, round((sr - n1 * (n1 + 1) / 2.0::DOUBLE) / nullif(n1 * (n - n1), 0) + {NUDGE}, 6) AS roc_auc FROM ag")
def confusion_auc(spark: SparkSession, d: str) -> DataFrame:
    b = technical.momentum(based(spark, d)).withColumn("target", (F.lead("close").over(B_SERIES()) > F.col("close")).cast("int"))
    rows = b.select("symbol", F.round(F.col("rsi_sma") / 100, 3).alias("p"), "target").where("p is not null and target is not null")
    return rounded(E.classification_metrics(rows, keys=("symbol",)))


# ---------------------------------------------------------------- point-in-time alternative data
from tidemill.operators import alternative as A  # noqa: E402

_BARS_INS = "tx AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'A' THEN 'Buy' WHEN 'R' THEN 'Sell' ELSE 'Other' END AS kind, l_extendedprice AS value, l_linenumber = 1 AS ex FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _transactions(spark: SparkSession, d: str) -> DataFrame:
    part = B.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    flag = F.col("l_returnflag")
    lines = B.load(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), F.when(flag == "A", "Buy").when(flag == "R", "Sell").otherwise("Other").alias("kind"), F.col("l_extendedprice").alias("value"), (F.col("l_linenumber") == 1).alias("executive"))
    return lines.join(part, "l_partkey")


_IND = f"""{_BARS_INS}, dl AS (SELECT symbol, day, count(*) FILTER (WHERE kind = 'Buy') AS b, count(*) FILTER (WHERE kind = 'Sell') AS s, sum(CASE kind WHEN 'Buy' THEN value ELSE 0 END) AS bv, sum(CASE kind WHEN 'Sell' THEN value ELSE 0 END) AS sv, count(*) FILTER (WHERE ex AND kind = 'Buy') - count(*) FILTER (WHERE ex AND kind = 'Sell') AS e FROM tx GROUP BY 1, 2),
  tr2 AS (SELECT symbol, day, sum(b) OVER w AS ib, sum(s) OVER w AS ins, sum(bv) OVER w AS bv, sum(sv) OVER w AS sv, sum(e) OVER w AS ie FROM dl WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)),
  md AS (SELECT *, bv - sv AS inet, {_BALANCE.format('bv', 'sv')} AS m FROM tr2), sg AS (SELECT *, least(greatest(m, -1), 1) AS sig FROM md)"""


@register("insider_daily", f"WITH {_IND} SELECT symbol, day, CAST(ib AS BIGINT) AS insider_buys, CAST(ins AS BIGINT) AS insider_sells, round(inet + {NUDGE}, 2) AS insider_net_value, CAST(ie AS BIGINT) AS executive_activity, round(m + {NUDGE}, 6) AS insider_sentiment, round(sig + {NUDGE}, 6) AS insider_signal FROM sg")
def insider_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.insider_daily(_transactions(spark, d)).withColumn("insider_net_value", F.round(F.col("insider_net_value") + NUDGE, 2)))


@register("insider_on_bars", f"WITH {BRAND}, {_IND} SELECT b.symbol, b.ts, round(coalesce(m, 0) + {NUDGE}, 6) AS insider_sentiment, round(coalesce(sig, 0) + {NUDGE}, 6) AS insider_signal FROM bars b ASOF LEFT JOIN sg ON sg.symbol = b.symbol AND b.ts >= sg.day")
def insider_on_bars(spark: SparkSession, d: str) -> DataFrame:
    names = ["insider_sentiment", "insider_signal"]
    return shown(A.on_bars(B.brand_week(spark, d), A.insider_daily(_transactions(spark, d)), names), names)


_POSTS = "ps AS (SELECT role AS symbol, DATE '2024-01-01' + CAST(conv_id % 40 AS INTEGER) AS day, length(text) AS score, turn AS comments, (length(text) % 21 - 10) / 10.0::DOUBLE AS sentiment FROM conversations), pd1 AS (SELECT symbol, day, count(*) AS n, sum(sentiment) AS s, sum(sentiment * ln(2 + greatest(score, 0))) AS sw, sum(ln(2 + greatest(score, 0))) AS w, sum(sentiment * sentiment) AS s2, count(*) FILTER (WHERE sentiment > 0.05) AS b, sum(score) AS sc, sum(comments) AS co FROM ps GROUP BY 1, 2), pt AS (SELECT symbol, day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(sw) OVER w AS sw, sum(w) OVER w AS w, sum(s2) OVER w AS s2, sum(b) OVER w AS b, sum(sc) OVER w AS sc, sum(co) OVER w AS co FROM pd1 WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))"


@register("social_daily", f"WITH {_POSTS} SELECT symbol, day, CAST(n AS BIGINT) AS mentions, round(s / n + {NUDGE}, 6) AS sentiment, round(coalesce(sw / nullif(w, 0), 0) + {NUDGE}, 6) AS weighted, round(sqrt(greatest(s2 / n - (s / n) * (s / n), 0)) + {NUDGE}, 6) AS sentiment_std, CAST(sc AS BIGINT) AS total_score, round(sc::DOUBLE / n + {NUDGE}, 6) AS avg_score, CAST(co AS BIGINT) AS total_comments, round(b::DOUBLE / n + {NUDGE}, 6) AS bullish_ratio, CAST(n > 10 AND sc::DOUBLE / n > 100 AS INTEGER) AS trending, round(least(n / 50.0::DOUBLE, 1) + {NUDGE}, 6) AS hype, round(0.5 * coalesce(sw / nullif(w, 0), 0) + 0.3::DOUBLE * (b::DOUBLE / n - 0.5) + 0.2::DOUBLE * least(n / 50.0::DOUBLE, 1) + {NUDGE}, 6) AS social_signal FROM pt")
def social_daily(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    posts = B.load(spark, d, "conversations").select(F.col("role").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 40).cast("int")).alias("day"), n.cast("long").alias("score"), F.col("turn").alias("comments"), ((n % 21 - 10) / 10.0).alias("sentiment"))
    return rounded(A.social_daily(posts))


@register("latest_news", "SELECT symbol, doc_id FROM (SELECT source AS symbol, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 30 DESC, doc_id) AS n FROM documents) WHERE n <= 10")
def latest_news(spark: SparkSession, d: str) -> DataFrame:
    news = B.load(spark, d, "documents").select(F.col("source").alias("symbol"), "doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("timestamp").alias("published"))
    return A.latest_news(news, 10, order=("doc_id",)).select("symbol", "doc_id")


@register("pause_flags", f"{_PATH} SELECT symbol, ts, CAST(strategy_return < -0.03 AS INTEGER) AS pause_day, CAST(sum(strategy_return) {over(-4)} < -0.07 AS INTEGER) AS pause_week, CAST(drawdown < -0.15 AS INTEGER) AS pause_drawdown FROM pf")
def pause_flags(spark: SparkSession, d: str) -> DataFrame:
    return A.pause_flags(pathed(spark, d)).select("symbol", "ts", "pause_day", "pause_week", "pause_drawdown")


# ---------------------------------------------------------------- further alignment and comparison
_fb = "list_transform(range(1, 31), lambda i: floor((i - 1) * {k} / 30.0::DOUBLE) * 1000 + least(floor((x[i] - lo) / nullif(hi - lo, 0) * {k}), {k} - 1))"
_fd = [stage("fx", "base", x=f"list(close) {over(-29)}", lo=f"min(close) {over(-29)}", hi=f"max(close) {over(-29)}"), stage("fy", "fx", **{f"n{k}": f"CASE WHEN len(x) = 30 THEN len(list_distinct({_fb.format(k=k)})) END" for k in (2, 4, 8, 16)})]
_fd.append(stage("fz", "fy", fractal_dimension="CASE WHEN len(x) = 30 AND hi > lo THEN least(greatest((-1.5 * ln(n2) - 0.5 * ln(n4) + 0.5 * ln(n8) + 1.5 * ln(n16)) / (5 * ln(2)), 1), 2) END"))


@register("box_dimension", sql(_fd, ["fractal_dimension"], "fz"))
def box_dimension(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.box_dimension(based(spark, d)), ["fractal_dimension"])


_CMP = f"{_head.replace('WITH ', 'WITH RECURSIVE ', 1)}{_hold}, rn AS (SELECT 'signals' AS strategy, symbol, ts, close, sign(signal_value) AS s FROM x8 UNION ALL SELECT 'inverse', symbol, ts, close, -sign(signal_value) FROM x8 UNION ALL SELECT 'held', x8.symbol, x8.ts, close, CASE WHEN walk.kept THEN sign(signal_value) ELSE 0 END FROM x8 LEFT JOIN walk ON walk.symbol = x8.symbol AND walk.seq = x8.seq), ra AS (SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position, close / nullif(lag(close) OVER w, 0) - 1 AS r2 FROM rn WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts)), rb AS (SELECT strategy, ts, greatest(coalesce(coalesce(lag(position) OVER (PARTITION BY strategy, symbol ORDER BY ts), 0) * r2, 0), -0.99::DOUBLE) AS sr FROM ra), rc2 AS (SELECT strategy, ts, avg(sr) AS sr FROM rb GROUP BY 1, 2), rd AS (SELECT *, exp(sum(ln(1 + sr)) OVER (PARTITION BY strategy ORDER BY ts)) AS e FROM rc2), re AS (SELECT *, e / max(e) OVER (PARTITION BY strategy ORDER BY ts) - 1 AS dd FROM rd), rg AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY strategy ORDER BY ts) IS NOT NULL THEN sr END AS s1 FROM re), rf AS (SELECT strategy, count(*) AS bars, arg_max(e, ts) / arg_min(e, ts) - 1 AS t, {_SHARPE.format('s1')} AS sharpe, {_SORTINO.format('s1')} AS sortino, stddev_samp(s1) AS sd, min(dd) AS dd FROM rg GROUP BY 1) SELECT strategy, bars, CAST(printf('%.6e', round(t, 4)) AS DOUBLE) AS total_return, CAST(printf('%.6e', round(t * 252 / bars, 4)) AS DOUBLE) AS annual_return, round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, round(dd, 4) AS max_drawdown, round(sd * sqrt(252), 4) AS volatility FROM rf"


@register("compare_runs", _CMP)
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    b = signalled(spark, d).select("symbol", "ts", "seq", "close", "signal_value")
    out = P.compare({"signals": P.position_path(b), "inverse": P.position_path(b.withColumn("signal_value", -F.col("signal_value"))), "held": P.position_path(G.minimum_hold(b, 5, "signal_value"))})
    return out.withColumns({x: F.format_string("%.6e", x).cast("double") for x in ("total_return", "annual_return")})  # the test tables' prices compound beyond any digits


_CHK = "ch AS (SELECT doc_id, i AS part, substr(text, CAST(i * 5000 + 1 AS BIGINT), 5000) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 5000.0) AS BIGINT), 1))) AS i FROM documents)), ct AS (SELECT doc_id, part, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, part, regexp_extract_all(lower(t), '[\\\\p{L}'']+') AS w FROM ch)), cn AS (SELECT *, coalesce(lag(word) OVER (PARTITION BY doc_id, part ORDER BY pos) IN ('not', 'no', 'never'), false) AS neg FROM ct), cs AS (SELECT doc_id, part, sum(CASE WHEN neg THEN valence * -0.74::DOUBLE ELSE valence END) AS s FROM cn JOIN lex USING (word) GROUP BY 1, 2)".replace("\\\\", "\\")


@register("long_doc_sentiment", f"WITH {_TOK}, {_LEX}, {_CHK} SELECT ch.doc_id, round(avg(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)) + {NUDGE}, 6) AS compound, count(*) AS parts FROM ch LEFT JOIN cs ON cs.doc_id = ch.doc_id AND cs.part = ch.part GROUP BY 1")
def long_doc_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.chunked_scores(B.load(spark, d, "documents"), _lexicon(spark, d)))


# each whole slice is a run of its own, which starts flat
@register("wf_slices", f"""{_PATH},
  sn AS (SELECT symbol, ts, close, s, CAST(floor((row_number() OVER ({ROW}) - 1 - 126) / 42.0) AS INTEGER) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM pf),
  sa AS (SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position, close / nullif(lag(close) OVER w, 0) - 1 AS r2 FROM sn WHERE k >= 0 AND (k + 1) * 42 + 126 <= n WINDOW w AS (PARTITION BY symbol, k ORDER BY ts)),
  sb AS (SELECT symbol, k, CASE WHEN lag(ts) OVER w IS NOT NULL THEN greatest(coalesce(coalesce(lag(position) OVER w, 0) * r2, 0), -0.99::DOUBLE) END AS sr FROM sa WINDOW w AS (PARTITION BY symbol, k ORDER BY ts)),
  pr AS (SELECT symbol, k, product(1 + coalesce(sr, 0)) - 1 AS total, {_SHARPE.format('sr')} AS sharpe FROM sb GROUP BY 1, 2)
  SELECT symbol, count(*) AS slices, {_r('avg(total)', 'mean_return')}, {_r('stddev_pop(total)', 'std_return')}, {_r('avg(sharpe)', 'mean_sharpe')}, {_r('stddev_pop(sharpe)', 'std_sharpe')} FROM pr GROUP BY symbol""")
def wf_slices(spark: SparkSession, d: str) -> DataFrame:
    b = signalled(spark, d).select("symbol", "ts", "close", "signal_value").withColumn("seq", F.row_number().over(B_SERIES()))
    return rounded(P.slice_metrics(P.slices(b, 126, 42)), 5)


from tidemill import queries_more  # noqa: E402, F401
