"""Further registered queries: alignment, filters, text and filings, walk-forward, learners, and recursive indicators by list reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import alternative as A
from tidemill.operators import backtest as P
from tidemill.operators import candles as K
from tidemill.operators import cleaning as C
from tidemill.operators import joins as J
from tidemill.operators import learning as E
from tidemill.operators import recursive as R
from tidemill.operators import refit as L
from tidemill.operators import signals as G
from tidemill.operators import statistical as S
from tidemill.operators import strategies as Y
from tidemill.operators import technical
from tidemill.operators import text as X
from tidemill.plans import order as O
from tidemill.plans.windows import series
from tidemill.queries import BASE, BRAND, NUDGE, ORACLES, RECURSIVE_SHOWN, ROW, _BALANCE, _EVENTS, _LEX, _PATH, _POSTS, _SHARPE, _SCO, _STRATEGY, _TOK, _dm, _dm2, _dm3, _dm4, _dm5, _dm6, _ew, _inputs, _m1, _m2, _m3, _m4, _r, _scored, _sg, _tr, _wf, based, full, judged, lag, over, pathed, ranked, register, rounded, shown, signalled, sql, stage
from tidemill.sources import bars as B

FIRST = "(SELECT min(symbol) FROM bars)"
_ref = f"{BASE}, ref AS (SELECT ts, close AS x FROM bars WHERE symbol = {FIRST}), j0 AS (SELECT base.*, x FROM base LEFT JOIN ref USING (ts))"
_r1 = stage("r1", "j0", vix_level=f"last_value(x IGNORE NULLS) {over('all')}")
_r2 = stage("r2", "r1", mr=f"vix_level / nullif({lag('vix_level')}, 0) - 1")
_r3 = stage("r3", "r2", a="CASE WHEN r IS NOT NULL AND mr IS NOT NULL THEN r END", b="CASE WHEN r IS NOT NULL AND mr IS NOT NULL THEN mr END", seen=f"list(vix_level) {over(-251)}")
_r4 = stage("r4", "r3", vix_correlation=f"CASE WHEN count(a) {over(-19)} = 20 THEN corr(a, b) {over(-19)} END", vix_percentile="CASE WHEN len(list_filter(seen, lambda v: v IS NOT NULL)) = 252 THEN 100 * (len(list_filter(seen, lambda v: v < vix_level)) + len(list_filter(seen, lambda v: v <= vix_level)) + 1) / 504.0::DOUBLE END", risk_on_off=f"({full('r', 10)}) - ({full('mr', 10)})")


def _first(bars: DataFrame) -> str:
    return bars.agg(F.min("symbol")).first()[0]


@register("volatility_index_features", sql([_r1, _r2, _r3, _r4], ["vix_level", "vix_correlation", "vix_percentile"], "r4", head=_ref))
def volatility_index_features(spark: SparkSession, d: str) -> DataFrame:
    bars = B.brand_week(spark, d)
    return shown(J.volatility_features(bars, bars, _first(bars)), ["vix_level", "vix_correlation", "vix_percentile"])


@register("bond_features", sql([_r1, _r2, _r3, _r4, stage("r5", "r4", bond_correlation="vix_correlation")], ["bond_correlation", "risk_on_off"], "r5", head=_ref))
def bond_features(spark: SparkSession, d: str) -> DataFrame:
    bars = B.brand_week(spark, d)
    return shown(J.bond_features(bars, bars, _first(bars)), ["bond_correlation", "risk_on_off"])


_rot = f"{BASE}, ra AS (SELECT ts, close AS xa FROM bars WHERE symbol = {FIRST}), rb AS (SELECT ts, close AS xb FROM bars WHERE symbol = (SELECT max(symbol) FROM bars)), j0 AS (SELECT base.*, xa, xb FROM base LEFT JOIN ra USING (ts) LEFT JOIN rb USING (ts))"


@register("sector_rotation", sql([stage("q1", "j0", qa=f"last_value(xa IGNORE NULLS) {over('all')}", qb=f"last_value(xb IGNORE NULLS) {over('all')}"), stage("q2", "q1", qq="qa / nullif(qb, 0)"), stage("q3", "q2", sector_rotation=f"qq / nullif({lag('qq', 20)}, 0) - 1")], ["sector_rotation"], "q3", head=_rot))
def sector_rotation(spark: SparkSession, d: str) -> DataFrame:
    bars = B.brand_week(spark, d)
    return shown(J.rotation(bars, bars, _first(bars), bars.agg(F.max("symbol")).first()[0]), ["sector_rotation"])


_ext = stage("e1", "base", **{f"zscore_{n}": f"(close - {full('close', n)}) / ({full('close', n, 'stddev_samp')} + 1e-8)" for n in (10, 20, 50)})
_ext2 = stage("e2", "e1", **{f"zscore_{n}_extreme_{s}": f"CAST(coalesce(zscore_{n} {o} {v}, false) AS INTEGER)" for n in (10, 20, 50) for s, o, v in (("high", ">", 2), ("low", "<", -2))})


@register("zscore_extremes", sql([_ext, _ext2], S.EXTREMES, "e2", ints=tuple(x for x in S.EXTREMES if "extreme" in x)))
def zscore_extremes(spark: SparkSession, d: str) -> DataFrame:
    return shown(S.extremes(based(spark, d)), S.EXTREMES)


# ---------------------------------------------------------------- joins, lookups, cleaning
_DAY = "dd AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, avg(l_discount) AS mean, CAST(count(*) AS DOUBLE) AS articles FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    part = B.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    lines = B.load(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_discount")
    return lines.join(part, "l_partkey").groupBy("symbol", "day").agg(F.avg("l_discount").alias("mean"), F.count("*").cast("double").alias("articles"))


@register("news_on_bars", f"WITH {BRAND}, {_DAY} SELECT b.symbol, b.ts, {_r('coalesce(mean, 0)', 'mean', 6)}, {_r('coalesce(articles, 0)', 'articles', 6)} FROM bars b LEFT JOIN dd ON dd.symbol = b.symbol AND dd.day = CAST(b.ts AS DATE)")
def news_on_bars(spark: SparkSession, d: str) -> DataFrame:
    return shown(J.news_on_bars(B.brand_week(spark, d), _daily(spark, d), ["mean", "articles"]), ["mean", "articles"])


@register("news_rolled_forward", f"WITH {BRAND}, {_DAY}, mv AS (SELECT dd.symbol, b.ts, avg(mean) AS mean, avg(articles) AS articles FROM dd ASOF JOIN bars b ON b.symbol = dd.symbol AND dd.day <= b.ts GROUP BY 1, 2) SELECT b.symbol, b.ts, {_r('coalesce(mean, 0)', 'mean', 6)}, {_r('coalesce(articles, 0)', 'articles', 6)} FROM bars b LEFT JOIN mv ON mv.symbol = b.symbol AND mv.ts = b.ts")
def news_rolled_forward(spark: SparkSession, d: str) -> DataFrame:
    return shown(J.news_on_bars(B.brand_week(spark, d), _daily(spark, d), ["mean", "articles"], roll_forward=True), ["mean", "articles"])


@register("company_numbers", "SELECT upper(s_name) AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey")
def company_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = B.load(spark, d, "supplier")
    numbers = J.cik(s.select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("cik")))
    names = B.load(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("n_name").alias("name"))
    known = J.named(s.select(F.upper("s_name").alias("ticker"), F.col("s_nationkey").cast("string").alias("symbol")), names)
    return numbers.join(known, "ticker").select("ticker", "cik", "name")


@register("top_orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return J.top_k(B.load(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@register("merged_importances", "WITH a AS (SELECT p_type AS feature, avg(p_size) AS importance FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_type AS feature, avg(p_size) AS importance FROM part WHERE p_size > 20 GROUP BY 1) SELECT coalesce(a.feature, b.feature) AS feature, round(coalesce(a.importance, 0) + 1.3e-8, 6) AS a, round(coalesce(b.importance, 0) + 1.3e-8, 6) AS b, round((coalesce(a.importance, 0) + coalesce(b.importance, 0)) / 2 + 1.3e-8, 6) AS mean FROM a FULL JOIN b ON a.feature = b.feature")
def merged_importances(spark: SparkSession, d: str) -> DataFrame:
    models = [B.load(spark, d, "part").where(x).groupBy(F.col("p_type").alias("feature")).agg(F.avg("p_size").alias("importance")) for x in ("p_size <= 25", "p_size > 20")]
    return rounded(J.merged_importances(*models))


@register("clean_table", f"WITH {BRAND}, l AS (SELECT *, lag(close) OVER ({ROW}) AS r FROM bars), z AS (SELECT *, CASE WHEN volume % 3 = 0 THEN NULL ELSE r END AS x FROM l) SELECT symbol, ts, round(coalesce(x, avg(x) OVER (PARTITION BY symbol)) + {NUDGE}, 6) AS x FROM z")
def clean_table(spark: SparkSession, d: str) -> DataFrame:
    b = B.brand_week(spark, d).withColumn("x", F.when(F.col("volume") % 3 != 0, F.lag("close").over(series()))).select("symbol", "ts", "x")
    return rounded(C.clean_table(b.union(b), C.CleanConfig(fill="mean", outlier="none"), order=[F.col("x")]).select("symbol", "ts", "x"))


@register("drop_and_zero", f"WITH {BASE}, {stage('mm', 'base', m=full('close', 20))} SELECT symbol, ts, round(r + {NUDGE}, 6) AS r, round(coalesce(m, 0) + {NUDGE}, 6) AS m FROM mm WHERE r IS NOT NULL")
def drop_and_zero(spark: SparkSession, d: str) -> DataFrame:
    b = based(spark, d).withColumn("m", technical.full("close", 20)).select("symbol", "ts", "r", "m")
    return rounded(C.drop_and_zero(b, ["r"]))


@register("signal_agreement", f"WITH {', '.join([BASE, _dm, _dm2, _dm3, _dm4, _dm5, _dm6])} SELECT symbol, round(avg(CAST(sign(sma_cross_20_50) = sign(r) AS DOUBLE)) + {NUDGE}, 6) AS agreement FROM d6 GROUP BY symbol")
def signal_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.agreement(technical.trend(based(spark, d)), "sma_cross_20_50", "r"))


# ---------------------------------------------------------------- model and strategy signals together
_both = f"WITH {', '.join([BASE, *_sg, *[x for x in _STRATEGY if x not in _sg]])}, mg AS (SELECT x8.*, s7.estrength * s7.edirection AS strategy_signal FROM x8 JOIN s7 ON s7.symbol = x8.symbol AND s7.ts = x8.ts), bl AS (SELECT *, sign(signal_value) = sign(strategy_signal) AS ag FROM mg), sc2 AS (SELECT *, (0.6::DOUBLE * signal_value + 0.4::DOUBLE * strategy_signal) * CASE WHEN ag THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END AS score FROM bl), po AS (SELECT *, CASE WHEN NOT ag THEN 0 WHEN score > 0.35 THEN 1 WHEN score < -0.35 THEN -1 ELSE 0 END AS p FROM sc2), lv AS (SELECT *, CASE WHEN p > 0 AND (coalesce(rsi_sma > 70, false) OR coalesce(close < sma_50 AND sma_20 < sma_50, false)) THEN 0 WHEN p < 0 AND (coalesce(rsi_sma < 30, false) OR coalesce(close > sma_50 AND sma_20 > sma_50, false)) THEN 0 ELSE p END AS position, least(greatest(1.5::DOUBLE * atr_sma / close, 0.01), 0.03) AS stop_pct, least(greatest(4 * atr_sma / close, 0.02), 0.1) AS target_pct FROM po)"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Signals and strategies as columns of one panel: one scan and one exchange by symbol."""
    panel = Y.strategies(G.prepared(based(spark, d)))
    return A.clipped_levels(G.filtered(A.merged_panel(G.levelled(judged(panel)))))


@register("merged_positions", f"{_both} SELECT symbol, ts, round(score + {NUDGE}, 5) AS score, CAST(ag AS INTEGER) AS agree, CAST(position AS INTEGER) AS position, round(stop_pct + {NUDGE}, 5) AS stop_pct, round(target_pct + {NUDGE}, 5) AS target_pct FROM lv")
def merged_positions(spark: SparkSession, d: str) -> DataFrame:
    return shown(_merged(spark, d), ["score", "agree", "position", "stop_pct", "target_pct"], 5)


@register("mean_levels", f"{_both} SELECT symbol, round(avg(stop_pct) + {NUDGE}, 6) AS stop_pct, round(avg(target_pct) + {NUDGE}, 6) AS target_pct FROM lv GROUP BY symbol")
def mean_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.mean_levels(A.clipped_levels(signalled(spark, d))))


_either = lambda *cases: "CASE " + " ".join(f"WHEN {cond} THEN {text}" for cond, text in cases) + " END"
_notes = ", ".join([
    _either(("ml > 0.7", "format('Strong ML bullish signal ({:.2f}%)', 100 * ml)"), ("ml < 0.3", "format('Strong ML bearish signal ({:.2f}%)', 100 * ml)")),
    _either(("mood > 0.1", "format('Positive news sentiment ({:+.2f})', mood)"), ("mood < -0.1", "format('Negative news sentiment ({:+.2f})', mood)")),
    _either(("rsi_sma < 30", "format('RSI oversold ({:.1f})', rsi_sma)"), ("rsi_sma > 70", "format('RSI overbought ({:.1f})', rsi_sma)")),
    _either(("adx_sma > 40", "format('Very strong trend (ADX={:.1f})', adx_sma)"), ("adx_sma > 25", "format('Strong trend (ADX={:.1f})', adx_sma)")),
])


@register("signal_notes", f"WITH {', '.join([BASE, *_sg])}, nt AS (SELECT list_filter([{_notes}], lambda x: x IS NOT NULL) AS l, symbol FROM x8) SELECT symbol, trim(regexp_extract(n, '^[A-Za-z ]+')) AS note, count(*) AS bars FROM (SELECT symbol, unnest(l) AS n FROM nt) GROUP BY 1, 2")
def signal_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = G.notes(signalled(spark, d)).select("symbol", F.explode("notes").alias("note")).withColumn("note", F.trim(F.regexp_extract("note", "^[A-Za-z ]+", 0)))
    return notes.groupBy("symbol", "note").agg(F.count("*").alias("bars"))


_se = stage("se", "base", ma5=full("r", 5), ma10=full("r", 10), ch=f"r - {lag('r')}", mu=full("r", 20), sd=full("r", 20, "stddev_samp"), sm=f"avg(r) {over(-2)}", dc=f"close - {lag('close')}")


@register("sentiment_features", sql([_se, stage("sf", "se", r_ma_5="ma5", r_ma_10="ma10", r_change="ch", r_zscore="(r - mu) / (sd + 1e-8)", r_smooth="sm", r_price_divergence="coalesce(CAST(sign(ch) <> sign(dc) AS INTEGER), 1)")], ["r_ma_5", "r_ma_10", "r_change", "r_zscore", "r_smooth", "r_price_divergence"], "sf", ints=("r_price_divergence",)))
def sentiment_features(spark: SparkSession, d: str) -> DataFrame:
    return shown(A.sentiment_features(based(spark, d), "r"), ["r_ma_5", "r_ma_10", "r_change", "r_zscore", "r_smooth", "r_price_divergence"])


@register("strategy_weights", f"WITH n AS (SELECT event_type AS strategy, value - 50 AS pnl, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events), s AS (SELECT strategy, CASE WHEN count(*) < 10 THEN 1 ELSE avg(pnl) / (stddev_pop(pnl) + 0.01::DOUBLE) END AS sharpe FROM n WHERE i <= 50 GROUP BY 1) SELECT strategy, round(sharpe + {NUDGE}, 6) AS sharpe, round(exp(sharpe / 0.5) / sum(exp(sharpe / 0.5)) OVER () + {NUDGE}, 6) AS weight FROM s")
def strategy_weights(spark: SparkSession, d: str) -> DataFrame:
    e = B.load(spark, d, "events").select(F.col("event_type").alias("strategy"), F.struct("ts", "event_id").alias("ts"), (F.col("value") - 50).alias("pnl"))
    return rounded(Y.strategy_weights(e))


# ---------------------------------------------------------------- text, filings
@register("text_ensemble", f"WITH {_TOK}, {_LEX}, {_SCO}, w AS (SELECT doc_id, compound AS a, polarity AS b, 0.4::DOUBLE * compound / 0.6 + 0.2::DOUBLE * polarity / 0.6 AS score FROM sc), l AS (SELECT *, list_filter([a, b], lambda x: x <> 0) AS live FROM w) SELECT doc_id, round(score + {NUDGE}, 6) AS score, CASE WHEN score > 0.15 THEN 'bullish' WHEN score < -0.15 THEN 'bearish' ELSE 'neutral' END AS label, round(CASE WHEN len(live) = 0 THEN 0 WHEN list_min(live) > 0 OR list_max(live) < 0 THEN least(list_avg(list_transform(live, lambda x: abs(x))) + 0.3::DOUBLE, 1) ELSE 0.5 * list_avg(list_transform(live, lambda x: abs(x))) END + {NUDGE}, 6) AS confidence, round(0.3::DOUBLE * a + 0.7::DOUBLE * b + {NUDGE}, 6) AS blended FROM l")
def text_ensemble(spark: SparkSession, d: str) -> DataFrame:
    score, label, sure = X.ensemble({"a": F.col("compound"), "b": F.col("polarity")}, {"a": 0.4, "b": 0.2, "c": 0.4})
    return rounded(_scored(spark, d).select("doc_id", score.alias("score"), label.alias("label"), sure.alias("confidence"), X.blend(F.col("compound"), F.col("polarity")).alias("blended")))


_FIL = "fl AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderkey AS VARCHAR) AS accession, CASE o_orderkey % 3 WHEN 0 THEN 'Item 1.01 and Item 2.02' WHEN 1 THEN 'Item 2.06' ELSE 'Item 5.02; Item 9.01' END AS text, CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN 'SC 13D' ELSE 'S-1' END AS form FROM orders)"


def _filings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "Item 1.01 and Item 2.02").when(k % 3 == 1, "Item 2.06").otherwise("Item 5.02; Item 9.01")
    form = F.when(k % 4 == 0, "10-K").when(k % 4 == 1, "8-K").when(k % 4 == 2, "SC 13D").otherwise("S-1")
    rows = B.load(spark, d, "orders").select((F.col("o_custkey") % 40).cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("filed"), k.cast("string").alias("accession"), text.alias("text"), form.alias("form"))
    return rows.withColumn("items", X.report_items(F.col("text")))


_SEC = f"{_FIL}, rc AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY filed DESC, accession) AS i FROM fl WHERE form = '8-K' AND filed <= DATE '1998-07-20'), ev AS (SELECT symbol, count(*) FILTER (WHERE filed >= DATE '1998-06-20' AND (contains(text, '1.01') OR contains(text, '5.02'))) AS recent_events, count(*) FILTER (WHERE filed >= DATE '1998-06-20' AND contains(text, '2.02')) AS recent_earnings FROM rc WHERE i <= 5 GROUP BY symbol), tx2 AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS symbol, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS b, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS s, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') - count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS e FROM orders GROUP BY 1)"


@register("filing_events", f"WITH {_SEC} SELECT ev.symbol, recent_events, recent_earnings, round(0.6::DOUBLE * {_BALANCE.format('b', 's')} + least(greatest(0.1::DOUBLE * e, -0.2), 0.2) + least(greatest(-0.05::DOUBLE * recent_events, -0.2), 0.2) + {NUDGE}, 6) AS sec_signal FROM ev JOIN tx2 ON tx2.symbol = ev.symbol")
def filing_events(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    tx = B.load(spark, d, "orders").select((F.col("o_custkey") % 40).cast("string").alias("symbol"), F.when(s == "F", "Buy").when(s == "O", "Sell").otherwise("Other").alias("kind"), F.lit(0).alias("shares"), F.col("o_totalprice").alias("value"), F.when(p.startswith("1"), "CEO").otherwise("Director").alias("relation"))
    insiders = X.insider_activity(tx, ("symbol",)).select("symbol", F.col("sentiment").alias("insider_signal"), (F.col("executive_buys") - F.col("executive_sells")).alias("executive_activity"))
    events = X.filing_events(_filings(spark, d), F.lit("1998-07-20").cast("date")).join(insiders, "symbol")
    return rounded(X.filing_signal(events).select("symbol", "recent_events", "recent_earnings", "sec_signal"))


@register("filing_items", f"WITH {_FIL} SELECT accession, regexp_extract_all(text, '[0-9]\\.[0-9]{{2}}') AS i, CASE form WHEN '10-K' THEN 1.0::DOUBLE WHEN '8-K' THEN 0.9::DOUBLE WHEN 'SC 13D' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM fl".replace("AS i,", "AS items,").replace("regexp_extract_all(text, '[0-9]\\.[0-9]{2}')", "array_to_string(regexp_extract_all(text, '[0-9]\\.[0-9]{2}'), '; ')"))
def filing_items(spark: SparkSession, d: str) -> DataFrame:
    return _filings(spark, d).select("accession", F.concat_ws("; ", "items").alias("items"), X.form_weight(F.col("form")).alias("weight"))


NAMES = [("TH", "ereth"), ("DER", "schein"), ("QUE", "mente"), ("XYZZY", "no such company")]


@register("general_feed", "SELECT doc_id, s AS symbol FROM documents JOIN (VALUES " + ", ".join(f"('{s}', '{n}')" for s, n in NAMES) + ") v(s, n) ON contains(lower(text), lower(s)) OR contains(lower(text), lower(n))")
def general_feed(spark: SparkSession, d: str) -> DataFrame:
    return A.about(B.load(spark, d, "documents"), NAMES).select("doc_id", "symbol")


@register("article_table", "SELECT source AS symbol, CAST(doc_id AS VARCHAR) AS url, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id % 30 DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS place FROM documents")
def article_table(spark: SparkSession, d: str) -> DataFrame:
    items = B.load(spark, d, "documents").select(F.col("source").alias("symbol"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("summary"), F.col("doc_id").cast("string").alias("link"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("string").alias("published"))
    return A.canonical(items, "feed").select("symbol", "url", "place")


# ---------------------------------------------------------------- walk-forward, resampling, ledger
def _windowed(spark: SparkSession, d: str, expanding: bool = False) -> DataFrame:
    p = pathed(spark, d).withColumn("seq", F.row_number().over(series()))
    return P.windows(p, 126, 42, 21, expanding, 126)


_wtest = f"{_wf.replace('sq AS (SELECT symbol, ts, strategy_return,', 'sq AS (SELECT symbol, ts, close, position, entry, strategy_return,')}, te AS (SELECT * FROM wn WHERE split = 'test'), eq AS (SELECT symbol, window_id, ts, exp(sum(ln(1 + strategy_return)) OVER o) AS e FROM te WINDOW o AS (PARTITION BY symbol ORDER BY window_id, ts)), fl AS (SELECT symbol, max(abs(d)) AS max_drawdown, arg_max(e, [window_id, epoch(ts)]) AS final_equity FROM (SELECT *, e / max(e) OVER (PARTITION BY symbol ORDER BY window_id, ts) - 1 AS d FROM eq) GROUP BY symbol), tk AS (SELECT *, sum(entry) OVER o AS t, coalesce(lead(close) OVER o, close) AS nx FROM te WINDOW o AS (PARTITION BY symbol, window_id ORDER BY ts)), tt AS (SELECT symbol, arg_min(position, ts) * (arg_max(nx, ts) - arg_min(close, ts)) AS pnl FROM tk WHERE position <> 0 GROUP BY symbol, window_id, t), ts2 AS (SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl > 0)::DOUBLE / count(*) AS win_rate, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / coalesce(abs(sum(pnl) FILTER (WHERE pnl < 0)), 0.001) AS profit_factor FROM tt GROUP BY symbol)"


@register("wf_stitched", f"{_wtest} SELECT fl.symbol, {_r('max_drawdown', 'max_drawdown')}, {_r('final_equity', 'final_equity')}, coalesce(trades, 0) AS trades, {_r('coalesce(win_rate, 0)', 'win_rate')}, {_r('coalesce(profit_factor, 0)', 'profit_factor')} FROM fl LEFT JOIN ts2 ON ts2.symbol = fl.symbol")
def wf_stitched(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.stitched_stats(_windowed(spark, d)), 5)


_wexp = _wf.replace("p >= w.id * 21 AND p < w.id * 21 + 126 THEN", "p < w.id * 21 + 126 THEN").replace("AND p >= w.id * 21 AND p < w.id * 21 + 168)", "AND p < w.id * 21 + 168)")


@register("wf_expanding", f"{_wexp} SELECT symbol, CAST(window_id AS INTEGER) AS window_id, split, bars, first_day, last_day, {_r('total_return', 'total_return')}, {_r('sharpe', 'sharpe')} FROM wm")
def wf_expanding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.window_metrics(_windowed(spark, d, True)), 5)


@register("wf_callbacks", f"WITH {BASE}, sq AS (SELECT *, seq - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM base), wn AS (SELECT sq.*, CAST(w.id AS INTEGER) AS window_id, CASE WHEN p < w.id * 40 + 80 THEN 'train' ELSE 'test' END AS split FROM sq JOIN (SELECT unnest(range(0, 1000)) AS id) w ON w.id * 40 + 120 <= n AND p >= w.id * 40 AND p < w.id * 40 + 120), lv AS (SELECT symbol, window_id, avg(close) AS level FROM wn WHERE split = 'train' GROUP BY 1, 2), sg AS (SELECT wn.*, CASE WHEN close > level THEN 1 ELSE -1 END AS s FROM wn JOIN lv USING (symbol, window_id)), rt AS (SELECT *, greatest(coalesce(lag(s) OVER o * (close / nullif(lag(close) OVER o, 0) - 1), 0), -0.99::DOUBLE) AS sr FROM sg WINDOW o AS (PARTITION BY symbol, window_id, split ORDER BY ts)) SELECT symbol, window_id, split, count(*) AS bars, {_r('exp(sum(ln(1 + sr))) - 1', 'total_return')} FROM rt GROUP BY 1, 2, 3")
def wf_callbacks(spark: SparkSession, d: str) -> DataFrame:
    level = lambda b: b.groupBy("symbol").agg(F.avg("close").alias("level"))
    signal = lambda b: b.withColumn("signal_value", F.when(F.col("close") > F.col("level"), 1).otherwise(-1))
    test = lambda b: P.position_path(b).groupBy("symbol").agg(F.count("*").alias("bars"), (F.exp(F.sum(F.log1p("strategy_return"))) - 1).alias("total_return"))
    return rounded(P.walk_forward(based(spark, d).select("symbol", "ts", "seq", "close"), signal, test, level, 80, 40, 40), 5)


_LED = f"""{_PATH.replace('WITH ', 'WITH RECURSIVE ', 1)}, runs(run_id, sl, tp, sh) AS (VALUES ('plain', NULL::DOUBLE, NULL::DOUBLE, true), ('tight', 0.05::DOUBLE, 0.1::DOUBLE, true), ('long_only', 0.02::DOUBLE, 0.04::DOUBLE, false)),
  rw AS (SELECT run_id, sl, tp, sh, symbol, ts, close AS p, s, row_number() OVER (PARTITION BY run_id, symbol ORDER BY ts) AS i FROM pf, runs),
  wk AS (SELECT run_id, symbol, 0::BIGINT AS i, 100000::DOUBLE AS cash, 0::DOUBLE AS pos, 0::DOUBLE AS entry, NULL::DOUBLE AS equity, NULL::DOUBLE AS trade_pnl, NULL::TIMESTAMP AS ts FROM rw WHERE i = 1
    UNION ALL
    SELECT run_id, symbol, i, cash1 - CASE WHEN opens THEN side * 0.1::DOUBLE * cash1 + 0.001::DOUBLE * 0.1::DOUBLE * cash1 ELSE 0 END, CASE WHEN opens THEN side * 0.1::DOUBLE * cash1 / p WHEN closes THEN 0 ELSE pos END, CASE WHEN opens THEN p ELSE entry END, equity, CASE WHEN closes THEN pos * (p - entry) END, ts
    FROM (SELECT *, cash + CASE WHEN closes THEN pos * p * (1 - 0.001::DOUBLE) ELSE 0 END AS cash1, NOT hit AND flips AND (side > 0 OR sh) AS opens
      FROM (SELECT *, hit OR (flips AND pos <> 0) AS closes FROM (
        SELECT r.run_id, r.symbol, r.i, r.ts, r.p, r.sh, r.s AS side, w.cash, w.pos, w.entry, w.cash + w.pos * r.p AS equity,
          w.pos <> 0 AND (coalesce((r.p - w.entry) / w.entry * sign(w.pos) < -r.sl, false) OR coalesce((r.p - w.entry) / w.entry * sign(w.pos) > r.tp, false)) AS hit, r.s <> 0 AND r.s <> sign(w.pos) AS flips
        FROM wk w JOIN rw r ON r.run_id = w.run_id AND r.symbol = w.symbol AND r.i = w.i + 1) a) b) c)"""


@register("ledger_runs", f"{_LED} SELECT run_id, symbol, ts, CAST(printf('%.5e', equity) AS DOUBLE) AS equity, CAST(sign(pos) AS INTEGER) AS side, CAST(printf('%.5e', trade_pnl) AS DOUBLE) AS trade_pnl FROM wk WHERE i > 0")
def ledger_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = {"plain": P.LedgerConfig(stop_loss=None, take_profit=None), "tight": P.LedgerConfig(stop_loss=0.05, take_profit=0.1), "long_only": P.LedgerConfig(short=False)}
    out = P.ledger(signalled(spark, d), runs)
    return out.withColumns({x: F.when(F.col(x).isNotNull(), F.format_string("%.5e", x).try_cast("double")) for x in ("equity", "trade_pnl")})


# ---------------------------------------------------------------- learners
_SCORES = f"WITH {BASE}, {_m1}, {_m2}, {_m3}, {_m4}, cl AS (SELECT symbol, ts, round(rsi_sma / 100, 3) AS p1, round(stoch_k / 100, 3) AS p2, round(mfi / 100, 3) AS p3, CAST(lead(close) OVER ({ROW}) > close AS INTEGER) AS y FROM m4), ck AS (SELECT * FROM cl WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND y IS NOT NULL)"
_AUC = f"{_SCORES}, lg AS (SELECT y, 'p1' AS learner, p1 AS p FROM ck UNION ALL SELECT y, 'p2', p2 FROM ck UNION ALL SELECT y, 'p3', p3 FROM ck), rk AS (SELECT *, rank() OVER (PARTITION BY learner ORDER BY p) + (count(*) OVER (PARTITION BY learner, p) - 1) / 2.0::DOUBLE AS r FROM lg), au AS (SELECT learner, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM rk GROUP BY learner), wt AS (SELECT *, roc_auc / sum(roc_auc) OVER () AS weight FROM au)"


def _learner_rows(spark: SparkSession, d: str) -> DataFrame:
    b = technical.momentum(based(spark, d)).withColumn("target", (F.lead("close").over(series()) > F.col("close")).cast("int"))
    return b.select("symbol", "ts", "seq", "target", *[F.round(F.col(x) / 100, 3).alias(f"p{i}") for i, x in enumerate(("rsi_sma", "stoch_k", "mfi"), 1)]).dropna()


@register("learner_weights", f"{_AUC} SELECT learner, {_r('roc_auc', 'roc_auc', 6)}, {_r('weight', 'weight', 6)} FROM wt")
def learner_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.learner_weights(_learner_rows(spark, d), ["p1", "p2", "p3"]))


@register("learner_votes", f"{_SCORES} SELECT symbol, ts, {_r('(p1 + p2 + p3) / 3', 'mean', 6)}, CAST(CAST(p1 > 0.5 AS INTEGER) + CAST(p2 > 0.5 AS INTEGER) + CAST(p3 > 0.5 AS INTEGER) >= 2 AS INTEGER) AS vote, CAST(CASE WHEN 0.6::DOUBLE * (1 - least(2 * sqrt((p1 * p1 + p2 * p2 + p3 * p3) / 3 - pow((p1 + p2 + p3) / 3, 2) + 1e-12), 1)) + 0.8::DOUBLE * abs((p1 + p2 + p3) / 3 - 0.5) < 0.5 THEN 0 WHEN (p1 + p2 + p3) / 3 > 0.6 THEN 1 WHEN (p1 + p2 + p3) / 3 < 0.4 THEN -1 ELSE 0 END AS INTEGER) AS signal FROM ck")
def learner_votes(spark: SparkSession, d: str) -> DataFrame:
    p = {x: F.col(x) for x in ("p1", "p2", "p3")}
    mean = E.mean_score(p)
    return rounded(_learner_rows(spark, d).select("symbol", "ts", mean.alias("mean"), E.mean_score(p, "vote").cast("int").alias("vote"), E.signal_of(mean, E.confidence(list(p.values()))).alias("signal")))


@register("purged_folds", f"WITH {BASE}, n AS (SELECT *, seq - 1 AS p, count(*) OVER (PARTITION BY symbol) AS c FROM base), z AS (SELECT *, c // 6 AS size FROM n), k AS (SELECT unnest(range(1, 6)) AS k) SELECT z.symbol, CAST(k.k AS INTEGER) AS fold, count(*) FILTER (WHERE p >= c - (6 - k.k) * size AND p < c - (5 - k.k) * size) AS tested, count(*) FILTER (WHERE p < c - (6 - k.k) * size - 20) AS trained FROM z, k GROUP BY 1, 2")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    b = E.folds(based(spark, d)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return b.groupBy("symbol", F.col("k").alias("fold")).agg(F.count_if(F.col("fold") == F.col("k")).alias("tested"), F.count_if(F.col("trains_from") <= F.col("k")).alias("trained"))


@register("regression_metrics", f"SELECT round(avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / 1e6 + {NUDGE}, 3) AS mse, round(avg(abs(l_extendedprice - 1500 * l_quantity)) + {NUDGE}, 3) AS mae FROM lineitem")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = E.regression_metrics(B.load(spark, d, "lineitem").select("l_extendedprice", (1500.0 * F.col("l_quantity")).alias("guess")), "guess", "l_extendedprice")
    return rounded(m.withColumn("mse", F.col("mse") / 1e6), 3)


# ---------------------------------------------------------------- recursive indicators, each from the whole list of values before it
def _smooth(x: str, n: int, a: str) -> str:
    """Seeded with the mean of the first n values of list x, then moved by `a` of the distance to each further one."""
    return f"CASE WHEN len({x}) >= {n} THEN list_reduce(list_prepend(list_avg({x}[1:{n}]), {x}[{n + 1}:]), lambda s, v: s + (v - s) * {a}) END"


def _ema(x: str, n: int) -> str:
    return _smooth(x, n, f"2 / {n + 1}.0::DOUBLE")


def _wilder(x: str, n: int) -> str:
    return _smooth(x, n, f"1 / {n}.0::DOUBLE")


def _listed(name: str, source: str, *columns: str) -> str:
    return stage(name, source, **{f"l_{x}": f"list({x}) FILTER (WHERE {x} IS NOT NULL) {over('all')}" for x in columns})


_v = [
    stage("v0", "base", cl="close", mt="CASE WHEN last IS NOT NULL THEN tr END", up=f"high - {lag('high')}", dn=f"{lag('low')} - low", gn="CASE WHEN last IS NOT NULL THEN greatest(close - last, 0) END", ls="CASE WHEN last IS NOT NULL THEN greatest(last - close, 0) END", mv=f"abs(close - {lag('close')})", far=f"abs(close - {lag('close', 20)})"),
    stage("v1", "v0", pm="CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END", mm="CASE WHEN dn IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END", path=full("mv", 20, "sum")),
    _listed("v2", "v1", "cl", "mt", "pm", "mm", "gn", "ls"),
    stage("v3", "v2", **{f"ema_{n}_adj": _ew("l_cl", n) for n in (5, 10, 20, 50, 100)}, e10=_ema("l_cl", 10), e15=_ema("l_cl", 15), e20=_ema("l_cl", 20), s26=_ema("l_cl", 26), f12="CASE WHEN len(l_cl) >= 26 THEN list_reduce(list_prepend(list_avg(l_cl[15:26]), l_cl[27:]), lambda s, v: s + (v - s) * 2 / 13.0::DOUBLE) END", wt=_wilder("l_mt", 14), wp=_wilder("l_pm", 14), wm=_wilder("l_mm", 14), wg=_wilder("l_gn", 14), wl=_wilder("l_ls", 14), er="CASE WHEN far IS NOT NULL THEN coalesce(far / nullif(path, 0), 0) END"),
    stage("v4", "v3", macd="f12 - s26", plus_di="100 * wp / nullif(wt, 0)", minus_di="100 * wm / nullif(wt, 0)", rsi="100 * wg / nullif(wg + wl, 0)", pr="CASE WHEN er IS NOT NULL THEN {'y': close, 'k': pow(er * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2)} END"),
    stage("v5", "v4", dx="100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)"),
    _listed("v6", "v5", "e10", "e15", "e20", "macd", "dx", "pr"),
    stage("v7", "v6", e10b=_ema("l_e10", 10), e15b=_ema("l_e15", 15), e20b=_ema("l_e20", 20), macd_signal=_ema("l_macd", 9), adx=_wilder("l_dx", 14), rlo=full("rsi", 5, "min"), rhi=full("rsi", 5, "max"), kama_20="CASE WHEN seq > 20 THEN list_reduce(list_prepend({'y': l_cl[20], 'k': 0::DOUBLE}, l_pr), lambda s, v: {'y': s.y + v.k * (v.y - s.y), 'k': v.k}).y END"),
    _listed("v8", "v7", "e10b", "e15b", "e20b"),
    stage("v9", "v8", e10c=_ema("l_e10b", 10), e15c=_ema("l_e15b", 15), e20c=_ema("l_e20b", 20), stoch_rsi_k="100 * (rsi - rlo) / nullif(rhi - rlo, 0)", macd_hist="macd - macd_signal"),
    _listed("va", "v9", "e10c"),
    stage("vb", "va", e10d=_ema("l_e10c", 10), dema_20="2 * e20 - e20b", tema_20="3 * e20 - 3 * e20b + e20c", trix=f"100 * (e15c / {lag('e15c')} - 1)", stoch_rsi_d=full("stoch_rsi_k", 3), adxr=f"(adx + {lag('adx', 13)}) / 2", macd_hist_slope=f"macd_hist - {lag('macd_hist', 3)}", rsi_slope=f"rsi - {lag('rsi', 5)}", price_slope=f"close / nullif({lag('close', 5)}, 0) - 1"),
    _listed("vc", "vb", "e10d"),
    stage("vd", "vc", e10e=_ema("l_e10d", 10)),
    _listed("ve", "vd", "e10e"),
    stage("vf", "ve", e10f=_ema("l_e10e", 10), strong_trend="CAST(coalesce(adx > 25, false) AS INTEGER)", very_strong_trend="CAST(coalesce(adx > 40, false) AS INTEGER)", rsi_divergence="CAST(coalesce(sign(rsi_slope) <> sign(price_slope), true) AS INTEGER)"),
    stage("vg", "vf", t3_10="-0.343::DOUBLE * e10f + 2.499::DOUBLE * e10e - 6.069::DOUBLE * e10d + 4.913::DOUBLE * e10c"),
]
RECURSIVE_LISTS = [*[f"ema_{n}_adj" for n in (5, 10, 20, 50, 100)], *"dema_20 tema_20 kama_20 t3_10 trix macd_signal macd_hist stoch_rsi_k stoch_rsi_d plus_di minus_di dx adx adxr rsi_slope price_slope macd_hist_slope rsi_divergence strong_trend very_strong_trend".split()]
_FLAGS = ("rsi_divergence", "strong_trend", "very_strong_trend")


@register("recursive_chains", sql(_v, RECURSIVE_LISTS, "vg", 5, ints=_FLAGS))
def recursive_chains(spark: SparkSession, d: str) -> DataFrame:
    return shown(R.recursive(B.brand_week(spark, d)), RECURSIVE_LISTS, 5)


# ---------------------------------------------------------------- recurrences by blocks, against the walk bar by bar
@register("recursive_blocks", ORACLES["recursive_core"])
def recursive_blocks(spark: SparkSession, d: str) -> DataFrame:
    return shown(R.core_by_blocks(B.brand_week(spark, d), block=64), RECURSIVE_SHOWN, 5)


_CHAINS = ["ema_5_adj", "ema_100_adj", "plus_di", "minus_di", "dx", "adx", "macd_signal", "macd_hist"]


@register("recursive_blocks_directional", sql(_v, _CHAINS, "vg", 5))
def recursive_blocks_directional(spark: SparkSession, d: str) -> DataFrame:
    return shown(R.core_by_blocks(B.brand_week(spark, d), block=64), _CHAINS, 5)


# ---------------------------------------------------------------- models fitted anew in every window
_refit = f"""WITH {BASE},
  fe AS (SELECT *, seq - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n, r AS f1, close / nullif({lag('close', 5)}, 0) - 1 AS f2, lead(r) OVER ({ROW}) AS y FROM base),
  wn AS (SELECT fe.*, w.id AS window_id FROM fe JOIN (SELECT unnest(range(0, 1000)) AS id) w ON w.id * 21 + 168 <= n AND p >= w.id * 21 AND p < w.id * 21 + 168),
  eq AS (SELECT symbol, window_id, count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, avg(y) AS my, covar_pop(f1, f1) * count(*) AS c11, covar_pop(f1, f2) * count(*) AS c12, covar_pop(f2, f2) * count(*) AS c22, covar_pop(f1, y) * count(*) AS c1y, covar_pop(f2, y) * count(*) AS c2y
    FROM wn WHERE p < window_id * 21 + 125 AND f1 IS NOT NULL AND f2 IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
  so AS (SELECT *, ((c22 + 1) * c1y - c12 * c2y) / ((c11 + 1) * (c22 + 1) - c12 * c12) AS b1, ((c11 + 1) * c2y - c12 * c1y) / ((c11 + 1) * (c22 + 1) - c12 * c12) AS b2 FROM eq),
  pr AS (SELECT wn.symbol, wn.window_id, y, my + b1 * (f1 - m1) + b2 * (f2 - m2) AS z FROM wn JOIN so USING (symbol, window_id) WHERE p >= window_id * 21 + 126)"""


def _refit_panel(spark: SparkSession, d: str) -> DataFrame:
    b = based(spark, d)
    return b.select("symbol", "ts", "seq", F.col("r").alias("f1"), (F.try_divide("close", F.lag("close", 5).over(series())) - 1).alias("f2"), F.lead("r").over(series()).alias("y"))


@register("wf_refit_models", f"{_refit} SELECT symbol, CAST(window_id AS INTEGER) AS window_id, n, {_r('my - b1 * m1 - b2 * m2', 'intercept', 6)}, {_r('b1', 'b1', 6)}, {_r('b2', 'b2', 6)} FROM so")
def wf_refit_models(spark: SparkSession, d: str) -> DataFrame:
    m = L.solved(L.normal_equations(_refit_panel(spark, d), ["f1", "f2"], "y", 126, 42, 21))
    return rounded(m.select("symbol", "window_id", "n", "intercept", F.col("coefficients")[0].alias("b1"), F.col("coefficients")[1].alias("b2")))


@register("wf_refit", f"""{_refit} SELECT symbol, CAST(window_id AS INTEGER) AS window_id, count(*) AS bars, {_r('avg((z - y) * (z - y))', 'mse')}, {_r('avg(CAST(z * y > 0 AS DOUBLE))', 'hits')},
  {_r('exp(sum(ln(1 + greatest(sign(z) * y, -0.99::DOUBLE)))) - 1', 'total_return')}, {_r(_SHARPE.format('greatest(sign(z) * y, -0.99::DOUBLE)'), 'sharpe')} FROM pr WHERE z IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def wf_refit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.refit_metrics(L.refitted(_refit_panel(spark, d), ["f1", "f2"], "y", 126, 42, 21), "y"), 5)


# ---------------------------------------------------------------- rollups by symbol and year
_SHARE = "round(100.0 * count(*) FILTER (WHERE signal_value {}) / count(*) + {}, 6)"


_NAMED = "coalesce(symbol, 'all') AS symbol, coalesce(year, 0) AS year, * EXCLUDE (symbol, year)"


@register("signal_rollup", f"""WITH {', '.join([BASE, *_sg])} SELECT {_NAMED} FROM (SELECT symbol, CAST(year(ts) AS INTEGER) AS year, CAST(grouping_id(symbol, year(ts)) AS INTEGER) AS level, count(*) AS total,
  count(*) FILTER (WHERE signal_value > 0) AS buys, count(*) FILTER (WHERE signal_value < 0) AS sells, count(*) FILTER (WHERE signal_value = 0) AS holds, count(*) FILTER (WHERE abs(signal_value) = 2) AS strong, count(*) FILTER (WHERE confidence > 0.7) AS high_confidence,
  {_r('avg(confidence)', 'avg_confidence', 6)}, {_r('avg(ml)', 'avg_ml_probability', 6)}, {_r('avg(mood)', 'avg_sentiment', 6)}, {_r('avg(combined)', 'avg_combined', 6)}, {_r('avg(technical_score)', 'avg_technical', 6)}, {_r('avg(risk_reward_ratio)', 'avg_risk_reward', 6)},
  {_SHARE.format('> 0', NUDGE)} AS buy_pct, {_SHARE.format('< 0', NUDGE)} AS sell_pct, {_SHARE.format('= 0', NUDGE)} AS hold_pct FROM x8 GROUP BY ROLLUP (symbol, year(ts)))""")
def signal_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.rolled_up(signalled(spark, d)).na.fill({"symbol": "all", "year": 0}))


@register("trade_rollup", f"""{_tr} SELECT {_NAMED} FROM (SELECT symbol, CAST(year(entry_ts) AS INTEGER) AS year, CAST(grouping_id(symbol, year(entry_ts)) AS INTEGER) AS level, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS won, count(*) FILTER (WHERE pnl < 0) AS lost,
  {_r('coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0)', 'avg_win', 4)}, {_r('coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0)', 'avg_loss', 4)}, {_r('coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / coalesce(abs(sum(pnl) FILTER (WHERE pnl < 0)), 1)', 'profit_factor', 4)},
  {_r('avg(pnl)', 'expectancy', 4)}, {_r('count(*) FILTER (WHERE pnl > 0) / count(*)', 'win_rate', 4)} FROM td GROUP BY ROLLUP (symbol, year(entry_ts)))""")
def trade_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.trades_rolled_up(P.trades(pathed(spark, d))).na.fill({"symbol": "all", "year": 0}), 4)


# ---------------------------------------------------------------- filings and posts at every bar, ownership reports
_BRANDS = "'Brand#' || (1 + o_custkey % 25 // 5) || (1 + o_custkey % 5)"
_TEXTS = "CASE o_orderkey % 3 WHEN 0 THEN 'Item 1.01 and Item 2.02' WHEN 1 THEN 'Item 2.06' ELSE 'Item 5.02; Item 9.01' END"


@register("filing_events_on_bars", f"""WITH {BRAND},
  fl AS (SELECT {_BRANDS} AS symbol, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderkey AS VARCHAR) AS accession, {_TEXTS} AS text FROM orders WHERE o_orderkey % 4 = 1),
  rc AS (SELECT b.symbol, b.ts, f.filed, f.text, row_number() OVER (PARTITION BY b.symbol, b.ts ORDER BY f.filed DESC, f.accession) AS i FROM bars b JOIN fl f ON f.symbol = b.symbol AND f.filed <= CAST(b.ts AS DATE)),
  ev AS (SELECT symbol, ts, count(*) FILTER (WHERE contains(text, '1.01') OR contains(text, '5.02')) AS events, count(*) FILTER (WHERE contains(text, '2.02')) AS earnings FROM rc WHERE i <= 5 AND filed >= CAST(ts AS DATE) - 30 GROUP BY 1, 2)
  SELECT b.symbol, b.ts, coalesce(events, 0) AS recent_events, coalesce(earnings, 0) AS recent_earnings FROM bars b LEFT JOIN ev ON ev.symbol = b.symbol AND ev.ts = b.ts""")
def filing_events_on_bars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("symbol").cast("int")
    filings = _filings(spark, d).drop("symbol").join(B.load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), (F.col("o_custkey") % 25).alias("symbol")), "accession")
    filings = filings.withColumn("symbol", F.concat(F.lit("Brand#"), (1 + F.floor(k / 5)).cast("string"), (1 + k % 5).cast("string")))
    return A.events_on_bars(B.brand_week(spark, d), filings).select("symbol", "ts", "recent_events", "recent_earnings")


_KINDS = ["click", "error", "purchase", "signup", "view"]
_SOCIAL = ["mentions", "weighted", "bullish_ratio", "trending", "hype", "social_signal"]
_POST = _POSTS.replace("SELECT role AS symbol, DATE '2024-01-01' + CAST(conv_id % 40 AS INTEGER)", f"SELECT [{', '.join(repr(x) for x in _KINDS)}][1 + conv_id % 5] AS symbol, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER)")


@register("social_on_bars", f"""WITH {_EVENTS}, {_POST},
  so AS (SELECT symbol, day, n AS mentions, coalesce(sw / nullif(w, 0), 0) AS weighted, b::DOUBLE / n AS bullish_ratio, CAST(n > 10 AND sc::DOUBLE / n > 100 AS INTEGER) AS trending, least(n / 50.0::DOUBLE, 1) AS hype FROM pt)
  SELECT b.symbol, b.ts, CAST(coalesce(mentions, 0) AS BIGINT) AS mentions, {_r('coalesce(weighted, 0)', 'weighted', 6)}, {_r('coalesce(bullish_ratio, 0)', 'bullish_ratio', 6)}, coalesce(trending, 0) AS trending, {_r('coalesce(hype, 0)', 'hype', 6)},
    {_r('coalesce(0.5 * weighted + 0.3::DOUBLE * (bullish_ratio - 0.5) + 0.2::DOUBLE * hype, 0)', 'social_signal', 6)} FROM bars b ASOF LEFT JOIN so ON so.symbol = b.symbol AND b.ts >= so.day""")
def social_on_bars(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    symbol = F.array(*[F.lit(x) for x in _KINDS])[(F.col("conv_id") % 5).cast("int")]
    posts = B.load(spark, d, "conversations").select(symbol.alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("day"), n.cast("long").alias("score"), F.col("turn").alias("comments"), ((n % 21 - 10) / 10.0).alias("sentiment"))
    return rounded(A.on_bars(B.event_hour(spark, d), A.social_daily(posts), _SOCIAL).select("symbol", "ts", *_SOCIAL))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ownership reports, one a customer; every seventh lacks its end."""
    k = F.col("o_orderkey")
    tag = lambda name, x: F.concat(F.lit(f"<{name}><value>"), x.cast("string"), F.lit(f"</value></{name}>"))
    code = F.coalesce(F.get(F.array(*[F.lit(x) for x in "PSADFMCG"]), (k % 9).cast("int")), F.lit("Z"))
    amounts = F.concat(tag("transactionShares", F.floor(F.col("o_totalprice") / 100)), F.when(k % 50 > 0, tag("transactionPricePerShare", k % 50)).otherwise(F.lit("")))
    after = F.when(k % 3 > 0, F.concat(F.lit("<postTransactionAmounts>"), tag("sharesOwnedFollowingTransaction", k % 1000), F.lit("</postTransactionAmounts>"))).otherwise(F.lit(""))
    one = F.concat(F.lit("<nonDerivativeTransaction>"), tag("transactionDate", F.to_date("o_orderdate")), F.lit("<transactionCoding><transactionCode>"), code, F.lit("</transactionCode></transactionCoding><transactionAmounts>"), amounts, F.lit("</transactionAmounts>"), after, F.lit("</nonDerivativeTransaction>"))
    who = F.col("o_custkey")
    head = F.concat(F.lit('<?xml version="1.0"?><ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>'), who.cast("string"), F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>"), (who % 2).cast("string"), F.lit("</isDirector>"), F.when(who % 5 == 0, F.lit("<officerTitle>CEO</officerTitle>")).otherwise(F.lit("")), F.lit("</reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"))
    whole = B.load(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws("", F.collect_list(one)).alias("t"))
    return whole.select(who.alias("cik"), F.concat(head, F.col("t"), F.lit("</nonDerivativeTable>"), F.when(who % 7 > 0, F.lit("</ownershipDocument>")).otherwise(F.lit(""))).alias("xml"))


@register("ownership_table", f"""SELECT CAST(o_custkey AS VARCHAR) AS filer, CASE WHEN o_custkey % 5 = 0 THEN 'CEO' WHEN o_custkey % 2 = 1 THEN 'Director' ELSE 'Other' END AS relation,
  coalesce(['Buy', 'Sell', 'Grant', 'Disposition', 'Tax Payment', 'Option Exercise', 'Conversion', 'Gift'][1 + o_orderkey % 9], 'Z') AS kind, count(*) AS transactions, CAST(sum(floor(o_totalprice / 100)) AS BIGINT) AS shares,
  {_r('sum(floor(o_totalprice / 100) * (o_orderkey % 50))', 'value', 2)}, CAST(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 1000 ELSE 0 END) AS BIGINT) AS shares_after, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1, 2, 3""")
def ownership_table(spark: SparkSession, d: str) -> DataFrame:
    t = A.ownership(_reports(spark, d)).groupBy("filer", "relation", "kind").agg(F.count("*").alias("transactions"), F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.sum("shares_after").alias("shares_after"), F.min("day").alias("first_day"))
    return rounded(t, 2)


# ---------------------------------------------------------------- confirmations of candles, order statistics by blocks
_two = lambda name, m: f"CASE WHEN {name} <> 0 THEN {{'at': seq, 'side': sign({name}), 'level': CASE WHEN {name} > 0 THEN {lag('high')} ELSE {lag('low')} END}} END"
_hk = stage("hk", "base", h1=lag("high"), l1=lag("low"), h2=lag("high", 2), l2=lag("low", 2), h3=lag("high", 3), l3=lag("low", 3), c1=lag("close"), mr1=f"CASE WHEN count(*) {over(-11, -2)} = 10 THEN avg(high - low) {over(-11, -2)} END")
_hm = stage("hm", "hk", a="CASE WHEN h1 < h2 AND l1 > l2 AND high < h1 AND low < l1 THEN 100 WHEN h1 < h2 AND l1 > l2 AND high > h1 AND low > l1 THEN -100 ELSE 0 END", b="CASE WHEN h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND c1 <= l1 + 0.2::DOUBLE * mr1 AND high < h1 AND low < l1 THEN 100 WHEN h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND c1 >= h1 - 0.2::DOUBLE * mr1 AND high > h1 AND low > l1 THEN -100 ELSE 0 END")
_hn = stage("hn", "hm", pa=_two("a", 0), pb=_two("b", 0))
_walked = lambda p, s: f"""list_reduce(list_prepend({{'v': 0::DOUBLE, 'at': -9::BIGINT, 'side': 0::DOUBLE, 'level': 0::DOUBLE}}, list({{'v': {s}::DOUBLE, 'at': coalesce({p}.at, seq), 'side': close, 'level': coalesce({p}.level, 0)}}) {over('all')}),
  lambda m, x: CASE WHEN x.v <> 0 THEN {{'v': x.v, 'at': x.at, 'side': sign(x.v), 'level': x.level}} WHEN x.at <= m.at + 3 AND m.side * (x.side - m.level) > 0 THEN {{'v': 200 * m.side, 'at': -9::BIGINT, 'side': 0::DOUBLE, 'level': 0::DOUBLE}} ELSE {{'v': 0::DOUBLE, 'at': m.at, 'side': m.side, 'level': m.level}} END).v"""  # noqa: E731
_ho = stage("ho", "hn", cdl_hikkake=_walked("pa", "a"), cdl_hikkakemod=_walked("pb", "b"))


@register("candles_confirmed", sql([_hk, _hm, _hn, _ho], ["cdl_hikkake", "cdl_hikkakemod"], "ho", ints=("cdl_hikkake", "cdl_hikkakemod")))
def candles_confirmed(spark: SparkSession, d: str) -> DataFrame:
    return K.confirmed(B.brand_week(spark, d))


@register("rank_shares", sql([*ranked("o1", "base", "close_rank_100", "close", 100), *ranked("o2", "o1b", "volume_rank_252", "volume", 252, 100.0)], ["close_rank_100", "volume_rank_252"], "o2b"))
def rank_shares(spark: SparkSession, d: str) -> DataFrame:
    b = based(spark, d)
    a, v = O.rank_shares(b, {"close_rank_100": "close"}, 100), O.rank_shares(b, {"volume_rank_252": "volume"}, 252)
    return rounded(a.join(v, ["symbol", "ts"]).withColumn("volume_rank_252", 100 * F.col("volume_rank_252")))


# ---------------------------------------------------------------- models without SQL: a text scorer as the third of the ensemble, boosters with early stop
@register("text_ensemble_model")
def text_ensemble_model(spark: SparkSession, d: str) -> DataFrame:
    docs = B.load(spark, d, "documents").select("doc_id", "text")
    labelled = docs.join(B.load(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    scored = E.text_scores(E.text_scorer(labelled), docs).drop("text").join(_scored(spark, d), "doc_id")
    score, label, sure = X.ensemble({"a": F.col("compound"), "b": F.col("polarity"), "c": F.col("model_score")}, {"a": 0.4, "b": 0.2, "c": 0.4})
    return rounded(scored.select("doc_id", "model_score", "model_confidence", score.alias("score"), label.alias("label"), sure.alias("confidence")))


@register("regression_stack")
def regression_stack(spark: SparkSession, d: str) -> DataFrame:
    b = technical.momentum(based(spark, d)).withColumn("target", F.lead("r").over(series()))
    names = ["r", "rsi_sma", "roc", "stoch_k", "willr"]
    rows = b.where("target is not null").na.drop(subset=names).select("symbol", "ts", "target", *names)
    out, _ = E.stacked_regression(rows, names)
    return rounded(out.select("symbol", "ts", "is_train", *[f"p_{x}" for x in E.BOOSTERS], "p", "p_weighted"))
