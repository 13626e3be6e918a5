"""Scans by blocks, refitted models, streams with state, confirmed candles, order statistics, ownership reports, and cases that tell rules apart."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def bars(spark, closes, symbol="x", spread=1.0, start="2024-01-01"):
    rows = [(symbol, (pd.Timestamp(start) + pd.Timedelta(days=i)).to_pydatetime(), float(c), float(c) + spread, float(c) - spread, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def numbers(seed, n):
    return 100 + np.random.default_rng(seed).standard_normal(n).cumsum()


# ---- position ledger as a stream
def test_ledger_stream_equals_the_batch_ledger(spark, tmp_path):
    from tidemill.operators.backtest import LedgerConfig, ledger, ledger_states
    from tidemill.streaming.live import live_ledger

    rng = np.random.default_rng(1)
    rows = [{"symbol": s, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), "close": float(p), "signal_value": int(v)} for s in "ab" for i, (p, v) in enumerate(zip(numbers(ord(s), 60), rng.integers(-1, 2, 60), strict=True))]
    schema = "symbol string, ts timestamp, close double, signal_value int"
    frame = spark.createDataFrame(pd.DataFrame(rows), schema)
    cfg = LedgerConfig(stop_loss=0.01, take_profit=0.02)
    want = {(r["symbol"], r["ts"]): (r["equity"], r["side"], r["trade_pnl"]) for r in ledger(frame, {"one": cfg}).collect()}
    cut = lambda lo, hi: [r for r in rows if lo <= (r["ts"] - pd.Timestamp("2024-01-01")).days < hi]
    start = ledger_states(spark.createDataFrame(pd.DataFrame(cut(0, 20)), schema), cfg)
    folder = tmp_path / "in"
    folder.mkdir()
    got = []
    for turn, (lo, hi) in enumerate([(20, 35), (35, 36), (36, 60)]):  # a new query each time, on the same checkpoint
        pd.DataFrame(cut(lo, hi)).to_json(folder / f"{turn}.json", orient="records", lines=True, date_format="iso")
        out = live_ledger(spark.readStream.schema(schema).json(str(folder)), cfg, start)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 80
    for r in got:
        equity, side, pnl = want[r["symbol"], r["ts"]]
        assert r["equity"] == pytest.approx(equity) and r["side"] == side and (r["trade_pnl"] == pytest.approx(pnl) if pnl is not None else r["trade_pnl"] is None)


# ---- scans by blocks
def test_scans_against_a_walk(spark):
    from tidemill.operators import recursive
    from tidemill.plans import scan

    panel = bars(spark, numbers(3, 700)).union(bars(spark, numbers(4, 30), "short")).union(bars(spark, [5] * 3, "tiny"))
    want = recursive.recursive(panel).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for block, seconds in ((256, 1 << 22), (16, 86_400 * 7), (64, 1 << 30)):
        got = recursive.core_by_blocks(panel, block, seconds).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
        for x in recursive.BLOCKED:
            np.testing.assert_allclose(got[x].astype(float), want[x].astype(float), rtol=1e-9, atol=1e-9, err_msg=x)
    one = recursive.with_macd_hist(panel.withColumn("seq", F.row_number().over(__import__("tidemill.plans.windows", fromlist=["series"]).series())))
    close = one.where("symbol = 'x'").orderBy("ts").toPandas()
    ewm = lambda s, n: s.ewm(span=n).mean()
    macd = ewm(close["close"], 12) - ewm(close["close"], 26)
    np.testing.assert_allclose(close["macd_hist_adj"], macd - ewm(macd, 9), rtol=1e-9, atol=1e-9)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Python" not in plan and "Join" not in plan
    with pytest.raises(ValueError):
        scan.smoothed(one, {"y": scan.Chain("close", 1e-9)})


def test_a_symbol_runs_in_many_tasks(spark):
    from tidemill.plans import scan

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join these few rows in one task
    b = scan.by_blocks(scan.numbered(bars(spark, numbers(5, 400)).select("symbol", "ts", "high", "low", "close"), seconds=86_400 * 30), {"y": scan.ema("close", 10)}, 32)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(symbol#" in plan and "_block#" in plan
    rows = b.select("symbol", F.floor((F.col("seq") - 1) / 32).alias("k"), F.spark_partition_id().alias("p")).groupBy("symbol").agg(F.countDistinct("p").alias("parts")).first()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows["parts"] > 1


# ---- models fitted anew in every window
def test_refits_against_single_fits(spark):
    from tidemill.operators import refit
    from tidemill.plans.windows import series

    rng = np.random.default_rng(7)
    n = 300
    x = rng.standard_normal((n, 3)) + 50
    y = x @ [1.0, -2.0, 0.5] + 7 + rng.standard_normal(n)
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), float(y[i]) if i % 17 else None) for i in range(n)]
    rows += [("b", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None, 1.0, 1.0, 1.0) for i in range(n)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp, u double, v double, w double, y double").withColumn("seq", F.row_number().over(series()))
    for alpha in (0.0, 3.0):
        got = refit.solved(refit.normal_equations(b, ["u", "v", "w"], "y", 100, 30, 20, gap=2), alpha).toPandas()
        a = got[got.symbol == "a"].sort_values("window_id").reset_index(drop=True)
        assert list(a.window_id) == list(range((n - 130) // 20 + 1)) and got[got.symbol == "b"]["intercept"].isna().all()
        for k, r in a.iterrows():
            part = [i for i in range(k * 20, k * 20 + 98) if i % 17]
            xs, ys = x[part] - x[part].mean(0), y[part] - y[part].mean()
            beta = np.linalg.solve(xs.T @ xs + alpha * np.eye(3), xs.T @ ys)
            np.testing.assert_allclose(r["coefficients"], beta, rtol=1e-7)
            assert r["n"] == len(part) and r["intercept"] == pytest.approx(y[part].mean() - beta @ x[part].mean(0), rel=1e-6)
    scored = refit.refitted(b, ["u", "v", "w"], "y", 100, 30, 20)
    assert scored.where("symbol = 'a'").count() == 9 * 30 and scored.where("symbol = 'b' and prediction is not null").count() == 0


# ---- candles
def test_confirmations(spark):
    from tidemill.operators.candles import confirmed

    base = [(10.0, 12.0, 8.0, 11.0)] * 12
    inside = [(10.0, 11.5, 9.0, 10.5)]  # within the bar before
    pattern = [(10.0, 11.0, 8.5, 9.0)]  # lower high and low: bullish, level 11.5
    flat, over_ = (9.0, 11.2, 8.6, 9.0), (9.0, 13.0, 9.0, 12.0)

    def values(tail):
        rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), *map(float, r), 1.0) for i, r in enumerate(base + inside + pattern + tail)]
        got = confirmed(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")).orderBy("ts").collect()
        return [r["cdl_hikkake"] for r in got][13:]

    assert values([over_, over_]) == [100, 200, 0]
    assert values([flat, flat, over_])[:1] == [100] and values([flat, flat, over_])[-1] == 200
    assert values([flat, flat, flat, over_])[-1] == 0


# ---- order statistics
def test_rank_shares(spark):
    from tidemill.plans.order import rank_shares, window_ranks
    from tidemill.plans.windows import rank_share, series

    b = bars(spark, np.round(numbers(6, 130))).union(bars(spark, range(7), "few"))
    b = b.withColumn("seq", F.row_number().over(series())).withColumn("holed", F.when(F.col("seq") % 40 != 0, F.col("close")))
    want = {(r["symbol"], r["ts"]): r["w"] for r in b.withColumn("w", rank_share("close", 20)).collect()}
    got = rank_shares(b, {"w": "close", "h": "holed"}, 20).collect()
    assert {(r["symbol"], r["ts"]): r["w"] for r in got} == want
    known = [r["h"] is not None for r in sorted(got, key=lambda r: r["ts"]) if r["symbol"] == "x"]
    assert known == [i >= 19 and not any((j + 1) % 40 == 0 for j in range(i - 19, i + 1)) for i in range(130)]
    assert window_ranks(np.array([3.0, 1.0, 2.0, 2.0]), 1, 3)[0].tolist() == [-1, 1, 1]


# ---- reports, feeds, filings
def test_reports_and_their_fields(spark):
    from tidemill.operators.alternative import ownership, reports

    one = "<nonDerivativeTransaction><transactionDate><value>2024-01-05</value></transactionDate><transactionCoding><transactionCode>{}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{}</value></transactionShares></transactionAmounts>{}</nonDerivativeTransaction>"
    after = "<postTransactionAmounts><sharesOwnedFollowingTransaction><value>900.0</value></sharesOwnedFollowingTransaction></postTransactionAmounts>"
    head = "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>A &amp; B</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>true</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>"
    tail = "</nonDerivativeTable></ownershipDocument>"
    texts = [head + one.format("A", "10.7", after) + one.format("F", "5", "") + one.format("M", "x", "") + tail, head + one.format("P", "1", ""), "no report", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, xml string")
    got = ownership(df, keep=("id",)).collect()
    assert [(r["id"], r["filer"], r["relation"], r["kind"], r["shares"], r["shares_after"], r["value"]) for r in got] == [(0, "A & B", "Director", "Grant", 10, 900, 0.0), (0, "A & B", "Director", "Tax Payment", 5, 0, 0.0), (0, "A & B", "Director", "Option Exercise", 0, 0, 0.0)]
    assert {r["id"]: r["malformed"] is not None for r in reports(df, keep=("id",)).collect()} == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_many_names_in_a_feed(spark):
    from tidemill.operators.alternative import about

    names = [(f"S{i}", f"company number {i} ") for i in range(10_000)] + [("TWIN", "Company number 7 ")]
    articles = spark.createDataFrame([(1, "News of COMPANY number 7 and s9999."), (2, None), (3, "nothing")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["symbol"]) for r in about(articles, names).collect())
    assert got == [(1, "S7"), (1, "S9"), (1, "S99"), (1, "S999"), (1, "S9999"), (1, "TWIN")]


def test_filings_at_every_bar(spark):
    from tidemill.operators.alternative import events_on_bars

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rng = np.random.default_rng(2)
    rows = [(rng.choice(["a", "b"]), rng.choice(["8-K", "4"]), day(int(rng.integers(0, 90))), str(i), [["1.01"], ["2.02", "5.02"], ["2.02"], ["9.01"], None][rng.integers(5)]) for i in range(120)]
    rows = [(str(s), str(f), d, a, x) for s, f, d, a, x in rows]
    got = events_on_bars(bars(spark, range(100), "a").union(bars(spark, range(100), "none")), spark.createDataFrame(rows, "symbol string, form string, filed date, accession string, items array<string>")).collect()
    for r in got:
        at = r["ts"].date()
        latest = sorted((x for x in rows if x[0] == r["symbol"] and x[1] == "8-K" and x[2] <= at), key=lambda x: (-x[2].toordinal(), x[3]))[:5]
        live = [x[4] or [] for x in latest if (at - x[2]).days <= 30]
        assert (r["recent_events"], r["recent_earnings"]) == (sum(bool({"1.01", "5.02"} & set(x)) for x in live), sum("2.02" in x for x in live)), at


# ---- cases that tell the rules apart
def test_insiders_by_value(spark):
    from tidemill.operators.text import insider_activity

    tx = spark.createDataFrame([("f", "Buy", 1, 10.0, "CEO"), ("f", "Buy", 2, 10.0, "x"), ("f", "Sell", 50, 1000.0, "x"), ("g", "Other", 1, 5.0, "x")], "filer string, kind string, shares long, value double, relation string")
    got = {r["filer"]: r for r in insider_activity(tx).collect()}
    assert got["f"]["sentiment"] == pytest.approx(-980 / 1020) and got["f"]["net_shares"] == -47 and got["f"]["transactions"] == 3 and got["g"]["sentiment"] == 0.0


def test_thresholds_are_strict(spark):
    from tidemill.operators.text import daily_sentiment, ensemble

    scored = spark.createDataFrame([(1, "s", 1, 0.15, 1.0), (2, "s", 1, -0.15, 1.0), (3, "s", 1, 0.16, 1.0)], "doc_id int, symbol string, day int, score double, confidence double")
    r = daily_sentiment(scored).first()
    assert (r["bullish"], r["bearish"], r["neutral"]) == (1, 0, 2)
    labels = [x["l"] for x in scored.select(ensemble({"a": F.col("score")}, {"a": 1.0})[1].alias("l")).collect()]
    assert labels == ["neutral", "neutral", "bullish"]


def trades(spark, pnls):
    rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * i), dt.datetime(2024, 1, 3) + dt.timedelta(days=3 * i), float(p)) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, entry_ts timestamp, exit_ts timestamp, pnl double")


def test_trades_without_profit_are_not_lost(spark):
    from tidemill.operators.backtest import trade_stats

    r = trade_stats(trades(spark, [1, 0, -2])).first()
    assert (r["won"], r["lost"], r["avg_loss"], r["avg_win_days"], r["recovery_factor"]) == (1, 1, -2.0, 2, -0.5)
    only = trade_stats(trades(spark, [3, 4])).first()
    assert (only["avg_loss"], only["profit_factor"], only["recovery_factor"]) == (0.0, 7.0, None)


def test_a_losing_run_is_significant(spark):
    from tidemill.operators.backtest import bootstrap, shuffle_test

    r = bootstrap(trades(spark, [-20 - i % 3 for i in range(20)]), 200).first()
    assert r["p_value"] == 0.0 and r["significant"] and r["high"] < 0 and r["original"] == sum(-20 - i % 3 for i in range(20))
    one = bootstrap(trades(spark, [5]), 50).first()
    assert one["p_value"] == 1.0 and not one["significant"] and (one["low"], one["high"]) == (0.0, 0.0)
    s = shuffle_test(trades(spark, [100, -50, 100, -50]), 50).first()
    assert s["actual"] == pytest.approx(50 / 100) and s["sharpe_std"] == 0.0 and s["is_robust"] == (abs(s["dependency"]) < 0.5)


def test_only_whole_slices_count(spark):
    from tidemill.operators.backtest import slice_metrics, slices
    from tidemill.plans.windows import series

    b = bars(spark, numbers(9, 259)).withColumn("seq", F.row_number().over(series())).withColumn("signal_value", F.lit(1))
    kept = slices(b, 126, 42)
    assert kept.agg(F.max("slice_id"), F.count("*")).first() == (2, 126)
    r = slice_metrics(kept).first()
    close = numbers(9, 259)
    totals = [close[k + 41] / close[k] - 1 for k in (126, 168, 210)]
    assert r["slices"] == 3 and r["mean_return"] == pytest.approx(np.mean(totals)) and r["std_return"] == pytest.approx(np.std(totals))


def test_the_first_bar_has_no_return(spark):
    from tidemill.operators.backtest import performance, position_path, with_equity

    close = [100, 110, 99, 120, 118]
    r = performance(with_equity(position_path(bars(spark, close).withColumn("signal_value", F.lit(1))))).first()
    x = pd.Series(close, dtype=float).pct_change().dropna()
    assert r["sharpe"] == pytest.approx(252**0.5 * x.mean() / x.std()) and r["max_drawdown_bars"] == 1
    flat = performance(with_equity(position_path(bars(spark, [5, 5, 5]).withColumn("signal_value", F.lit(0))))).first()
    assert (flat["sharpe"], flat["sortino"]) == (0.0, 0.0)


def test_notes(spark):
    from tidemill.operators.signals import notes

    cases = [(0.71, 0.2, 20.0, 41.0), (0.29, -0.2, 75.0, 26.0), (0.5, 0.1, 50.0, 25.0), (None, None, None, None)]
    got = [r["notes"] for r in notes(spark.createDataFrame(cases, "ml_probability double, sentiment_score double, rsi_sma double, adx_sma double").coalesce(1)).collect()]
    assert got[0] == ["Strong ML bullish signal (71.00%)", "Positive news sentiment (+0.20)", "RSI oversold (20.0)", "Very strong trend (ADX=41.0)"]
    assert got[1] == ["Strong ML bearish signal (29.00%)", "Negative news sentiment (-0.20)", "RSI overbought (75.0)", "Strong trend (ADX=26.0)"]
    assert got[2] == [] and got[3] == []


def test_dates_of_feeds(spark):
    from tidemill.operators.text import parse_dates

    cases = ["Tue, 02 Jan 2024 10:00:00 -0500", "Tue, 2 Jan 2024 10:00:00 GMT", " 2024-01-02T10:00:00.25Z ", "2024-01-02 10:00:00", "2 Jan", "", None]
    got = [r["d"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, t string").orderBy("i").select(parse_dates(F.col("t")).alias("d")).collect()]
    ten = dt.datetime(2024, 1, 2, 10)
    assert got == [ten, ten, ten.replace(microsecond=250_000), ten, None, None, None]


def test_features_on_a_few_bars(spark):
    """Against the rules written out bar by bar."""
    from tidemill.operators import statistical as S
    from tidemill.operators import technical

    rng = np.random.default_rng(12)
    close = numbers(12, 300)
    rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(c + rng.normal()), float(c + 2 + rng.random()), float(c - 2 - rng.random()), float(c), float(rng.integers(50, 200))) for i, c in enumerate(close)]
    b = technical.base(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))
    p = pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])
    c, h, lo, v = p.close, p.high, p.low, p.volume
    r = c.pct_change()

    def same(df, names):
        got = df.orderBy("ts").toPandas()
        for name, want in names.items():
            np.testing.assert_allclose(got[name].astype(float), np.asarray(want, float), rtol=1e-8, atol=1e-8, err_msg=name)

    same(S.factors(b), {"ts_momentum_20": c / c.rolling(20).mean() - 1, "momentum_quality_50": (r > 0).rolling(50).sum() / 50, "momentum_acceleration": (c / c.shift(21) - 1).diff(), "pct_from_52w_high": c / c.rolling(252).max() - 1, "momentum_breadth": sum((c > c.rolling(n).mean()).astype(int) for n in (20, 50, 100, 200)) / 4})
    d = c.diff()
    delta = np.where(d > 0, v, 0) - np.where(d < 0, v, 0)
    ease = ((h + lo) / 2).diff() / (v / 1e6 / (h - lo + 1e-10))
    same(S.flow(b), {"volume_delta": delta, "cum_volume_delta": delta.cumsum(), "pvt": (r * v).cumsum(), "ease_of_movement": ease, "intraday_intensity": (2 * c - h - lo) / (h - lo + 1e-10) * v})

    def entropy(x):
        hist, _ = np.histogram(x, bins=10, density=True)
        hist = hist[hist > 0]
        return -np.sum(hist * np.log2(hist + 1e-10))

    same(S.chaos(b), {"price_entropy": r.rolling(20).apply(entropy, raw=True)})
    std = lambda x, n: x.rolling(n).std()
    rv = std(r, 20)
    same(S.volatilities(b), {"parkinson_volatility": np.sqrt((np.log(h / lo) ** 2).rolling(20).mean() / (4 * np.log(2))), "vol_persistence": rv.rolling(5).mean() / (rv.rolling(50).mean() + 1e-10)})
    same(S.proxies(b), {"put_call_proxy": ((r < 0).astype(int) * (v > v.rolling(20).mean()).astype(int)).rolling(10).mean(), "skew_proxy": std(pd.Series(np.where(r < 0, r, 0)), 20) / (std(pd.Series(np.where(r > 0, r, 0)), 20) + 1e-10), "liquidity_proxy": v.rolling(20).mean() / (rv * c + 1e-10)})
    pivot = (h.shift() + lo.shift() + c.shift()) / 3
    same(S.levels(b), {"dist_to_pivot": (c - pivot) / c, "dist_to_s1": (c - (2 * pivot - h.shift())) / c, "price_position": (c - lo.rolling(20).min()) / (h.rolling(20).max() - lo.rolling(20).min() + 1e-10)})
    m = {n: c.rolling(n).mean() for n in (20, 50, 100)}
    same(S.relations(b), {"trend_regime": sum(x.astype(int) for x in (c > m[20], c > m[50], c > m[100], m[20] > m[50], m[50] > m[100])), "range_lag_2": ((h - lo) / c).shift(2)})
    low, high = c.rolling(20).min(), c.rolling(20).max()
    same(S.rolling(b, 20), {"rolling_20_range_pct": (c - low) / (high - low + 1e-8)})


def test_the_walked_indicators_against_plain_loops(spark):
    """Accumulation oscillator, volatility flag and parabolic stop of recursive(), each written out again from its published rule."""
    from tidemill.operators import recursive

    rng = np.random.default_rng(8)
    close = numbers(8, 200)
    high, low, volume = close + rng.random(200) * 3, close - rng.random(200) * 3, rng.integers(10, 99, 200).astype(float)
    high[50] = low[50] = close[50]
    rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(close[i]), float(high[i]), float(low[i]), float(close[i]), float(volume[i])) for i in range(200)]
    got = recursive.recursive(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")).orderBy("ts").toPandas()

    line, fast, slow, adosc = 0.0, None, None, []
    for i in range(200):
        if high[i] > low[i]:
            line += ((close[i] - low[i]) - (high[i] - close[i])) / (high[i] - low[i]) * volume[i]
        fast = line if fast is None else fast + (line - fast) * 2 / 4
        slow = line if slow is None else slow + (line - slow) * 2 / 11
        adosc.append(fast - slow if i >= 9 else np.nan)
    np.testing.assert_allclose(got["adosc"], adosc, rtol=1e-9, atol=1e-7)

    atr = got["atr"].astype(float)
    assert (got["high_volatility"] == (atr > 1.5 * atr.rolling(50).mean()).astype(int)).all()

    # the stop follows the extreme with a growing share; it never enters the range of the last two bars, and the side turns when the bar meets it
    rising = not (low[0] - low[1] > 0 and low[0] - low[1] > high[1] - high[0])
    point, share, stop = (high[1] if rising else low[1]), 0.02, (low[0] if rising else high[0])
    sar = [np.nan]
    for i in range(1, 200):
        met = low[i] <= stop if rising else high[i] >= stop
        if met:
            stop = max(point, high[i - 1], high[i]) if rising else min(point, low[i - 1], low[i])
            rising, share = not rising, 0.02
            sar.append(stop)
            point = high[i] if rising else low[i]
        else:
            sar.append(stop)
            better = high[i] > point if rising else low[i] < point
            if better:
                point, share = (high[i] if rising else low[i]), min(0.2, share + 0.02)
        stop += share * (point - stop)
        stop = min(stop, low[i - 1], low[i]) if rising else max(stop, high[i - 1], high[i])
    np.testing.assert_allclose(got["sar"], sar, rtol=1e-12, equal_nan=True)
    assert (got["sar_signal"] == np.where(close > np.nan_to_num(sar, nan=np.inf), 1, -1)).all()


def test_pattern_counts(spark):
    from tidemill.operators.candles import candles

    close = numbers(10, 250)
    rng = np.random.default_rng(10)
    rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(c + rng.normal()), float(c + 2 + rng.random()), float(c - 2 - rng.random()), float(c), 1.0) for i, c in enumerate(close)]
    got = candles(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")).toPandas()
    found = got[[x for x in got.columns if x.startswith("cdl_")]]
    assert (got["bullish_pattern_count"] == (found > 0).sum(axis=1)).all() and (got["bearish_pattern_count"] == (found < 0).sum(axis=1)).all()
    assert len(found.columns) == 61 and (found != 0).any().sum() > 10


def test_merged_on_one_panel_equals_the_join(spark):
    from tidemill.operators.alternative import merged, merged_panel

    rows = [("x", dt.datetime(2024, 1, 1 + i), v, d, s) for i, (v, d, s) in enumerate([(2, 1, 0.5), (-1, 1, 0.3), (0, 0, None), (1, -1, 1.0), (-2, None, 0.4)])]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp, signal_value int, direction int, strength double")
    one = merged_panel(b.select("symbol", "ts", "signal_value", F.struct("direction", "strength").alias("ensemble")))
    two = merged(b.select("symbol", "ts", "signal_value"), b.select("symbol", "ts", "direction", "strength"))
    pick = lambda df: [tuple(r) for r in df.select("ts", "strategy_signal", "score", "agree").orderBy("ts").collect()]
    assert pick(one) == pick(two)


def test_fitting_on_few_partitions(spark):
    """A panel is kept in as many partitions as its rows ask for, in order of its symbols and bars, whatever it came in."""
    from tidemill.operators import learning as E

    rows = spark.range(900).selectExpr("cast(id % 7 as string) AS symbol", "timestamp_seconds(id * 60) AS ts", "cast(id % 2 as int) AS target", "cast(id % 13 as double) AS a", "cast(id % 5 as double) AS b").repartition(40)
    kept = E.gathered(rows)
    assert kept.rdd.getNumPartitions() == 1 and kept.storageLevel.useMemory
    got = [tuple(r) for r in kept.collect()]
    assert got == sorted(map(tuple, rows.collect()), key=lambda r: r[:2])
    one, two = (E.stacked(rows.repartition(n), ["a", "b"], n_folds=2, gap=2, rounds=2, trees=2)[0].select("symbol", "ts", "p") for n in (3, 11))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_lexicon_without_a_shuffle_of_words(spark, data):
    """The words of all texts are not dealt out to meet the lexicon, nor by document and word to count them."""
    from tidemill import queries as Q

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = Q.doc_sentiment(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [word" not in plan and "BroadcastHashJoin [word" in plan
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(doc_id#" in plan and plan.count("keys=[doc_id#") and ", word#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
