"""Streams, sinks, stored models, and rules whose cases the tables lack."""

import pandas as pd
import pytest
from pyspark.sql import functions as F


def bars(spark, closes, symbol="x", spread=1.0):
    rows = [(symbol, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(c), float(c) + spread, float(c) - spread, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def streamed(spark, tmp_path, batches, schema, job, mode="append"):
    """The rows that a job gives over files that arrive one after the other."""
    folder, name = tmp_path / "in", f"t{abs(hash(str(tmp_path)))}"
    folder.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows).to_json(folder / f"{i}.json", orient="records", lines=True, date_format="iso")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    q = job(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_minimum_hold_across_batches(spark, tmp_path):
    from tidemill.operators.signals import minimum_hold
    from tidemill.streaming.live import live_hold

    values = {"a": [1, -1, 0, 1, 2, -1, 0, 0, 1, 1, -2, 0], "b": [0, 0, 1, 0, 0, 0, 0, 1, -1, 0, 0, 1]}
    rows = [{"symbol": s, "seq": i, "signal_value": v} for i in range(12) for s in values for v in [values[s][i]]]
    got = streamed(spark, tmp_path, [rows[:10], rows[10:18], rows[18:]], "symbol string, seq long, signal_value int", lambda s: live_hold(s, 5))
    whole = minimum_hold(spark.createDataFrame([(r["symbol"], r["seq"], r["signal_value"]) for r in rows], "symbol string, seq int, signal_value int"), 5, "signal_value").collect()
    assert {(r["symbol"], r["seq"]): r["signal_value"] for r in got} == {(r["symbol"], r["seq"]): r["signal_value"] for r in whole}


def test_news_streams(spark, tmp_path):
    from tidemill.streaming.live import fresh_news, trailing_sentiment

    day = lambda i: f"2024-01-{i:02d}T12:00:00Z"
    rows = [{"symbol": "a", "url": f"u{i % 4}", "ts": day(1 + i), "score": float(i)} for i in range(8)]
    schema = "symbol string, url string, ts timestamp, score double"
    (tmp_path / "n").mkdir()
    assert len(streamed(spark, tmp_path / "n", [rows[:4], rows[4:]], schema, lambda s: fresh_news(s, "30 days"))) == 4
    (tmp_path / "s").mkdir()
    got = streamed(spark, tmp_path / "s", [rows[:4], rows[4:]], schema, lambda s: trailing_sentiment(s, 3), "complete")
    ends = {str(r["ts"])[:10]: (r["score"], r["articles"]) for r in got}
    assert ends["2024-01-05"] == (2.0, 3) and ends["2024-01-02"] == (0.0, 1)


def test_sinks_and_models(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from tidemill.operators import learning as E
    from tidemill.sources import bars as B

    df = bars(spark, range(1, 21)).union(bars(spark, range(1, 4), "y"))
    assert B.last_features(df, 5).groupBy("symbol").count().orderBy("symbol").collect() == [("x", 5), ("y", 3)]
    B.write_csv(df.limit(2).withColumn("tags", F.array(F.lit("a"), F.lit("b"))), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["tags"] == "a; b"
    rows = df.withColumn("target", (F.col("close") > 10).cast("int"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["open", "volume"], outputCol="features"), RandomForestClassifier(labelCol="target", numTrees=3, seed=1)]).fit(rows)
    assert [x for x, _ in E.importances(model, ["open", "volume"])] == ["open", "volume"] and sum(v for _, v in E.importances(model, ["open", "volume"])) == pytest.approx(1)
    E.save([model, model], str(tmp_path / "m"))
    again = E.load(str(tmp_path / "m"), 2)
    assert E.score(again[1], rows.withColumn("_raw", F.lit(0)), "x").where("p_x > 0.5").count() == 10
    p = spark.range(1).select(E.probabilities(F.lit(0.25)).alias("p")).first()["p"]
    assert p == [0.75, 0.25]


def test_filings_by_company(spark):
    from tidemill.operators import text as X

    payload = '{"filings": {"recent": {"form": ["8-K", "4", "8-K", "8-K"], "filingDate": ["2024-01-04", "2024-01-03", "2024-01-02", "2024-01-01"], "accessionNumber": ["1", "2", "3", "4"], "items": ["2.02", "", "1.01", "5.02"]}}}'
    rows = spark.createDataFrame([("a", payload), ("b", payload)], "symbol string, payload string")
    got = X.filings_from_json(rows, forms=("8-K",), k=2, keep=("symbol",))
    assert sorted((r["symbol"], r["accession"]) for r in got.collect()) == [("a", "1"), ("a", "3"), ("b", "1"), ("b", "3")]
    events = X.filing_events(got, F.lit("2024-02-02").cast("date")).orderBy("symbol").collect()
    assert [(r["symbol"], r["recent_events"], r["recent_earnings"]) for r in events] == [("a", 0, 1), ("b", 0, 1)]


def test_signal_rules(spark):
    """The direction of a strong trend, bands at a tenth, a mean without direction, neutral news and the least confidence."""
    from tidemill.operators import signals as G

    base = {"adx_sma": 30.0, "plus_di_sma": 20.0, "minus_di_sma": 10.0, "rsi_sma": 50.0, "macd_hist_adj": 0.0, "bb_pct_sma": 0.15, "sma_20": 2.0, "sma_50": 1.0, "volume_ratio": 1.0, "atr_sma": 0.0, "close": 100.0, "ml_probability": 0.5, "sentiment": 0.0}
    cases = [{}, {"minus_di_sma": 30.0}, {"bb_pct_sma": 0.05}, {"bb_pct_sma": 0.95}, {"sma_20": 1.0}, {"volume_ratio": 2.0}, {"adx_sma": None}, {"macd_hist_adj": -1.0}]
    got = [r["technical_score"] for r in G.scored(spark.createDataFrame(pd.DataFrame([{**base, "i": i, **c} for i, c in enumerate(cases)])).replace(float("nan"), None)).orderBy("i").collect()]
    assert got == pytest.approx([0.65, 0.45, 0.75, 0.55, 0.55, 0.7, 0.55, 0.6])
    one = G.scored(spark.createDataFrame(pd.DataFrame([base]))).first()
    # model -1, news 0, rules 1: no agreement; a calm market
    assert one["confidence"] == pytest.approx((0 + 0 + 0.3 + 0 + 1) / 5) and one["combined"] == pytest.approx(0.25 + 0.1 + 0.3 * 0.65)
    assert str(G.sentiment_of(["x", "sentiment", "sentiment_weighted"])).count("sentiment_weighted") == 1


def test_ledger_stops_are_strict(spark):
    from tidemill.operators.backtest import LedgerConfig, ledger

    df = bars(spark, [100, 98, 97, 97]).withColumn("signal_value", F.when(F.col("close") == 100, 1).otherwise(0))
    out = ledger(df, {"a": LedgerConfig(stop_loss=0.02, take_profit=None)}).orderBy("ts").collect()
    assert [r["side"] for r in out] == [1, 1, 0, 0] and out[2]["trade_pnl"] == pytest.approx(-300)


def test_folds_keep_a_gap(spark):
    from tidemill.operators import learning as E
    from tidemill.operators import technical

    f = E.folds(technical.base(bars(spark, range(120))), 5, 7).toPandas()
    for k in range(1, 6):
        test, train = f[f.fold == k].seq, f[f.trains_from <= k].seq
        assert len(test) == 20 and train.max() == test.min() - 8


def test_tickers(spark):
    from tidemill.operators import text as X

    row = spark.createDataFrame([("$A AM UK FED buys $TSLA and NVDA, NASDAQ: GME xAB ABCDEF",)], "t string").select(X.tickers(F.col("t")).alias("x")).first()
    assert row["x"] == ["TSLA", "NVDA", "GME"]
