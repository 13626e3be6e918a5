"""Every registered market query against its SQL in DuckDB, and properties of the operators."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import queries as market

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(market.ORACLES))
def test_like_sql(spark, con, name):
    a, b = market.QUERIES[name](spark, DATA).toPandas(), con.sql(market.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    keys = [x for x in a.columns if not pd.api.types.is_float_dtype(a[x])] or list(a.columns)
    a, b = (x[list(a.columns)].sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for x in a.columns:
        if pd.api.types.is_float_dtype(a[x]) or pd.api.types.is_float_dtype(b[x]):
            np.testing.assert_allclose(a[x].astype(float), b[x].astype(float), rtol=1e-9, atol=2e-5, err_msg=x)
        else:
            assert (a[x].astype(str) == b[x].astype(str)).all(), x


@pytest.mark.parametrize("name", sorted(set(market.QUERIES) - set(market.ORACLES)))
def test_rows_without_sql(spark, name):
    assert market.QUERIES[name](spark, DATA).count() > 0


def bars(spark, closes, symbol="x", spread=1.0):
    rows = [(symbol, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(c), float(c) + spread, float(c) - spread, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_one_bar_constant_and_rising(spark):
    from tidemill.operators import recursive, statistical, technical

    panel = bars(spark, [5]).union(bars(spark, [7] * 60, "flat", 0.0)).union(bars(spark, range(1, 61), "up"))
    b = technical.base(panel)
    for f in (technical.trend, technical.momentum, technical.volatility, technical.volume, technical.derived, statistical.ratios, statistical.relations, statistical.regimes, statistical.chaos, statistical.flow, statistical.levels, statistical.reversion, statistical.factors, statistical.volatilities, statistical.proxies):
        assert f(b).count() == 121
    m = technical.momentum(b).where("symbol = 'up'").orderBy(F.desc("ts")).first()
    assert m["rsi_sma"] == 100.0 and m["stoch_fastk"] <= 100
    up = technical.trend(b).where("symbol = 'up'").orderBy(F.desc("ts")).first()
    assert up["aroon_up"] == 100.0 and up["sma_200"] is None
    flat = technical.momentum(b).where("symbol = 'flat'").orderBy(F.desc("ts")).first()
    assert flat["rsi_sma"] is None and flat["bop"] == 0.0
    r = recursive.recursive(panel)
    assert r.count() == 121 and r.where("rsi < 0 OR rsi > 100").count() == 0


def test_no_look_ahead(spark):
    from tidemill.operators import technical

    rng = np.random.default_rng(1)
    c = 100 + rng.standard_normal(120).cumsum()
    names = ["ts", *technical.MOMENTUM]
    long, short = (technical.momentum(technical.base(bars(spark, x))).select(*names).toPandas() for x in (c, c[:90]))
    both = long.merge(short, on="ts", suffixes=("", "_s"))
    for x in technical.MOMENTUM:
        np.testing.assert_allclose(both[x].astype(float), both[f"{x}_s"].astype(float), err_msg=x)


def test_recursive_against_loops():
    from tidemill.operators.recursive import affine, ema, ema_adjusted

    rng = np.random.default_rng(2)
    x = rng.standard_normal(500)
    y, s = [], 3.0
    for v in x:
        s = 0.9 * s + 0.1 * v
        y.append(s)
    np.testing.assert_allclose(affine(x, 0.1, 3.0), y)
    np.testing.assert_allclose(ema_adjusted(x, 20), pd.Series(x).ewm(span=20).mean())
    assert np.isnan(ema(x, 20)[18]) and ema(x, 20)[19] == pytest.approx(x[:20].mean())


def test_one_shuffle_for_the_windows(spark):
    from tidemill.operators import technical

    b = technical.volatility(technical.momentum(technical.trend(technical.base(bars(spark, range(50))))))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Python" not in plan and "NestedLoop" not in plan


def test_clean_repairs(spark):
    from tidemill.operators.cleaning import CleanConfig, clean_bars

    df = bars(spark, [10, 11, 12, 13]).withColumn("high", F.when(F.col("close") == 11, 1.0).otherwise(F.col("high"))).withColumn("low", F.when(F.col("close") == 13, -5.0).otherwise(F.col("low"))).withColumn("volume", F.when(F.col("close") == 12, -1.0).otherwise(F.col("volume")))
    out = clean_bars(df.union(df), CleanConfig(outlier="none")).orderBy("ts").collect()
    assert len(out) == 4 and all(r["high"] >= r["low"] > 0 and r["volume"] >= 0 for r in out)


def test_ledger_totals(spark):
    from tidemill.operators.backtest import LedgerConfig, ledger

    df = bars(spark, [100, 110, 120, 90]).withColumn("signal_value", F.when(F.col("close") == 100, 1).when(F.col("close") == 120, -1).otherwise(0))
    out = ledger(df, {"a": LedgerConfig(commission=0.0, stop_loss=None, take_profit=None)}).orderBy("ts").collect()
    assert [round(r["equity"]) for r in out] == [100000, 101000, 102000, 104550]
    assert [r["side"] for r in out] == [1, 1, -1, -1] and out[2]["trade_pnl"] == pytest.approx(2000)


def test_sources_round_trip(spark, tmp_path):
    from tidemill.sources import bars as B

    df = bars(spark, [1, 2, 3], "aa").union(bars(spark, [4, 5], "bb"))
    B.write_bars(df, str(tmp_path / "p"))
    B.write_bars(bars(spark, [9], "bb"), str(tmp_path / "p"))
    assert B.read_bars(spark, str(tmp_path / "p")).count() == 4
    assert B.read_bars(spark, str(tmp_path / "p"), ["aa"], "2024-01-02").count() == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "aa.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,1,2,0.5,1.5,1.4,10\n2024-01-02,x,2,0.5,1.6,1.4,10\n")
    got = B.read_csv_bars(spark, str(tmp_path / "c")).orderBy("ts").collect()
    assert got[0]["symbol"] == "aa" and got[1]["open"] is None and got[1]["close"] == 1.6
    js = spark.createDataFrame([("aa", '{"2024-01-02": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "5. volume": "7"}}')], "symbol string, payload string")
    assert B.from_daily_json(js).first()["volume"] == 7.0


def test_json_and_dates(spark):
    from tidemill.operators import text as X

    posts = spark.createDataFrame([('{"data": {"children": [{"data": {"title": "a", "score": 3}}, {"data": {"selftext": "b", "created_utc": 0}}]}}',), ("broken",)], "payload string")
    assert X.posts_from_json(posts).count() == 2
    filings = spark.createDataFrame([('{"filings": {"recent": {"form": ["8-K", "4"], "filingDate": ["2024-01-02", "2024-01-01"], "accessionNumber": ["1", "2"], "items": ["2.02,9.01", ""]}}}',)], "payload string")
    assert X.filings_from_json(filings, forms=("8-K",)).first()["items"] == ["2.02", "9.01"]
    d = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("20240102T030405",), ("no",)], "t string").select(X.parse_dates(F.col("t")).alias("x")).collect()
    assert d[0]["x"] == d[1]["x"] and d[2]["x"] is None
