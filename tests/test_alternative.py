"""Ownership reports, feeds, decayed sentiment and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

FORM = """<?xml version="1.0"?><ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Jane Roe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-05</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionDate><value>2024-01-06</value></transactionDate><transactionCoding><transactionCode>Z</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>7</value></transactionShares><transactionPricePerShare><value>1</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_ownership(spark):
    from tidemill.operators.alternative import ownership

    got = ownership(spark.createDataFrame([(FORM,), ("<ownershipDocument><broken",), (None,)], "xml string")).orderBy("day").collect()
    assert [(r["filer"], r["relation"], r["kind"], r["value"]) for r in got] == [("Jane Roe", "CFO", "Buy", 250.0), ("Jane Roe", "CFO", "Z", 7.0)]


def test_articles_by_url(spark):
    from tidemill.operators.alternative import distinct_articles

    a = spark.createDataFrame([("u1", "first", 1), ("u2", "x", 2)], "url string, title string, published int")
    b = spark.createDataFrame([("u1", "second", 9), ("u3", "y", 3)], "url string, title string, published int")
    got = {r["url"]: r["title"] for r in distinct_articles([a, b]).collect()}
    assert got == {"u1": "first", "u2": "x", "u3": "y"}


def test_decayed_mean(spark):
    from tidemill.operators.alternative import decayed

    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 3), dt.date(2024, 1, 20)]
    got = decayed(spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days, 1)], "symbol string, day date, mean double")).orderBy("day").collect()
    assert got[1]["mean_decayed"] == pytest.approx((2 + 0.81 * 1) / 1.81) and got[2]["mean_decayed"] == 3.0


def test_stream_bars_equal_batch(spark, data, tmp_path):
    from tidemill.sources.bars import event_hour
    from tidemill.streaming.live import live_bars

    src = spark.read.parquet(f"{data}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    q = live_bars(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), late="400 days").writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    live, batch = ({(r["symbol"], r["ts"].replace(tzinfo=None)): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in df.collect()} for df in (spark.table("live"), event_hour(spark, data)))
    assert live == batch


def test_live_signals(spark, data, tmp_path):
    from tidemill.operators import signals as G
    from tidemill.operators import technical
    from tidemill.sources.bars import brand_week
    from tidemill.streaming.live import live_signals

    bars = brand_week(spark, data).cache()
    symbol = bars.agg(F.min("symbol")).first()[0]
    bars.where(F.col("symbol") == symbol).write.parquet(str(tmp_path / "in"))
    seen = []
    signal = lambda b: G.levelled(G.scored(G.prepared(technical.base(b)))).select("symbol", "ts", "signal_value")
    q = live_signals(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in")), lambda: bars, signal, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    want = G.latest(signal(bars)).where(F.col("symbol") == symbol).first()
    assert [(r["symbol"], r["ts"], r["signal_value"]) for r in seen] == [(want["symbol"], want["ts"], want["signal_value"])]


def test_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidemill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'signal_summary' in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})
