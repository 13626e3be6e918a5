"""Structured Streaming counterparts: live bars, trailing sentiment, deduplicated news, live signals, minimum hold, position ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemill.operators.backtest import LedgerConfig, booked, new_state
from tidemill.plans.windows import c

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_bars(ticks: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (symbol, ts, price, size, seq); ticks later than `late` are left out."""
    g = ticks.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", interval).alias("w"))
    o = F.struct("ts", "seq")
    return g.agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("size").alias("volume")).select("symbol", c("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def trailing_sentiment(scored: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """Mean score and count of the last days, sliding by a day. scored: symbol, ts, score."""
    g = scored.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{days} days", "1 day").alias("w"))
    return g.agg(F.avg("score").alias("score"), F.count("*").alias("articles")).select("symbol", c("w.end").alias("ts"), "score", "articles")


def fresh_news(news: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Z3: the first article of each URL within the horizon."""
    return news.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["url"])


def live_signals(bars: DataFrame, history: Callable[[], DataFrame], signal: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, warmup: int = 252) -> StreamingQuery:
    """For each batch of bars, recomputes the last `warmup` bars of the symbols in it and hands the newest signals to the sink.

    history() reads the stored bars, the batch's included; signal() turns a panel into signals; sink(signals, batch_id) must be idempotent.
    """
    from pyspark.sql import Window

    def each(batch: DataFrame, number: int) -> None:
        touched = batch.select("symbol").distinct()
        w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
        recent = history().join(touched, "symbol", "left_semi").withColumn("_r", F.row_number().over(w)).where(c("_r") <= warmup).drop("_r")
        out = signal(recent)
        sink(out.groupBy("symbol").agg(F.max_by(F.struct(*[x for x in out.columns if x != "symbol"]), "ts").alias("s")).select("symbol", "s.*"), number)

    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def live_hold(signals: DataFrame, bars: int = 5) -> DataFrame:
    """The minimum hold across batches: a signal counts only if the last one that counted is at least `bars` bars back; the state is
    the place of that one. signals: symbol, seq long, signal_value int; each symbol's bars arrive in order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, parts, state):
        last = state.get[0] if state.exists else -(10**9)
        for pdf in parts:
            pdf = pdf.sort_values("seq")
            out = []
            for place, value in zip(pdf["seq"], pdf["signal_value"], strict=True):
                counts = bool(value) and place - last >= bars
                last = int(place) if counts else last
                out.append(int(value) if counts else 0)
            yield pd.DataFrame({"symbol": key[0], "seq": pdf["seq"], "signal_value": out})
        state.update((last,))

    kind = "symbol string, seq long, signal_value int"
    return signals.select("symbol", "seq", "signal_value").groupBy("symbol").applyInPandasWithState(step, kind, "last long", "append", GroupStateTimeout.NoTimeout)


class _Ledger(StatefulProcessor):
    """Walks the bars of a symbol as the batch ledger does; the state of a symbol is its cash, position, entry price and last equity."""

    def __init__(self, cfg: LedgerConfig, keep_ms: int | None) -> None:
        self.cfg, self.keep_ms = cfg, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "cash double, position double, entry double, equity double", self.keep_ms)

    def _load(self) -> dict:
        return dict(zip(("cash", "position", "entry", "equity"), self.state.get(), strict=True)) if self.state.exists() else new_state(self.cfg)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update(tuple(float(initialState[x].iloc[0]) for x in ("cash", "position", "entry", "equity")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows)).sort_values("ts")
        state, equity, side, pnl = self._load(), [], [], []
        for price, s in zip(g["close"], g["signal_value"].fillna(0), strict=True):
            pnl.append(booked(state, price, int(s), self.cfg))
            equity.append(state["equity"])
            side.append(int(np.sign(state["position"])))
        self.state.update(tuple(float(state[x]) for x in ("cash", "position", "entry", "equity")))
        yield pd.DataFrame({"symbol": key[0], "ts": g["ts"].to_numpy(), "equity": equity, "side": np.array(side, np.int32), "trade_pnl": np.array([np.nan if x is None else x for x in pnl], float)})

    def close(self) -> None:
        pass


def live_ledger(bars: DataFrame, cfg: LedgerConfig = LedgerConfig(), start: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """The position ledger of a stream: (symbol, ts, equity before the bar's trade, side after it, trade_pnl, null where the bar closes
    no trade), equal to the batch ledger over the same bars. bars: symbol, ts, close, signal_value; each symbol's bars arrive in order.

    start: states that the ledger goes on from, as ledger_states() gives them for the bars before the stream. keep: seconds after which
    the state of a symbol without bars is forgotten, so that it starts anew. State lies in RocksDB, which the session is set to."""
    spark = bars.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    first = start.groupBy("symbol") if start is not None else None
    kind = "symbol string, ts timestamp, equity double, side int, trade_pnl double"
    rows = bars.select("symbol", "ts", "close", c("signal_value").cast("int").alias("signal_value")).groupBy("symbol")
    return rows.transformWithStateInPandas(_Ledger(cfg, None if keep is None else 1000 * keep), kind, "Append", "None" if keep is None else "ProcessingTime", first)
