"""Positions and performance for a panel of runs: vectorised paths, a ledger with stops, metrics, walk-forward windows, resampling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.windows import c, corr, past, prev, series

YEAR = 252**0.5
#: A bar takes at most this share of a position: losses beyond the capital are not booked.
WORST = -0.99


def position_path(b: DataFrame, signal: str = "signal_value") -> DataFrame:
    """Position held after each bar (the last signal that was not 0), its entries and exits, and the strategy's return."""
    s = F.signum(c(signal)).cast("int")
    b = b.withColumn("position", F.coalesce(F.last(F.when(s != 0, s), True).over(past()), F.lit(0)))
    b = b.withColumns({"_before": F.coalesce(prev("position"), F.lit(0)), "r": F.try_divide(c("close"), prev("close")) - 1})
    return b.withColumns({"entry": (c("position") != c("_before")).cast("int"), "strategy_return": F.greatest(F.coalesce(c("_before") * c("r"), F.lit(0.0)), F.lit(WORST))}).drop("_before")


def with_equity(b: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Compounded equity of strategy_return, its running peak and drawdown."""
    b = b.withColumn("equity", capital * F.exp(F.sum(F.log1p("strategy_return")).over(past())))
    b = b.withColumn("peak", F.max("equity").over(past()))
    return b.withColumn("drawdown", c("equity") / c("peak") - 1)


def ratios(r: Column) -> tuple[Column, Column]:
    """Sharpe and Sortino ratio of returns by year, 0 where the deviation is 0 or unknown; nulls, such as the first bar's return, do
    not count."""
    ratio = lambda x: F.when(F.stddev_samp(x) > 0, F.avg(r) / F.stddev_samp(x) * YEAR).otherwise(0.0)
    return ratio(r), ratio(F.when(r < 0, r))


def performance(b: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row a run. b: keys, ts, equity, strategy_return, drawdown. The first bar has no return."""
    w = Window.partitionBy(*keys).orderBy("ts")
    # islands of bars under water: the number of peaks so far names the island, the bars since the last peak are its length so far
    under = b.withColumns({"_i": F.sum(F.when(c("drawdown") < 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.when(F.lag("ts").over(w).isNotNull(), c("strategy_return"))})
    place = Window.partitionBy(*keys, "_i").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    under = under.withColumn("_n", F.sum(F.when(c("drawdown") < 0, 1).otherwise(0)).over(place))
    sharpe, sortino = ratios(c("_r"))
    out = under.groupBy(*keys).agg(
        F.count("*").alias("bars"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"), sharpe.alias("sharpe"), sortino.alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), (F.stddev_samp("_r") * YEAR).alias("volatility"), F.max("_n").cast("long").alias("max_drawdown_bars"),
    )
    return out.withColumn("annual_return", c("total_return") * 252 / c("bars")).withColumn("calmar", F.try_divide(c("annual_return"), F.abs("max_drawdown")))


def trades(b: DataFrame) -> DataFrame:
    """One row a holding period of position_path(): side, entry and exit, bars, return. Open positions end at the last bar."""
    marked = b.withColumns({"_t": F.sum("entry").over(past()), "_next": F.lead("close").over(series()), "_nts": F.lead("ts").over(series())})
    held = marked.where("position <> 0").groupBy("symbol", "_t").agg(F.first("position").alias("side"), F.min("ts").alias("entry_ts"), F.max(F.coalesce("_nts", "ts")).alias("exit_ts"), F.min_by("close", "ts").alias("entry_price"), F.max_by(F.coalesce("_next", "close"), "ts").alias("exit_price"), F.count("*").alias("bars"))
    return held.withColumn("pnl", c("side") * (c("exit_price") - c("entry_price"))).withColumn("ret", F.try_divide("pnl", "entry_price")).drop("_t")


def trade_stats(t: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, win rate, means (0 without trades of the kind), profit factor (losses count as 1 if there are none), expectancy,
    Kelly share, the whole days that won trades last on average, and the recovery factor: profit over the largest fall of the summed
    profits. A trade without profit is neither won nor lost."""
    win, loss = F.when(c("pnl") > 0, c("pnl")), F.when(c("pnl") < 0, c("pnl"))
    order = Window.partitionBy(*keys).orderBy("entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_sum", F.sum("pnl").over(order))
    t = t.withColumn("_fall", F.greatest(F.max("_sum").over(order), F.lit(0.0)) - c("_sum"))
    days = F.avg(F.when(c("pnl") > 0, F.unix_timestamp("exit_ts") - F.unix_timestamp("entry_ts"))) / 86_400
    out = t.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count(win).alias("won"), F.count(loss).alias("lost"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("_w"), F.coalesce(F.abs(F.sum(loss)), F.lit(1.0)).alias("_l"), F.avg("pnl").alias("expectancy"), F.coalesce(F.floor(days), F.lit(0)).alias("avg_win_days"), F.try_divide(F.sum("pnl"), F.max("_fall")).alias("recovery_factor"),
    )
    out = out.withColumns({"win_rate": c("won") / c("trades"), "profit_factor": c("_w") / c("_l")})
    return out.withColumn("kelly", c("win_rate") - F.try_divide(1 - c("win_rate"), F.try_divide(c("avg_win"), F.abs("avg_loss")))).drop("_w", "_l")


def trades_rolled_up(t: DataFrame) -> DataFrame:
    """A8 by symbol and the year of the entry, by symbol (year null) and in all (both null); level is 0, 1 and 3: counts, win rate, means,
    profit factor and expectancy, taken over the trades of each level."""
    win, loss = F.when(c("pnl") > 0, c("pnl")), F.when(c("pnl") < 0, c("pnl"))
    out = t.withColumn("year", F.year("entry_ts")).rollup("symbol", "year").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("trades"), F.count(win).alias("won"), F.count(loss).alias("lost"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        (F.coalesce(F.sum(win), F.lit(0.0)) / F.coalesce(F.abs(F.sum(loss)), F.lit(1.0))).alias("profit_factor"), F.avg("pnl").alias("expectancy"),
    )
    return out.withColumn("win_rate", c("won") / c("trades"))


def var_cvar(b: DataFrame, keys: tuple[str, ...] = ("symbol",), share: float = 0.05) -> DataFrame:
    """Quantile of returns, the mean at or below it, and the normal approximation of the quantile."""
    q = b.groupBy(*keys).agg(F.percentile("strategy_return", share).alias("var95"), (F.avg("strategy_return") - 1.645 * F.stddev_samp("strategy_return")).alias("var95_normal"))
    return b.join(q, list(keys)).groupBy(*keys).agg(F.first("var95").alias("var95"), F.avg(F.when(c("strategy_return") <= c("var95"), c("strategy_return"))).alias("cvar95"), F.first("var95_normal").alias("var95_normal"))


def monthly(b: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A10: compounded returns, one row a year, one column a month."""
    return b.groupBy(*keys, F.year("ts").alias("year")).pivot("_m", list(range(1, 13))).agg(F.exp(F.sum(F.log1p("strategy_return"))) - 1) if "_m" in b.columns else monthly(b.withColumn("_m", F.month("ts")), keys)


@dataclass(frozen=True)
class LedgerConfig:
    capital: float = 100_000.0
    commission: float = 0.001
    share: float = 0.1
    stop_loss: float | None = 0.02
    take_profit: float | None = 0.04
    short: bool = True


def step(state: dict, price: float, signal: int, cfg: LedgerConfig) -> float | None:
    """The state (cash, signed position, entry price) after a bar; returns the profit of the trade that the bar closes, without
    commission, if any. A bar that passes a stop or target ignores its signal. The commission of a closing trade is charged on its signed
    value, so that closing a short earns it; an order takes a share of the cash, also of negative cash."""
    closed = None

    def close() -> float:
        pnl = state["position"] * (price - state["entry"])
        state.update(cash=state["cash"] + state["position"] * price * (1 - cfg.commission), position=0.0)
        return pnl

    side = np.sign(state["position"])
    if side:
        gain = side * (price - state["entry"]) / state["entry"]
        if cfg.stop_loss is not None and gain < -cfg.stop_loss or cfg.take_profit is not None and gain > cfg.take_profit:
            return close()
    order = np.sign(signal)
    if order and order != side:
        if side:
            closed = close()
        if order > 0 or cfg.short:
            value = state["cash"] * cfg.share
            state.update(position=order * value / price, entry=price, cash=state["cash"] - order * value - cfg.commission * value)
    return closed


def new_state(cfg: LedgerConfig) -> dict:
    return {"cash": cfg.capital, "position": 0.0, "entry": 0.0, "equity": cfg.capital}


def booked(state: dict, price: float, signal: int, cfg: LedgerConfig) -> float | None:
    """One bar: state["equity"] becomes the equity before the bar's trade (that of the bar before if the price is unknown), then step()."""
    if price == price:
        state["equity"] = state["cash"] + state["position"] * price
    return step(state, price, signal, cfg) if price == price and price > 0 else None


LEDGER = "run_id string, symbol string, ts timestamp, equity double, side int, trade_pnl double"


def ledger(b: DataFrame, runs: dict[str, LedgerConfig], signal: str = "signal_value") -> DataFrame:
    """One row a run, symbol and bar: equity before the bar's trade, side after it, and the profit of a trade it closes.

    The parameter sets are a literal array, so that runs times symbols go to tasks side by side; a task walks one run of one symbol.
    """
    known = {k: asdict(v) for k, v in runs.items()}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("ts")
        cfg = LedgerConfig(**known[g["run_id"].iloc[0]])
        state = new_state(cfg)
        equity, side, pnl = [], [], []
        for price, s in zip(g["close"], g[signal], strict=True):
            pnl.append(booked(state, price, int(s), cfg))
            equity.append(state["equity"])
            side.append(int(np.sign(state["position"])))
        return pd.DataFrame({"run_id": g["run_id"], "symbol": g["symbol"], "ts": g["ts"], "equity": equity, "side": np.array(side, np.int32), "trade_pnl": pd.array(pnl, dtype="Float64")})

    runs_col = F.explode(F.array(*[F.lit(k) for k in sorted(known)]))
    rows = b.select("symbol", "ts", "close", F.coalesce(c(signal), F.lit(0)).alias(signal)).withColumn("run_id", runs_col)
    return rows.groupBy("run_id", "symbol").applyInPandas(walk, LEDGER)


STATE = "symbol string, cash double, position double, entry double, equity double"


def ledger_states(b: DataFrame, cfg: LedgerConfig, signal: str = "signal_value") -> DataFrame:
    """The state in which ledger() leaves each symbol: what live_ledger() can start from."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("ts")
        state = new_state(cfg)
        for price, s in zip(g["close"], g[signal], strict=True):
            booked(state, price, int(s), cfg)
        return pd.DataFrame([{"symbol": g["symbol"].iloc[0], **state}])

    return b.select("symbol", "ts", "close", F.coalesce(c(signal), F.lit(0)).alias(signal)).groupBy("symbol").applyInPandas(walk, STATE)


def windows(b: DataFrame, train: int = 252, test: int = 63, every: int = 21, expanding: bool = False, least: int = 126) -> DataFrame:
    """H1 H2: each row with the windows it belongs to, window_id and split, found by arithmetic on seq (from 1)."""
    first = least if expanding else train
    b = b.withColumn("_n", F.max("seq").over(Window.partitionBy("symbol")))
    last = F.floor((c("_n") - first - test) / every)
    # a row is in the windows that start at most train + test bars before it; when expanding, in all that end after it
    lo = F.greatest(F.lit(0), F.ceil((c("seq") - first - test) / every))
    hi = last if expanding else F.least(last, F.floor((c("seq") - 1) / every))
    b = b.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")})
    ids = F.when(c("_lo") <= c("_hi"), F.sequence("_lo", "_hi"))
    out = b.withColumn("window_id", F.explode(ids))
    start = F.lit(0) if expanding else c("window_id") * every
    cut = (c("window_id") * every + first)
    place = c("seq") - 1
    split = F.when((place >= start) & (place < cut), "train").when((place >= cut) & (place < cut + test), "test")
    return out.withColumn("split", split).where("split is not null").drop("_n", "_lo", "_hi")


def window_metrics(w: DataFrame) -> DataFrame:
    """H3: bars, first and last day, return and Sharpe ratio of each symbol, window and split."""
    return w.groupBy("symbol", "window_id", "split").agg(F.count("*").alias("bars"), F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"), (F.exp(F.sum(F.log1p("strategy_return"))) - 1).alias("total_return"), ratios(c("strategy_return"))[0].alias("sharpe"))


def walk_forward_summary(m: DataFrame) -> DataFrame:
    """H4 H5: one row a symbol: the tests' returns compounded, also by year of 252 days between the tests' first and last bars, the mean of
    their Sharpe ratios that are not 0 (0 without any), and how they compare with the training parts."""
    both = m.groupBy("symbol", "window_id").agg(*[F.max(F.when(c("split") == s, c(x))).alias(f"{s}_{x}") for s in ("train", "test") for x in ("total_return", "sharpe")], F.max(F.when(c("split") == "test", F.datediff("last_day", "first_day"))).alias("days"))
    out = both.groupBy("symbol").agg(
        F.count("*").alias("windows"), (F.product(1 + c("test_total_return")) - 1).alias("total_return"), F.greatest(F.sum("days") / 252, F.lit(1 / 252)).alias("_years"), F.coalesce(F.avg(F.when(c("test_sharpe") != 0, c("test_sharpe"))), F.lit(0.0)).alias("avg_sharpe"),
        F.avg((c("test_total_return") > 0).cast("double")).alias("positive_windows"), F.coalesce(F.try_divide(F.avg("train_total_return") - F.avg("test_total_return"), F.abs(F.avg("train_total_return"))), F.lit(0.0)).alias("overfitting_ratio"),
        F.when(F.count("*") > 2, F.coalesce(corr("train_total_return", "test_total_return"), F.lit(0.0))).otherwise(0.0).alias("train_test_corr"),
    )
    return out.withColumn("annual_return", F.pow(1 + c("total_return"), 1 / c("_years")) - 1).drop("_years")


def stitched(w: DataFrame) -> DataFrame:
    """The test parts of windows() one after the other: compounded equity (from 1) and drawdown of each symbol."""
    order = Window.partitionBy("symbol").orderBy("window_id", "ts").rowsBetween(Window.unboundedPreceding, 0)
    out = w.where(c("split") == "test").withColumn("equity", F.exp(F.sum(F.log1p("strategy_return")).over(order)))
    return out.withColumn("drawdown", c("equity") / F.max("equity").over(order) - 1)


def window_trades(w: DataFrame) -> DataFrame:
    """The holding periods within each test part, open ones ended at its last bar; one row a trade of a symbol and window."""
    one = Window.partitionBy("symbol", "window_id").orderBy("ts")
    marked = w.where(c("split") == "test").withColumns({"_t": F.sum("entry").over(one.rowsBetween(Window.unboundedPreceding, 0)), "_exit": F.coalesce(F.lead("close").over(one), "close")})
    held = marked.where("position <> 0").groupBy("symbol", "window_id", "_t").agg(F.first("position").alias("side"), F.min_by("close", "ts").alias("entry_price"), F.max_by("_exit", "ts").alias("exit_price"), F.count("*").alias("bars"))
    return held.withColumn("pnl", c("side") * (c("exit_price") - c("entry_price"))).drop("_t")


def stitched_stats(w: DataFrame) -> DataFrame:
    """H6 H7: one row a symbol: largest drawdown of the stitched equity; trades, win rate and profit factor over all windows' trades (losses
    count as 0.001 if there are none)."""
    falls = stitched(w).groupBy("symbol").agg(F.abs(F.min("drawdown")).alias("max_drawdown"), F.max_by("equity", F.struct("window_id", "ts")).alias("final_equity"))
    win, loss = F.when(c("pnl") > 0, c("pnl")), F.when(c("pnl") < 0, c("pnl"))
    t = window_trades(w).groupBy("symbol").agg(F.count("*").alias("trades"), (F.count(win) / F.count("*")).alias("win_rate"), (F.coalesce(F.sum(win), F.lit(0.0)) / F.coalesce(F.abs(F.sum(loss)), F.lit(0.001))).alias("profit_factor"))
    return falls.join(t, "symbol", "left").na.fill({"trades": 0, "win_rate": 0.0, "profit_factor": 0.0})


def walk_forward(b: DataFrame, signal_func: Callable[[DataFrame], DataFrame], backtest_func: Callable[[DataFrame], DataFrame], optimize_func: Callable[[DataFrame], DataFrame] | None = None, train: int = 252, test: int = 63, every: int = 21) -> DataFrame:
    """Q2: user functions on all windows at once; each part of a window is a symbol of its own to them, so they may use any operator.

    optimize_func: the training parts to parameters, one row a symbol, which are joined to both parts. signal_func: bars (and parameters)
    to bars with signal_value. backtest_func: these to metrics, one row a symbol. Returns symbol, window_id, split and the metrics.
    """
    w = windows(b, train, test, every)
    name = lambda split: F.to_json(F.struct("symbol", "window_id", split.alias("split")))
    parts = w.withColumns({"_train": name(F.lit("train")), "_own": name(c("split"))})
    parts = parts.withColumn("symbol", c("_own")).drop("_own", "window_id", "split", "seq").withColumn("seq", F.row_number().over(series()))
    if optimize_func is not None:
        best = optimize_func(parts.where(c("symbol") == c("_train")).drop("_train")).withColumnRenamed("symbol", "_train")
        parts = parts.join(best, "_train", "left")
    out = backtest_func(signal_func(parts.drop("_train")))
    key = F.from_json("symbol", "struct<symbol: string, window_id: int, split: string>")
    return out.withColumn("_k", key).select("_k.symbol", "_k.window_id", "_k.split", *[x for x in out.columns if x != "symbol"])


def drawn(*parts: Column | str) -> Column:
    """A number of 32 bits for the parts: the same wherever and whenever it is drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c(x).cast("string") for x in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(t: DataFrame, sims: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """H8: resamples of trade profits with replacement, per symbol; seeded, so a rerun gives the same. p_value is the share of resamples on the
    other side of 0 than the original total (at least 0 for a total of 0 or less), and a result is significant if the whole interval lies
    beyond 0 on the original's side. Fewer than two trades tell nothing: p_value 1, not significant.
    The draws are rows: sims times trades of the symbol, joined to the trades by number."""
    w = Window.partitionBy("symbol").orderBy("entry_ts")
    numbered = t.select("symbol", "pnl", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    draws = numbered.select("symbol", "n", "i", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim")).withColumn("j", (drawn("symbol", "sim", "i", F.lit(seed)) % c("n") + 1).cast("int"))
    sums = draws.join(numbered.select("symbol", F.col("i").alias("j"), "pnl"), ["symbol", "j"]).groupBy("symbol", "sim").agg(F.sum("pnl").alias("total"), F.count("*").alias("n"))
    a = (1 - level) / 2
    out = sums.groupBy("symbol").agg(
        F.max("n").alias("_n"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"), F.percentile("total", a).alias("low"), F.percentile("total", 1 - a).alias("high"),
        F.avg((c("total") <= 0).cast("double")).alias("_under"), F.avg((c("total") >= 0).cast("double")).alias("_over"),
    )
    out = out.join(t.groupBy("symbol").agg(F.sum("pnl").alias("original")), "symbol")
    enough, up = c("_n") > 1, c("original") > 0
    known = {x: F.when(enough, c(x)) for x in ("original", "mean", "std")} | {x: F.when(enough, c(x)).otherwise(0.0) for x in ("low", "high")}
    sure = up & (c("low") > 0) | (c("original") < 0) & (c("high") < 0)
    return out.withColumns({"p_value": F.when(~enough, 1.0).when(up, c("_under")).otherwise(c("_over")), "significant": enough & sure}).withColumns(known).drop("_n", "_under", "_over")


def shuffle_test(t: DataFrame, sims: int = 500, seed: int = 42) -> DataFrame:
    """H9: the largest drawdown of the summed profits, over max(peak, 1), of the trades in their order and on average over shuffled orders;
    their relative difference is the dependency on the sequence, and a run under a half is robust. Mean and deviation of the profits are the
    same in every order, so the deviation of their ratio over the orders is 0. Fewer than two trades: robust, no dependency."""
    plain = Window.partitionBy("symbol").orderBy("entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    mixed = Window.partitionBy("symbol", "sim").orderBy(drawn("symbol", "sim", F.unix_timestamp("entry_ts"), F.lit(seed)), "entry_ts").rowsBetween(Window.unboundedPreceding, 0)

    def fall(df: DataFrame, w, keys: list[str]) -> DataFrame:
        run = df.withColumn("_s", F.sum("pnl").over(w)).withColumn("_m", F.max("_s").over(w))
        return run.withColumn("_d", (c("_m") - c("_s")) / F.greatest(c("_m"), F.lit(1.0))).groupBy(*keys).agg(F.max("_d").alias("fall"), F.count("*").alias("n"))

    own = fall(t, plain, ["symbol"]).withColumnRenamed("fall", "actual")
    many = fall(t.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))), mixed, ["symbol", "sim"]).groupBy("symbol").agg(F.avg("fall").alias("avg_shuffled"))
    out = own.join(many, "symbol").withColumn("dependency", F.when(c("n") > 1, (c("actual") - c("avg_shuffled")) / F.greatest(c("avg_shuffled"), F.lit(0.001))).otherwise(0.0))
    return out.select("symbol", "actual", "avg_shuffled", "dependency", (F.abs("dependency") < 0.5).alias("is_robust"), F.lit(0.0).alias("sharpe_std"))


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """Performance of several runs, one row a run over all its symbols taken with equal weight, rounded to 4 digits."""
    every = None
    for name, b in runs.items():
        part = b.groupBy("ts").agg(F.avg("strategy_return").alias("strategy_return")).select(F.lit(name).alias("symbol"), "ts", "strategy_return")
        every = part if every is None else every.union(part)
    out = performance(with_equity(every)).withColumnRenamed("symbol", "strategy")
    return out.select("strategy", *[F.round(x, 4).alias(x) if x != "bars" else c(x) for x in ("bars", "total_return", "annual_return", "sharpe", "sortino", "max_drawdown", "volatility")])


def slices(b: DataFrame, train: int = 252, test: int = 63) -> DataFrame:
    """Adds slice_id of fixed-signal walk-forward slices. Bars before the first slice are left out, and those behind the last whole one."""
    b = b.withColumns({"slice_id": F.floor((c("seq") - 1 - train) / test).cast("int"), "_n": F.max("seq").over(Window.partitionBy("symbol"))})
    return b.where((c("slice_id") >= 0) & ((c("slice_id") + 1) * test + train <= c("_n"))).drop("_n")


def slice_metrics(b: DataFrame, signal: str = "signal_value") -> DataFrame:
    """Each slice of slices() is a run of its own that starts flat; mean and deviation of the runs' returns and Sharpe ratios by symbol."""
    name = F.to_json(F.struct("symbol", "slice_id"))
    runs = performance(with_equity(position_path(b.withColumn("symbol", name).select("symbol", "ts", "close", signal), signal)))
    per = runs.select(F.get_json_object("symbol", "$.symbol").alias("symbol"), "total_return", "sharpe")
    return per.groupBy("symbol").agg(F.count("*").alias("slices"), F.avg("total_return").alias("mean_return"), F.stddev_pop("total_return").alias("std_return"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"))
