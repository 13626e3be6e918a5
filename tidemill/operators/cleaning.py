"""Cleaning of bar panels: deduplication, fills, outliers, repair of impossible bars, targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.plans.windows import c, past, series

PRICES = ("open", "high", "low", "close")
AHEAD = (0, Window.unboundedFollowing)


@dataclass(frozen=True)
class CleanConfig:
    """fill: ffill, bfill, interpolate, mean, median or zero. outlier: zscore, iqr, mad or none."""

    fill: str = "ffill"
    outlier: str = "zscore"
    threshold: float = 5.0
    dedup: bool = True


def first_of_key(df: DataFrame, order: list[Column], key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def numeric(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [x.name for x in df.schema if isinstance(x.dataType, T.NumericType)]


def forward(x: str | Column) -> Column:
    return F.last(c(x), ignorenulls=True).over(past())


def backward(x: str | Column) -> Column:
    return F.first(c(x), ignorenulls=True).over(series().rowsBetween(*AHEAD))


def filled(x: str, method: str) -> Column:
    """C2-C7. Expects a column _seq (position in the symbol) for interpolate."""
    if method == "ffill":
        return F.coalesce(forward(x), backward(x))
    if method == "bfill":
        return F.coalesce(backward(x), forward(x))
    if method == "interpolate":
        at = F.when(c(x).isNotNull(), c("_seq"))
        p, n, sp, sn = forward(x), backward(x), F.last(at, True).over(past()), F.first(at, True).over(series().rowsBetween(*AHEAD))
        return F.coalesce(c(x), p + (n - p) * (c("_seq") - sp) / F.nullif(sn - sp, F.lit(0)), n, p)
    whole = Window.partitionBy("symbol")
    if method == "mean":
        return F.coalesce(c(x), F.avg(x).over(whole))
    if method == "median":
        return F.coalesce(c(x), F.median(x).over(whole))
    if method == "zero":
        return F.coalesce(c(x), F.lit(0.0))
    raise ValueError(f"unknown fill: {method}")


def fill(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    df = df.withColumn("_seq", F.row_number().over(series()))
    return df.withColumns({x: filled(x, method) for x in columns}).drop("_seq")


def outlier_marks(df: DataFrame, columns: list[str], method: str, k: float) -> DataFrame:
    """Adds <column>_outlier, judged over each symbol's whole series. Quantiles are one row a symbol, joined back."""
    if method == "zscore":
        w = Window.partitionBy("symbol")
        return df.withColumns({f"{x}_outlier": F.coalesce(F.abs(F.try_divide(c(x) - F.avg(x).over(w), F.stddev_pop(x).over(w))) > k, F.lit(False)) for x in columns})
    if method == "iqr":
        q = df.groupBy("symbol").agg(*[F.percentile(x, p).alias(f"_{x}{i}") for x in columns for i, p in ((1, 0.25), (3, 0.75))])
        out = df.join(q, "symbol")
        test = {f"{x}_outlier": F.coalesce((c(x) < c(f"_{x}1") - k * (c(f"_{x}3") - c(f"_{x}1"))) | (c(x) > c(f"_{x}3") + k * (c(f"_{x}3") - c(f"_{x}1"))), F.lit(False)) for x in columns}
        return out.withColumns(test).drop(*[f"_{x}{i}" for x in columns for i in (1, 3)])
    if method == "mad":
        mid = df.groupBy("symbol").agg(*[F.median(x).alias(f"_{x}m") for x in columns])
        out = df.join(mid, "symbol")
        dev = out.groupBy("symbol").agg(*[F.median(F.abs(c(x) - c(f"_{x}m"))).alias(f"_{x}d") for x in columns])
        out = out.join(dev, "symbol")
        test = {f"{x}_outlier": F.coalesce(F.abs(0.6745 * F.try_divide(c(x) - c(f"_{x}m"), c(f"_{x}d"))) > k, F.lit(False)) for x in columns}
        return out.withColumns(test).drop(*[f"_{x}{i}" for x in columns for i in "md"])
    raise ValueError(f"unknown outlier method: {method}")


def without_outliers(df: DataFrame, columns: list[str], method: str, k: float) -> DataFrame:
    """C11: outliers become null, then the value before holds; leading ones stay null."""
    if method == "none":
        return df
    marked = outlier_marks(df, columns, method, k).withColumns({x: F.when(~c(f"{x}_outlier"), c(x)) for x in columns})
    return marked.withColumns({x: forward(x) for x in columns}).drop(*[f"{x}_outlier" for x in columns])


def clean_bars(df: DataFrame, cfg: CleanConfig = CleanConfig(), order: list[Column] | None = None) -> DataFrame:
    """(dedup,) fill, swap of inverted high and low, clip of open and close, positive prices, volume at 0 or more, outliers."""
    if cfg.dedup:
        df = first_of_key(df, order or [c(x).asc() for x in (*PRICES, "volume")])
    df = fill(df, [*PRICES, "volume"], cfg.fill)
    df = df.withColumns({"high": F.greatest("high", "low"), "low": F.least("high", "low")})
    clip = lambda x: F.least(F.greatest(c(x), c("low")), c("high"))
    df = df.withColumns({"open": clip("open"), "close": clip("close")})
    df = df.withColumns({x: F.when(c(x) > 0, c(x)) for x in PRICES}).withColumns({x: forward(x) for x in PRICES})
    df = df.withColumn("volume", F.greatest("volume", F.lit(0.0)))
    return without_outliers(df, list(PRICES), cfg.outlier, cfg.threshold)


def clean_table(df: DataFrame, cfg: CleanConfig, columns: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """C17: dedup, fill and outliers over the given (or all numeric) columns."""
    columns = columns or [x for x in numeric(df) if x != "symbol"]
    if cfg.dedup:
        df = first_of_key(df, order or [c(x).asc() for x in columns])
    return without_outliers(fill(df, columns, cfg.fill), columns, cfg.outlier, cfg.threshold)


def returns(df: DataFrame, column: str = "close", method: str = "log") -> DataFrame:
    """C18."""
    ratio = F.try_divide(c(column), F.lag(column).over(series()))
    return df.withColumn("returns", F.log(ratio) if method == "log" else ratio - 1)


def target(df: DataFrame) -> DataFrame:
    """1 if the next close is higher, null on the last bar."""
    return df.withColumn("target", (F.lead("close").over(series()) > c("close")).cast("int"))


def drop_and_zero(df: DataFrame, critical: list[str]) -> DataFrame:
    """Rows without the critical columns go, other nulls become 0."""
    return df.na.drop(subset=critical).na.fill(0)
