"""Joins and alignment on time: shared and united indexes, as-of joins, daily joins, lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.windows import c, corr, full, past, prev, rank_share, win


def align(panel: DataFrame, how: str = "inner") -> DataFrame:
    """Every symbol on the timestamps that all have (inner), or on all timestamps with nulls (outer)."""
    symbols = panel.select("symbol").distinct()
    if how == "inner":
        n = symbols.count()
        shared = panel.groupBy("ts").agg(F.countDistinct("symbol").alias("n")).where(F.col("n") == n).select("ts")
        return panel.join(shared, "ts", "left_semi")
    grid = panel.select("ts").distinct().join(symbols)  # one row a symbol and timestamp is the result's own size
    return grid.join(panel, ["symbol", "ts"], "left")


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row of its keys that is latest at or before it: one union, one sort, no range join."""
    own = left.select(*[F.col(x) for x in left.columns], F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_r"))
    other = right.select(*keys, on, F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_r.{x}").alias(x) for x in columns])


def with_reference(bars: DataFrame, reference: DataFrame, symbol: str, name: str) -> DataFrame:
    """The close of one reference symbol at the same timestamp, carried forward from earlier bars."""
    ref = reference.where(F.col("symbol") == symbol).select("ts", F.col("close").alias(f"_{name}"))
    return bars.join(ref, "ts", "left").withColumn(name, F.last(f"_{name}", True).over(past())).drop(f"_{name}")


def market_features(bars: DataFrame, reference: DataFrame, market: str) -> DataFrame:
    """Beta, alpha and relative strength to a market symbol."""
    b = with_reference(bars, reference, market, "mkt")
    b = b.withColumns({"_mr": F.try_divide("mkt", prev("mkt")) - 1, "r": F.try_divide(c("close"), prev("close")) - 1})
    b = b.withColumns({"_x": F.when(c("r").isNotNull() & c("_mr").isNotNull(), c("r")), "_y": F.when(c("r").isNotNull() & c("_mr").isNotNull(), c("_mr"))})

    def beta(n: int) -> Column:
        return F.when(F.count("_x").over(win(n)) == n, F.covar_samp("_x", "_y").over(win(n)) / (F.var_samp("_y").over(win(n)) + 1e-10))

    b = b.withColumns({"beta_20": beta(20), "beta_60": beta(60), "_rel": F.try_divide("close", "mkt")})
    return b.withColumns({"alpha_60": full("_x", 60) - c("beta_60") * full("_y", 60), "relative_strength": c("_rel"), "rs_momentum": F.try_divide(c("_rel"), prev("_rel", 20)) - 1, "market_correlation": F.when(F.count("_x").over(win(20)) == 20, corr("_x", "_y", win(20))), "market_percentile": rank_share("mkt", 100)}).drop("_mr", "_x", "_y", "_rel")


MARKET = ["beta_20", "beta_60", "alpha_60", "relative_strength", "rs_momentum", "market_correlation", "market_percentile"]


def volatility_features(bars: DataFrame, reference: DataFrame, index: str) -> DataFrame:
    """Level of a volatility index, correlation of returns with its changes over 20 bars, its percentile over 252."""
    b = with_reference(bars, reference, index, "vix_level")
    b = b.withColumns({"_a": F.try_divide("close", prev("close")) - 1, "_b": F.try_divide("vix_level", prev("vix_level")) - 1})
    b = b.withColumns({"_x": F.when(c("_b").isNotNull(), c("_a")), "_y": F.when(c("_a").isNotNull(), c("_b"))})
    return b.withColumns({"vix_correlation": F.when(F.count("_x").over(win(20)) == 20, corr("_x", "_y", win(20))), "vix_percentile": 100 * rank_share("vix_level", 252)}).drop("_a", "_b", "_x", "_y")


def bond_features(bars: DataFrame, reference: DataFrame, bond: str) -> DataFrame:
    """Correlation of returns with a bond's over 20 bars, and mean return less the bond's over 10."""
    b = with_reference(bars, reference, bond, "_bond")
    b = b.withColumns({"_a": F.try_divide("close", prev("close")) - 1, "_b": F.try_divide("_bond", prev("_bond")) - 1})
    b = b.withColumns({"_x": F.when(c("_b").isNotNull(), c("_a")), "_y": F.when(c("_a").isNotNull(), c("_b"))})
    return b.withColumns({"bond_correlation": F.when(F.count("_x").over(win(20)) == 20, corr("_x", "_y", win(20))), "risk_on_off": full("_a", 10) - full("_b", 10)}).drop("_bond", "_a", "_b", "_x", "_y")


def rotation(bars: DataFrame, reference: DataFrame, a: str, b: str, n: int = 20) -> DataFrame:
    """N-bar change of the ratio of two reference symbols."""
    out = with_reference(with_reference(bars, reference, a, "_a"), reference, b, "_b")
    return out.withColumn("_q", F.try_divide("_a", "_b")).withColumn("sector_rotation", F.try_divide(c("_q"), prev("_q", n)) - 1).drop("_a", "_b", "_q")


def pivot_panel(bars: DataFrame, field: str = "close", symbols: list[str] | None = None) -> DataFrame:
    """One row a timestamp, one column a symbol."""
    return bars.groupBy("ts").pivot("symbol", symbols).agg(F.first(field))


def cik(companies: DataFrame) -> DataFrame:
    """Zero-padded company numbers by upper-case ticker."""
    return companies.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))


def named(rows: DataFrame, names: DataFrame, key: str = "symbol", name: str = "name") -> DataFrame:
    """A name for each key, the key itself where it has none."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, key))


def co_moments(r: DataFrame, wide: int = 256, chunks: int = 16) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) of each pair of symbols a < b that share a timestamp, one row a pair and chunk of timestamps: counts,
    sums and sums of products of column r over the timestamps that both have. r: symbol, ts, r.

    Symbols fall into blocks of about `wide`. A task multiplies the (timestamp x symbol) matrices of two blocks over one chunk of timestamps;
    a row goes once to each block, so what is shuffled is rows times blocks and not rows times symbols."""
    blocks = -(-max(1, r.select("symbol").distinct().count()) // wide)
    rows = r.select("symbol", "ts", "r", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("own"), F.pmod(F.xxhash64("ts"), F.lit(chunks)).cast("int").alias("chunk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("other", other).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other")

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, p, q = key
        t, times = pd.factorize(pdf["ts"])

        def matrix(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s, names = pd.factorize(pdf["symbol"].to_numpy()[part], sort=True)
            x, known = np.zeros((len(times), len(names))), np.zeros((len(times), len(names)))
            x[t[part], s], known[t[part], s] = pdf["r"].to_numpy()[part], 1.0
            return x, known, np.asarray(names)

        own = pdf["own"].to_numpy()
        (x, kx, a), (y, ky, b) = matrix(own == p), matrix(own == q)
        sums = [kx.T @ ky, x.T @ ky, kx.T @ y, (x * x).T @ ky, kx.T @ (y * y), x.T @ y]
        i, j = np.nonzero(sums[0])
        left, right = a[i], b[j]
        keep = left < right if p == q else np.ones(len(i), bool)
        i, j, left, right = i[keep], j[keep], left[keep], right[keep]
        n, sa, sb, saa, sbb, sab = (m[i, j] for m in sums)
        swap = left > right  # of two blocks either may hold the smaller name
        pick = lambda u, v: np.where(swap, v, u)
        return pd.DataFrame({"a": pick(left, right), "b": pick(right, left), "n": n.astype(np.int64), "sa": pick(sa, sb), "sb": pick(sb, sa), "saa": pick(saa, sbb), "sbb": pick(sbb, saa), "sab": sab})

    return rows.groupBy("chunk", "p", "q").applyInPandas(multiply, "a string, b string, n long, sa double, sb double, saa double, sbb double, sab double")


def correlations(bars: DataFrame, limit: float = 0.7) -> DataFrame:
    """Correlation of returns for each pair of symbols on shared timestamps; above: over the limit."""
    r = bars.select("symbol", "ts", (F.try_divide(c("close"), prev("close")) - 1).alias("r")).where("r is not null")
    s = co_moments(r).groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in ("n", "sa", "sb", "saa", "sbb", "sab")])
    spread = lambda x: F.greatest(c("n") * c(f"s{x}{x}") - c(f"s{x}") * c(f"s{x}"), F.lit(0.0))
    out = s.withColumn("corr", F.try_divide(c("n") * c("sab") - c("sa") * c("sb"), F.sqrt(spread("a") * spread("b"))))
    return out.select("a", "b", "corr", "n", (c("corr") > limit).alias("above"))


def news_on_bars(bars: DataFrame, daily: DataFrame, columns: list[str], roll_forward: bool = False) -> DataFrame:
    """Daily news aggregates on the bar of the same day, 0 where there are none; with roll_forward news of days without a bar goes to
    the next bar (mean over the days it then holds)."""
    day = F.to_date("ts")
    if not roll_forward:
        return bars.withColumn("day", day).join(daily.select("symbol", "day", *columns), ["symbol", "day"], "left").drop("day").na.fill(0, columns)
    own = bars.select("symbol", day.alias("day"), F.lit(1).alias("_bar"), F.col("ts").alias("_ts"))
    both = daily.select("symbol", "day", *columns, F.lit(0).alias("_bar")).unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("day", "_bar").rowsBetween(0, Window.unboundedFollowing)
    moved = both.withColumn("_ts", F.first("_ts", ignorenulls=True).over(w)).where("_bar = 0 and _ts is not null")
    per_bar = moved.groupBy("symbol", F.col("_ts").alias("ts")).agg(*[F.avg(x).alias(x) for x in columns])
    return bars.join(per_bar, ["symbol", "ts"], "left").na.fill(0, columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits groups below the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def merged_importances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feature, importance) of two models side by side, 0 where one lacks the feature, and their mean."""
    j = a.select("feature", F.col("importance").alias("a")).join(b.select("feature", F.col("importance").alias("b")), "feature", "full_outer").na.fill(0.0)
    return j.withColumn("mean", (F.col("a") + F.col("b")) / 2)


def agreement(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Share of rows on which two signals have the same sign."""
    return df.groupBy(*keys).agg(F.avg((F.signum(c(a)) == F.signum(c(b))).cast("double")).alias("agreement"))
