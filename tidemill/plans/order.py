"""Order statistics of sliding windows by blocks.

A window of n bars lies in two neighbouring blocks of n. Bars are dealt out by (symbol, block), each to its own block and to the next, and
a task compares a block's bars with at most 2n values: the bars of one symbol run in many tasks, and no row carries its window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1 << 22  # comparisons that are made at a time


def window_ranks(values: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of values[first:] how many of the last n values, itself included, are less than it, and how many at most it. Unknown
    values are in no window; they and bars with a window that is not whole get -1."""
    size = len(values) - first
    less, upto = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    if len(values) < n:
        return less, upto
    whole = np.lib.stride_tricks.sliding_window_view(values, n)  # row i ends at place i + n - 1
    begin = max(first, n - 1)
    step = max(1, ROWS // n)
    for lo in range(begin, len(values), step):
        hi = min(lo + step, len(values))
        part, own = whole[lo - n + 1 : hi - n + 1], values[lo:hi, None]
        ok = ~np.isnan(part).any(1)
        less[lo - first : hi - first] = np.where(ok, (part < own).sum(1), -1)
        upto[lo - first : hi - first] = np.where(ok, (part <= own).sum(1), -1)
    return less, upto


def rank_shares(b: DataFrame, columns: dict[str, str], n: int) -> DataFrame:
    """(symbol, ts, a column for each entry of columns: its share): which share of the last n values of a column lies under the current
    one, ties counted half, of 1; null unless all n values are known. b: symbol, ts, seq (from 1) and the columns."""
    names = list(columns.items())
    own = F.floor((F.col("seq") - 1) / n)
    rows = b.select("symbol", "ts", "seq", own.alias("own"), *[F.col(x).cast("double").alias(f"x{i}") for i, (_, x) in enumerate(names)])
    both = rows.withColumn("block", F.explode(F.array("own", F.col("own") + 1)))

    def rank(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("seq")
        first = int((g["own"] < key[1]).sum())
        out = {"symbol": g["symbol"].iloc[first:], "ts": g["ts"].iloc[first:]}
        for i in range(len(names)):
            less, upto = window_ranks(g[f"x{i}"].to_numpy(float), first, n)
            out[f"s{i}"] = np.where(less < 0, np.nan, (less + upto + 1) / (2.0 * n))
        return pd.DataFrame(out)

    kind = b.schema["symbol"].dataType.simpleString()
    found = both.groupBy("symbol", "block").applyInPandas(rank, f"symbol {kind}, ts timestamp, " + ", ".join(f"s{i} double" for i in range(len(names))))
    return found.select("symbol", "ts", *[F.when(~F.isnan(f"s{i}"), F.col(f"s{i}")).alias(name) for i, (name, _) in enumerate(names)])
