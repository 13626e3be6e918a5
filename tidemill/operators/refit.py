"""Linear models fitted anew in every walk-forward window, without going through a window's bars again for each of them.

A ridge regression needs the sums of its columns and of their products only. Running sums of these over a symbol's bars are taken once; a
window's normal equations are the difference of two of their rows. Windows are rows of a table, solved in batches of small systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.backtest import WORST, ratios, windows
from tidemill.plans.windows import c, past


def normal_equations(b: DataFrame, features: list[str], target: str, train: int = 252, test: int = 63, every: int = 21, gap: int = 1) -> DataFrame:
    """(symbol, window_id, n, start array, sums array, products array) of each training part: features and target less their `start`, their
    sums, and the sums of their products, row by row of the upper triangle. Bars with a null in one of them do not count, nor do the last
    `gap` bars of a training part, whose targets may lie in the test. b: symbol, ts, seq (from 1)."""
    names = [*features, target]
    whole = F.lit(True)
    for x in names:
        whole = whole & c(x).isNotNull()
    b = b.withColumns({"_ok": whole, "_n": F.max("seq").over(Window.partitionBy("symbol"))})
    # less the first value, which changes no slope and keeps the sums small
    b = b.withColumns({f"_0_{i}": F.first(F.when(c("_ok"), c(x)), True).over(past()) for i, x in enumerate(names)})
    b = b.withColumns({f"_z_{i}": F.when(c("_ok"), c(x) - c(f"_0_{i}")) for i, x in enumerate(names)})
    over = lambda x: F.coalesce(F.sum(x).over(past()), F.lit(0.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    b = b.withColumns({"_k": F.sum(c("_ok").cast("long")).over(past()), "_s": F.array(*[over(c(f"_z_{i}")) for i in range(len(names))]), "_g": F.array(*[over(c(f"_z_{i}") * c(f"_z_{j}")) for i, j in pairs]), "_0": F.array(*[c(f"_0_{i}") for i in range(len(names))])})
    edge = lambda start, sign: F.when((c("seq") >= start) & ((c("seq") - start) % every == 0), F.struct(((c("seq") - start) / every).cast("int").alias("w"), F.lit(sign).alias("sign")))
    before = F.when(c("seq") % every == 0, F.struct((c("seq") / every).cast("int").alias("w"), F.lit(-1).alias("sign")))
    rows = b.select("symbol", "_n", "_k", "_s", "_g", "_0", F.explode(F.array_compact(F.array(before, edge(train - gap, 1)))).alias("e"))
    rows = rows.where(c("e.w") * every + train + test <= c("_n"))
    signed = lambda x, i: F.sum(c("e.sign") * c(x)[i])
    out = rows.groupBy("symbol", c("e.w").alias("window_id")).agg(
        F.sum(c("e.sign") * c("_k")).alias("n"), F.max(F.when(c("e.sign") > 0, c("_0"))).alias("start"),
        F.array(*[signed("_s", i) for i in range(len(names))]).alias("sums"), F.array(*[signed("_g", i) for i in range(len(pairs))]).alias("products"),
    )
    return out


def solved(equations: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(symbol, window_id, n, intercept, coefficients array): ridge regression, whose intercept is free of the penalty. Null where there are
    no more bars than features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_numpy(zero_copy_only=False).astype(float), b.num_rows
            if not m:
                continue
            values = lambda x: np.array([v if v is not None else () for v in b.column(x).to_pylist()], dtype=object)
            size = max((len(v) for v in b.column("sums").to_pylist()), default=0)
            fit = [i for i in range(m) if n[i] > size - 1 and b.column("start")[i].is_valid and None not in b.column("start")[i].as_py()]
            slopes, base = [None] * m, [None] * m
            if fit:
                s = np.array([values("sums")[i] for i in fit], float)
                start = np.array([values("start")[i] for i in fit], float)
                g = np.zeros((len(fit), size, size))
                at = np.triu_indices(size)
                g[:, at[0], at[1]] = np.array([values("products")[i] for i in fit], float)
                g[:, at[1], at[0]] = g[:, at[0], at[1]]
                k = n[fit][:, None]
                around = g - s[:, :, None] * s[:, None, :] / k[:, :, None]
                left = around[:, :-1, :-1] + alpha * np.eye(size - 1)
                beta = np.linalg.solve(left, around[:, :-1, -1:])[:, :, 0] if alpha > 0 else (np.linalg.pinv(left) @ around[:, :-1, -1:])[:, :, 0]
                mean = s / k + start
                free = mean[:, -1] - (beta * mean[:, :-1]).sum(1)
                for j, i in enumerate(fit):
                    slopes[i], base[i] = beta[j].tolist(), float(free[j])
            yield pa.RecordBatch.from_arrays([b.column("symbol"), b.column("window_id"), b.column("n"), pa.array(base, pa.float64()), pa.array(slopes, pa.list_(pa.float64()))], ["symbol", "window_id", "n", "intercept", "coefficients"])

    kind = equations.schema["symbol"].dataType.simpleString()
    return equations.mapInArrow(run, f"symbol {kind}, window_id int, n long, intercept double, coefficients array<double>")


def refitted(b: DataFrame, features: list[str], target: str, train: int = 252, test: int = 63, every: int = 21, alpha: float = 1.0, gap: int = 1) -> DataFrame:
    """The bars of each test part with window_id and the prediction of the model of its own training part; null where a feature is null or
    there is no model."""
    models = solved(normal_equations(b, features, target, train, test, every, gap), alpha)
    bars = windows(b, train, test, every).where("split = 'test'").drop("split")
    out = bars.join(models.select("symbol", "window_id", "intercept", "coefficients"), ["symbol", "window_id"])
    terms = sum((c("coefficients")[i] * c(x) for i, x in enumerate(features)), c("intercept"))
    return out.withColumn("prediction", terms).drop("intercept", "coefficients")


def refit_metrics(scored: DataFrame, target: str) -> DataFrame:
    """One row a symbol and window: bars with a prediction and a target, mean squared error, share of right signs, and return and Sharpe ratio
    of holding the predicted side for the target, which is the return that follows."""
    known = scored.where(c("prediction").isNotNull() & c(target).isNotNull())
    d, r = c("prediction") - c(target), F.greatest(F.signum("prediction") * c(target), F.lit(WORST))
    return known.groupBy("symbol", "window_id").agg(F.count("*").alias("bars"), F.avg(d * d).alias("mse"), F.avg((c("prediction") * c(target) > 0).cast("double")).alias("hits"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), ratios(r)[0].alias("sharpe"))
