"""Window helpers for panels keyed by (symbol, ts). All frames over one key share one exchange and one sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Agg = Callable[[Column], Column]


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series(key: str = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def frame(lo: int, hi: int) -> WindowSpec:
    return series().rowsBetween(lo, hi)


def win(n: int) -> WindowSpec:
    """The last n bars, the current one included."""
    return frame(-(n - 1), 0)


def past() -> WindowSpec:
    return frame(Window.unboundedPreceding, 0)


def full(x: Column | str, n: int, agg: Agg = F.avg) -> Column:
    """agg over the last n bars, null unless all n values are there."""
    return F.when(F.count(c(x)).over(win(n)) == n, agg(c(x)).over(win(n)))


def prev(x: Column | str, k: int = 1) -> Column:
    return F.lag(c(x), k).over(series())


def change(x: Column | str, k: int = 1) -> Column:
    return F.try_divide(c(x), prev(x, k)) - 1


def div(a: Column | str, b: Column | str | float) -> Column:
    return F.try_divide(c(a), F.lit(b) if isinstance(b, (int, float)) else c(b))


def corr(x: Column | str, y: Column | str, w: WindowSpec | None = None) -> Column:
    """Correlation of the pairs without nulls, null where one side does not vary (the built-in raises there in ANSI mode)."""
    a, b = F.when(c(y).isNotNull(), c(x)), F.when(c(x).isNotNull(), c(y))
    over = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    return F.try_divide(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def flag(cond: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def sign(cond: Column) -> Column:
    """1 or -1; an unknown condition is -1."""
    return F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(-1)


def true_range() -> Column:
    """High less low, or the distance to the close before if larger; the first bar has high less low."""
    last = prev("close")
    return F.greatest(c("high") - c("low"), F.abs(c("high") - last), F.abs(c("low") - last))


def skew(x: Column | str, n: int) -> Column:
    """Bias-corrected skewness of the last n values."""
    return full(x, n, F.skewness) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(x: Column | str, n: int) -> Column:
    """Bias-corrected excess kurtosis of the last n values."""
    return ((n + 1) * full(x, n, F.kurtosis) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def rank_share(x: Column | str, n: int) -> Column:
    """Share of the last n values under the current one, ties counted half: (less + less-or-equal + 1) / 2n, of 1."""
    last, seen = c(x), F.collect_list(c(x)).over(win(n))
    less = F.size(F.filter(seen, lambda v: v < last))
    upto = F.size(F.filter(seen, lambda v: v <= last))
    return F.when(F.count(last).over(win(n)) == n, (less + upto + 1) / F.lit(2.0 * n))


def slope_sign(x: Column | str, k: int) -> Column:
    return F.signum(c(x) - prev(x, k))


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation, error under 1.5e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def run_length(cond: Column) -> list[Column]:
    """Two columns for a run length: the island number, then (over it) the place in the island; see islands()."""
    return [F.sum(F.when(F.coalesce(cond, F.lit(False)), 0).otherwise(1)).over(past())]


def island_place(cond: Column, island: Column, key: str = "symbol", order: str = "ts") -> Column:
    """Length of the current run of true, 0 where false."""
    w = Window.partitionBy(key, island).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.coalesce(cond, F.lit(False)).cast("int")).over(w).cast("long")
