"""First-order linear recurrences y[t] = k * y[t-1] + a * x[t] as sums, without a walk over the bars.

A row lies at place p of its block of BLOCK rows. The recurrence over a block is the affine map (k^BLOCK, sum of a * x * k^(BLOCK - p)), a
plain sum that combines before a shuffle. A row's value is composed from the maps of the blocks before it, those of its own block up to it
(a running sum of a * x * k^-p, times k^p), and its start k^(t - first) * seed. A block that lies so far back that its factor is under
1e-17 changes no digit of a double, so a few blocks are composed, as many as the factor demands.

smoothed() does this in windows of a panel that is already dealt out by symbol. by_blocks() deals the rows of one symbol out to
many tasks by (symbol, block).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
FAR = -math.log(1e-17)
MOST = 600.0  # the largest exponent by which a running sum is scaled


@dataclass(frozen=True)
class Chain:
    """Exponential smoothing of column x by the factor k. first: place (seq) of the seed, the mean of the n values up to it; what x holds
    before these does not count. Without `first` the weights sum to one from the first bar on."""

    x: str
    k: float
    n: int = 0
    first: int | None = None

    @property
    def gain(self) -> float:
        return 1.0 if self.first is None else 1.0 - self.k


def ema(x: str, n: int, first: int | None = None) -> Chain:
    """Exponential mean of x over n bars, seeded at place `first` (default n)."""
    return Chain(x, 1.0 - 2.0 / (n + 1), n, n if first is None else first)


def wilder(x: str, n: int, first: int | None = None) -> Chain:
    return Chain(x, 1.0 - 1.0 / n, n, n if first is None else first)


def adjusted(x: str, n: int) -> Chain:
    return Chain(x, 1.0 - 2.0 / (n + 1))


def _reach(k: float, block: int) -> int:
    """How many blocks before the own one count."""
    if not 0.0 < k < 1.0 or -math.log(k) * block > MOST:
        raise ValueError(f"a factor of {k} does not suit blocks of {block}")
    return math.ceil(FAR / (-math.log(k) * block))


def _steps(chain: Chain) -> Column:
    """What a bar adds: gain * x behind the seed, 0 before it and for unknown values."""
    z = chain.gain * F.col(chain.x)
    return F.coalesce(z if chain.first is None else F.when(F.col("seq") > chain.first, z), F.lit(0.0))


def _value(chain: Chain, prefix: Column, carry: Column, seed: Column, place: Column) -> Column:
    """The chain at a row, from the running sum in its block, the state at the block's start, and its seed."""
    y = F.pow(F.lit(chain.k), place) * (prefix + carry)
    seq = F.col("seq")
    if chain.first is None:
        return F.when(F.col(chain.x).isNotNull(), y * (1.0 - chain.k) / (1.0 - F.pow(F.lit(chain.k), seq)))
    return F.when(seq >= chain.first, y + seed * F.pow(F.lit(chain.k), seq - chain.first))


def _seed(chain: Chain) -> Column:
    """Mean of the n values up to `first`, null unless all are there."""
    x = F.when((F.col("seq") > chain.first - chain.n) & (F.col("seq") <= chain.first), F.col(chain.x))
    return F.when(F.count(x) == chain.n, F.avg(x))


def smoothed(b: DataFrame, chains: dict[str, Chain], block: int = BLOCK) -> DataFrame:
    """Adds a column a chain. b: symbol, ts, seq (from 1) and the chains' columns, which know no gaps behind their first value. All
    windows are over one symbol, so a panel that is dealt out by symbol is not dealt out again."""
    b = b.withColumn("_block", F.floor((F.col("seq") - 1) / block))
    place = F.col("seq") - F.col("_block") * block
    inside = Window.partitionBy("symbol", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    whole, blocks = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("_block")
    names = list(enumerate(chains.items()))
    b = b.withColumns({f"_z{i}": _steps(c) for i, (_, c) in names} | {f"_s{i}": _windowed_seed(c, whole) for i, (_, c) in names if c.first is not None})
    sums = {f"_p{i}": F.sum(F.col(f"_z{i}") * F.pow(F.lit(c.k), -place)).over(inside) for i, (_, c) in names}
    ends = {f"_e{i}_{j}": F.sum(F.col(f"_z{i}") * F.pow(F.lit(c.k), block - place)).over(blocks.rangeBetween(-j, -j)) for i, (_, c) in names for j in range(1, _reach(c.k, block) + 1)}
    b = b.withColumns(sums | ends)
    carry = lambda i, c: sum((F.coalesce(F.col(f"_e{i}_{j}"), F.lit(0.0)) * c.k ** (block * (j - 1)) for j in range(1, _reach(c.k, block) + 1)), F.lit(0.0))
    b = b.withColumns({name: _value(c, F.col(f"_p{i}"), carry(i, c), F.col(f"_s{i}") if c.first is not None else F.lit(0.0), place) for i, (name, c) in names})
    return b.drop("_block", *[f"_z{i}" for i, _ in names], *[f"_s{i}" for i, _ in names], *sums, *ends)


def _windowed_seed(chain: Chain, w) -> Column:
    x = F.when((F.col("seq") > chain.first - chain.n) & (F.col("seq") <= chain.first), F.col(chain.x))
    return F.when(F.count(x).over(w) == chain.n, F.avg(x).over(w))


def numbered(bars: DataFrame, last: tuple[str, ...] = ("high", "low", "close"), seconds: int = 1 << 22) -> DataFrame:
    """Adds seq, the place of a bar in its symbol, and last_<column> of the bar before it, with no task that holds a symbol: bars are dealt
    out by stretches of time, and of each stretch only its size and its last bar meet those of the other stretches."""
    b = bars.withColumn("_t", F.floor(F.unix_timestamp("ts") / seconds))
    order = Window.partitionBy("symbol").orderBy("_t")
    parts = b.groupBy("symbol", "_t").agg(F.count("*").alias("_m"), F.max_by(F.struct(*last), "ts").alias("_end"))
    parts = parts.select("symbol", "_t", F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_end").over(order).alias("_end"))
    inside = Window.partitionBy("symbol", "_t").orderBy("ts")
    b = b.join(parts, ["symbol", "_t"]).withColumns({"seq": F.row_number().over(inside) + F.col("_before"), **{f"last_{x}": F.when(F.row_number().over(inside) == 1, F.col(f"_end.{x}")).otherwise(F.lag(x).over(inside)) for x in last}})
    return b.drop("_t", "_before", "_end")


def by_blocks(b: DataFrame, chains: dict[str, Chain], block: int = BLOCK) -> DataFrame:
    """smoothed() for long series: rows are dealt out by (symbol, block), so that the bars of one symbol run in many tasks. One row a block,
    a `block`-th of the bars, goes to its symbol's others; the seeds come from the first bars only."""
    names = list(enumerate(chains.items()))
    seeded = [(i, c) for i, (_, c) in names if c.first is not None]
    b = b.withColumn("_block", F.floor((F.col("seq") - 1) / block))
    place = F.col("seq") - F.col("_block") * block
    b = b.withColumns({f"_z{i}": _steps(c) for i, (_, c) in names})
    maps = b.groupBy("symbol", "_block").agg(*[F.sum(F.col(f"_z{i}") * F.pow(F.lit(c.k), block - place)).alias(f"_e{i}") for i, (_, c) in names])
    seeds = b.where(F.col("seq") <= max([c.first for _, c in seeded], default=0)).groupBy("symbol").agg(F.count("*").alias("_n"), *[_seed(c).alias(f"_s{i}") for i, c in seeded])
    order = Window.partitionBy("symbol").orderBy("_block")
    carry = {f"_c{i}": sum((F.coalesce(F.lag(f"_e{i}", j).over(order), F.lit(0.0)) * c.k ** (block * (j - 1)) for j in range(1, _reach(c.k, block) + 1)), F.lit(0.0)) for i, (_, c) in names}
    state = maps.withColumns(carry).join(seeds, "symbol", "left").select("symbol", "_block", *carry, *[f"_s{i}" for i, _ in seeded])
    inside = Window.partitionBy("symbol", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({f"_p{i}": F.sum(F.col(f"_z{i}") * F.pow(F.lit(c.k), -place)).over(inside) for i, (_, c) in names})
    b = b.join(state, ["symbol", "_block"])
    b = b.withColumns({name: _value(c, F.col(f"_p{i}"), F.col(f"_c{i}"), F.col(f"_s{i}") if c.first is not None else F.lit(0.0), place) for i, (name, c) in names})
    return b.drop("_block", *carry, *[f"{x}{i}" for i, _ in names for x in ("_z", "_s", "_p")])
