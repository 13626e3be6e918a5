"""Mixing sources to target weights by proportionally fair (Pfair) scheduling.

Each source is cut into blocks of equally many rows, of which the last may be short; a source of n among N blocks has the weight
n/N. Block i (from 0) of a source with a slots among L is released at floor(i*L/a) and due at ceil((i+1)*L/a), and each slot goes
to the released block that is due first. So every source is at all times less than one block from its share.

Long mixtures are cut into periods of PERIOD slots. The same rule, with periods for slots, gives each source its blocks
of each period: at the end of a period a source has floor or ceil of its share, and what is over goes to the blocks that are due
first. The driver walks over periods only, one step of array arithmetic each; the slots of a period are dealt in a task. Within
a period a source is less than one block from the line between its counts at both ends, and these are less than one block from its
share: less than two blocks in all, and less than one while the mixture is one period.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import written

PERIOD = 1 << 16
BLOCK_ROWS = 8
DIGITS = 4  # hex digits of the hash by which the rows of a source are dealt to be ranked


def rows_taken(sizes: dict[str | None, int], weights: dict[str | None, float]) -> dict[str | None, int]:
    """Rows of each source in the longest mixture to these weights; a source without a positive weight has none."""
    own = {s: w for s, w in weights.items() if w > 0 and sizes.get(s)}
    most = min((sizes[s] / w for s, w in own.items()), default=0)
    return {s: k for s, w in own.items() if (k := min(sizes[s], int(most * w + 0.5)))}


def slots(counts: list[int]) -> Iterator[tuple[int, int]]:
    """(source, its block) of each slot of a period with counts[s] blocks of source s: of the released blocks the one that is due
    first, of equals the first source's."""
    length = sum(counts)
    waiting = [(0, s, 0) for s, n in enumerate(counts) if n]  # by release
    ready: list[tuple[int, int, int]] = []
    for t in range(length):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * length // counts[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i
        if i + 1 < counts[s]:
            heapq.heappush(waiting, ((i + 1) * length // counts[s], s, i + 1))


def early(blocks: list[int], period: int = PERIOD) -> Iterator[np.ndarray]:
    """For the end of each period (but the last, when all are done): which sources have one block more than the floor of their share."""
    total = sum(blocks)
    n = np.array(blocks, np.int64)
    step = np.array([b * period // total for b in blocks], np.int64)
    part = np.array([b * period % total for b in blocks], np.int64)
    floor, rest, done = np.zeros_like(n), np.zeros_like(n), np.zeros_like(n)
    for t in range(period, total, period):
        rest += part
        over = rest >= total
        floor, rest = floor + step + over, np.where(over, rest - total, rest)
        done = np.maximum(done, floor)
        need = t - int(done.sum())
        free = np.flatnonzero((done == floor) & (rest > 0))
        due = -(-(total - rest[free]) // n[free])
        done[free[np.argsort(due, kind="stable")[:need]]] += 1
        yield done > floor


def schedule(docs: DataFrame, blocks: list[int], period: int = PERIOD) -> DataFrame:
    """(si int, block long, slot long) of every block; si is the place of its source in `blocks`."""
    spark, total, n = docs.sparkSession, sum(blocks), len(blocks)
    none = np.packbits(np.zeros(n, bool)).tobytes()
    ends = [np.packbits(x).tobytes() for x in early(blocks, period)] if total else []
    rows = pa.table({"p": pa.array(range(len(ends) + 1 if total else 0), pa.int64()), "before": pa.array([none, *ends][: None if total else 0], pa.binary()), "after": pa.array([*ends, none][: None if total else 0], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: int, bits: bytes) -> list[int]:
            more = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
            return [b * t // total + int(x) for b, x in zip(blocks, more, strict=True)]

        for b in batches:
            for p, before, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first, last = done(p * period, before), done(min(total, (p + 1) * period), after)
                x = np.array(list(slots([z - a for a, z in zip(first, last, strict=True)])), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1] + np.array(first, np.int64)[x[:, 0]]), pa.array(np.arange(len(x)) + p * period)], ["si", "block", "slot"])

    return spark.createDataFrame(rows).repartition(max(1, min(len(rows), 1000))).mapInArrow(run, "si int, block long, slot long")


def _missing(slot: Column, short: list[tuple[int, int]]) -> Column:
    """Rows that the short blocks before the slot lack. short: (slot, rows lacking), at most one a source; found by bisection."""
    if not short:
        return F.lit(0)
    short = sorted(short)
    at = F.split(F.lit(",".join(str(t) for t, _ in short)), ",").cast("array<bigint>")
    sums = F.split(F.lit(",".join(map(str, accumulate((k for _, k in short), initial=0)))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(short).bit_length()))])
    n = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(short)) & (F.get(at, lo + step - 1) < slot), lo + step).otherwise(lo))
    return F.get(sums, n)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, key: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = (), period: int = PERIOD) -> DataFrame:
    """One row a document: key, source, block long (from 0 in its source), slot long, in_mix boolean, position long (its place in the
    mixture), and the carried columns.

    Within a source rows come in order of the md5 of the key, then the key: a fixed shuffle. weights: by source, null included;
    without weights the natural shares, to which every row has its position. Other weights take as many rows of each source as the
    longest mixture to them holds, to the row; the rows behind these, and sources without a weight, lie outside (in_mix false, slot
    and position null). Rows of one key and source stand together, in order of a hash of what they carry. Driver and tasks
    hold a few numbers by source; carried columns are shuffled once, after the ranks are known.
    """
    spark = docs.sparkSession
    full = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    n = full.groupBy("k", "s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if n > 1:
        full = written(full.withColumn("again", F.row_number().over(Window.partitionBy("k", "s").orderBy(F.xxhash64(F.lit(0), *[f"c{i}" for i in range(len(carry))])))))
    else:
        full = full.withColumn("again", F.lit(1))
    rows = full.select("k", "s", "again", F.md5(F.coalesce(F.col("k").cast("string"), F.lit("")).cast("binary")).alias("h")).withColumn("b", F.conv(F.substring("h", 1, DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy("s", "b").agg(F.count("*").alias("n"))
    sizes = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    taken = rows_taken(sizes, sizes if weights is None else weights)
    order = sorted(taken, key=lambda s: (s is None, s or ""))
    blocks = [-(-taken[s] // block_rows) for s in order]
    dealt = written(schedule(docs, blocks, period))
    per_source = spark.createDataFrame([(s, i, taken[s], blocks[i] - 1, blocks[i] * block_rows - taken[s]) for i, s in enumerate(order)], "qs string, si int, taken long, last long, lack int")
    ends = per_source.where("lack > 0").select("si", F.col("last").alias("block"), "lack")
    short = [(r["slot"], r["lack"]) for r in dealt.join(F.broadcast(ends), ["si", "block"]).collect()]  # one row a source
    # ranks in a source without gathering it: the rows of earlier buckets, then the place in the bucket
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("s").alias("s2"), F.col("b").alias("b2"), F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k", "again"))).join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
    ranked = ranked.withColumn("place", F.col("before") + F.col("r") - 1).withColumn("block", F.floor(F.col("place") / block_rows).cast("long"))
    ranked = ranked.join(F.broadcast(per_source), F.col("s").eqNullSafe(F.col("qs")), "left")  # one row a source
    inside = F.coalesce(F.col("place") < F.col("taken"), F.lit(False))
    ranked = ranked.select("k", "s", "again", "place", "block", inside.alias("in_mix"), F.when(inside, F.col("si")).otherwise(-1).alias("si"))
    ranked = ranked.join(dealt, ["si", "block"], "left")
    position = (F.col("slot") * block_rows + F.col("place") % block_rows - _missing(F.col("slot"), short)).cast("long")
    out = ranked.select("k", "s", "again", "block", "slot", "in_mix", position.alias("position"))
    if carry:
        own = out.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("again").alias("a2"), "block", "slot", "in_mix", "position")
        out = full.join(own, F.col("k").eqNullSafe(F.col("k2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("again") == F.col("a2")))
    return out.select(F.col("k").alias(key), F.col("s").alias(source), "block", "slot", "in_mix", "position", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
