"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may do without; it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, *parts: str) -> str:
    """The new folder in the shared one to which df is written as a Parquet table, in folders by `parts`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what this write shuffles is not needed after it
    try:
        df.write.partitionBy(*parts).parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    return path


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df as a stored table: cuts the lineage, survives lost executors."""
    path = stored(df, *parts)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % n


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose md5 of the key is least: a fixed random sample, the same for any partitioning. A share that leaves about
    twice as many rows is cut off by the hash first, so that few rows meet in the ordering."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    total = df.count()
    if total > 2 * n + 200:
        df = df.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < int(2**32 * (2 * n + 200) / total))
    return df.orderBy(h, key).limit(n)


def byte_column(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the offset of each row; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


SHARE = 1024


def key_join(rows: DataFrame, per_key: DataFrame, on: str | list[str], size: str, total: int) -> DataFrame:
    """rows.join(per_key, on), where per_key has one row a key and in `size` how many of the `total` rows bear it. Keys that more than
    a SHARE-th of all rows bear, of which there are fewer than SHARE, are broadcast, so that no task gets all rows of a hot key."""
    hot = F.col(size) * SHARE > total
    rest = rows.join(F.broadcast(per_key.where(hot).select(on)), on, "left_anti").join(per_key.where(~hot), on)
    return rows.join(F.broadcast(per_key.where(hot)), on).unionByName(rest)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected edges (a, b): (node, component = smallest node reachable) of every node but the smallest ones.

    Alternating large-star and small-star steps; every node only ever points to a smaller one, so the forest of pointers
    shrinks until each component is a star around its smallest node: then a node with a smaller neighbour has no other. Stars are built
    with grouped minima, which combine before the shuffle. They go back to the edges by a join, to those of hubs (nodes with more than a
    SHARE-th of all ends, so fewer than SHARE) by a broadcast: a hub of any degree is no hot task. Each step is a written table, so that
    the driver never holds a plan of more than one.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())

    def with_low(rows: DataFrame, low: DataFrame, hubs: list[int]) -> DataFrame:
        if not hubs:
            return rows.join(low, "x")
        hub = F.col("x").isin(hubs)
        return rows.where(~hub).join(low.where(~hub), "x").union(rows.where(hub).join(F.broadcast(low.where(hub)), "x"))

    for _ in range(rounds):
        both = now.union(now.select("y", "x"))
        stars = written(both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("c")))
        ends = stars.agg(F.sum("c").alias("n"), F.count_if((F.col("m") < F.col("x")) & (F.col("c") > 1)).alias("open")).first()
        if not ends["open"]:
            return stars.where("m < x").select(F.col("x").alias("node"), F.col("m").alias("component"))
        hubs = [r["x"] for r in stars.where(F.col("c") * SHARE > ends["n"]).select("x").collect()]
        # large star: neighbours above a node point to the smallest of its neighbourhood
        low = stars.select("x", F.least("x", "m").alias("m"))
        large = written(with_low(both.where("y > x"), low, hubs).select(F.col("y").alias("x"), F.col("m").alias("y")))
        # small star: a node and its neighbours below point to the smallest of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = with_low(large, low, hubs).select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
        now = written(small.where("x <> y").distinct())
    raise RuntimeError("components did not settle")
