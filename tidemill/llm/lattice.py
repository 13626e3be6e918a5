"""Near-duplicate embeddings by lattice hashing on E8.

In each of TABLES tables two random projections take a unit vector to two points of eight dimensions; each is decoded to its
nearest E8 point, and the label with the two points is the vector's cell. A vector is also sent to PROBES more cells, in which one of
the points is replaced by a neighbouring lattice point, those nearest to its projections. Two vectors of one label meet where one is at home and
the other at home or probing; pairs that meet are compared by cosine in double precision.

Equal vectors are one class with a weight from the start. A cell of more than TILE vectors is compared in tiles. A pair is
counted in the first table in which it meets, which both vectors alone decide, so tiles return one count a vector and one
edge a vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import connected, key_join, written

LEAST = 0.93
TABLES = 14
PROBES = 10
SCALE = 1.3
TILE = 512
_MIX = np.random.default_rng(8).integers(1, 1 << 62, 32, dtype=np.int64) * 2 + 1


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(whole + half)


@cache
def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """[tables, 2, 8, dim] maps that keep squared lengths on average, and [tables, 2, 8] shifts."""
    rng = np.random.default_rng(88)
    return rng.standard_normal((TABLES, 2, 8, dim)) * SCALE / np.sqrt(8), rng.uniform(0, 2, (TABLES, 2, 8))


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    p = np.rint(y)
    off = y - p
    worst = np.abs(off).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    odd = (p.sum(axis=-1, keepdims=True) % 2) != 0
    np.put_along_axis(p, worst, np.take_along_axis(p, worst, -1) + np.where(odd, step, 0.0), -1)
    return p


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points: integers with an even sum, or such points moved by one half in each coordinate."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=-1) <= ((y - b) ** 2).sum(axis=-1))[..., None], a, b)


def cells(unit: np.ndarray) -> np.ndarray:
    """[rows, tables, 1 + PROBES] numbers of the cells of unit vectors: home first, then the probed cells."""
    maps, shifts = projections(unit.shape[1])
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    near = neighbours()
    for t in range(TABLES):
        y = np.einsum("nd,bkd->nbk", unit, maps[t]) + shifts[t]
        p = decode(y)
        gain = np.einsum("nbk,gk->nbg", y - p, near).reshape(len(unit), -1)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        two = (2 * p).astype(np.int64)
        mix = _MIX[:16].reshape(2, 8)
        home = (two * mix).sum(axis=(1, 2)) + _MIX[16:17] * (t + 1)
        out[:, t, 0] = home
        moved = (2 * near).astype(np.int64) @ mix.T  # [240, 2]
        out[:, t, 1:] = home[:, None] + moved.T.reshape(-1)[best]
    return out ^ (out >> 31)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(vectors: DataFrame) -> DataFrame:
    """(key, id, at: table of the cell, home) of every cell of every vector. vectors: id, label, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                ids, label, x = b.column(0).slice(lo, 2000).to_numpy(), b.column(1).slice(lo, 2000).to_numpy(), _matrix(b.column(2).slice(lo, 2000))
                c = cells(_unit(x)) * 31 + label[:, None, None]
                n = TABLES * (1 + PROBES)
                at = np.broadcast_to(np.arange(TABLES, dtype=np.int32)[None, :, None], c.shape)
                home = np.broadcast_to((np.arange(1 + PROBES) == 0)[None, None, :], c.shape)
                yield pa.RecordBatch.from_arrays([pa.array(c.reshape(-1)), pa.array(np.repeat(ids, n)), pa.array(at.reshape(-1)), pa.array(home.reshape(-1))], ["key", "id", "at", "home"])

    return vectors.select("id", "label", "v").mapInArrow(run, "key long, id long, at int, home boolean")


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _links(members: DataFrame, least: float) -> DataFrame:
    """(a, b, links): for each vector of a tile the weight linked to it there (b null), and its edge to the tile's component (links 0)."""

    def tile(ids: np.ndarray, home: np.ndarray, at: int, block: np.ndarray, cross: bool, weight: np.ndarray, label: np.ndarray, unit: np.ndarray) -> list[tuple]:
        alike = unit @ unit.T >= least
        alike &= (home[:, None] | home[None, :]) & (label[:, None] == label[None, :])
        if cross:
            alike &= block[:, None] != block[None, :]
        np.fill_diagonal(alike, False)
        i, j = np.nonzero(np.triu(alike))
        if not len(i):
            return []
        x, y = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        c, (x1, y1) = cells(unit[used]), back.reshape(2, -1)
        counted = np.ones(len(x), bool)
        for t in range(at):
            counted &= ~((c[x1, t, :1] == c[y1, t, :]).any(axis=1) | (c[y1, t, :1] == c[x1, t, :]).any(axis=1))
        # met here at the home of the smaller, or at the home of the larger only if the larger does not reach the smaller's
        counted &= home[x] | ~(c[x1, at, :1] == c[y1, at, :]).any(axis=1)
        links = np.bincount(x[counted], weights=weight[y[counted]], minlength=len(ids)) + np.bincount(y[counted], weights=weight[x[counted]], minlength=len(ids))
        joined, own = alike | alike.T, np.arange(len(ids))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        low = rank.copy()
        while True:
            new = np.minimum(low, np.where(joined, low[None, :], len(ids)).min(axis=1))
            new = np.minimum(new, new[order[new]])
            if (new == low).all():
                break
            low = new
        root = ids[order[low]]
        out = [(int(ids[k]), None, int(links[k])) for k in own[links > 0]]
        return out + [(int(ids[k]), int(root[k]), 0) for k in own[ids != root]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table, last: bool) -> tuple[list, pa.Table]:
            t = t.combine_chunks()
            key = np.column_stack([t.column(c).to_numpy() for c in ("key", "at", "ti", "tj")])
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
            cut = cut if last else cut[:-1]
            found = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i > 1:
                    s = t.slice(i, j - i).combine_chunks()
                    get = lambda c, s=s: s.column(c).to_numpy()
                    found += tile(get("id"), get("home"), int(key[i, 1]), get("block"), bool(key[i, 2] != key[i, 3]), get("weight"), get("label"), _unit(_matrix(s.column("v").chunk(0))))
            return found, t.slice(cut[-1]) if len(cut) else t

        for b in batches:
            t = pa.Table.from_batches([b])
            found, held = done(pa.concat_tables([held, t]) if held is not None and len(held) else t, False)
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip("abn", x, strict=True)) for x in found], schema=_FOUND).rename_columns(["a", "b", "links"])
        if held is not None and len(held) and (found := done(held, True)[0]):
            yield pa.RecordBatch.from_pylist([dict(zip("abn", x, strict=True)) for x in found], schema=_FOUND).rename_columns(["a", "b", "links"])

    blocks = F.ceil(F.col("c") / TILE)
    tiled = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    tiled = tiled.select("key", "at", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "id", "home", "weight", "label", "v")
    return tiled.repartition("key", "at", "ti", "tj").sortWithinPartitions("key", "at", "ti", "tj", "id").mapInArrow(run, "a long, b long, links long")


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """(key, n_links long, component_id long, kept boolean) of every row: how many others are linked directly, the smallest key
    reachable, whether it is the key itself.

    Only rows with equal labels that are not null are compared. Vectors that are null, empty, zero, or hold null or non-finite components are linked
    with nothing; of vectors of other lengths than the first by key, each length is compared within itself. Keys are unique
    integers; rows with a null key are left out, and of rows with equal keys the one of least hash stays.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    ids = rows.agg(F.count("id").alias("n"), F.countDistinct("id").alias("d")).first()
    if ids["n"] != ids["d"]:
        rows = written(rows.groupBy("id").agg(F.min_by(F.struct("label", "v"), F.xxhash64("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # the length of a vector is part of its label
    good = rows.where(F.coalesce(fine, F.lit(False))).withColumn("label", F.xxhash64("label", F.size("v")))
    classes = written(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    lengths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    found = None
    for n in lengths:  # almost always one
        own = classes.where(F.size("v") == n)
        keyed = written(_keys(own).withColumn("cell", F.struct("key", "at")))
        sizes = written(keyed.groupBy("cell").agg(F.count("*").alias("c"), F.max("home").alias("h")).where("c > 1 and h").drop("h"))
        crowd = key_join(keyed, sizes, "cell", "c", sizes.agg(F.sum("c")).first()[0] or 0).drop("cell")
        part = _links(crowd.join(own, "id"), least)
        found = part if found is None else found.union(part)
    named = rows.select("id", "label", "v")
    if found is None:
        return named.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = connected(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    members = good.select("id", "label", "v").join(classes.withColumnRenamed("id", "rep"), ["label", "v"]).select("id", "rep", "weight")
    told = members.join(counts, "rep", "left").join(comps, "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id").join(told, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
