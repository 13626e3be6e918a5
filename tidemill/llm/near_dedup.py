"""Near-duplicate documents by SetSketch registers, banded, estimated jointly by likelihood, and verified on full sets.

A document is the set of its 5-word shingles. Register i holds the truncated exponential spacing of the minimum of hash i over
the set: floor(1 - log_B(x)) for x = -ln(1 - min) / RATE, cut to a byte. Registers of a union are the maxima of the registers, and equal
registers are as likely as the sets are alike. Bands of registers give buckets; in a bucket the likelihood of the counts of
larger, equal and smaller registers, given both set sizes, estimates the Jaccard similarity of a pair. What may reach the
threshold is compared on whole sets.

Documents with equal sets are one class from the start. First each bucket is cut at random into parts of about FAN classes, and
each class is compared with the smallest of its part, then these smallest ones among themselves in the same way, until one is
left: what most buckets hold, copies of one text, is joined by as many comparisons as there are copies. A second round turns to
the buckets that the links so far leave in several components. Their members come together with the members of other components than
the largest: those with a promising partner in another component with their texts, and every such pair is verified, or found joined by
then, in the first bucket that it shares. This is done in tiles of about TILE classes, or SHINGLES shingles, to a side, so no task
holds a bucket and none is capped; tiles return at most one row a member, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import byte_column, connected, key_join, written

WORDS = 5
PERCENT = 85  # the default: 100 * intersection >= percent * union
REGISTERS = 125
BAND = 5
BASE, RATE = 1.1, 20.0
#: Pairs are not verified whose estimate, or whose share of equal registers, lies so many standard errors below the threshold.
ESTIMATE_ERRORS, EQUAL_ERRORS = 4.08, 4.7
FAN = 256
TILE = 512
SHINGLES = 1 << 20

_rng = np.random.default_rng(5)
_byte = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_place = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_family = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raw: np.ndarray, at: np.ndarray, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text raw[at[i]:at[i+1]]; empty without a word."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk, "right")) - 1)
        yield from _sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def _sets(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    n = len(raw)
    texts = len(at) - 1
    if not n:
        yield from (np.zeros(0, np.uint64) for _ in range(texts))
        return
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_space[raw]
    first = np.zeros(n + 1, bool)
    first[at] = True  # a word never runs over the end of a text
    begin = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    # a word is the sum of a random number for each of its bytes and its place in the word
    inside = np.arange(n, dtype=np.uint64)
    inside[begin[0] if len(begin) else n :] -= np.repeat(begin, np.diff(np.r_[begin, n])).astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(_byte[_lower[raw]] + inside * _STEP), out=sums[1:])
    words = _mixed((sums[end] - sums[begin]) + (end - begin).astype(np.uint64))
    upto = np.searchsorted(begin, at)
    k = len(words) - WORDS + 1
    runs = np.zeros(max(k, 0), np.uint64)
    for j in range(WORDS if k > 0 else 0):
        runs += words[j : j + k] * _place[j]
    runs = _mixed(runs)
    for i in range(texts):
        a, b = upto[i], upto[i + 1]
        if b - a >= WORDS:
            yield np.unique(runs[a : b - WORDS + 1])
        elif b > a:
            yield _mixed((words[a:b] * _place[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes, REGISTERS bytes."""
    low = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, np.multiply.outer(_family, shingles[i : i + 2048]).min(axis=1), out=low)
    x = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) / 2**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_grid = np.linspace(0.0, 1.0, 101)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likeliest(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of largest likelihood for pairs of sets of sizes n_a and n_b of whose registers `above` are larger in the
    first and `below` in the second."""
    u = (n_a / (n_a + n_b))[:, None]
    v, j = 1 - u, np.minimum(_grid[None, :], np.minimum(u / (1 - u), (1 - u) / u))
    p, q = _chance(u - v * j), _chance(v - u * j)
    equal = np.maximum(1 - p - q, 1e-9)
    return np.take_along_axis(j, (above[:, None] * np.log(p) + below[:, None] * np.log(q) + (REGISTERS - above - below)[:, None] * np.log(equal)).argmax(axis=1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, d1, d2: a digest of the set, sketch binary) of every whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d, s = [], [], []
            for x in shingle_sets(*byte_column(b.column(1))):
                n.append(len(x))
                d.append(((x * _place[0] ^ (x >> np.uint64(29))).sum(dtype=np.uint64), _mixed(x ^ _place[1]).sum(dtype=np.uint64)))
                s.append(registers(x).tobytes() if len(x) else b"")
            d = np.array(d, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(s, pa.binary())], ["k", "n_shingles", "d1", "d2", "sketch"])

    return docs.select(F.col(key).cast("long").alias("k"), text).mapInArrow(run, "k long, n_shingles long, d1 long, d2 long, sketch binary").withColumnRenamed("k", key)


def least_estimates(percent: int) -> tuple[float, float]:
    """The least likelihood estimate and the least share of equal registers of pairs to verify."""
    error = (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    return percent / 100 - ESTIMATE_ERRORS * error, percent / 100 - EQUAL_ERRORS * error


def _promising(block: np.ndarray, ids: np.ndarray, n: np.ndarray, regs: np.ndarray, comp: np.ndarray | None, cross: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, likelihood estimate) of a tile's pairs that may reach the threshold; with comp only those of different components."""
    least, least_equal = least_estimates(percent)
    left = np.flatnonzero(block == block.min()) if cross else np.arange(len(ids))
    right = np.flatnonzero(block != block.min()) if cross else left
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(left), 64):
        own = left[lo : lo + 64]
        same = (regs[own][:, None, :] == regs[right][None, :, :]).sum(axis=2, dtype=np.int32)
        ok = (same >= least_equal * REGISTERS) & (100 * np.minimum(n[own][:, None], n[right][None, :]) >= percent * np.maximum(n[own][:, None], n[right][None, :]))
        ok &= ids[own][:, None] != ids[right][None, :] if cross else ids[own][:, None] < ids[right][None, :]
        if comp is not None:
            ok &= comp[own][:, None] != comp[right][None, :]
        r, c = np.nonzero(ok)
        for k in range(0, len(r), 4096):
            a, b = own[r[k : k + 4096]], right[c[k : k + 4096]]
            likely = likeliest(n[a], n[b], (regs[a] > regs[b]).sum(axis=1), (regs[a] < regs[b]).sum(axis=1))
            keep = likely >= least
            out.append((a[keep], b[keep], likely[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_here(regs_a: np.ndarray, regs_b: np.ndarray, band: int) -> np.ndarray:
    """Whether `band` is the first band in which the sketches agree: each pair is judged in one bucket only."""
    agree = (regs_a.reshape(-1, REGISTERS // BAND, BAND) == regs_b.reshape(-1, REGISTERS // BAND, BAND)).all(axis=2)
    return agree.argmax(axis=1) == band


def _open_members(t: dict, cross: bool, percent: int) -> list[tuple[int, int]]:
    """(bucket, member) of the members that have a promising partner in another component."""
    i, j, _ = _promising(t["block"], t["id"], t["n"], t["regs"], t["comp"], cross, percent)
    here = _first_here(t["regs"][i], t["regs"][j], int(t["band"][0]))
    return [(int(t["key"][0]), int(x)) for x in t["id"][np.unique(np.concatenate([i[here], j[here]]))]]


def _joined(t: dict, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join components, verified on whole sets; the most similar pairs first, and none between what is joined by then."""
    i, j, likely = _promising(t["block"], t["id"], t["n"], t["regs"], t["comp"], cross, percent)
    here = _first_here(t["regs"][i], t["regs"][j], int(t["band"][0]))
    i, j, likely = i[here], j[here], likely[here]
    parent: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    held = 0

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def shingles(k: int) -> np.ndarray:
        nonlocal held
        if k not in sets:
            raw, at = byte_column(t["text"].slice(k, 1))
            x = next(shingle_sets(raw, at))
            if held > 4 * SHINGLES:
                sets.clear()
                held = 0
            sets[k], held = x, held + len(x)
            return x
        return sets[k]

    out = []
    for k in np.argsort(-likely, kind="stable"):
        a, b = int(i[k]), int(j[k])
        x, y = root(int(t["comp"][a])), root(int(t["comp"][b]))
        if x != y and alike(shingles(a), shingles(b), percent):
            parent[x] = y
            out.append((int(min(t["id"][a], t["id"][b])), int(max(t["id"][a], t["id"][b]))))
    return out


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _tiles(rows: DataFrame, judge, names: tuple[str, str], percent: int) -> DataFrame:
    """What `judge` finds in each tile. rows: key, band, id, n, sketch, comp, main (whether comp is the bucket's largest component), own
    and other (how many blocks of members of that component and of others the bucket has), and text if it is needed."""
    columns = ["key", "ti", "tj", "band", "block", "id", "n", "comp", "sketch", *(["text"] if "text" in rows.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table, last: bool) -> tuple[list, pa.Table]:
            t = t.combine_chunks()
            tile = np.column_stack([t.column(c).to_numpy() for c in ("key", "ti", "tj")])
            cut = np.r_[0, np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1, len(tile)]
            cut = cut if last else cut[:-1]
            whole = {c: t.column(c).to_numpy() for c in ("key", "band", "block", "id", "n", "comp")}
            whole["regs"] = byte_column(t.column("sketch"))[0].reshape(-1, REGISTERS)
            found = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i > 1:
                    own = {c: x[i:j] for c, x in whole.items()} | ({"text": t.column("text").slice(i, j - i)} if "text" in columns else {})
                    found += judge(own, bool(tile[i, 1] != tile[i, 2]), percent)
            return found, t.slice(cut[-1])

        def made(found: list) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], list(names))

        for b in batches:
            t = pa.Table.from_batches([b])
            found, held = done(pa.concat_tables([held, t]) if held is not None and len(held) else t, False)
            yield from made(found)
        if held is not None and len(held):
            yield from made(done(held, True)[0])

    part = F.xxhash64("id")
    tiled = rows.withColumn("block", F.when(F.col("main"), F.pmod(part, "own")).otherwise(F.col("own") + F.pmod(part, "other")).cast("int"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.when(F.col("main"), F.col("own")).otherwise(0).cast("int"), (F.col("own") + F.col("other") - 1).cast("int"))))
    tiled = tiled.withColumn("ti", F.least("block", "o")).withColumn("tj", F.greatest("block", "o")).select(*columns)
    dealt = tiled.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "id")
    return dealt.mapInArrow(run, f"{names[0]} long, {names[1]} long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            sets = zip(shingle_sets(*byte_column(b.column(2))), shingle_sets(*byte_column(b.column(3))), strict=True)
            for i, (x, y) in enumerate(sets):
                if alike(x, y, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches may reach the threshold. pairs: a, b, na, nb, sa, sb."""
    least, least_equal = least_estimates(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = (byte_column(b.column(i))[0].reshape(-1, REGISTERS) for i in (4, 5))
            ok = np.flatnonzero(((x == y).sum(axis=1) >= least_equal * REGISTERS) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            keep = [ok[k : k + 4096][likeliest(n[i := ok[k : k + 4096]], m[i], (x[i] > y[i]).sum(axis=1), (x[i] < y[i]).sum(axis=1)) >= least] for k in range(0, len(ok), 4096)]
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *keep]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _to_smallest(members: DataFrame, most: int) -> DataFrame:
    """(a, b): each member (key, id, c) of a bucket with the smallest of its part, and so on among these."""
    out, size, level = None, F.col("c"), members.select("key", "id", "c")
    while True:
        parts = F.ceil(size / FAN)
        level = level.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("a", F.min("id").over(Window.partitionBy("key", "part")))
        pairs = level.where("a <> id").select("a", F.col("id").alias("b"))
        out = pairs if out is None else out.union(pairs)
        if most <= FAN:
            return out.distinct()
        level, size, most = written(level.where("a = id").select("key", "id", "c")), F.ceil(size / FAN), -(-most // FAN)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles long, component_id long, kept boolean) of every row; kept: the key is its component's smallest.

    Keys are unique integers; rows with a null key are left out, a repeated key counts once with the text of least hash. Texts
    without a word are linked with nothing; with fewer than five words the whole sequence is the one shingle. percent: least similarity
    of a link; a pair at 80 agrees in no band with chance 3e-5 (4e-7 at 85).
    """
    clean = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    ids = clean.agg(F.count("id").alias("n"), F.countDistinct("id").alias("d")).first()
    if ids["n"] != ids["d"]:
        clean = written(clean.groupBy("id").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text")))
    sketched = written(sketches(clean, "id"))
    set_key = F.struct("n_shingles", "d1", "d2").alias("set")
    classes = written(sketched.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("rep"), F.min_by("sketch", "id").alias("sketch"), F.count("*").alias("c")))
    bands = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sketch", i * BAND + 1, BAND)).alias("key")) for i in range(REGISTERS // BAND)]
    keyed = classes.select(F.col("rep").alias("id"), F.explode(F.array(*bands)).alias("e")).select("id", "e.band", "e.key")
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    found = sizes.agg(F.sum("c").alias("n"), F.max("c").alias("m")).first()
    members = written(key_join(keyed, sizes, "key", "c", found["n"] or 0))
    reps = classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    texts = written(clean.join(members.select("id").distinct(), "id", "left_semi"))
    pairs = written(_to_smallest(members, found["m"] or 0))
    sketched_pairs = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    links = written(_verified(written(_likely(sketched_pairs, percent)), texts, percent))
    comps = written(connected(links).withColumnRenamed("node", "id"))
    tagged = written(members.drop("c").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component").join(reps.select("id", "n"), "id"))
    # of each bucket the largest component, and how many members and shingles lie in it and outside
    by_comp = tagged.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    mixed = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda c, w: F.ceil(F.greatest(F.col(c) / TILE, F.col(w) / SHINGLES)).alias
    mixed = written(mixed.select("key", "c", F.col("top.comp").alias("largest"), F.col("top.c").alias("tc"), F.col("top.w").alias("tw"), (F.col("c") - F.col("top.c")).alias("oc"), (F.col("w") - F.col("top.w")).alias("ow")).select("key", "c", "largest", blocks("tc", "tw")("own"), blocks("oc", "ow")("other")))
    split = key_join(tagged, mixed, "key", "c", mixed.agg(F.sum("c")).first()[0] or 0).withColumn("main", F.col("comp") == F.col("largest")).drop("c", "largest")
    split = written(split.join(reps.select("id", "sketch"), "id"))
    unsure = written(_tiles(split, _open_members, ("key", "id"), percent))
    more = written(_tiles(split.join(unsure, ["key", "id"]).join(texts, "id"), _joined, ("a", "b"), percent))
    # the second round's links join components of the first
    ends = [comps.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
    between = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    last = written(connected(between).select(F.col("node").alias("first"), F.col("component").alias("component_id")))
    firsts = written(classes.select(set_key, "c", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set", "c", F.coalesce("component", "rep").alias("first")))
    named = written(firsts.join(last, "first", "left").select("set", "c", F.coalesce("component_id", "first").alias("component_id")))
    full = sketched.where("n_shingles > 0").select("id", "n_shingles", set_key)
    out = key_join(full, named, "set", "c", ids["d"]).select("id", "n_shingles", "component_id").union(sketched.where("n_shingles = 0").select("id", "n_shingles", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
