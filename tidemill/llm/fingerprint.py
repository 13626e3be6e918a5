"""Quartile bucket digest of texts, and the comparison of digests.

A digest counts hashed byte triplets in 128 buckets and writes, as lower-case hex: one byte for the length (logarithmic), one
for the ratios of the quartiles, then two bits a bucket for the quarter of the sorted counts in which it lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
FAR = 1.25 * BUCKETS  # expected difference of two digests whose bucket codes are unrelated
LENGTH_STEP = np.log(1.1)
LEAST = -(2**63)

_mix = np.random.default_rng(19700101).integers(1, 1 << 32, 3, dtype=np.uint32) | np.uint32(1)
_first, _second, _third = (np.arange(256, dtype=np.uint32) * m for m in _mix)
_scramble = np.uint32(2654435761)


def digest(text: str | None) -> str:
    """The digest of a whole text; null and empty texts, and those under three bytes, have all counts 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    if len(b) > 2:
        h = _first[b[:-2]] + _second[b[1:-1]] + _third[b[2:]]
        counts = np.bincount((h ^ (h >> np.uint32(15))) * _scramble >> np.uint32(25), minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
    low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).reshape(-1, 4)
    packed = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    size = min(255, int(np.log(len(b)) / LENGTH_STEP) + 1) if len(b) else 0
    ratios = (int(low * 15 // high) << 4 | int(mid * 15 // high)) if high else 0
    return bytes([size, ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


_pairs = np.abs((np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3)[:, None, :] - (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3)[None, :, :]).sum(axis=2)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0: one less the difference score over its bound. The score adds the bucket codes' distances,
    a quarter of the lengths' distance beyond one step, and a quarter of the ratios' distance; it is cut off at the bound."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    size = max(0, abs(int(x[0] - y[0])) - 1)
    ratio = abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
    return float(1 - min(FAR, _pairs[x[2:], y[2:]].sum() + (size + ratio) / 4) / FAR)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_chars long (code points) and fingerprint string of every row; null text is empty."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(map(len, texts), pa.int64()), pa.array(map(digest, texts), pa.string())], [*keep, "n_chars", "fingerprint"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, n_chars long, fingerprint string")


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_slice: int = 4000, most_slices: int = 20_000) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row.

    Rows are put in order of (key, text), the last followed by the first, nulls first; the edited text has its last quarter of
    code points (rounded down) replaced by the first as many, or all, of the next row's text. A lone row is its own next.
    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The keys alone are cut into slices at approximate quantiles. Each slice is sorted by Spark and streamed; the first row of a
    slice is also sent to the slice before it, so texts move once and a task holds two texts at a time. The driver gets the
    first key of each slice, at most most_slices numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("k"), F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    rows = rows.withColumn("kd", F.col("k").cast("double"))
    slices = max(1, min(most_slices, -(-rows.count() // rows_per_slice)))
    cuts = sorted(set(rows.approxQuantile("kd", [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else []
    cuts = [-float("inf"), *(cuts or [0.0]), float("inf")]
    sliced = Bucketizer(splits=cuts, inputCol="kd", outputCol="s").transform(rows).select("k", "key", "t", F.col("s").cast("int").alias("s"))
    heads = sliced.groupBy("s").agg(F.min("k").alias("k")).orderBy("s").collect()
    before = spark.createDataFrame([(h["k"], heads[i - 1]["s"]) for i, h in enumerate(heads)], "k long, before int")
    both = F.explode(F.array_compact(F.array(F.struct("s", F.lit(0).alias("other")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("s"), F.lit(1).alias("other"))))))
    sent = sliced.join(F.broadcast(before), "k", "left").select(both.alias("e"), "k", "key", "t").select("e.s", "e.other", "key", "t")
    dealt = sent.repartitionById(len(cuts) - 1, F.col("s")).sortWithinPartitions("s", "other", F.asc_nulls_first("key"), "t")
    schema = "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for its next; the slice whose follower has come
        for b in batches:
            out = []
            for s, other, k, t in zip(*(b.column(i) for i in range(4)), strict=True):
                s, other, k, t = s.as_py(), other.as_py(), k.as_py(), t.as_py() or ""
                if other and done == s:
                    continue
                now = (s, k, t, digest(t))
                if held is not None and held[0] == s:
                    out.append(_beside(held, now))
                held, done = (None, s) if other else (now, done)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return dealt.mapInArrow(run, schema).withColumnRenamed("k", key)


_OUT = pa.schema([("k", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _beside(row: tuple, follower: tuple) -> dict:
    _, k, t, own = row
    quarter = len(t) // 4
    edited = t[: len(t) - quarter] + follower[2][:quarter]
    print_ = digest(edited)
    return {"k": k, "n_chars": len(t), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own, "edited_fingerprint": print_, "near_edited": likeness(own, print_), "near_next": likeness(own, follower[3])}
