"""Importance resampling towards a target distribution, on hashed runs of words that an Aho-Corasick automaton reads.

The automaton's dictionary holds distinct words with a delimiter at both ends, so that a match is one whole word and neighbours may share
a delimiter; each carries the CRC-32 and the length of its UTF-8 bytes. A scan of a text gives the payloads of its words in order, and
the CRC of a run of neighbouring words is composed from theirs, without the bytes: crc(ab) = crc(a) moved on by len(b) zero bytes, xor
crc(b). Each task fills its own dictionary from the words that its scans did not know; these have their payload taken from their bytes, so
results do not depend on what a dictionary holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import byte_column, written

BUCKETS = 10_000
MOST_WORDS = 100_000  # of a task's dictionary; a full one starts anew
LONGEST = 64  # bytes of a word in a dictionary
CHUNK = 1 << 22  # bytes of a scan, up to the end of a word
SPACE = zlib.crc32(b" ")

#: Word bytes as they are, A-Z lower-cased, all other ASCII the delimiter.
FOLD = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


@cache
def _steps() -> list[np.ndarray]:
    """For each k, tables by byte of the linear map that moves a CRC on by 2^k zero bytes."""
    base = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)

    def tables(f) -> np.ndarray:
        bits = [f(np.array([1 << i], np.uint32))[0] for i in range(32)]
        return np.array([[np.bitwise_xor.reduce([bits[8 * j + i] for i in range(8) if b >> i & 1] or [np.uint32(0)]) for b in range(256)] for j in range(4)], np.uint32)

    out = [tables(lambda c: base[c & 255] ^ (c >> np.uint32(8)))]
    while len(out) < 31:
        out.append(tables(lambda c: _apply(out[-1], _apply(out[-1], c))))
    return out


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved on by so many zero bytes."""
    crc, k = crc.astype(np.uint32), 0
    while (by >> k).any():
        some = (by >> k & 1).astype(bool)
        crc[some] = _apply(_steps()[k], crc[some])
        k += 1
    return crc


class Dictionary:
    """Words with their payloads, and the automaton over those that were there when it was last built."""

    def __init__(self, most: int = MOST_WORDS) -> None:
        self.most = most
        self.words: dict[bytes, int] = {}
        self.crc, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.machine = ahocorasick.Automaton()

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in sorted(words) if w not in self.words and len(w) <= LONGEST]
        if len(self.words) + len(new) > self.most:
            self.words, new = {}, sorted(w for w in words if len(w) <= LONGEST)[: self.most]
        if not new and self.words:
            return
        self.words |= {w: len(self.words) + i for i, w in enumerate(new)}
        self.crc = np.array([zlib.crc32(w) for w in self.words], np.uint32)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.machine = ahocorasick.Automaton()
        for w, i in self.words.items():
            self.machine.add_word(f" {w.decode('latin-1')} ", i)
        if self.words:
            self.machine.make_automaton()

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC and length of each word of a folded text that begins and ends with a delimiter."""
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff((raw != 32).astype(np.int8))
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        crc, known = np.zeros(len(start), np.uint32), np.zeros(len(start), bool)
        if self.words:
            hits = np.fromiter(chain.from_iterable(self.machine.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, hits[:, 0])
            crc[at], known[at] = self.crc[hits[:, 1]], True
        rest = np.flatnonzero(~known)
        if len(rest):
            words = [text[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            crc[rest] = [zlib.crc32(w) for w in words]
            self.learn(set(words))
        return start, crc, end - start


def words_of(book: Dictionary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, CRC, length) of the words of folded texts."""
    whole = b" " + b" ".join(texts) + b" "  # a delimiter between texts, so that no word crosses two
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    rows, crcs, sizes = [], [], []
    low = 0
    while low < len(whole) - 1:
        high = whole.index(b" ", min(low + CHUNK, len(whole) - 1))
        start, crc, size = book.payloads(whole[low : high + 1])
        rows.append(np.searchsorted(begins, start + low, "right") - 1)
        crcs.append(crc), sizes.append(size)
        low = high
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(crcs, np.uint32), join(sizes, np.int64)


def folded(column: pa.Array) -> list[bytes]:
    """The texts with A-Z lower-cased and all other ASCII but digits and letters as delimiters."""
    raw, at = byte_column(column)
    whole = FOLD[raw].tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def pieces(b: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices that end with the row that brings them to `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < b.num_rows:
        reached = (ends[low - 1] if low else 0) + most
        high = min(b.num_rows, int(np.searchsorted(ends, reached)) + 1)
        yield b.slice(low, high - low)
        low = high


def runs(row: np.ndarray, crc: np.ndarray, size: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC) of all runs of n neighbouring words of a row, joined by one space, for each n from low to high."""
    spaced = moved(np.full(len(crc), SPACE, np.uint32), size) ^ crc
    own = crc
    for n in range(1, high + 1):
        if n > 1:
            m = max(0, len(crc) - n + 1)
            own = moved(own[:m], size[n - 1 :] + 1) ^ spaced[n - 1 :] if m else own[:0]
        if n >= low:
            inside = row[: len(own)] == row[n - 1 :] if len(own) else np.zeros(0, bool)
            yield row[: len(own)][inside], own[inside]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(k, n_words long, n_features long, codes binary): the buckets of a text's runs as unsigned numbers of 2 bytes, or 4 from 65536
    buckets on. A null text has none."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Dictionary()
        for b in (x for whole in batches for x in pieces(whole, "t")):
            row, crc, size = words_of(book, folded(b.column("t")))
            found = list(runs(row, crc, size, low, high))
            of = np.concatenate([r for r, _ in found])
            code = np.concatenate([c % buckets for _, c in found]).astype(kind)
            if low < high:
                code = code[np.argsort(of, kind="stable")]
            n = np.bincount(of, minlength=b.num_rows)
            offsets = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
            codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(code)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(np.bincount(row, minlength=b.num_rows).astype(np.int64)), pa.array(n.astype(np.int64)), codes], ["k", "n_words", "n_features", "codes"])

    return rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, codes binary")


def _codes(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw, at = byte_column(column)
    return np.frombuffer(raw.tobytes(), kind), at // kind.itemsize


def bucket_counts(coded: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket int, n long) of the buckets that occur; tasks add up before the shuffle."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            sums += np.bincount(_codes(b.column("codes"), kind)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    return coded.select("codes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket floor(1000 ln of the ratio of its smoothed shares in target and source); both are counts by bucket, so that the driver
    gets one row a bucket."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    rows = both.select("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t"))
    in_source, in_target = rows.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(in_source + buckets) / ((F.col("s") + 1) * F.lit(in_target + buckets))
    got = rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r["bucket"]] = r["gain"]
    return out


def weights(coded: DataFrame, gain: np.ndarray) -> DataFrame:
    """(k, n_words, n_features, weight long): the sum of the gains of a row's buckets."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = _codes(b.column("codes"), kind)
            sums = np.concatenate([[0], np.cumsum(gain[codes])])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("k", "n_words", "n_features")), pa.array(sums[at[1:]] - sums[at[:-1]])], ["k", "n_words", "n_features", "weight"])

    return coded.mapInArrow(run, f"k {coded.schema['k'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank` long from 1 in the given order. They are dealt out by range, so each task sorts a stretch; the numbers of
    rows of the stretches before, one number a partition, are added to the place in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, rank = {}, 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # one row a partition
        before[r["p"]] = rank
        rank += r["n"]
    offsets = rows.sparkSession.createDataFrame(sorted(before.items()), "_p long, _before long")
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_before") + F.col("_at") % (1 << 33) + 1).drop("_p", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row a row of docs: key, n_features, weight, score, rank, all long but the key. Draws without replacement floor(percent / 100) of
    the documents of `least_words` words or more, in proportion to how likely their runs of words are in the texts of target rather
    than in docs: the highest scores, weight plus Gumbel noise; of equal scores the smaller key goes first, a null key last. rank
    counts the drawn from 1 and is null for others. A null or empty text has no features and the weight 0. Repeated rows are drawn each for
    itself; their noise is the same. Texts are read once; after that only their buckets, 2 bytes a run."""
    coded = written(features(docs, key, text, low, high, buckets))
    goal = features(target.withColumn("_k", F.lit(0)), "_k", text, low, high, buckets)
    gain = gains(bucket_counts(coded, buckets), bucket_counts(goal, buckets), buckets)
    scored = weights(coded, gain).withColumn("score", (F.col("weight") + noise(F.col("k"), seed)).cast("long"))
    own = written(scored)
    fit = own.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    inside = ranked(fit, F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("n_features"), F.col("weight"))
    inside = inside.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = inside.unionByName(own.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("k").alias(key), "n_features", "weight", "score", "rank")


def resample_sql(buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """The registered query's rows over the tables documents and benchmark, in DuckDB's SQL."""
    digits = "0123456789ABCDEF"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH crc_table AS (SELECT list(v ORDER BY c) AS t FROM (SELECT c, list_reduce(list_prepend(c::UBIGINT, range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS v FROM range(256) r(c))),
    doc_words AS (SELECT doc_id, {words} AS ws FROM documents),
    doc_word AS (SELECT doc_id, unnest(ws) AS w FROM doc_words),
    goal_word AS (SELECT unnest({words}) AS w FROM benchmark),
    distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM doc_word UNION ALL SELECT w FROM goal_word)),
    hexed AS (SELECT w, hex(encode(w)) AS x FROM distinct_words),
    crcs AS (
      SELECT w, CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x), 2), lambda i: ((strpos('{digits}', x[i]) - 1) * 16 + strpos('{digits}', x[i + 1]) - 1)::UBIGINT)),
        lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) % {buckets} AS INTEGER) AS bucket
      FROM hexed, crc_table
    ),
    s AS (SELECT bucket, count(*)::DOUBLE AS n FROM doc_word JOIN crcs USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*)::DOUBLE AS n FROM goal_word JOIN crcs USING (w) GROUP BY bucket),
    sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS S, (SELECT coalesce(sum(n), 0) FROM t) AS T),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (S + {buckets}) / ((s.n + 1) * (T + {buckets})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), sums),
    weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM doc_word JOIN crcs USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
    scored AS (
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(list_transform(string_split(sha256('{seed}:' || CAST(doc_id AS VARCHAR))[1:8], ''), lambda d: strpos('{digits}', upper(d)) - 1), lambda a, b: a * 16 + b) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM doc_words LEFT JOIN weighed USING (doc_id)
    ),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {least_words})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
    """
