"""Removal of byte strings that repeat anywhere in the corpus, by prefix-free parsing.

The text is parsed at triggers of a rolling hash: in every run of LENGTH bytes the first GRAM-byte string of least hash is the
trigger, so equal runs have equal triggers and every run belongs to exactly one. A phrase is a stretch of successive runs of
one trigger, on one side of it (whether the run reaches CONTEXT bytes before the trigger); phrases overlap by LENGTH - 1 bytes, so each
run of LENGTH bytes lies whole in one phrase, and the dictionary of distinct phrases holds every distinct run.

Dictionary: phrases meet by the hash of a context that all their runs contain, then by the hash of their whole content; of
equal phrases all but the first in corpus order are repeats as a whole, wherever the parse has them. Distinct phrases that share a
context are resolved suffix by suffix: the suffixes of these dictionary phrases, cut to LENGTH bytes and sorted by the hash of
that prefix, with their corpus position, form the groups of equal runs; all but the first of a group are repeats. Phrases whose
context occurs once have no repeated run, and never come that far.

Before each shuffle a task keeps the first of its own equal phrases (or suffixes) and marks the others, which are certain
repeats; a context under which a task saw several contents sends one row. So a passage that a third of all documents hold
arrives once from each batch of rows, and every step is a sort that streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ARROW, byte_column, written

LENGTH = 100
GRAM = 12
CONTEXT = (LENGTH - GRAM) // 2
CHUNK = 1 << 18  # bytes that are hashed at a time
BATCH = 8 << 20  # bytes whose phrases a task compares among themselves
SUFFIXES = 2 << 20  # bytes whose suffixes a task compares among themselves

_rng = np.random.default_rng(7)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_other = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOW = np.uint64(24)  # bits of a position in a chunk


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Spans:
    """Hashes of spans of a byte array, from prefix sums modulo 2^64."""

    def __init__(self, raw: np.ndarray, table: np.ndarray):
        n = len(raw)
        if len(_powers[0]) <= n:
            for i, step in enumerate((_STEP, _BACK)):
                p = np.full(max(n + 1, 2 * CHUNK), step, np.uint64)
                p[0] = 1
                _powers[i] = np.cumprod(p, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw] * _powers[0][:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[hi] - self.sums[lo]) * _powers[1][lo])

    def every(self, k: int) -> np.ndarray:
        return _mixed((self.sums[k:] - self.sums[:-k]) * _powers[1][: len(self.sums) - k])


def parse(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the texts raw[at[i]:at[i+1]]: context hash, content hash, text, first run's start in the text, number of runs."""
    n, span = len(raw), LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    spans = _Spans(raw, _byte)
    least = spans.every(GRAM) >> _LOW << _LOW | np.arange(n - GRAM + 1, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    trigger = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(trigger))
    left = np.maximum(0, np.diff(at) - LENGTH + 1)  # runs of each text
    live = np.zeros(len(trigger) + 1, np.int32)
    np.add.at(live, at[:-1][left > 0], 1)
    np.add.at(live, (at[:-1] + left)[left > 0], -1)
    key = np.where(np.cumsum(live[:-1]) > 0, trigger * 2 + (trigger - start >= CONTEXT), -1)
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tail = np.r_[head[1:], len(key)]
    own = key[head] >= 0
    head, tail = head[own], tail[own]
    t, before = trigger[head], key[head] & 1
    context = spans.of(t - before * CONTEXT, t + GRAM + (1 - before) * CONTEXT) + before.astype(np.uint64)
    content = _mixed(spans.of(head, tail - 1 + LENGTH) + np.uint64(0x632BE5AB) * (tail - head).astype(np.uint64))
    text = np.searchsorted(at, head, "right") - 1
    return context, content, text, head - at[text], tail - head


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole texts of about CHUNK bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def _pieces(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) of the texts by chunk; a text too long for positions of 24 bits is cut into overlapping parts by
    the caller."""
    raw, at = byte_column(texts)
    for lo, hi in _chunks(at):
        yield raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo


def _parsed(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """parse() over a whole column; texts beyond 8 MB go in parts that overlap by LENGTH - 1 bytes."""
    part = 8 << 20
    found = []
    for raw, at, row in _pieces(texts):
        if len(raw) <= part:
            c, h, t, s, n = parse(raw, at)
            found.append((c, h, t + row, s, n))
            continue
        for lo in range(0, len(raw) - LENGTH + 1, part):  # one text: a stretch longer than a part is alone in its chunk
            piece = raw[lo : lo + part + LENGTH - 1]
            c, h, t, s, n = parse(piece, np.array([0, len(piece)]))
            found.append((c, h, t + row, s + lo, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else parse(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _slices(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of rows of about `size` bytes of text, so that a task's memory does not follow the rows' length."""
    for b in batches:
        _, at = byte_column(b.column(column))
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to the tasks' workers in batches of at most BATCH bytes (and one row)."""
    before = spark.conf.get(ARROW)
    spark.conf.set(ARROW, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(ARROW, before)


FIRST, REPEAT, CHECK = 0, 1, 2
_MARKS = "doc long, start int, runs int, kind int"


def _rows(columns: list[np.ndarray], names: list[str], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[lo : lo + size])) for c in columns], names)


def _phrases(docs: DataFrame) -> DataFrame:
    """(route, several, content, doc, start, runs, kind) of each phrase, after the task's own equal phrases are resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, BATCH):
            ids = b.column(0).to_numpy()
            context, content, text, start, runs = _parsed(b.column(1))
            doc = ids[text] if len(text) else np.zeros(0, np.int64)
            order = np.lexsort((start, doc, content, context))
            context, content, doc, start, runs = (x[order] for x in (context, content, doc, start, runs))
            if not len(doc):
                continue
            new = np.r_[True, context[1:] != context[:-1]]
            other = new | np.r_[True, content[1:] != content[:-1]]
            group = np.cumsum(new) - 1
            several = np.bincount(group, weights=other)[group] > 1
            kind = np.where(other, np.where(several & ~new, CHECK, FIRST), REPEAT)
            lone = np.where(kind == FIRST, context, _mixed(doc.astype(np.uint64))).view(np.int64)
            # of several contents the first is sent to meet others, and is checked like the rest
            again = np.flatnonzero((kind == FIRST) & several)
            cat = lambda x, y: np.concatenate([x, y])
            yield from _rows(
                [cat(lone, _mixed(doc[again].astype(np.uint64)).view(np.int64)), cat((kind == FIRST) & several, np.zeros(len(again), bool)).astype(np.int32), cat(content, content[again]).view(np.int64), cat(doc, doc[again]), cat(start, start[again]).astype(np.int32), cat(runs, runs[again]).astype(np.int32), cat(kind, np.full(len(again), CHECK)).astype(np.int32)],
                ["route", "several", "content", "doc", "start", "runs", "kind"],
            )

    return docs.select("doc", "text").mapInArrow(run, "route long, several int, content long, doc long, start int, runs int, kind int")


def _dictionary(phrases: DataFrame) -> DataFrame:
    """Marks (doc, start, runs, kind): phrases that repeat as a whole, and phrases whose suffixes must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = content = None  # of the last row; whether its context is known to have several contents; its first row, if not yet marked
        several, waiting = False, None
        for b in batches:
            r, s, h, d, st, n, k = (b.column(i).to_numpy() for i in range(7))
            first = np.flatnonzero(k == FIRST)
            out = [np.column_stack([d, st, n, k])[k != FIRST]]
            if len(first):
                r, s, h, d, st, n = (x[first] for x in (r, s, h, d, st, n))
                new = np.r_[route is None or r[0] != route, r[1:] != r[:-1]]
                other = new | np.r_[content is None or h[0] != content, h[1:] != h[:-1]]
                group = np.cumsum(new)  # 0: goes on from the batch before
                size = int(group[-1]) + 1
                many = (np.bincount(group, weights=other & ~new, minlength=size) > 0) | (np.bincount(group, weights=s, minlength=size) > 0)
                many[0] |= several
                kind = np.where(~other, REPEAT, np.where(many[group], CHECK, FIRST))
                out.append(np.column_stack([d, st, n, kind])[kind != FIRST])
                if waiting is not None and many[0]:
                    out.append(np.array([[*waiting, CHECK]]))
                if waiting is not None and (many[0] or size > 1):
                    waiting = None
                last = np.flatnonzero(group == size - 1)
                if size > 1 or new[0]:
                    several = bool(many[-1])
                    waiting = None if several else (d[last[0]], st[last[0]], n[last[0]])
                else:
                    several = bool(many[0])
                route, content = r[-1], h[-1]
            x = np.concatenate(out)
            if len(x):
                yield from _rows([x[:, 0], x[:, 1].astype(np.int32), x[:, 2].astype(np.int32), x[:, 3].astype(np.int32)], ["doc", "start", "runs", "kind"])

    # contents in corpus order, whichever task knew of several: of equal phrases the first must come first
    dealt = phrases.repartition("route").sortWithinPartitions("route", "content", "doc", "start")
    return dealt.mapInArrow(run, _MARKS)


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, m: array of start, runs) from (doc, start, runs): neighbours are one span before the spans of a document meet, so that their
    number follows the passages and not the bytes of a document; a long document's spans are merged by stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, s, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            if not len(d):
                continue
            base = np.cumsum(np.r_[False, d[1:] != d[:-1]]).astype(np.int64) << 40
            until = np.maximum.accumulate(s + n + base)
            head = np.flatnonzero(np.r_[True, (s + base)[1:] > until[:-1]])
            end = until[np.r_[head[1:], len(d)] - 1] - base[head]
            yield from _rows([d[head], s[head].astype(np.int32), (end - s[head]).astype(np.int32)], ["doc", "start", "runs"])

    dealt = spans.select("doc", "start", "runs").withColumn("part", F.shiftright("start", 20)).repartition("doc", "part").sortWithinPartitions("doc", "start")
    return dealt.select("doc", "start", "runs").mapInArrow(run, "doc long, start int, runs int").groupBy("doc").agg(F.collect_list(F.struct("start", "runs")).alias("m"))


def _suffixes(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(w1, w2, doc, start, kind) for every suffix of the phrases to check, cut to LENGTH bytes; the task's own repeats are marked."""
    listed = _merged(marks.where(F.col("kind") == CHECK))

    def told(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        found.clear()
        order = np.lexsort(columns[::-1])
        for i, x in enumerate(columns):  # one at a time: only one is held twice
            columns[i] = x[order]
        del order, x
        w1, w2, doc, p = columns
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        yield from _rows([np.where(new, w1, _mixed(doc.astype(np.uint64))).view(np.int64), w2, doc, p, np.where(new, FIRST, REPEAT).astype(np.int32)], ["w1", "w2", "doc", "start", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, SUFFIXES):
            ids, lists = b.column(0).to_numpy(), b.column(2)
            first = lists.offsets.to_numpy()
            starts, runs = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(2))  # offsets count from the start of the values, in slices too
            found, many = [], 0
            for raw, at, row in _pieces(b.column(1)):
                lo, hi = first[row], first[row + len(at) - 1]
                begin = np.repeat(at[:-1], np.diff(first[row : row + len(at)])) + starts[lo:hi]
                for cut in range(0, len(raw), SUFFIXES):  # one turn but for a long text
                    a = np.maximum(begin, cut)
                    k = np.maximum(np.minimum(begin + runs[lo:hi], cut + SUFFIXES) - a, 0)
                    p = np.unique(np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                    if not len(p):
                        continue
                    part = raw[cut : cut + SUFFIXES + LENGTH - 1]
                    t = np.searchsorted(at, p, "right") - 1
                    w1, w2 = (_Spans(part, table).of(p - cut, p - cut + LENGTH) for table in (_byte, _other))
                    found.append((w1, (w2 >> np.uint64(33)).astype(np.int32), ids[t + row], (p - at[t]).astype(np.int32)))
                    many += len(p)
                    if many >= SUFFIXES:
                        yield from told(found)
                        many = 0
            if found:
                yield from told(found)

    return docs.join(listed, "doc").select("doc", "text", "m").mapInArrow(run, "w1 long, w2 int, doc long, start int, kind int")


def _ranked(suffixes: DataFrame) -> DataFrame:
    """Marks of the suffixes that are not the first of their group in corpus order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            w1, w2, d, s, k = (b.column(i).to_numpy() for i in range(5))
            first = np.flatnonzero(k == FIRST)
            out = [np.column_stack([d, s])[k != FIRST]]
            if len(first):
                w1, w2, d, s = (x[first] for x in (w1, w2, d, s))
                same = np.r_[last == (w1[0], w2[0]), (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]
                last = (w1[-1], w2[-1])
                out.append(np.column_stack([d, s])[same])
            x = np.concatenate(out)
            if len(x):
                yield from _rows([x[:, 0], x[:, 1].astype(np.int32), np.ones(len(x), np.int32), np.full(len(x), REPEAT, np.int32)], ["doc", "start", "runs", "kind"])

    return suffixes.repartition("w1").sortWithinPartitions("w1", "w2", "doc", "start").mapInArrow(run, _MARKS)


def _removed(own: np.ndarray, spans: pa.Array, whole_letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of a text that its spans (start, runs) cover, in order and apart from each other."""
    s = spans.field(0).to_numpy().astype(np.int64)
    order = np.argsort(s, kind="stable")
    s, until = s[order], np.maximum.accumulate((s + spans.field(1).to_numpy() - 1 + LENGTH)[order])
    head = np.flatnonzero(np.r_[True, s[1:] > until[:-1]])
    low, high = s[head], until[np.r_[head[1:], len(s)] - 1]
    if whole_letters:  # up to the next begin of a code point, and back to one
        for _ in range(3):
            low = low + ((low < len(own)) & ((own[np.minimum(low, len(own) - 1)] & 0xC0) == 0x80))
            high = high - ((high < len(own)) & ((own[np.minimum(high, len(own) - 1)] & 0xC0) == 0x80))
        low, high = low[low < high], high[low < high]
    return low, high


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", whole_letters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_bytes long, n_removed long, n_spans long, kept binary, carried columns) of every text as UTF-8 bytes; null is empty.

    Removed is each byte covered by a LENGTH-byte string that also starts earlier, at a smaller key or an earlier place of the
    same text; matches never cross texts and are judged on the input. Texts under LENGTH bytes stay whole. whole_letters: a code
    point goes only if all its bytes go, so that kept is UTF-8. Keys are unique integers: rows with a null key are left out, and of rows
    with equal keys the one whose text has the least hash stays. Tasks work through a long text in parts.
    """
    plain = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    ids = plain.agg(F.count("doc").alias("n"), F.countDistinct("doc").alias("d")).first()
    if ids["n"] != ids["d"]:
        rest = F.struct(*[x for x in plain.columns if x != "doc"])
        one = plain.groupBy("doc").agg(F.min_by(rest, F.struct(F.xxhash64("text"), F.xxhash64(*[x for x in plain.columns if x != "doc"]))).alias("r"))
        plain = written(one.select("doc", *[F.col(f"r.{x}").alias(x) for x in plain.columns if x != "doc"]))
    with _small_batches(docs.sparkSession):
        marks = written(_dictionary(_phrases(plain)))
        ranked = written(_ranked(_suffixes(plain, marks)))
    spans = marks.where(F.col("kind") == REPEAT).select("doc", "start", "runs").union(ranked.select("doc", "start", "runs"))
    listed = _merged(spans)
    extra = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, BATCH):
            raw, at = byte_column(b.column(1))
            lists = b.column(2)
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for i in range(len(b)):
                own = raw[at[i] : at[i + 1]]
                n_bytes.append(len(own))
                if not lists[i].is_valid:
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(own.tobytes())
                    continue
                low, high = _removed(own, lists[i].values, whole_letters)
                n_removed.append(int((high - low).sum()))
                n_spans.append(len(low))
                kept.append(b"".join(own[a:z].tobytes() for a, z in zip([0, *high.tolist()], [*low.tolist(), len(own)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), *b.columns[3:]], ["k", "n_bytes", "n_removed", "n_spans", "kept", *extra])

    kinds = "".join(f", {c} {plain.schema[c].dataType.simpleString()}" for c in extra)
    out = plain.join(listed, "doc", "left").select("doc", "text", "m", *extra).mapInArrow(run, f"k long, n_bytes long, n_removed long, n_spans long, kept binary{kinds}")
    return out.select(F.col("k").alias(key), "n_bytes", "n_removed", "n_spans", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
