"""The trie of conversation prefixes, by union-find over the edges between neighbours in sorted order.

A turn is 16 bytes of the SHA-256 of its role and text, a conversation the key of its turns' bytes. Keys are sorted and cut into blocks of
neighbours. Within a block an edge joins two neighbours at the number of turns that they share; edges are taken in descending depth, and
each union of two components makes the branching node of that depth, the parent of both (or joins the node of that depth that
one of them has already). Turns between a node and its parent are nodes with one child.

Nodes of a block that do not lie on the path of its first or last key have no members elsewhere: they are final. What hangs off the nodes
of these two paths is summed up at them, and the two paths with their sums go on, two rows a block: the block's forest is
contracted to them. The rows of all blocks are sorted in turn and cut into blocks again, until one block holds them all and is
taken whole. So a task never holds more than a block and its longest key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import written

TURN = 16
ITEMS, TURNS = 20_000, 200_000  # a block has at most so many rows, and is closed once it has so many turns
GROUP = 4_096  # rows that a block of contracted paths has at most
NONE = 2**63 - 1
EMPTY = hashlib.sha256(b"").hexdigest()

SCHEMA = (
    "kind string, block long, side int, depth int, digest binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, ids string, key binary, words array<int>, at array<int>, convs array<long>, least array<long>, leaves array<long>, saved array<long>, kids array<long>"
)
FIELDS = [x.split(" ")[0] for x in SCHEMA.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
ARROW = pa.schema([(f, TYPES[x.split(" ")[1]]) for f, x in zip(FIELDS, SCHEMA.split(", "), strict=True)])


@dataclass
class Item:
    """A sorted key with the words of its turns. hang: depth: [conversations, least conv_id, leaves, saved tokens, children], of what is known
    to lie below that node off the path, or to end at it. conv_id: of a single conversation."""

    key: bytes
    words: Sequence[int]
    hang: dict[int, list[int]] = field(default_factory=dict)
    conv_id: int | None = None


def shared(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    high = min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    low = 0
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN] else (low, mid)
    return low


def digests(key: bytes, low: int, high: int) -> dict[int, bytes]:
    """Digest of each prefix of low to high turns."""
    h, out = hashlib.sha256(key[: low * TURN]), {}
    for d in range(low, high + 1):
        out[d] = h.digest()[:TURN]
        h.update(key[d * TURN : (d + 1) * TURN])
    return out


def forest(items: list[Item]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each node its depth, its parent (-1: none) and an item below it; of each item the node at which its key ends. Node i is the
    end of item i unless an equal key came before it."""
    n = len(items)
    depth, up, below, end = [len(x.key) // TURN for x in items], [-1] * n, list(range(n)), list(range(n))
    of, top = list(range(n)), list(range(n))  # union-find, and the topmost node of each component

    def find(i: int) -> int:
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    edge = [shared(a.key, b.key) for a, b in zip(items, items[1:], strict=False)]
    for i in sorted(range(n - 1), key=lambda i: -edge[i]):  # of equal depth from left to right
        a, b = find(i), find(i + 1)
        x, y = top[a], top[b]
        if depth[x] > edge[i]:
            depth.append(edge[i]), up.append(-1), below.append(i)
            up[x] = top[a] = len(depth) - 1
        if depth[y] == edge[i]:  # the same key as at the left
            end[y] = top[a]
        else:
            up[y] = top[a]
        of[b] = a
    root = top[find(0)]
    if depth[root] > 0:
        depth.append(0), up.append(-1), below.append(0)
        up[root] = len(depth) - 1
    for i in range(1, n):
        end[i] = end[end[i]]
    return depth, up, below, end


def contract(items: list[Item], block: int, whole: bool, named: bool) -> Iterator[dict]:
    """The rows of one block. kind node: a final node; pend: one whose parent lies on a path that goes on; spine: the
    digest of a node on such a path; path: the paths themselves; ends: the conversations that end at a node of such a path. whole: nothing
    lies outside the block. named: nodes get their digests."""
    depth, up, below, end = forest(items)
    floor = [depth[p] + 1 if p >= 0 else 0 for p in up]  # a node stands for all depths from floor to its own
    hang: dict[int, dict[int, list[int]]] = {}
    ids: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        v = end[i]
        if x.conv_id is not None:
            ids.setdefault(v, []).append(x.conv_id)
        for d in sorted(x.hang, reverse=True):
            while floor[v] > d:
                v = up[v]
            at = hang.setdefault(v, {}).setdefault(d, [0, NONE, 0, 0, 0])
            c, least, *more = x.hang[d]
            at[:] = [at[0] + c, min(at[1], least), *(p + q for p, q in zip(at[2:], more, strict=True))]
    live = [i for i in range(len(depth)) if i >= len(items) or end[i] == i]
    side: dict[int, int] = {}
    for s, i in () if whole else ((1, len(items) - 1), (0, 0)):
        v = end[i]
        while v >= 0:
            side[v], v = s, up[v]
    gathered = {v: [0, NONE, 0, 0, 0] for v in live}
    done: dict[int, list[list[int]]] = {}  # final nodes: [conversations, least, leaves, saved, children], by depth from floor
    left: list[dict[int, list[int]]] = [{}, {}]  # what hangs at the paths that go on
    for v in sorted(live, key=lambda v: -depth[v]):
        have, words, rows = gathered[v], items[below[v]].words, []
        for d in range(depth[v], floor[v] - 1, -1):
            own = hang.get(v, {}).get(d)
            if own:
                have = [have[0] + own[0], min(have[1], own[1]), have[2] + own[2], have[3] + own[3], have[4] + own[4]]
            if v in side:
                if any(have[k] for k in (0, 2, 3, 4)):
                    left[side[v]][d] = have
                have = [0, NONE, 0, 0, 0]
            else:
                have = [have[0], have[1], have[2] + (have[4] == 0), have[3] + ((have[0] - 1) * words[d - 1] if d else 0), have[4]]
                rows.append(have)
                have = [*have[:4], 1]
        if v not in side:
            done[v] = rows[::-1]
            if up[v] >= 0:
                to = gathered[up[v]]
                to[:] = [to[0] + have[0], min(to[1], have[1]), to[2] + have[2], to[3] + have[3], to[4] + 1]
    for v, rows in done.items():
        names = digests(items[below[v]].key, floor[v], depth[v]) if named else {}
        for d, (n, least, leaves, saved, kids) in enumerate(rows, floor[v]):
            row = {"kind": "node", "block": block, "depth": d, "conv_id": least, "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "digest": names.get(d)}
            if d > floor[v]:
                row["parent_conv_id"] = rows[d - floor[v] - 1][1]
            elif up[v] in done:
                row["parent_conv_id"] = done[up[v]][-1][1]
            elif up[v] >= 0:
                row |= {"kind": "pend", "side": side[up[v]]}
            if d == depth[v] and v in ids:
                row["ends_sha256"] = hashlib.sha256(",".join(map(str, ids[v])).encode()).hexdigest()
            yield row
    if whole:
        return
    first, last = items[0], items[-1]
    both = shared(first.key, last.key)
    for s, x, low in ((0, first, 0), (1, last, both + 1)):
        names = digests(x.key, low, len(x.key) // TURN)
        for d, name in names.items():
            yield {"kind": "spine", "block": block, "side": s, "depth": d, "digest": name}
        if s == 0 or names:
            at = sorted(d for d in left[s] if d >= low)
            sums = [[left[s][d][k] for d in at] for k in range(5)]
            yield {"kind": "path", "block": block, "side": s, "key": x.key, "words": list(x.words), "at": at, **dict(zip(("convs", "least", "leaves", "saved", "kids"), sums, strict=True))}
    for v in ids.keys() & side.keys():
        yield {"kind": "ends", "block": block, "digest": digests(items[below[v]].key, depth[v], depth[v])[depth[v]], "ids": ",".join(map(str, ids[v]))}


def _batches(rows: Iterable[dict], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, ARROW)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, ARROW)


def _blocks(items: Iterator[Item], most: int, turns: int) -> Iterator[list[Item]]:
    own: list[Item] = []
    n = 0
    for x in items:
        own.append(x)
        n += len(x.key) // TURN
        if len(own) == most or n >= turns:
            yield own
            own, n = [], 0
    if own:
        yield own


def _contracted(sorted_rows: DataFrame, level: int, most: int, turns: int, whole: bool = False) -> DataFrame:
    """contract() over the blocks of each partition; the columns are those of conversations at level 0, of paths above."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Item]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if level == 0:
                    yield Item(r["key"], r["words"], {len(r["key"]) // TURN: [1, r["conv_id"], 0, 0, 0]}, r["conv_id"])
                else:
                    yield Item(r["key"], r["words"], dict(zip(r["at"], map(list, zip(*(r[x] for x in ("convs", "least", "leaves", "saved", "kids")), strict=True)), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        cut = [list(read(batches))] if whole else _blocks(read(batches), most, turns)
        yield from _batches(row for i, items in enumerate(cut) if items for row in contract(items, part + i, whole, level > 0))

    return sorted_rows.mapInArrow(run, SCHEMA)


def _joined_hashes(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of conversations that lie in several blocks: their lists stream through one hash in the blocks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, hashlib.sha256()
        for b in batches:
            out = []
            for name, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = name, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"digest": pa.array([x for x, _ in out], pa.binary()), "ends_sha256": pa.array([x for _, x in out], pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"digest": pa.array([now], pa.binary()), "ends_sha256": pa.array([h.hexdigest()])})

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.repartition(parts, "digest").sortWithinPartitions("digest", "block").select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k, w): 16 bytes (as hex digits) that name role and text of a turn, and the words of its text. Nulls count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(name, 1, 2 * TURN).alias("k"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))


def rebuilt(conversations: DataFrame, step: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, key binary, words array<int>) of every conversation with its first h turns from conversation conv_id - conv_id % step,
    h = crc32 of the decimal conv_id modulo `heads`, and its own from there on. Turns of equal number come in order of their names."""
    turns = turn_rows(conversations).withColumn("lead", F.col("conv_id") - F.col("conv_id") % step).repartition("lead")
    own = turns.groupBy("lead", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k", "w"))).alias("t"))
    lead = own.where("conv_id = lead").select("lead", F.slice("t", 1, heads - 1).alias("h"))  # one row a lead
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head: Column = F.slice(F.coalesce("h", F.array().cast("array<struct<turn:bigint,k:string,w:int>>")), F.lit(1), h)
    t = F.concat(head, F.slice("t", h + 1, F.size("t")))
    return own.join(lead, "lead", "left").select("conv_id", t.alias("t")).select("conv_id", F.unhex(F.array_join(F.col("t")["k"], "")).alias("key"), F.col("t")["w"].alias("words"))


def trie(items: DataFrame, most: int = ITEMS, turns: int = TURNS, group: int = GROUP) -> DataFrame:
    """One row a node of the trie of items (conv_id, key, words): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, all long, ends_sha256. Empty without items. Equal keys are sorted by conv_id, so copies of a conversation are dealt
    out like any others."""
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = written(items)
    rows = written(_contracted(items.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"), 0, most, turns))
    final = rows.where("kind = 'node'").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest")
    pend, spine, ends = [rows.where("kind = 'pend'")], [rows.where("kind = 'spine'")], rows.where("kind = 'ends'")
    paths, level = rows.where("kind = 'path'"), 0
    while True:
        level += 1
        n = paths.count()
        whole = n <= group
        # a block of up to `group` paths leaves two
        by = paths.repartition(1) if whole else paths.repartitionByRange(-(-n // group), "block", "side")
        rows = written(_contracted(by.sortWithinPartitions("block", "side"), level, group, NONE, whole))
        final = final.unionByName(rows.where("kind = 'node'").select(*final.columns))
        if whole:
            break
        pend.append(rows.where("kind = 'pend'")), spine.append(rows.where("kind = 'spine'"))
        paths = rows.where("kind = 'path'")
    late = final.where("digest is not null").select("digest", "conv_id")
    for p in pend[1:]:
        late = late.unionByName(p.select("digest", "conv_id"))
    for p, s in zip(pend, spine, strict=True):
        ups = s.join(late.withColumnRenamed("conv_id", "up"), "digest").select("block", "side", F.col("depth").alias("d"), "up")
        rows = p.withColumn("d", F.col("depth") - 1).join(ups, ["block", "side", "d"])
        final = final.unionByName(rows.withColumn("parent_conv_id", F.col("up")).select(*final.columns))
    hashed = _joined_hashes(ends).withColumnRenamed("ends_sha256", "late")
    inner = final.where("digest is null").withColumn("late", F.lit(None).cast("string"))
    outer = final.where("digest is not null").join(hashed, "digest", "left")
    out = inner.unionByName(outer)
    longs = [F.col(x).cast("long").alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*longs, F.coalesce("ends_sha256", "late", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of the rebuilt conversations. Rows without conv_id belong to no conversation and are left out; repeated rows are turns of
    their own. A conversation is one row of 16 bytes a turn from the moment that its turns meet."""
    return trie(rebuilt(conversations))


def trie_sql() -> str:
    """The registered query's rows over the table conversations, in DuckDB's SQL."""
    return f"""
    WITH crc_table AS (SELECT list(v ORDER BY c) AS t FROM (SELECT c, list_reduce(list_prepend(c::UBIGINT, range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS v FROM range(256) r(c))),
    named AS (SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS t FROM named GROUP BY conv_id),
    hashed AS (
      SELECT conv_id, t, CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ord(s)::UBIGINT)), lambda c, b: xor(c >> 8, table_[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) % 4 AS INTEGER) AS h
      FROM convs, (SELECT t AS table_ FROM crc_table)
    ),
    built AS (SELECT a.conv_id, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM hashed a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 20),
    prefixes AS (
      SELECT conv_id, d AS depth, list_aggregate(list_transform(t[1:d], lambda x: x.k), 'string_agg', '') AS p, CASE WHEN d > 0 THEN t[d].w ELSE 0 END AS w, len(t) = d AS ends
      FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM built)
    ),
    nodes AS (
      SELECT coalesce(p, '') AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
      FROM prefixes GROUP BY ALL
    ),
    kids AS (SELECT p[1:32 * (depth - 1)] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    sized AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
    below AS (SELECT p[1:32 * a] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM sized) GROUP BY 1)
    SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, s.n_convs, CAST(s.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
    FROM sized s JOIN below b USING (p) LEFT JOIN nodes u ON s.depth > 0 AND u.p = s.p[1:32 * (s.depth - 1)]
    """
