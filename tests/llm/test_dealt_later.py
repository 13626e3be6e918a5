"""Importance resampling, the prefix trie and line dedup against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import importance, line_dedup, prefix_trie

SCHEMA = "doc_id long, text string, k string, t string, o long, l string, rank long, n_words string, batch long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "k", "t", 5, "l", 9, "n", 3) for r in rows], SCHEMA)


# ---- op11
def runs_of(text, low, high):
    up = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", up)
    return w, [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def resampled(docs, goal, low, high, buckets, least, percent, seed=2024):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(code, runs_of(x, low, high)[1]))
    for x in goal:
        t.update(map(code, runs_of(x, low, high)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, x in docs:
        w, f = runs_of(x, low, high)
        weight = sum(gain(code(y)) for y in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("low, high, buckets", [(1, 1, 10_000), (1, 3, 97), (2, 2, 70_000)])
def test_resampling_against_brute_force(spark, low, high, buckets):
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(40)] + ["äöü", "日本", "é", "x" * 100]
    text = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " ,. "), (None, text(30)), (203, text(5000)), (204, "ABC-d1" * 30), (204, "ABC-d1" * 30), (205, "\x7f\x80\xa0 q"), (206, "\ta_b`c")]
    goal = [text(30) for _ in range(10)] + [None, ""]
    got = importance.resample(docs_of(spark, docs), docs_of(spark, list(enumerate(goal))), low=low, high=high, buckets=buckets, least_words=5, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, goal, low, high, buckets, 5, 30)


def test_resampling_without_rows(spark):
    none = docs_of(spark, [])
    assert importance.resample(none, none).count() == 0
    one = importance.resample(docs_of(spark, [(1, "a b")]), none).collect()
    assert [(r["n_features"], r["rank"]) for r in one] == [(2, None)]


def test_scans_in_pieces_with_small_dictionaries(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "c", "ödé", "longer1", "z" * 80]) for _ in range(rng.randrange(30))).encode() for _ in range(40)]
    assert importance.folded(pa.array(["A-b", None, "", "Ödé9"])) == [b"a b", b"", b"", "Ödé9".encode()]
    sizes = [x.num_rows for x in importance.pieces(pa.record_batch({"t": ["abc", None, "d" * 9, "e", "", "f"]}), "t", 4)]
    assert sizes == [3, 3]
    for chunk, most in ((1, 2), (7, 3), (1 << 20, 100)):
        monkeypatch.setattr(importance, "CHUNK", chunk)
        book = importance.Dictionary(most)
        for _ in range(2):  # the second scan knows the words
            row, crc, size = importance.words_of(book, texts)
            want = [(i, zlib.crc32(w), len(w)) for i, x in enumerate(texts) for w in x.split()]
            assert list(zip(row.tolist(), crc.tolist(), size.tolist(), strict=True)) == want


def test_crcs_of_runs_are_composed():
    words = [bytes([97 + i]) * (i * i * 7 + 1) for i in range(20)]
    crc, size = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for n, (row, got) in enumerate(importance.runs(np.zeros(20, np.int64), crc, size, 1, 4), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(21 - n)] and len(row) == 21 - n


# ---- op12
def nodes(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), name, role, text))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        lead, h = c - int(math.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(lead, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    ends = {p: sorted(c for c in m if len(built[c]) == len(p)) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k string, lead long")


def turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, i, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "d e f", ""])))
    rows += [(20, 0, "user", "a b"), (20, None, "user", "first"), (20, None, "user", "also"), (None, 0, "user", "x"), (-3, 0, "user", "a b"), (-41, 0, "u", "v w"), (-41, 1, "u", "v w"), (-41, 1, "u", "v w")]
    rows += [(1000 + c, i, "user", f"same {i}") for c in range(40) for i in range(6)]  # copies
    rows += [(3000, i, "user", f"long {i}") for i in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most, length, group", [(20_000, 200_000, 4_096), (3, 10, 4_096), (2, 1_000, 5), (1, 1, 4)])
def test_trie_against_brute_force(spark, most, length, group):
    rows = turns(most, 150)
    items = prefix_trie.rebuilt(conversations(spark, rows))
    got = prefix_trie.trie(items, most, length, group)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == nodes(rows)


def test_trie_of_few_conversations(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0
    for rows in ([(5, 0, "u", "a")], [(0, 0, "u", "a"), (1, 0, "u", "b")], [(3, 0, None, None)], [(7, i, "u", "x " * i) for i in range(5)]):
        assert sorted((tuple(r) for r in prefix_trie.conversation_trie(conversations(spark, rows)).collect()), key=str) == nodes(rows)


# ---- op13
def kept_lines(rows, least=10):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: 2**63 if d is None else d
    low = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            low[k] = min(low.get(k, order(d)), order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or low[key(x)] == order(d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5, 9])
def test_lines_against_brute_force(spark, batches):
    rng = random.Random(batches)
    pool = [f"Line number {i} of the pool" for i in range(60)] + ["short", "", "exactly te", "äöüäöüäöüä", "  \tLINE number 3 of THE pool\r", "ÄÖÜÄÖÜÄÖÜÄ", "x" * 9, "tab\tin the line"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in rng.sample(range(10**12), 60)]
    rows += [(5, None), (6, ""), (7, "\n"), (8, "\n\n" + pool[0] + "\n"), (None, pool[0] + "\n" + pool[1]), (None, pool[1] + "\nonly among the null ones"), (9, pool[2]), (9, pool[2]), (9, pool[2] + "\n" + pool[4]), (10, "own line here\nown line here\nOWN LINE HERE  ")]
    rows += [(11, "\n".join(f"long text line {i % 700}" for i in range(20_000))), (12, "\n".join(f"long text line {i}" for i in range(1500)))]
    got = line_dedup.remove_lines(docs_of(spark, rows), batches=batches)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == kept_lines(rows)


def test_lines_of_no_and_of_like_documents(spark):
    assert line_dedup.remove_lines(docs_of(spark, [])).count() == 0
    rows = [(i, "the very same line") for i in range(50)] + [(100, "a\nb"), (101, "a\nb")]
    assert sorted((tuple(r) for r in line_dedup.remove_lines(docs_of(spark, rows)).collect()), key=str) == kept_lines(rows)


def test_runs_are_merged_by_levels(spark):
    runs = line_dedup.Runs(spark)
    for i in range(7):
        keys = spark.range(10 * i - 3, 10 * i + 10).select("id", F.lit(1).cast("long").alias("b")).withColumnRenamed("id", "a").where("a >= 0")
        got = {r["a"]: r["seen"] for r in runs.add(keys).collect()}
        assert got == {a: a < 10 * i for a in range(max(0, 10 * i - 3), 10 * i + 10)}
    assert sorted(runs.levels) == [0, 1, 2]
    assert sorted(r["a"] for level in runs.levels.values() for r in runs._run(level).collect()) == list(range(70))
    plan = runs._run(runs.levels[2]).join(runs._run(runs.levels[1]).hint("merge"), ["a", "b"], "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name in runs.names]
