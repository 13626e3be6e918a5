"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe, fingerprint, html_text, language, lattice, licences, mixing, near_dedup, repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, id string, _text string, s string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))


def table(spark, rows):
    """(doc_id, text, lang, source) rows with further columns whose names operators might use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def words(n, seed, vocabulary=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    base = words(200, 1)
    near = base.split()
    near[50] = "changed"
    return [(1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "a"), (4, base, "en", "a"), (5, base, "en", "b"), (6, " ".join(near), "de", "b"), (7, "one two", "en", "a"), (8, "ONE two", "fr", "a"), (9, LONG, "en", "a"), (10, "äöü 日本語 😀 " * 30, None, "c"), (11, "1234 !!! ...", "en", "c"), (12, words(300, 2), "en", "a")]


# ---- op2
def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {d: (len(sets[d]), comp[d]) for d in sets}


def test_near_dedup_against_all_pairs(spark, odd_rows):
    rows = list(odd_rows)
    rng = random.Random(3)
    for g in range(4):  # groups of edited copies, borderline on purpose
        base = words(120, 100 + g).split()
        for i in range(12):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((100 + g * 20 + i, " ".join(copy), "en", "a"))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("fan, tile, shingles", [(3, 3, 1 << 20), (256, 512, 200), (2, 1, 1)])
def test_near_dedup_in_small_parts(spark, monkeypatch, fan, tile, shingles):
    for name, value in (("FAN", fan), ("TILE", tile), ("SHINGLES", shingles)):
        monkeypatch.setattr(near_dedup, name, value)
    base = words(100, 9).split()
    rows = [(i, " ".join([*base[:-1], f"end{i}"]), "en", "a") for i in range(20)]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    rng = random.Random(11)  # two groups that differ by about the threshold: their buckets stay mixed
    for i in range(30):
        copy = [*base[: 92 if i % 2 else 100], *[f"x{i % 2}{k}" for k in range(8 if i % 2 else 0)]]
        copy[rng.randrange(40)] = f"e{i}"
        rows.append((100 + i, " ".join(copy), "en", "a"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_dedup_odd_keys_and_words(spark):
    assert near_dedup.near_duplicates(table(spark, []).limit(0)).collect() == []
    line = "ab"
    for _ in range(9):  # words that polynomial hashes modulo powers of two confuse
        line += line.translate(str.maketrans("ab", "ba"))
    other = line.translate(str.maketrans("ab", "ba"))
    rows = [(1, line, "en", "a"), (2, other, "en", "a"), (3, "one two", "en", "a"), (3, "three four five", "en", "a"), (4, "three four five", "en", "a"), (4, "three four five", "en", "a"), (None, "one two", "en", "a")]
    for parts in (1, 3):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows).repartition(parts)).collect())
        assert [g[0] for g in got] == [1, 2, 3, 4] and got[0][2] == 1 and got[1][2] == 2
        assert parts == 1 or got == first
        first = got


def test_components_with_hubs(spark, monkeypatch):
    from tidemill.llm import common

    monkeypatch.setattr(common, "SHARE", 8)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 399), (7, 7), (9000, 9001)]
    got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(1, 400), 5000], 0), **dict.fromkeys(range(1001, 1061), 1000), 9001: 9000}
    sizes = spark.createDataFrame([(1, 90, "a"), (2, 10, "b"), (9, 4, "c")], "k long, n long, v string")
    rows = spark.createDataFrame([(1 if i % 10 else 2, i) for i in range(100)] + [(7, 7)], "k long, i int")
    assert sorted(common.key_join(rows, sizes, "k", "n", 100).select("k", "v", "i").collect()) == sorted((1 if i % 10 else 2, "a" if i % 10 else "b", i) for i in range(100))


def test_components_take_no_round_more_than_they_need(spark, monkeypatch):
    """Stars are seen at once (the edges and the stars are written), a path of three after one round, which writes two tables and the stars again."""
    from tidemill.llm import common

    calls, real = [], common.written
    monkeypatch.setattr(common, "written", lambda df, *parts: calls.append(1) or real(df, *parts))
    for edges, tables in (([(1, i) for i in range(2, 9)] + [(20, 21)], 2), ([(1, 2), (2, 3)], 5)):
        calls.clear()
        got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {b: min(1 if b < 20 else 20, b) for _, b in edges} and len(calls) == tables


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.6, 0.9):
        common, rest = rng.integers(1, 2**63, int(2000 * j), dtype=np.uint64), rng.integers(1, 2**63, (2, int(1000 * (1 - j))), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, r])) for r in rest)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        est = near_dedup.likeliest(np.array([len(a)]), np.array([len(b)]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0]
        assert abs(est - true) < 0.16
        assert (near_dedup.merged(x, y) == near_dedup.registers(np.union1d(a, b))).all()


# ---- op5
def brute_repeats(rows):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(w)
        m = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, m, strict=True) if not g)
        out[d] = (len(b), int(m.sum()), int((m & ~np.r_[False, m[:-1]]).sum()) if len(m) else 0, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batch", [10000, 3])
def test_repeats_against_brute_force(spark, odd_rows, batch):
    passage = words(60, 77)
    rows = [*odd_rows, (20, "aaaa" * 200, None, "a"), (21, "a" * 99, None, "a"), (22, "a" * 150, None, "a"), (23, words(30, 5) + " " + passage + " " + words(30, 6), "en", "a"), (24, passage + " tail", "en", "b"), (25, words(10, 8) + " " + passage[3:], "en", "b")]
    rows = [(r[0], r[1][:30_000] if r[1] else r[1], *r[2:]) for r in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(table(spark, rows).repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("seed", [0, 4, 6])
def test_repeats_met_in_other_batches(spark, seed):
    """Equal and overlapping passages, dealt in any order: the first in the corpus stays, also if another batch knows more contents of its context."""
    rng = random.Random(seed)
    sources = ["".join(rng.choice("abcdefgh é") for _ in range(600)) for _ in range(4)]
    rows = []
    for i in range(120):
        cuts = [(rng.choice(sources), rng.randrange(540), rng.choice([90, 100, 101, 130, 200, 400])) for _ in range(rng.randrange(5))]
        rows.append((i * 7 - 300, "".join(x[a : a + n] + "xyz"[: rng.randrange(4)] for x, a, n in cuts), None, "a"))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(table(spark, rows).repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_repeats(rows)


def test_repeats_in_a_long_text(spark):
    """Beyond the part that a task hashes at a time, with changes so dense that phrases must be compared suffix by suffix."""
    rng = np.random.default_rng(3)
    one = rng.integers(97, 123, 2_300_000).astype(np.uint8)
    two = one.copy()
    two[rng.integers(0, len(two), 5000)] = 32
    rows = [(5, one.tobytes().decode(), None, "a"), (7, two.tobytes().decode(), None, "a"), (8, two[2_097_000:2_097_400].tobytes().decode(), None, "a")]
    seen, want = set(), {}
    for d, t, *_ in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int32)
        for i in range(len(b) - 99):
            h = hash(b[i : i + 100])
            if h in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(h)
        m = np.cumsum(gone[:-1]) > 0
        want[d] = (len(b), int(m.sum()), int((m & ~np.r_[False, m[:-1]]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(table(spark, rows)).collect()}
    assert got == want


def test_removed_stretches_against_a_mask():
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(200):
        own = np.frombuffer("".join(rng.choice("aé日😀") for _ in range(300)).encode(), np.uint8)
        spans = [(s := rng.randrange(len(own) - 110), rng.randrange(1, min(60, len(own) - 99 - s))) for _ in range(rng.randrange(1, 6))]
        gone = np.zeros(len(own), bool)
        for s, n in spans:
            gone[s : s + n + 99] = True
        for whole in (False, True):
            mask = gone
            if whole:
                letter = np.cumsum((own & 0xC0) != 0x80)
                mask = ~(np.bincount(letter[~gone], minlength=letter[-1] + 1) > 0)[letter]
            low, high = repeats._removed(own, pa.array([{"start": s, "runs": n} for s, n in spans], pa.struct([("start", pa.int32()), ("runs", pa.int32())])), whole)
            found = np.zeros(len(own), bool)
            for a, z in zip(low, high, strict=True):
                found[a:z] = True
            assert (found == mask).all() and len(low) == int((mask & ~np.r_[False, mask[:-1]]).sum())


def test_one_text_of_a_repeated_key_stays(spark):
    rows = [(1, f"text number {i} " * 20, None, "a") for i in range(6)]
    kept = {tuple(r["kept"] for r in repeats.remove_repeats(table(spark, rng).repartition(n)).collect()) for rng, n in ((rows, 1), (rows[::-1], 3), (rows[3:] + rows[:3], 2))}
    assert len(kept) == 1


def test_repeats_by_letters_and_empty(spark):
    rows = [(1, "é" * 120, None, None), (2, "x" + "é" * 120, None, None)]
    got = {r["doc_id"]: r["kept"].decode() for r in repeats.remove_repeats(table(spark, rows), whole_letters=True, carry=("lang",)).collect()}
    assert got[2].startswith("x") and set(got[1]) == {"é"}
    assert repeats.remove_repeats(table(spark, rows).limit(0)).collect() == []
    assert repeats.remove_repeats(table(spark, [rows[0], rows[0], (None, "y", None, None)])).count() == 1


# ---- op8
def test_byte_bpe_like_the_library(spark, odd_rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, odd_rows)
    ids = byte_bpe.encode(docs, path, P.PATTERN)
    for r, plain in zip(ids.orderBy("doc_id").collect(), sorted(odd_rows), strict=True):
        assert r["ids"] == library.encode_ordinary(plain[1] or "") and r["n_tokens"] == len(r["ids"])
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(ids, path, P.PATTERN).collect()}
    assert back == {r[0]: r[1] or "" for r in odd_rows}
    digests = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, path, P.PATTERN).collect()}
    for d, t, *_ in odd_rows:
        assert digests[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert digests[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0


# ---- op7
def test_fingerprints_against_a_plain_loop(spark, odd_rows):
    rows = [*odd_rows, (12, words(300, 2), "en", "a")]  # a repeated row
    got = sorted(fingerprint.against_next(table(spark, rows).repartition(3), rows_per_slice=3).collect(), key=lambda r: (r["doc_id"], r["edited_sha256"]))
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    want = []
    for (d, t, *_), (_, n, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.digest(t), fingerprint.digest(edited), fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(edited)), fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(n))))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))
    assert fingerprint.against_next(table(spark, rows).limit(0)).count() == 0
    one = fingerprint.against_next(table(spark, rows[3:4])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 for r in got)


# ---- op4
def test_language_and_families(spark, odd_rows):
    say = {"en": "the quick brown fox jumps over the lazy dog and runs away", "de": "der schnelle braune fuchs springt über den faulen hund und läuft", "fr": "le renard brun rapide saute par dessus le chien paresseux et court", "es": "el rápido zorro marrón salta sobre el perro perezoso y corre"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(say[lang].split(), k=20)), lang, "a") for i in range(200) for lang in [list(say)[i % 4]]]
    model = language.fit(table(spark, rows), train_rows=150)
    assert set(model.families) == {"germanic", "romance"} and set(model.by_pair) == {("de", "en"), ("es", "fr")}
    got = {r["doc_id"]: r for r in language.predict(table(spark, rows), model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows]) > 0.98
    odd = {r["doc_id"]: r for r in language.predict(table(spark, odd_rows), model).collect()}
    assert all(odd[d]["lang_pred"] == "und" and odd[d]["score"] == 0 for d in (1, 2, 3, 11))
    assert odd[4]["lang_pred"] in say and 0 <= odd[4]["score"] <= 1
    none = language.fit(table(spark, [(1, "text", None, "a")]))
    assert language.predict(table(spark, odd_rows), none).where("lang_pred <> 'und'").count() == 0
    assert language.predict(table(spark, odd_rows).limit(0), model).count() == 0


# ---- op9
def test_language_fit_holds_the_sample_once(spark):
    """Of the driver's memory the fit takes the matrix of the sample and little besides."""
    import tracemalloc

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tracemalloc.start()
    try:
        model = language.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = docs.where("lang is not null").count()
    assert sorted(model.families) == ["germanic", "romance"] and peak < 1.5 * n * language.DIM * 4


def test_toxicity_marks_and_marginals(spark, odd_rows):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        w = words(60, 1000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "grossy", "nastyo"])
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(toxic), 1))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (9999, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(table(spark, rows), lab)
    out = {r["doc_id"]: r for r in toxicity.tag(table(spark, [*rows, *[(r[0] + 5000, *r[1:]) for r in odd_rows]]), model).collect()}
    assert all((out[i]["score"] >= 0.7) == bool(y) for i, y, _ in labels)
    first = out[0]
    assert first["spans"] and all(rows[0][1][s["start"] : s["end"]] in ("vilex", "grossy", "nastyo") for s in first["spans"])
    assert all(0 <= out[r[0] + 5000]["score"] < 0.5 for r in odd_rows)
    plain = toxicity.fit(table(spark, rows), lab.limit(0))
    assert toxicity.tag(table(spark, odd_rows), plain).where("score >= 0.7").count() == 0


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    for n, at in ((6, [0, 2, 5]), (7, [3]), (5, [0, 1, 2, 3, 4]), (9, [1, 8]), (8, [6])):
        c = toxicity.Crf(bias=-1.0, start=0.4, move=rng.standard_normal((2, 2)))
        x = np.zeros(n)
        x[at] = rng.standard_normal(len(at))
        total, one = 0.0, np.zeros(n)
        for s in itertools.product((0, 1), repeat=n):
            e = math.exp(sum((x[i] + c.bias) * s[i] for i in range(n)) + c.start * s[0] + sum(c.move[s[i], s[i + 1]] for i in range(n - 1)))
            total, one = total + e, one + e * np.array(s)
        got = c.marginals([np.array(at), np.zeros(0, int), np.array([1])], [x[at], np.zeros(0), np.zeros(1)], [n, 3, 4])
        assert np.allclose(got[0], (one / total)[at]) and len(got[1]) == 0 and len(got[2]) == 1
        p, _, _ = toxicity.forward_backward((x + c.bias)[None], np.array([n]), c.start, c.move)
        assert np.allclose(p[0], one / total)


def test_toxic_scores_and_markers_against_a_plain_loop(spark):
    """Markers from plain counts; scores from the whole chains in logarithms, words without features included; a very long text too."""
    rng = random.Random(8)
    docs = []
    for i in range(300):
        w = words(rng.randrange(5, 400), i).split()
        for _ in range(4 if i % 5 == 0 else 0):
            w[rng.randrange(len(w))] = rng.choice(["vilex", "grossyard", "grossyfy"])
        if i % 7 == 0:
            w[0] = "grossyx"  # a beginning that clean documents hold too, but once only
        docs.append((i, " ".join(w), i % 5 == 0))
    known = spark.createDataFrame([(int(y), t) for _, t, y in docs], "y int, t string")
    count = {}
    for _, t, y in docs:
        for x, n in collections.Counter(x for w in re.findall(r"\w+", t.lower()) for x in toxicity.traits(w)).items():
            for m in range(1, min(n, 3) + 1):
                count.setdefault((x, m), [0, 0])[y] += 1
    count = {k: v for k, v in count.items() if v[1] > 2}
    want = {}
    for (x, m), (k0, k1) in count.items():
        n1, n0 = 60, 240
        like = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if k < n else 0)
        p = (k1 + k0) / 300
        g = 2 * (like(k1, n1, k1 / n1) + like(k0, n0, k0 / n0) - like(k1, n1, p) - like(k0, n0, p))
        if k1 / n1 > 8 * k0 / n0 and g >= 2 * math.log(len(count) / 0.0025):
            want[x] = min(m, want.get(x, 9))
    assert toxicity.markers(known) == want and want.get("=vilex") == 1 and want.get("gross", 9) > 1
    model = toxicity.fit(table(spark, [(i, t, "en", "a") for i, t, _ in docs]), spark.createDataFrame([(i, int(y)) for i, _, y in docs], "doc_id long, toxic int"))
    texts = [*[t for _, t, _ in docs[:40]], LONG + " vilex grossyard " + LONG, "", "vilex"]
    got = toxicity.tag(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model).collect()
    for r in got:
        w = re.findall(r"\w+", texts[r["doc_id"]].lower())
        at = [i for i, x in enumerate(w) if any(t in model.weights for t in toxicity.traits(x))]
        u = np.full(len(w), model.bias)
        for i in at:
            near = min(2, sum(abs(i - j) <= toxicity.REACH for j in at) - 1)
            u[i] += sum(model.weights.get(t, 0) for t in toxicity.traits(w[i])) + (model.weights[f"near {near}"] if near else 0)
        p = toxicity.forward_backward(u[None], np.array([len(w)]), model.start, model.move)[0][0][at] if w else np.zeros(0)
        x = [math.log1p(p.sum()), math.log1p(100 * p.sum() / max(len(w), 1)), max(p, default=0)]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], x, strict=True))))), rel_tol=1e-6)
    assert got[40]["score"] >= 0.0 and len(got[40]["spans"]) == 1


# ---- op3
def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><header class="site-header"><a href=/>Home</a></header>
    <div class="cookie-notice">We use cookies to make this site better for all of you.</div><div id="wrap"><div class="content"><h2>A title</h2>
    <p>First paragraph with <a href=q>a link</a> and text that goes&nbsp;on.<p>Second <b>bold</b> one &lt;now&gt;, also long enough to count.<ul><li>item one<li>item two</ul></div>
    <div class="sidebar"><p>Side text that must not be there at all, however long it may be.</p></div></div>
    <section id="comments"><p>A reader says that this was nice to read and thanks.</p></section><form><p>Enter your name here</p></form><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "A title First paragraph with a link and text that goes on. Second bold one <now>, also long enough to count. item one item two"
    for broken in (None, "", "   ", "<", "<div", "<p", "<!--", "<script>x", "&amp;" * 3, "<div>" * 2000 + "x", '<a href="' * 500, "plain"):
        html_text.main_text(broken)
    assert html_text.main_text("plain &eacute; text") == "plain é text" and html_text.main_text("<nav>x</nav>") == ""
    body = words(4000, 4)
    assert html_text.main_text(f"<article><p>{body}</p></article>") == body


def test_extract_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages.withColumn("_html", F.lit(1)).withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- op1
def plain_scan(rows):
    """Every unit against every notice."""
    want = {}
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        units = [(0, 0, None, t or "")] * (len(lines) > 1) + [(i, i, None, u) for i, u in enumerate(lines, 1)]
        for name, texts in licences.NOTICES.items():
            known = set().union(*map(licences.pairs, texts))
            near = []
            for i, u in enumerate(lines, 1):
                if len(licences.pairs(u) & known) >= licences.SHARED:
                    if not near or i - near[-1][-1] > licences.GAP + 1:
                        near.append([])
                    near[-1].append(i)
            units += [(x[0], x[-1], name, "\n".join(lines[i - 1] for i in x)) for x in near if len(x) > 1]
        for first, last, own, u in units:
            for name, texts in licences.NOTICES.items():
                for n in texts if own in (None, name) else []:
                    a, b = licences.pairs(u), licences.pairs(n)
                    if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                        now = (-2 * len(a & b) / (len(a) + len(b)), name)
                        want[d, first, last] = min(now, want.get((d, first, last), (0, "")))
    return {k: (v[1], -v[0]) for k, v in want.items()}


def test_licences_against_a_plain_loop(spark, odd_rows):
    import textwrap

    prose = "\n".join(words(9, i) for i in range(40))
    wrapped = {n: "\n".join(f"{mark} {x}" for x in textwrap.wrap(licences.NOTICES[n][i], 72)) for n, i, mark in (("MIT", 3, "//"), ("GPL-3.0", 2, "#"), ("BSD-3-Clause", 1, " *"), ("Apache-2.0", 2, ""))}
    rows = [*odd_rows, (30, "Some text.\nReleased under the MIT License.\nmore", "en", "a"), (31, "LICENSED UNDER the apache license -- version 2.0!", None, None), (32, "intro\nThis work is licensed under the GNU General Public License, version 2", "en", "a"), (33, "Licensed under CC BY 4.0.\n" * 3, "en", "a")]
    rows += [(40, f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrapped['MIT']}", "en", "a"), (41, f"{prose}\n{wrapped['GPL-3.0']}\n{prose}", "en", "a"), (42, f"{prose}\n/*\n{wrapped['BSD-3-Clause']}\n */\n{prose}\n{wrapped['Apache-2.0']}\n{prose}\n{wrapped['MIT']}", "en", "a")]
    want = plain_scan(rows)
    got = {(r["doc_id"], r["line"], r["last_line"]): (r["licence"], r["dice"]) for r in licences.scan(table(spark, [*rows, rows[-1]])).collect()}
    assert got.keys() == want.keys() and len(got) >= 10
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert {(k[0], v[0]) for k, v in got.items() if k[0] >= 40} >= {(40, "MIT"), (41, "GPL-3.0"), (42, "BSD-3-Clause"), (42, "Apache-2.0"), (42, "MIT")}
    assert licences.scan(table(spark, rows).limit(0)).count() == 0 and licences.scan(table(spark, rows), notices={}).count() == 0


# ---- op6
def plain_edf(blocks):
    """Earliest deadline first over all slots, by looking at every source in every slot."""
    total, done, out = sum(blocks), [0] * len(blocks), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // n), s) for s, n in enumerate(blocks) if done[s] < n and done[s] * total // n <= t]
        s = min(ready)[1]
        out.append((s, done[s]))
        done[s] += 1
    return out


SIZES = [[1], [1, 1], [600, *[20] * 19], [7] * 100, [*range(1, 60)], [1000 // i for i in range(1, 200)], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233], [5000, 1], [1] * 300]


@pytest.mark.parametrize("sizes", SIZES)
def test_pfair_slots(sizes):
    assert list(mixing.slots(sizes)) == plain_edf(sizes)
    total, done = sum(sizes), [0] * len(sizes)
    for t, (s, i) in enumerate(mixing.slots(sizes)):
        assert i == done[s]
        done[s] += 1
        assert all(abs(d - (t + 1) * n / total) < 1 for d, n in zip(done, sizes, strict=True))


@pytest.mark.parametrize("period", [3, 10, 64])
def test_pfair_periods(period):
    rng = random.Random(4)
    for sizes in [*SIZES, *([rng.randrange(1, 90) ** 2 for _ in range(30)] for _ in range(5))]:
        total, last = sum(sizes), np.zeros(len(sizes), int)
        for k, more in enumerate(mixing.early(sizes, period), 1):
            t = k * period
            done = np.array([n * t // total for n in sizes]) + more
            assert done.sum() == t and (done >= last).all() and (np.abs(done - np.array(sizes) * t / total) < 1).all()
            last = done


@pytest.mark.parametrize("period", [16, 1 << 16])
def test_pfair_schedule(spark, period):
    for sizes in ([600, *[20] * 19], [7] * 100, [1000 // i for i in range(1, 200)]):
        got = sorted((r["slot"], r["si"], r["block"]) for r in mixing.schedule(spark.range(1), sizes, period).collect())
        total, done = sum(sizes), [0] * len(sizes)
        assert [t for t, _, _ in got] == list(range(total))
        for t, s, i in got:
            assert i == done[s]
            done[s] += 1
            assert abs(done[s] - (t + 1) * sizes[s] / total) < (1 if total <= period else 2)


def test_mixing(spark, odd_rows):
    rows = [(i, f"t{i}", "en", ["hot", "hot", "hot", "x", None][i % 5]) for i in range(1000)]
    for period in (10, mixing.PERIOD):
        got = mixing.mix(table(spark, rows), block_rows=4, carry=("text",), period=period).collect()
        assert sorted(r["position"] for r in got) == list(range(1000)) and all(r["in_mix"] and r["text"] == f"t{r['doc_id']}" for r in got)
        got.sort(key=lambda r: r["position"])
        assert max(abs(sum(r["source"] == "hot" for r in got[: t + 1]) - 0.6 * (t + 1)) for t in range(1000)) < 8
    got = mixing.mix(table(spark, rows), weights={"hot": 3, "x": 3, None: 4}, block_rows=4).collect()
    assert sorted(r["position"] for r in got if r["in_mix"]) == list(range(500)) and sum(r["source"] is None for r in got if r["in_mix"]) == 200
    assert {r["in_mix"] for r in mixing.mix(table(spark, rows), weights={"x": 1.0}, block_rows=4).where("source = 'hot'").collect()} == {False}
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0
    twice = mixing.mix(table(spark, [*odd_rows, *odd_rows]), carry=("text",)).collect()
    assert sorted(r["position"] for r in twice) == list(range(2 * len(odd_rows))) and sum(r["text"] is None for r in twice) == 2


def test_mixing_tiny_sources(spark):
    """100 sources of 7 rows, and sources of far less than one row in 10000, neither fall out nor end the mixture."""
    docs = spark.range(700).selectExpr("id doc_id", "concat('s', id % 100) source")
    assert sorted(r["position"] for r in mixing.mix(docs).collect()) == list(range(700))
    n = 60_000
    docs = spark.range(n).selectExpr("id doc_id", "case when id < 3 then concat('rare', id) when id < 14 then 'few' when id % 3 = 0 then null else concat('s', id % 2) end source")
    for weights in (None, {"rare0": 1, "rare1": 1, "rare2": 1, "few": 11, None: 19_995, "s0": 19_996, "s1": 19_995}):
        got = mixing.mix(docs, weights, period=1000).toPandas().sort_values("position")
        assert got["in_mix"].all() and list(got["position"]) == list(range(n))
        assert got["slot"].is_monotonic_increasing and got.groupby("slot")["source"].nunique(dropna=False).max() == 1
        assert got["source"].isna().cumsum().sub(got["source"].isna().mean() * (got["position"] + 1)).abs().max() < 3 * mixing.BLOCK_ROWS


# ---- op10
def test_lattice_points():
    rng = np.random.default_rng(3)
    y = rng.normal(0, 2, (200, 8))
    p = lattice.decode(y)
    near = lattice.neighbours()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    d = ((y - p) ** 2).sum(axis=1)
    assert (d[:, None] <= ((y[:, None, :] - p[:, None, :] - near[None]) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize("tile", [512, 5])
def test_near_vectors_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        center = rng.standard_normal(32)
        for _ in range(8):
            v = center + rng.standard_normal(32) * rng.uniform(0.1, 0.45)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(g % 3)))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 32, 0), (205, [float("nan")] + [1.0] * 31, 0), (206, [None] + [1.0] * 31, 0), (207, [float("inf")] * 32, 0), (208, [2 * x for x in rows[0][1]], rows[0][2]), (209, [1.0, 2.0], 0), (210, [], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, v string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(df).collect()}
    good = {r[0]: (np.array(r[1], float) / np.linalg.norm(r[1]), r[2]) for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])}
    links = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.93} for i in good}
    comp = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i in links:
            for j in links[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    assert {k: v[:2] for k, v in got.items()} == {r[0]: (len(links.get(r[0], ())), comp[r[0]]) for r in rows}
    assert all(v[2] == (v[1] == k) for k, v in got.items())
    assert lattice.near_vectors(df.limit(0)).count() == 0
