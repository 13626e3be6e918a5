"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given by document, so token labels come first. Traits of a word are the word itself and its beginnings of 3 to 7
letters. Over all labelled documents (near copies count once) it is counted how many toxic and clean documents hold a trait one, two
or three times; where the toxic ones hold it far more often, by a likelihood ratio that the number of traits tested corrects, the trait is a
marker from that number of times on. Words of toxic documents that bear such a marker are labelled 1, all others 0.

The CRF has two states; its features are the markers that a word bears, whether another word with markers stands near it, and
the transitions. It is fitted on windows of a bounded sample of labelled documents. Forward-backward then runs over the whole chain of
every document; runs of words without features are crossed by powers of their transition matrix, which is exact. The expected number of
toxic words, alone and by the document's length, and the largest marginal give the document's score through a logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import byte_column, sampled, written
from tidemill.llm.near_dedup import shingle_sets

BEGINNINGS = (3, 4, 5, 6, 7)
TIMES = 3
REACH = 10  # words to either side that count as near
WINDOW = 100  # words of a training window
GROUP = 5000  # documents whose chains a task walks together
HELD = 300_000  # counts that a task holds before it sends them on
CACHE = 100_000  # tokens whose weight a worker remembers; all are forgotten when it is full
NEAR = ("near 1", "near 2")  # features of a word with markers that has one such word near it, or several
_word = re.compile(r"\w+")


def traits(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in BEGINNINGS if len(word) > k]]


def forward_backward(unary: np.ndarray, lengths: np.ndarray, start: float, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """unary: [rows, steps] score of state 1 against 0; rows are sorted by falling length. Returns the marginals of state 1,
    the expected transitions [2, 2], each row counting `weight` times, and the sum of the log partition functions."""
    rows, steps = unary.shape
    a, b = np.zeros((2, rows, steps)), np.zeros((2, rows, steps))
    if not steps or not rows:
        return np.zeros((rows, steps)), np.zeros((2, 2)), 0.0
    active = np.array([(lengths > t).sum() for t in range(steps)])
    a[1, :, 0] = start + unary[:, 0]
    for t in range(1, steps):
        n = active[t]
        p0, p1 = a[0, :n, t - 1], a[1, :n, t - 1]
        a[0, :n, t] = np.logaddexp(p0 + move[0, 0], p1 + move[1, 0])
        a[1, :n, t] = np.logaddexp(p0 + move[0, 1], p1 + move[1, 1]) + unary[:n, t]
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        q0, q1 = b[0, :n, t + 1], b[1, :n, t + 1] + unary[:n, t + 1]
        b[0, :n, t] = np.logaddexp(q0 + move[0, 0], q1 + move[0, 1])
        b[1, :n, t] = np.logaddexp(q0 + move[1, 0], q1 + move[1, 1])
    live = np.arange(steps)[None, :] < lengths[:, None]
    total = np.logaddexp(a[0, :, 0] + b[0, :, 0], a[1, :, 0] + b[1, :, 0])
    p = np.where(live, np.exp(np.minimum(0, a[1] + b[1] - total[:, None])), 0)
    moves = np.zeros((2, 2))
    both = live[:, 1:] * (np.ones(rows) if weight is None else weight)[:, None]
    for i in range(2):
        for j in range(2):
            x = a[i, :, :-1] + move[i, j] + (unary[:, 1:] if j else 0) + b[j, :, 1:] - total[:, None]
            moves[i, j] = (np.exp(np.minimum(0, x)) * both).sum()
    return p, moves, float(total[lengths > 0].sum())


@dataclass
class Crf:
    """weights: of the features, for state 1. bias, start and move: of the states. curve: of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    start: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float, float] = (-3.0, 0.0, 0.0, 0.0)

    @cached_property
    def heads(self) -> set[str]:
        return {t.removeprefix("=")[:3] for t in self.weights if t not in NEAR}

    def marked(self, words: list[str], cache: dict[str, float | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words with features, and their weights. Only words that begin like a trait can have one."""
        heads, at, out = self.heads, [], []
        for i, w in enumerate(words):
            if w[:3] in heads:
                if w not in cache:
                    if len(cache) > CACHE:
                        cache.clear()
                    own = [self.weights[t] for t in traits(w) if t in self.weights]
                    cache[w] = sum(own) if own else None
                if cache[w] is not None:
                    at.append(i)
                    out.append(cache[w])
        at, out = np.array(at, np.int64), np.array(out, float)
        near = neighbours(at)
        for k, name in enumerate(NEAR, 1):
            out[near == k] += self.weights.get(name, 0.0)
        return at, out

    def marginals(self, places: list[np.ndarray], weights: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
        """Marginals of state 1 of the words with features, in chains of so many words of which these stand at so many places."""
        move, odds = np.exp(np.clip(self.move - self.move.max(), -30, 0)), np.exp(np.clip(self.bias, -30, 30))
        blank = move * np.array([1.0, odds])  # one step onto a word without features
        roots, left = np.linalg.eig(blank)
        big = int(np.abs(roots).argmax())
        right = np.linalg.inv(left)
        parts = [np.outer(left[:, i], right[i]).real for i in (big, 1 - big)]
        ratio = float((roots[1 - big] / roots[big]).real)

        def across(v: np.ndarray, steps: np.ndarray, back: bool = False) -> np.ndarray:
            """v times the power of `blank`, but for a factor."""
            one, two = (p.T if back else p for p in parts)
            return np.where(steps[:, None] > 0, np.maximum(v @ one + np.power(ratio, steps.astype(float))[:, None] * (v @ two), 1e-300), v)

        order = sorted((i for i in range(len(places)) if len(places[i])), key=lambda i: -len(places[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(places)
        if not order:
            return out
        many = np.array([len(places[i]) for i in order])
        first = np.r_[0, np.cumsum(many)[:-1]]  # where each chain's words begin in the flat arrays
        at, n = np.concatenate([places[i] for i in order]), np.array([lengths[i] for i in order])
        gain = np.exp(np.clip(np.concatenate([weights[i] for i in order]) + self.bias, -30, 30))
        fore, back = np.zeros((len(at), 2)), np.ones((len(at), 2))
        begin = np.array([1.0, np.exp(np.clip(self.start, -30, 30))])
        v = across(np.broadcast_to(begin * np.array([1.0, odds]), (len(order), 2)), at[first] - 1)
        v = np.where(at[first, None] > 0, v @ move, begin)
        for t in range(many[0]):
            own = first[: np.searchsorted(-many, -t, "left")] + t
            if t:
                v = across(fore[own - 1], at[own] - at[own - 1] - 1) @ move
            v = v * np.column_stack([np.ones(len(own)), gain[own]])
            fore[own] = v / v.sum(axis=1, keepdims=True)
        last = first + many - 1
        back[last] = across(np.ones((len(order), 2)), n - 1 - at[last], back=True)
        back[last] /= back[last].sum(axis=1, keepdims=True)
        for t in range(many[0] - 2, -1, -1):
            own = first[: np.searchsorted(-many, -(t + 1), "left")] + t
            v = (back[own + 1] * np.column_stack([np.ones(len(own)), gain[own + 1]])) @ move.T
            v = across(v, at[own + 1] - at[own] - 1, back=True)
            back[own] = v / v.sum(axis=1, keepdims=True)
        both = fore * back
        p = both[:, 1] / both.sum(axis=1)
        for k, i in enumerate(order):
            out[i] = p[first[k] : first[k] + many[k]]
        return out

    def score(self, x: tuple[float, float, float]) -> float:
        """Document score of summed(); of a document without marked words, that of no toxic word."""
        z = self.curve[0] + sum(c * v for c, v in zip(self.curve[1:], x, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def neighbours(at: np.ndarray) -> np.ndarray:
    """For each place how many other places lie within REACH, 2 at most."""
    return np.minimum(np.searchsorted(at, at + REACH, "right") - np.searchsorted(at, at - REACH, "left") - 1, 2)


def summed(p: np.ndarray, words: int) -> tuple[float, float, float]:
    """ln(1 + expected number of toxic words), the same by 100 words of the document, and the largest marginal."""
    n = float(p.sum())
    return float(np.log1p(n)), float(np.log1p(100 * n / max(words, 1))), float(p.max()) if len(p) else 0.0


def word_labels(words: list[str], toxic: bool, markers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words that bear markers, and their labels: in a toxic document, whether it holds a marker often enough."""
    bear = [(i, own) for i, w in enumerate(words) if (own := [t for t in traits(w) if t in markers])]
    held = Counter(t for _, own in bear for t in own)
    return np.array([i for i, _ in bear], np.int64), np.array([toxic and any(held[t] >= markers[t] for t in own) for _, own in bear], bool)


def train(windows: list[tuple[list[str], list[int], list[int], int]], blanks: dict[int, int], markers: dict[str, int], steps: int = 60, penalty: float = 1e-3) -> Crf:
    """Fits the CRF by gradient ascent (Adam). windows: (words with markers, their places, their labels, length); blanks: how many windows
    without such words there are of each length."""
    model = Crf()
    if not any(any(w[2]) for w in windows):
        return model
    known = [*sorted(markers), *NEAR]
    number = {t: i for i, t in enumerate(known)}
    windows = sorted([(w, at, y, n, 1) for w, at, y, n in windows] + [([], [], [], n, k) for n, k in blanks.items() if n], key=lambda x: -x[3])
    lengths, weight = np.array([x[3] for x in windows]), np.array([x[4] for x in windows], float)
    row = np.concatenate([np.full(len(x[1]), r) for r, x in enumerate(windows)]).astype(np.int64)
    place = np.concatenate([np.array(x[1], np.int64) for x in windows])
    gold = np.zeros((len(windows), lengths[0]), bool)
    gold[row, place] = np.concatenate([np.array(x[2], bool) for x in windows])
    near = np.concatenate([neighbours(np.array(x[1], np.int64)) for x in windows])
    have = [[number[t] for t in traits(w) if t in number] + ([number[NEAR[k - 1]]] if k else []) for w, k in zip((w for x in windows for w in x[0]), near, strict=True)]
    flat, owner = np.concatenate([np.array(h, np.int64) for h in have]), np.repeat(np.arange(len(have)), [len(h) for h in have])
    live = np.arange(lengths[0])[None, :] < lengths[:, None]
    gold_moves = np.array([[((live[:, 1:] & (gold[:, :-1] == i) & (gold[:, 1:] == j)) * weight[:, None]).sum() for j in range(2)] for i in range(2)])
    theta = np.concatenate([np.zeros(len(known)), [-3.0, 0.0], np.zeros(4)])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), weight.sum()

    def gather(p: np.ndarray) -> np.ndarray:
        p = p * weight[:, None]
        return np.concatenate([np.bincount(flat, weights=p[row, place][owner], minlength=len(known)), [p[live].sum(), p[:, 0].sum()]])

    target = np.concatenate([gather(gold.astype(float)), gold_moves.ravel()])
    for step in range(1, steps + 1):
        u = np.where(live, theta[-6], 0.0)
        u[row, place] += np.bincount(owner, weights=theta[flat], minlength=len(have))
        p, moves, _ = forward_backward(u, lengths, theta[-5], theta[-4:].reshape(2, 2), weight)
        g = (target - np.concatenate([gather(p), moves.ravel()])) / n - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model.weights = {t: float(x) for t, x in zip(known, theta, strict=False)}
    model.bias, model.start, model.move = float(theta[-6]), float(theta[-5]), theta[-4:].reshape(2, 2).copy()
    return model


def curve(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * z * (1 - z))[:, None]).T @ x + ridge * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (weight * (toxic - z)) - ridge * c)
    return tuple(float(k) for k in c)


def _words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def _once(docs: DataFrame, per_key: DataFrame) -> DataFrame:
    """(k, y, t): the labelled rows of docs (k, t) without near copies: of the documents of a label with the same least hash over
    runs of five words, the one with the smallest key. Only keys and hashes meet to choose them; texts are shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [int(x[0]) if len(x) else 0 for x in shingle_sets(*byte_column(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(least, np.uint64).view(np.int64))], ["k", "h", "sketch"])

    kind = docs.schema["k"].dataType.simpleString()
    hashed = docs.select("k", F.xxhash64("t").alias("h"), "t")
    sketched = hashed.mapInArrow(run, f"k {kind}, h long, sketch long").join(per_key, "k")
    chosen = written(sketched.groupBy("y", "sketch").agg(F.min(F.struct("k", "h")).alias("c")).select("y", "c.k", "c.h"))
    return written(hashed.join(chosen.hint("merge"), ["k", "h"]).dropDuplicates(["k", "h"]).select("k", "y", "t"))


def markers(docs: DataFrame, most: int = 20_000) -> dict[str, int]:
    """Markers of docs (y, t), and from how many times on they are; the `most` of largest likelihood ratio (the size of the model).
    Counts of all rows are added up in tasks and by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def sent() -> Iterator[pa.RecordBatch]:
            keys = [*dict.fromkeys([*seen[1], *seen[0]])]
            for lo in range(0, len(keys), 50_000):
                own = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own]), pa.array([k[1] for k in own], pa.int32()), pa.array([seen[1][k] for k in own], pa.int64()), pa.array([seen[0][k] for k in own], pa.int64())], ["trait", "times", "k1", "k0"])
            for s in seen:
                s.clear()

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held = Counter(x for w, n in Counter(_words(t.as_py())).items() for x in traits(w) for _ in range(min(n, TIMES)))
                seen[y].update((x, m) for x, n in held.items() for m in range(1, min(n, TIMES) + 1))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield from sent()
        yield from sent()

    total = {r["y"]: r["n"] for r in docs.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    if not n1 or not n0:
        return {}
    counts = docs.select("y", "t").mapInArrow(run, "trait string, times int, k1 long, k0 long").groupBy("trait", "times").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    counts = written(counts.where("k1 > 2"))
    tested = counts.count()

    def part(k: str, n: float, p: str) -> str:
        return f"(if({k} > 0, {k} * ln({p}), 0D) + if({k} < {n}, ({n} - {k}) * ln(1 - {p}), 0D))"

    ratio = f"2 * ({part('k1', n1, 'p1')} + {part('k0', n0, 'p0')} - {part('k1', n1, 'p')} - {part('k0', n0, 'p')})"
    shares = counts.selectExpr("*", f"k1 / {n1} p1", f"k0 / {n0} p0", f"(k1 + k0) / {n1 + n0} p").selectExpr("*", f"{ratio} g")
    found = shares.where((F.col("p1") > 8 * F.col("p0")) & (F.col("g") >= 2 * float(np.log(max(tested, 1) / 0.0025))))
    best = found.groupBy("trait").agg(F.min("times").alias("times"), F.max("g").alias("g")).orderBy(F.desc("g"), "trait").limit(most)
    return {r["trait"]: r["times"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows_per_class: int = 1500, most_windows: int = 20_000) -> Crf:
    """Markers come from all labelled documents. The CRF is fitted on at most most_windows windows with markers of at most
    rows_per_class labelled documents of each label 0 and 1, those whose md5 is least: a fixed random sample. Keys with another
    label, or null, and those that docs lacks teach nothing; of several labels of a key the largest counts. Without documents
    of both labels every score is low."""
    per_key = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).where("y in (0, 1)")
    known = _once(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), per_key)
    marks = markers(known)
    if not marks:
        return Crf()
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = sampled(known.where("y = 0").select("k", "y"), "k", rows_per_class).union(sampled(known.where("y = 1").select("k", "y"), "k", rows_per_class))
    sample = written(known.join(F.broadcast(chosen), ["k", "y"]))  # rows_per_class keys of each label
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = _words(t.as_py())
                at, label = word_labels(words, bool(y), shared.value)
                lo = np.searchsorted(at, np.arange(0, len(words) + WINDOW, WINDOW))
                empty: Counter = Counter()
                for i in range(-(-len(words) // WINDOW)):
                    n, own = min(WINDOW, len(words) - i * WINDOW), slice(lo[i], lo[i + 1])
                    if lo[i] == lo[i + 1]:
                        empty[n] += 1
                    else:
                        out.append((f"{k} {i}", [words[j] for j in at[own]], (at[own] - i * WINDOW).tolist(), label[own].astype(int).tolist(), n, 1))
                out += [("", [], [], [], n, c) for n, c in empty.items()]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["w", "words", "at", "y", "n", "c"])

    found = written(sample.select(F.col("k").cast("string"), "y", "t").mapInArrow(run, "w string, words array<string>, at array<int>, y array<int>, n int, c long"))
    windows = sampled(found.where("w <> ''"), "w", most_windows).collect()
    blanks = {r["n"]: r["c"] for r in found.where("w = ''").groupBy("n").agg(F.sum("c").alias("c")).collect()}
    model = train([(r["words"], r["at"], r["y"], r["n"]) for r in windows], blanks, marks)
    got = tag(sample, model, "t", ("k", "y")).select("y", "sums").collect()  # a few numbers by sampled document
    got.sort()
    y = np.array([r["y"] for r in got], float)
    weight = np.array([total[int(v)] / (y == v).sum() for v in y])
    model.curve = curve(np.array([r["sums"] for r in got]), y, weight * len(y) / weight.sum())
    return model


def tag(docs: DataFrame, model: Crf, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The kept columns, score double, sums array<double> (what the score is made of), and spans array<struct<start, end, chance>>: the
    code-point ranges of words whose marginal is `least` or more, neighbours joined. Null and empty texts have no span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `most` markers
    n = len(keep)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, known = shared.value, {}
        for b in batches:
            scores, sums, spans = [], [], []
            for lo in range(0, len(b), GROUP):
                texts = b.column(n).slice(lo, GROUP)
                size, places, weights = [], [], []
                for t in texts:
                    words = _words(t.as_py())
                    at, w = crf.marked(words, known)
                    size.append(len(words))
                    places.append(at)
                    weights.append(w)
                for i, p in enumerate(crf.marginals(places, weights, size)):
                    sums.append(summed(p, size[i]))
                    scores.append(crf.score(sums[-1]))
                    spans.append(_spans(texts[i].as_py(), places[i][p >= least], p[p >= least]) if len(p) and p.max() >= least else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, pa.float64()), pa.array(sums, pa.list_(pa.float64())), pa.array(spans, kind)], [*keep, "score", "sums", "spans"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double, sums array<double>, spans array<struct<start: int, end: int, chance: double>>")


def _spans(text: str, at: np.ndarray, p: np.ndarray) -> list[dict]:
    low, out = text.lower(), []
    if len(low) != len(text):  # lower-casing changed the length: find the words letter by letter
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = [m.span() for m in _word.finditer(low)]
    if at[-1] >= len(places):
        return [{"start": 0, "end": len(text), "chance": float(p.max())}]
    last = -2
    for i, x in zip(at.tolist(), p.tolist(), strict=True):
        if i == last + 1:
            out[-1]["end"], out[-1]["chance"] = places[i][1], max(out[-1]["chance"], x)
        else:
            out.append({"start": places[i][0], "end": places[i][1], "chance": x})
        last = i
    return out
