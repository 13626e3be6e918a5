"""Language identification in two levels: family first, then one-versus-one linear SVMs between the family's languages.

Features of a text are the counts of hashed byte triplets of its lower-cased letters (everything else is a space), square-rooted
and scaled to length 1. Every SVM is linear, with squared hinge loss and balanced classes, fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cmp_to_key
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemill.llm.common import sampled

DIM = 4096
UNKNOWN = "und"

# Language codes (ISO 639-1) by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "iranian": "fa ps ku tg",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_mix = np.random.default_rng(20240229).integers(1, 1 << 32, 3, dtype=np.uint32) | np.uint32(1)
_first, _second, _third = (np.arange(256, dtype=np.uint32) * m for m in _mix)


def features(text: str) -> np.ndarray | None:
    """The text's vector, or None if it has no letter."""
    text = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(_ASCII)
    text = " " + " ".join(text.split()) + " "
    if len(text) < 3:
        return None
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = (_first[b[:-2]] + _second[b[1:-1]] + _third[b[2:]]) >> np.uint32(20)
    v = np.sqrt(np.bincount(at, minlength=DIM)).astype(np.float32)
    return v / np.linalg.norm(v)


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


@dataclass
class Svm:
    """A separating plane, and the slope that turns its margin into a probability."""

    weight: np.ndarray
    bias: float
    slope: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weight + self.bias), -30, 30)))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> Svm:
    """y: true for the first class. Accelerated gradient descent on the mean balanced squared hinge loss."""
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c, rate = w.copy(), b, 0.25  # rows have length 1, so the curvature is at most 4
    for i in range(steps):
        gap = np.maximum(0, 1 - sign * (x @ v + c))
        g = -2 * share * sign * gap
        nw, nb = v - rate * (x.T @ g + penalty * v), c - rate * g.sum()
        m = i / (i + 3)
        v, c = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    margin = sign * (x @ w + b)
    slopes = np.geomspace(1, 32, 24)
    loss = [float((share * np.log1p(np.exp(-np.clip(s * margin, -30, 30)))).sum()) for s in slopes]
    return Svm(w, float(b), float(slopes[int(np.argmin(loss))]))


@dataclass
class Model:
    """families: name to languages. by_family: one SVM a family against the rest. by_pair: one a pair of languages."""

    families: dict[str, list[str]] = field(default_factory=dict)
    by_family: dict[str, Svm] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], Svm] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row."""
        names = list(self.families)
        if not names:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        p = np.ones((len(x), 1)) if len(names) == 1 else np.column_stack([self.by_family[f].chance(x) for f in names]) + 1e-12
        p /= p.sum(axis=1, keepdims=True)
        best, out, score = p.argmax(axis=1), np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        for i, f in enumerate(names):
            rows, langs = np.flatnonzero(best == i), self.families[f]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(langs)))
            for j, k in combinations(range(len(langs)), 2):
                q = self.by_pair[langs[j], langs[k]].chance(x[rows])
                votes[:, j] += q
                votes[:, k] += 1 - q
            won = votes.argmax(axis=1)
            out[rows] = np.array(langs, object)[won]
            score[rows] = p[rows, i] * (votes.max(axis=1) / (len(langs) - 1) if len(langs) > 1 else 1.0)
        return out.tolist(), score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = 4000) -> Model:
    """Fits on the train_rows labelled rows whose md5 of the key is least: a fixed random sample, so the driver gets at most
    train_rows vectors: of each the places and values that are not 0 (at most 16 KB), then one matrix of 16 KB a row. Rows without a label or a letter teach nothing."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, v.astype(np.float16)) for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True) if (v := features(t.as_py() or "")) is not None]
            at = [np.flatnonzero(v).astype(np.uint16) for _, v in got]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].tobytes() for (_, v), i in zip(got, at, strict=True)], pa.binary())], ["lang", "at", "v"])

    def whole(r: Row) -> np.ndarray:
        v = np.zeros(DIM, np.float16)
        v[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float16)
        return v

    def compared(a: Row, b: Row) -> int:
        one, other = ((r["lang"], whole(r).tobytes()) for r in (a, b))
        return (one > other) - (one < other)

    sample = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    keys = sampled(sample.select("k").distinct(), "k", train_rows)  # at most train_rows keys; only their texts are turned into vectors
    rows = sample.join(F.broadcast(keys), "k").select("t", "l").mapInArrow(vectors, "lang string, at binary, v binary").collect()
    rows.sort(key=cmp_to_key(compared))
    model = Model()
    if not rows:
        return model
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i] = whole(r)
    y = np.array([r["lang"] for r in rows], object)
    del rows
    for code in sorted(set(y)):
        model.families.setdefault(FAMILY_OF.get(code, code), []).append(code)
    home = np.array([FAMILY_OF.get(c, c) for c in y], object)
    if len(model.families) > 1:
        model.by_family = {f: fit_svm(x, home == f) for f in model.families}
    for langs in model.families.values():
        for a, b in combinations(langs, 2):
            own = np.flatnonzero((y == a) | (y == b))
            if own[-1] - own[0] + 1 == len(own):  # neighbours: no copy
                own = slice(own[0], own[-1] + 1)
            model.by_pair[a, b] = fit_svm(x[own], y[own] == a)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred string and score double. Null texts and texts without a letter: 'und', 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few planes of 16 KB, one for each pair of languages in a family
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = [UNKNOWN] * len(b), np.zeros(len(b))
            for lo in range(0, len(b), 1000):
                got = [(i, v) for i, t in enumerate(b.column(n).slice(lo, 1000), lo) if (v := features(t.as_py() or "")) is not None]
                if got:
                    names, s = m.predict(np.stack([v for _, v in got]))
                    for (i, _), name in zip(got, names, strict=True):
                        langs[i] = name
                    scores[[i for i, _ in got]] = s
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")
