"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

Each byte becomes one letter, each vocabulary entry the piece spelt with those letters, scored by its negative rank, so
sentencepiece merges in rank order. Normalisation is the identity. Text is split into pre-tokens by the pattern of the
vocabulary; each is encoded on its own. Decoding maps every id back to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_LETTER = 0x100  # byte b is written as the letter with this code plus b
CACHE = 200_000  # pre-tokens that a worker remembers; all are forgotten when it is full


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64 and rank a line), by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTERS)


_LETTERS = {b: FIRST_LETTER + b for b in range(256)}


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model: piece i is token i, so ids are ranks; the unknown piece comes last."""
    pieces = [_field(1, _field(1, letters(t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))  # model_type BPE, vocab_size, unk_id
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one process."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """Encodes pre-tokens that are not in the cache."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        hard = []
        for w in new:
            one = self.whole.get(data := w.encode())
            if one is None:
                hard.append((w, letters(data)))
            else:
                self.known[w] = (one,)
        if hard:
            for (w, _), ids in zip(hard, self.pieces.encode([x for _, x in hard], out_type=int, num_threads=1), strict=True):
                self.known[w] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        try:
            return list(chain.from_iterable(map(self.known.__getitem__, words)))
        except KeyError:
            self.learn(set(words))
            return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_open: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder; built once a process."""
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteBpe(path, pattern)
    return _open[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids array<int>) for each row; null text is empty. Other columns are left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["k", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"k {kind}, n_tokens long, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) for each row of ids; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["k", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"k {kind}, decoded binary").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes in one pass: (kept columns, n_tokens, ids_sha256 of the comma-joined ids, decoded_sha256).

    The ids never leave the worker, so nothing but digests moves. Null and empty texts have no ids.
    """

    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = coder(path, pattern), hashlib.sha256
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column(width):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(",".join(map(NUMBERS.__getitem__, ids) if len(bpe.tokens) <= len(NUMBERS) else map(str, ids)).encode()).hexdigest())
                of_bytes.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


NUMBERS = [str(i) for i in range(1 << 16)]
