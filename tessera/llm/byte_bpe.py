"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece, exactly one token can end its encoding: the
one that forms a valid pair with the last token of the prefix before it.
``PrefixTable`` stores these last tokens, so appending bytes extends the table
and keeps what it holds, and an edit recomputes only until the table falls
into step with the old one. An automaton of the tokens names those that end at
a byte, so the work per byte does not depend on the longest token. A pair of tokens is valid if merging their bytes
by rank gives these two tokens back.

Texts are split by the public pattern and each match is encoded on its own.
The vocabulary file is a parameter; the driver reads it and broadcasts its
bytes, which must not exceed ``MOST_VOCABULARY_BYTES``. Words repeat, so each
worker remembers the encodings of a bounded number of them.

Defined cases: a null text counts as empty and has no tokens; texts of any
length are encoded in pieces; special token strings are ordinary text; rows
are independent of each other, so repeated rows, null identifiers and further
columns do not matter; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.llm.common import documents, text_batches, whole, worker_cache

MOST_VOCABULARY_BYTES = 64 << 20
_REMEMBERED_WORDS = 150_000
_REMEMBERED_BYTES = 256
_REMEMBERED_PAIRS = 150_000
_REMEMBERED_STEPS = 150_000
_LONG_TEXT = 1 << 20


class Vocabulary:
    """Ranks of a byte-level BPE; ``data`` holds lines of a base64 token and its rank."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.longest = max(map(len, self.rank), default=1)
        self._pairs: dict[tuple[int, int], bool] = {}
        # tokens that merging would never produce cannot occur inside an encoding
        self.made = {t: r for t, r in self.rank.items() if self.merged(t) == [r]}
        self._step, self._fail, self._ends = self._automaton()

    def _automaton(self) -> tuple[dict[int, int], list[int], list[tuple]]:
        """Aho-Corasick automaton of ``made``: the states that a byte leads to,
        the state of the longest proper suffix, and (token, length) of all
        tokens that end in a state, the longest first."""
        step, came, own = {}, [(0, 0, 0)], [None]
        for token, r in self.made.items():
            state = 0
            for depth, byte in enumerate(token):
                now = step.get(state << 8 | byte)
                if now is None:
                    now = step[state << 8 | byte] = len(came)
                    came.append((depth, state, byte))
                    own.append(None)
                state = now
            own[state] = (r, len(token))
        fail, ends = [0] * len(came), [()] * len(came)
        for state in sorted(range(1, len(came)), key=came.__getitem__):
            _, before, byte = came[state]
            if before:
                at = fail[before]
                while at and at << 8 | byte not in step:
                    at = fail[at]
                fail[state] = step.get(at << 8 | byte, 0)
            rest = ends[fail[state]]
            ends[state] = (own[state], *rest) if own[state] else rest
        return step, fail, ends

    def merged(self, data: bytes) -> list[int]:
        """Merge by rank, step by step; for short ``data``."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank, none = self.rank.get, len(self.token)
        least = [rank(a + b, none) for a, b in itertools.pairwise(parts)]
        while least and (now := min(least)) < none:
            at = least.index(now)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del least[at]
            if at:
                least[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(least):
                least[at] = rank(parts[at] + parts[at + 1], none)
        return [self.rank[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= _REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def _later(self, key: int) -> int:
        """The state after one that has no step for the byte, by its suffixes."""
        state, byte = key >> 8, key & 255
        while state and state << 8 | byte not in self._step:
            state = self._fail[state]
        state = self._step.get(state << 8 | byte, 0)
        if len(self._step) < _REMEMBERED_STEPS:
            self._step[key] = state
        return state

    def ids(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes tell."""
        ids, end, token = [], len(last), self.token
        while end:
            ids.append(last[end - 1])
            end -= len(token[ids[-1]])
        return ids[::-1]

    def extend(self, data: bytes, last: list[int], end: int) -> int | None:
        """Extend ``last`` to the first ``end`` bytes; returns its last entry.
        Of the tokens that end a prefix, one only is valid after its predecessor."""
        step, ends, pairs = self._step.get, self._ends, self._pairs.get
        done, state = len(last), 0
        at = max(0, done - self.longest)  # the state depends on no earlier bytes
        for stop, byte in enumerate(data[at:end], at + 1):
            key = state << 8 | byte
            state = step(key)
            if state is None:
                state = self._later(key)
            if stop <= done:
                continue
            for t, size in ends[state]:
                if size == stop:
                    break
                before = last[stop - size - 1]
                fits = pairs((before, t))
                if fits or fits is None and self.valid(before, t):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(t)
        return last[-1] if last else None


class PrefixTable:
    """The last tokens of all prefixes of some bytes; ``last[i]`` ends the first ``i + 1`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; what is stored stays right."""
        self.data += data
        self.vocabulary.extend(bytes(self.data), self.last, len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in the place of the bytes from ``start`` to ``end``;
        returns how many prefixes were computed again."""
        old, shift = self.last, len(data) - (end - start)
        self.data[start:end] = data
        self.last = old[:start]
        same, at = 0, start
        now = bytes(self.data)
        while at < len(now):
            at += 1
            t = self.vocabulary.extend(now, self.last, at)
            inside = at > start + len(data)
            same = same + 1 if inside and old[at - 1 - shift] == t else 0
            if same >= self.vocabulary.longest:  # all that later entries look back on agrees
                self.last += old[at - shift:]
                break
        return at - start

    def encode(self) -> list[int]:
        return self.vocabulary.ids(self.last)


class _Words(dict):
    """Encodings of pieces as packed little-endian numbers, made when asked
    for. When full, the words move to ``old`` and those still in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is not None:
            self[piece] = packed
            return packed
        data = piece.encode("utf-8", "surrogatepass")
        whole_piece = self.vocabulary.rank.get(data)
        if whole_piece is not None:
            ids = [whole_piece]
        else:
            last: list[int] = []
            self.vocabulary.extend(data, last, len(data))
            ids = self.vocabulary.ids(last)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(data) <= _REMEMBERED_BYTES:
            if len(self) >= _REMEMBERED_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Coder:
    def __init__(self, data: bytes, pattern: str):
        self.vocabulary = Vocabulary(data)
        self.split = regex.compile(pattern)
        self.words = _Words(self.vocabulary)

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of the text, in pieces of bounded size."""
        if len(text) <= _LONG_TEXT:
            yield b"".join(map(self.words.__getitem__, self.split.findall(text)))
            return
        found = (m.group() for m in self.split.finditer(text))
        while some := list(itertools.islice(found, _LONG_TEXT // 16)):
            yield b"".join(map(self.words.__getitem__, some))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _coder(data: bytes, pattern: str) -> Coder:
    return worker_cache(("byte_bpe", hash(data), pattern), lambda: Coder(data, pattern))


def _vocabulary(spark: SparkSession, path: str):
    text_batches(spark)
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than the broadcast bound")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text as an array."""
    data = _vocabulary(docs.sparkSession, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(data.value, pattern)
        for texts in batches:
            yield texts.map(lambda t: np.frombuffer(b"".join(coder.encode(t)), "<i4"))

    return docs.withColumn(into, ids(whole(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``docs`` with the bytes of its ids; null counts as no ids."""
    data = _vocabulary(docs.sparkSession, path)

    @F.pandas_udf(T.BinaryType())
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(data.value, pattern)
        for lists in batches:
            yield lists.map(lambda x: coder.decode(np.asarray(x, "<u4").tobytes()))

    return docs.withColumn(into, joined(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again."""
    data = _vocabulary(docs.sparkSession, path)

    @F.pandas_udf(T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(data.value, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
                for packed in coder.encode(t):
                    n += len(packed) // 4
                    ids.update(packed)
                    back.update(coder.decode(packed))
                rows.append((n, ids.hexdigest(), back.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(doc_id).alias("id"), both(whole(text)).alias("r"))
    return out.select("id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def token_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir).select("doc_id", "text"))
