"""Byte-level BPE against tiktoken, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tessera.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
CODER = byte_bpe.Coder(DATA, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(b"".join(CODER.encode(text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdetion 'sS01\n\t é", max_size=80)))
def test_ids_equal_tiktoken(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)
    assert CODER.decode(b"".join(CODER.encode(text))) == text.encode("utf-8", "surrogatepass")


def test_long_texts_are_cut_between_pieces():
    text = "word, 12  x\n" * 120_000
    assert ids(text) == TIKTOKEN.encode_ordinary(text)


def test_appends_and_edits_equal_a_new_table():
    rng, v = random.Random(5), CODER.vocabulary
    for _ in range(150):
        data = bytes(rng.choice(b"abcdet ionr") for _ in range(rng.randint(0, 400)))
        table = byte_bpe.PrefixTable(v, data)
        assert table.encode() == v.merged(data)
        table.append(b"ing")
        assert table.last == byte_bpe.PrefixTable(v, data + b"ing").last
        data += b"ing"
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new = bytes(rng.choice(b"abet") for _ in range(rng.randint(0, 6)))
        again = table.replace(a, b, new)
        assert table.last == byte_bpe.PrefixTable(v, data[:a] + new + data[b:]).last and again <= len(table.data)


def test_a_byte_is_tried_with_the_tokens_that_end_there_only():
    class Counted(dict):
        tried = 0

        def get(self, *a):
            Counted.tried += 1
            return super().get(*a)

    v = byte_bpe.Vocabulary(DATA)
    for name in ("made", "_pairs", "_step"):
        setattr(v, name, Counted(getattr(v, name, {})))
    data = b" eaanthedlyed wasretionwhtion ofbeeringinst" * 20
    assert byte_bpe.PrefixTable(v, data).encode() == v.merged(data)
    assert Counted.tried < 4 * len(data)


def test_edits_recompute_a_part_only():
    data = b"the quick brown fox jumps over the lazy dog " * 200
    table = byte_bpe.PrefixTable(CODER.vocabulary, data)
    assert table.replace(100, 103, b"cat") < 1000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, "Hello world's 42 <|endoftext|>", 0), (1, "Hello world's 42 <|endoftext|>", 0), (None, None, 1), (3, "", 2), (4, "ab" * 60_000 + "  \x1c x", 3)],
        "doc_id long, text string, n_tokens int",
    )


def test_digests(spark, docs):
    got = byte_bpe.token_digests(docs.select("doc_id", "text", "n_tokens")).collect()
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        i = TIKTOKEN.encode_ordinary(t) if len(t) < 1000 else ids(t)
        want.append((str(r["doc_id"]), len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert byte_bpe.token_digests(docs.limit(0)).count() == 0


def test_columns_of_ids_and_bytes(spark, docs):
    both = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    for r in both.collect():
        assert bytes(r["bytes"]).decode() == (r["text"] or "") and r["ids"] == ids(r["text"] or "")
