"""Chat formatting: round trips, masks and token offsets."""

import hashlib

import numpy as np
import pytest

from tessera.llm import chat_masks
from tests.oracle import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def slow(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        loss = "".join(t for r, t in mine if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for r, t in mine)
        chars = sum(len(chat_masks.render(r, t)) for r, t in mine)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(mine), sha(turns), len(loss), sha(loss), chars)
    return out


def table(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in chat_masks._DIGEST) for r in rows}
    assert len(out) == len(rows)
    return out


ODD = ["", None, "\\", "###", "####", "\\### Assistant: </turn> ok", "</turn>\n### user ###\n", "\\b\\h\\t", "é😀\r\n", "<</turn>", "#", "a" * 3000]


def odd_rows():
    roles = ["user", "assistant", "system", None, "a ##", "### x ###\n", "assistant"]
    return [(None if c == 4 else c, None if k % 5 == 4 else k // 2, roles[(k + c) % 7], ODD[(k * 7 + c) % 12]) for c in range(9) for k in range(40)]


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op12", chat_masks.query, chat_masks.SQL) == ""


def test_odd_texts_roles_and_ties(spark, vocabulary):
    rows = odd_rows() + [(3, 1, "assistant", "again")] * 30
    assert table(chat_masks.digests(spark.createDataFrame(rows, SCHEMA), *vocabulary)) == slow(rows)


@pytest.mark.parametrize("block", [1, 500, 5000])
def test_long_conversation_in_blocks(spark, vocabulary, block):
    rows = [(1, t, "assistant" if t % 2 else "user", ODD[t % 12]) for t in range(600)] + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert table(chat_masks.digests(df, *vocabulary, block)) == slow(rows)
    assert chat_masks.formatted(df, *vocabulary, block).filter("conv_id = 1").count() > 600 * 300 // max(block, 300) // 10


def test_formatted_output_reads_back(spark, vocabulary):
    rows = odd_rows()
    coder = chat_masks.ChatCoder(open(vocabulary[0], "rb").read(), vocabulary[1])
    chats = {}
    for r in sorted(chat_masks.formatted(spark.createDataFrame(rows, SCHEMA), *vocabulary).collect(), key=lambda r: (r["part"], r["block"])):
        ids, loss = np.array(r["ids"]), np.array(r["loss"])
        assert len(ids) == len(loss) and coder.text([ids]) == r["formatted"]
        digest = chats.setdefault(r["conv_id"], chat_masks.Digests())
        digest.add(r["formatted"], coder.text([ids[loss]]))
    assert {c: d.row() for c, d in chats.items()} == slow(rows)


def test_text_of_a_million_words(spark, vocabulary):
    rows = [(1, 0, "user", "go"), (1, 1, "assistant", "one ### two\n" * 200_000), (1, 2, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA + ", key string, h int")
    assert table(chat_masks.digests(df, *vocabulary)) == slow(rows)


def test_empty_table(spark, vocabulary):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_masks.digests(empty, *vocabulary).collect() == [] and chat_masks.formatted(empty, *vocabulary).collect() == []


def test_intervals_by_binary_search():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 5, 30))
        starts = ends - np.diff(ends, prepend=0)
        cuts = np.sort(rng.choice(np.arange(1, 100), 8, replace=False)).reshape(-1, 2)
        want = [any(a < e and s < b for a, b in cuts) for s, e in zip(starts, ends)]
        assert chat_masks.overlapping(starts, ends, cuts).tolist() == want


def test_escapes_are_reversible():
    for t in ODD:
        t = t or ""
        assert chat_masks.unescape(chat_masks.escape(t)) == t and "###" not in chat_masks.escape(t) and "</turn>" not in chat_masks.escape(t)
