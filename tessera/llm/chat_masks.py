"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn after turn, by one template:

    ### role ###
    text</turn>

Control strings (``###``, ``</turn>`` and the backslash itself) are escaped
inside roles and texts, so that they mark turns only and every text can be read
back. The rendering is encoded once by byte-level BPE, each control string as a
token of its own, which gives the byte offsets of all tokens; the sorted spans
of the assistant's texts and the sorted spans of the tokens are intersected by
binary search, and tokens inside are under the loss mask. No token crosses a
control string, so the mask holds the assistant's texts and nothing between.

Turns are range partitioned along (conversation, turn), so a conversation with
a third of all rows is rendered and encoded by many tasks, in blocks of about
``BLOCK`` characters cut between turns. Digests are taken where a conversation
lies in one range; of conversations that touch the edge of a range the rendered
blocks are hashed in order by a second, sequential stream (a hash of one long
text has no other way; its memory is one block).

Defined cases: rows go by turn, nulls first, ties by role, then by SHA-256 of
the text; repeated rows are turns of their own; null roles and texts count as
empty; rows without a conversation id form one conversation, whose id is null;
only the role ``assistant``, spelled so, is under the mask; texts of any length
are encoded in pieces; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.byte_bpe import Coder, MOST_VOCABULARY_BYTES
from tessera.llm.common import id_key, saved, text_batches, whole, worker_cache

OPEN, SAYS, CLOSE = "### ", " ###\n", "</turn>\n"
MARKS = (OPEN, SAYS, CLOSE)
#: What stands for a control string inside a role or text.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
LOSS_ROLE = "assistant"
#: Characters of one rendered block, about; a turn is never cut.
BLOCK = 1 << 20
#: Bytes of packed ids that are intersected at a time.
_PIECE = 1 << 20
_MARK = re.compile("|".join(map(re.escape, MARKS)))
_BACK = {short: long for long, short in ESCAPES}
_SHORT = re.compile("|".join(map(re.escape, _BACK)))


def escape(text: str) -> str:
    for long, short in ESCAPES:
        text = text.replace(long, short)
    return text


def unescape(text: str) -> str:
    return _SHORT.sub(lambda m: _BACK[m.group()], text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{SAYS}{escape(text)}{CLOSE}"


def turns_of(rendered: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendering."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise ValueError("a turn does not start with its mark")
        says = rendered.index(SAYS, at + len(OPEN))
        close = rendered.index(CLOSE, says + len(SAYS))
        yield unescape(rendered[at + len(OPEN):says]), unescape(rendered[says + len(SAYS):close])
        at = close + len(CLOSE)


def overlapping(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the sorted intervals [start, end) meet one of the sorted,
    disjoint ``spans`` (rows of start and end)."""
    first = np.searchsorted(spans[:, 1], starts, "right")  # spans before it end at or before the interval's start
    beyond = np.searchsorted(spans[:, 0], ends, "left")  # spans from it on start at or after the interval's end
    return beyond > first


class ChatCoder:
    """Renders, encodes, masks and reads back; control strings have the ids after the vocabulary's."""

    def __init__(self, data: bytes, pattern: str):
        self.coder = Coder(data, pattern)
        plain = self.coder.vocabulary.token
        self.token = plain + [m.encode() for m in MARKS]
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.mark = {m: np.array([len(plain) + n], "<u4").tobytes() for n, m in enumerate(MARKS)}

    def _packed(self, rendered: str) -> Iterator[bytes]:
        at = 0
        for m in _MARK.finditer(rendered):
            if m.start() > at:
                yield from self.coder.encode(rendered[at:m.start()])
            yield self.mark[m.group()]
            at = m.end()

    def masked(self, rendered: str, spans: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, under the mask) of the rendering, in pieces of bounded size;
        ``spans`` are byte spans."""
        offset, held, size = 0, [], 0
        for packed in itertools.chain(self._packed(rendered), (None,)):
            if packed is not None:
                held.append(packed)
                size += len(packed)
                if size < _PIECE:
                    continue
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = offset + np.cumsum(self.length[ids])
            starts = ends - self.length[ids]
            if len(ids):
                offset = int(ends[-1])
                yield ids, overlapping(starts, ends, spans)
            held, size = [], 0

    def text(self, pieces: Iterator[np.ndarray]) -> str:
        """The text of some ids; a character may be cut between pieces."""
        token = self.token.__getitem__
        return b"".join(b"".join(map(token, ids.tolist())) for ids in pieces).decode("utf-8", "surrogatepass")


def rendered_block(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The rendering of some turns and the byte spans of the texts under the mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        line = render(role, text)
        size = len(line.encode("utf-8", "surrogatepass"))
        if role == LOSS_ROLE and text:
            inside = len(escape(text).encode("utf-8", "surrogatepass"))
            spans.append((at + size - len(CLOSE) - inside, at + size - len(CLOSE)))
        parts.append(line)
        at += size
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(conversation, turns) of at most about ``most`` characters, in order."""
    now, held, size = None, [], 0
    for batch in batches:
        for key, role, text in zip(batch["key"], batch["role"], batch["text"]):
            if held and (key != now or size >= most):
                yield now, held
                held, size = [], 0
            now = key
            held.append((role, text))
            size += len(text)
    if held:
        yield now, held


class Digests:
    """What the contract asks of a conversation, from its output."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, under: str) -> None:
        for role, text in turns_of(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        text = unescape(under)
        self.loss_chars += len(text)
        self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_DIGEST_TYPE = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(key, role, text, ...) range partitioned and sorted along the turns."""
    rows = turns.select(
        id_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), whole("role").alias("role"), whole("text").alias("text"),
    ).withColumns({
        "h": F.sha2("text", 256),
        "copy": F.pmod(F.monotonically_increasing_id(), F.lit(4096)),  # equal rows may lie in several ranges
    })
    order = ["key", F.col("turn").asc_nulls_first(), "role", "h", "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "role", "text")


def _vocabulary(spark: SparkSession, path: str):
    text_batches(spark)
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than the broadcast bound")
    return spark.sparkContext.broadcast(data)


def _coder(data: bytes, pattern: str) -> ChatCoder:
    return worker_cache(("chat_masks", hash(data), pattern), lambda: ChatCoder(data, pattern))


def conversation(key: Column) -> Column:
    return F.when(key != "null", key.cast("long"))


def formatted(turns: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, block, formatted, ids, loss): renderings with their token
    ids and the mask per token; the blocks of a long conversation go by part, then block."""
    data = _vocabulary(turns.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = _coder(data.value, pattern), TaskContext.get().partitionId()
        for n, (key, held) in enumerate(_blocks(batches, block)):
            text, spans = rendered_block(held)
            pieces = list(coder.masked(text, spans))
            yield pd.DataFrame({
                "key": [key], "part": [part], "block": [n], "formatted": [text],
                "ids": [np.concatenate([i for i, _ in pieces]).astype("<i4")], "loss": [np.concatenate([m for _, m in pieces])],
            })

    out = ordered_turns(turns).mapInPandas(run, "key string, part int, block long, formatted string, ids array<int>, loss array<boolean>")
    return out.select(conversation(F.col("key")).alias("conv_id"), "part", "block", "formatted", "ids", "loss")


def digests(turns: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars), read back from ids and mask."""
    data = _vocabulary(turns.sparkSession, path)
    columns = ["key", "part", "block", *_DIGEST, "formatted", "under"]
    schema = f"key string, part int, block long, {_DIGEST_TYPE}, formatted string, under string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = _coder(data.value, pattern), TaskContext.get().partitionId()
        rows, size, first, now, state = [], 0, None, None, None
        kept: list = []  # what the latest conversation returned; it may go on in the next range

        def closed():
            if state is not None:
                rows.append((now, part, 0, *state.row(), None, None))

        for n, (key, held) in enumerate(_blocks(batches, block)):
            text, spans = rendered_block(held)
            pieces = list(coder.masked(text, spans))
            back = coder.text(ids for ids, _ in pieces)
            under = coder.text(ids[mask] for ids, mask in pieces)
            if key != now:
                closed()
                kept, now = [], key
                first = key if first is None else first
                state = None if key == first else Digests()
            if key == first:  # may have begun in the range before
                rows.append((key, part, n, *[None] * len(_DIGEST), back, under))
                size += len(back)
            else:
                state.add(back, under)
                kept.append((back, under))
                if sum(len(b) for b, _ in kept) > block:  # long: left to the second stream as well
                    rows += [(key, part, n - len(kept) + 1 + m, *[None] * len(_DIGEST), b, u) for m, (b, u) in enumerate(kept)]
                    size += sum(len(b) for b, _ in kept)
                    first, state, kept = key, None, []
            if len(rows) >= 1000 or size >= 8 * block:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if state is not None:  # the last one of the range
            rows += [(now, part, 1 << 40, *[None] * len(_DIGEST), b, u) for b, u in kept]
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, None, []
        for batch in batches:
            for key, back, under in zip(batch["key"], batch["formatted"], batch["under"]):
                if key != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = key, Digests()
                state.add(back, under)
            if done:
                yield pd.DataFrame(done, columns=["key", *_DIGEST])
                done = []
        if state is not None:
            yield pd.DataFrame([(now, *state.row())], columns=["key", *_DIGEST])

    out = saved(ordered_turns(turns).mapInPandas(run, schema), "chat-masks")
    open_ones = out.filter(F.col("formatted").isNotNull())
    late = open_ones.repartition("key").sortWithinPartitions("key", "part", "block").select("key", "formatted", "under")
    both = out.filter(F.col("formatted").isNull()).select("key", *_DIGEST).unionByName(late.mapInPandas(hashed, f"key string, {_DIGEST_TYPE}"))
    return both.select(conversation(F.col("key")).alias("conv_id"), *_DIGEST)


#: A conversation that holds control strings, formatted besides the table's.
PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(PROBE).alias("text"),
    )
    return digests(rows.unionByName(probe), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _sql_escape(column: str) -> str:
    for long, short in ESCAPES:
        column = f"replace({column}, '{long}', '{short}')"
    return column


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, '{LOSS_ROLE}', '{PROBE}'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text ELSE '' END, '' ORDER BY place) AS loss,
    CAST(sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {sum(map(len, MARKS))}) AS BIGINT) AS formatted_chars
  FROM o GROUP BY conv_id
) SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""
