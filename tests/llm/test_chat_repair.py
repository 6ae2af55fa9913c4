"""Conversation repair against a search over whole edit strings."""

import hashlib
import heapq
import re
import zlib

import pytest

from tessera.llm import chat_repair

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def cheapest(turns):
    """(cost, audit, repaired turns): best-first search over edit strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, kept
        if (at, state) in done:
            continue
        done.add((at, state))
        need = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", at, need[0], kept + ((need, ""),)))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, need[0], kept + ((need, text),)))
                if role[:1] == need[0] or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], kept + ((role, text),)))


def slow(rows):
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        seen, turns = set(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        cost, audit, kept = cheapest(turns)
        times = [r[1] for r in mine if r[1] is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        n = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *n, illegal, cost, audit, digest)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def fast(spark, rows, part=chat_repair.PART):
    out = chat_repair.report(spark.createDataFrame(rows, SCHEMA), part).collect()
    table = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out}
    assert len(table) == len(out)
    return table


def mixed(n, seed=1):
    """Rows with every fault, role and tie, in conversations of 1 to 12 turns and a long one."""
    roles = ["user", "assistant", "system", None, "", "tool", "assistant", "user", "Über"]
    texts = ["Yes.", "cut", "", None, " \t", "Why?", "Yes.", "e!  \n", "é", "!?"]
    rows = []
    for k in range(n):
        x = zlib.crc32(f"{seed}:{k}".encode())
        conv = 10_000 if k % 3 == 0 else k // 9
        rows.append((conv, None if x % 17 == 0 else (k if conv == 10_000 else x % 12), roles[x // 7 % 9], texts[x // 64 % 10]))
    return rows


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in chat_repair.query(spark, folder).collect()}
    assert out == slow(rows)


@pytest.mark.parametrize("part", [1, 3, chat_repair.PART])
def test_every_fault_role_and_tie(spark, part):
    rows = mixed(700) + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    assert fast(spark, rows, part) == slow(rows)


def test_repeated_rows_of_one_conversation(spark):
    rows = [(5, 3, "user", "Same.")] * 400 + [(5, t, "user", "Same.") for t in range(10, 200)] + [(6, t, "s", "x.") for t in range(50)]
    assert fast(spark, rows, 16) == slow(rows)


def test_conversation_without_rows_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert fast(spark, [(conv, 1, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert fast(spark, []) == {}


def test_long_text_and_further_columns(spark):
    rows = [(1, 1, "user", "w " * 500_000 + "."), (1, 2, "assistant", "a" * 300_000)]
    df = spark.createDataFrame([(*r, 7, "k", 0) for r in rows], SCHEMA + ", copies int, key string, part int")
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in chat_repair.report(df).collect()}
    assert out == slow(rows)


def test_repaired_turns(spark):
    rows = mixed(200)
    _, found, turns = chat_repair.repaired(chat_repair.damaged(spark.createDataFrame(rows, SCHEMA)), 4)
    kept = {}
    for r in sorted(chat_repair.repaired_turns(turns, found).collect(), key=lambda r: (r["key"], r["place"])):
        kept.setdefault(int(r["key"]), []).append(f"{r['role']}:{r['text']}")
    want = slow(rows)
    for conv, lines in kept.items():
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_nodes_are_the_distinct_suffixes():
    signatures = sorted({"uaua", "suaua", "xuaua", "uA", "a", "uaxa", "ua"}, key=lambda s: s[::-1])
    made = sum(n for _, _, n in chat_repair.automaton(iter(signatures), chat_repair.END))
    assert made == len({s[i:] for s in signatures for i in range(len(s))})


def test_parts_come_from_the_same_signatures(spark):
    """Distinct signatures are solved once however many conversations have them."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c} {t}.") for c in range(300) for t in range(1, 5)]
    symbols = chat_repair.symbols(chat_repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    cuts = chat_repair.parts(symbols)
    assert chat_repair.solved(cuts.selectExpr("signature", f"'{chat_repair.END}' AS costs")).count() == cuts.select("signature").distinct().count() < 300
