"""Conversation structure repair over a suffix-shared automaton.

Every turn of a conversation is one symbol: the initial of its role with its
fault, or one symbol for all turns that must go. A conversation's signature is
the string of its symbols. What it costs to repair the rest of a conversation
depends on the rest of its signature and on the state of the role grammar only,
so signatures are merged from the end: the nodes of the automaton are the
distinct suffixes of all signatures, and cost-to-go, best audit suffix and
final state are computed once per node and grammar state for all conversations
together. Distinct signatures are range partitioned by their reversal, so equal
suffixes meet in one task, where a sorted pass keeps the nodes of the current
signature on a stack.

Turns are range partitioned along (conversation, turn) and signatures are cut
into parts of at most ``PART`` turns per range, so a conversation with a third
of all rows is many parts. The cost-to-go at a cut is a vector of four numbers,
known up to a constant: the parts' cost matrices (computed once per distinct
part) give it from the last part backwards; the automaton then runs on distinct
(part, vector) pairs. Nothing in a task grows with a conversation. Repaired
texts are hashed by one sequential stream per conversation, as a hash of one
long text asks for; its memory is one batch.

The grammar of role initials is ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user
or assistant 1, Delete 2, Insert 5; a truncated turn that stays adds 5; blank
and duplicate turns must be deleted. Of equally cheap repairs the one with the
ASCII-least string of initials is taken; the initials fix the repair.

Defined cases: a null role or text is one space, so is a null conversation or
turn in the damage key; rows go by turn, nulls first, ties by role, then by
SHA-256 of the text, so repeated rows are adjacent and all but the first are
duplicates; rows without an id form one conversation with a null id; roles with
other initials can be reroled or deleted; texts of any length are only hashed
and matched in the JVM or streamed; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import WORD, id_key, saved, text_batches

#: Turns of one part of a signature.
PART = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after s, after u, after a.
STATES = 4
_FAR = 1 << 40
#: Role that an inserted or reroled turn gets in a state, and the state after it.
_ROLE = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: State after a kept turn with this initial.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: The end: turns still to be inserted.
_END = ((0, ""), (10, "II"), (5, "I"), (0, ""))
END = ",".join(str(c) for c, _ in _END)
#: Symbols: initials of sound turns, capitals for truncated ones, x for those that must go.
GONE = "x"


def damaged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, copies) of ``conversations`` after the damage of the contract."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    return rows.select(
        id_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).filter(F.col("kind") != 0).withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1)).drop("kind")


def hashed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("h", F.unhex(F.sha2("text", 256)))


def symbols(turns: DataFrame) -> DataFrame:
    """(key, turn, role, h, copy, fault, symbol) of every turn; narrow rows."""
    blank = ~F.col("text").rlike(WORD)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = hashed(turns).select("key", "turn", "role", "h", blank.alias("blank"), cut.alias("cut"), "copies")
    rows = saved(rows.groupBy("key", "turn", "role", "h", "blank", "cut").agg(F.sum("copies").alias("copies")), "chat-repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.filter(~F.col("blank")).groupBy("key", "role", "h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    same = (F.col("key") == F.col("k")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    rows = rows.join(again, same, "left").withColumn("later", F.coalesce(F.col("first") != place, F.lit(False)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("later") | (F.col("copy") > 1), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.withColumn("fault", fault).select("key", "turn", "role", "h", "copy", "fault", initial.alias("initial"), symbol.alias("symbol"))


def _order(*more) -> list:
    """How turns follow each other."""
    return [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), *more]


def parts(rows: DataFrame, size: int = PART) -> DataFrame:
    """(key, range, part, signature, turn, role, h of the first turn, illegal
    pairs inside, first and last initial): signatures of at most ``size`` turns."""
    columns = ["key", "range", "part", "signature", "turn", "role", "h", "illegal", "first", "last"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, part = TaskContext.get().partitionId(), 0
        done, held, head, wrong, before, first = [], [], None, 0, "", ""

        def close():
            done.append((head[0], where, part, "".join(held), head[1], head[2], head[3], wrong, first, before))

        for batch in batches:
            for key, turn, role, h, initial, symbol in zip(*(batch[c] for c in ("key", "turn", "role", "h", "initial", "symbol"))):
                if held and (key != head[0] or len(held) == size):
                    close()
                    part, held, wrong = part + 1, [], 0
                if not held:
                    head, first = (key, turn, role, h), initial
                elif before + initial not in ("su", "ua", "au"):
                    wrong += 1
                before = initial
                held.append(symbol)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if held:
            close()
            yield pd.DataFrame(done, columns=columns)

    order = _order(F.col("copy"))
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.select("key", F.col("turn").cast("string").alias("turn"), "role", "h", "initial", "symbol")
    schema = "key string, range int, part long, signature string, turn string, role string, h binary, illegal long, first string, last string"
    return spread.mapInPandas(cut, schema)


class Node:
    """One suffix: per grammar state the cost-to-go, the best audit and the state at its end."""

    __slots__ = ("cost", "audit", "exit")

    def __init__(self, cost: list[int], audit: list[str], exit: list[int]):
        self.cost, self.audit, self.exit = cost, audit, exit


def terminal(costs: str) -> Node:
    """The node of the empty suffix: what the following parts cost from each state."""
    return Node([int(c) for c in costs.split(",")], [""] * STATES, list(range(STATES)))


def before(symbol: str, rest: Node) -> Node:
    """The node of ``symbol`` followed by ``rest``."""
    kept, extra = _KEPT.get(symbol.lower(), {}), TRUNCATED if symbol.isupper() else 0
    cost, audit, last = [0] * STATES, [""] * STATES, [0] * STATES
    for q in range(STATES):
        best = (DELETE + rest.cost[q], "D", q)
        if symbol != GONE:
            if q in kept:
                best = min(best, (KEEP + extra + rest.cost[kept[q]], "K", kept[q]))
            best = min(best, (REROLE + extra + rest.cost[_NEXT[q]], "R", _NEXT[q]))
        cost[q], audit[q], last[q] = best[0], best[1] + rest.audit[best[2]], rest.exit[best[2]]
    plain = list(zip(cost, audit, last))
    # insertions lead to states 2 and 3 only; of these two at most one can gain by another one
    for q in (2, 3, 0, 1):
        c, a, e = (cost[_NEXT[q]], audit[_NEXT[q]], last[_NEXT[q]]) if q < 2 else plain[_NEXT[q]]
        if (INSERT + c, "I") < (cost[q], audit[q][:1]):
            cost[q], audit[q], last[q] = INSERT + c, "I" + a, e
    return Node([min(c, _FAR) for c in cost], audit, last)


def automaton(signatures: Iterator[str], costs: str) -> Iterator[tuple[str, Node, int]]:
    """(signature, its node, nodes made for it) of distinct signatures in the
    order of their reversals; a shared suffix is computed once."""
    stack, latest = [terminal(costs)], ""
    for signature in signatures:
        backwards = signature[::-1]
        same = 0
        while same < min(len(latest), len(backwards)) and latest[same] == backwards[same]:
            same += 1
        del stack[same + 1:]
        for symbol in backwards[same:]:
            stack.append(before(symbol, stack[-1]))
        latest = backwards
        yield signature, stack[-1], len(backwards) - same


def solved(wanted: DataFrame) -> DataFrame:
    """(signature, costs, cost, audit, exit) with one entry per grammar state,
    for distinct (signature, costs)."""
    columns = ["signature", "costs", "cost", "audit", "exit"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, feed, nodes = None, None, None
        for batch in batches:
            rows = []
            for signature, costs in zip(batch["signature"], batch["costs"]):
                if costs != now:  # an automaton per vector; it goes on from batch to batch
                    now, (feed, nodes) = costs, _fed(costs)
                feed.append(signature)
                _, node, _ = next(nodes)
                rows.append((signature, costs, node.cost, node.audit, node.exit))
            yield pd.DataFrame(rows, columns=columns)

    spread = wanted.select("signature", "costs").distinct().withColumn("backwards", F.reverse("signature"))
    spread = spread.repartitionByRange("backwards", "costs").sortWithinPartitions("costs", "backwards").select("signature", "costs")
    return spread.mapInPandas(solve, "signature string, costs string, cost array<long>, audit array<string>, exit array<int>")


def _fed(costs: str) -> tuple[deque, Iterator]:
    feed: deque = deque()

    def pulled():
        while True:
            yield feed.popleft()

    return feed, automaton(pulled(), costs)


def _vector(costs) -> str:
    """Costs per state, less their least."""
    least = min(costs)
    return ",".join(str(_FAR if c >= _FAR else c - least) for c in costs)


#: One part that ends in one state: the rows of a cost matrix.
UNITS = [",".join(str(0 if p == q else _FAR) for p in range(STATES)) for q in range(STATES)]


def audits(cuts: DataFrame) -> DataFrame:
    """(key, range, part, entry, cost, audit): the grammar state at the start of
    each part, and what the part's edits are and cost."""
    place = ["key", "range", "part"]
    cuts = cuts.select(*place, "signature")
    many = cuts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    long_ones, short_ones = cuts.join(many, "key", "left_semi"), cuts.join(many, "key", "left_anti")
    units = long_ones.select("signature").distinct().withColumn("costs", F.explode(F.array(*map(F.lit, UNITS))))
    matrix = solved(units).groupBy("signature").agg(F.map_from_entries(F.collect_list(F.struct("costs", "cost"))).alias("m"))
    matrix = matrix.select("signature", F.array(*[F.col("m")[u] for u in UNITS]).alias("matrix"))  # by final, then first state

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, costs = None, []
        for batch in batches:
            rows = []
            for key, m in zip(batch["key"], batch["matrix"]):
                final = key != now
                if final:
                    now, costs = key, [c for c, _ in _END]
                rows.append((_vector(costs), final))
                costs = [min(min(int(m[q][p]) + costs[q] for q in range(STATES)), _FAR) for p in range(STATES)]
                least = min(costs)
                costs = [c if c >= _FAR else c - least for c in costs]
            yield batch.drop(columns="matrix").assign(costs=[c for c, _ in rows], final=[f for _, f in rows])

    def forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, 0
        for batch in batches:
            rows = []
            for key, final, costs, cost, audit, last in zip(*(batch[c] for c in ("key", "final", "costs", "cost", "audit", "exit"))):
                if key != now:
                    now, state = key, 0
                at_end = int(last[state])
                paid, more = _END[at_end] if final else (0, "")
                rows.append((state, int(cost[state]) - int(costs.split(",")[at_end]) + paid, audit[state] + more))
                state = at_end
            yield batch[place].assign(entry=[r[0] for r in rows], cost=[r[1] for r in rows], audit=[r[2] for r in rows])

    tail = long_ones.join(matrix, "signature").select(*place, "signature", "matrix")
    tail = tail.repartition("key").sortWithinPartitions("key", F.col("range").desc(), F.col("part").desc())
    vectors = tail.mapInPandas(backwards, "key string, range int, part long, signature string, costs string, final boolean")
    vectors = vectors.unionByName(short_ones.withColumns({"costs": F.lit(END), "final": F.lit(True)}))
    vectors = saved(vectors, "chat-repair-vectors")
    joined = vectors.join(solved(vectors), ["signature", "costs"]).select(*place, "final", "costs", "cost", "audit", "exit")
    joined = joined.repartition("key").sortWithinPartitions(*place)
    return joined.mapInPandas(forwards, "key string, range int, part long, entry int, cost long, audit string")


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(key, edit, role, text) of the turns of repaired conversations, a list
    per batch. In ``batches`` each part's audit comes before its turns; a turn
    that goes has no role."""
    now, state, at, audit, queue = None, 0, 0, "", deque()

    def ending():
        nonlocal state, at
        while at < len(audit):  # only insertions are left
            yield now, "I", _ROLE[state], ""
            state, at = _NEXT[state], at + 1

    for batch in batches:
        rows = []
        for key, kind, role, text, copies, entry, edits in zip(*(batch[c] for c in ("key", "kind", "role", "text", "copies", "entry", "audit"))):
            if key != now:
                rows.extend(ending())
                now, state, at, audit = key, 0, 0, ""
            if kind == 0:
                queue.append((entry, edits))
                continue
            for _ in range(int(copies)):
                edit = "I"
                while edit == "I":
                    if at == len(audit):
                        (state, audit), at = queue.popleft(), 0
                        state = int(state)
                    edit, at = audit[at], at + 1
                    if edit == "I":
                        rows.append((now, edit, _ROLE[state], ""))
                        state = _NEXT[state]
                if edit == "K":
                    rows.append((now, edit, role, text))
                    state = _KEPT[role[0]][state]
                elif edit == "R":
                    rows.append((now, edit, _ROLE[state], text))
                    state = _NEXT[state]
        yield rows
    yield list(ending())


def _stream(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns and their parts' audits, one conversation after the other."""
    own = turns.select("key", "turn", "role", "h", F.lit(1).alias("kind"), "text", "copies")
    audits_ = found.select("key", F.col("turn").cast("long").alias("turn"), "role", "h", F.lit(0).alias("kind"), "range", "part", "entry", "audit")
    both = own.unionByName(audits_, allowMissingColumns=True)
    both = both.repartition("key").sortWithinPartitions(*_order(F.col("kind"), F.col("range"), F.col("part")))
    return both.select("key", "kind", "role", "text", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("entry", F.lit(0)).alias("entry"), "audit")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(key, place, edit, role, text) of all turns that stay or come in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place = None, 0
        for rows in _edited(batches):
            numbered = []
            for key, edit, role, text in rows:
                now, place = key, place + 1 if key == now else 1
                numbered.append((key, place, edit, role, text))
            if numbered:
                yield pd.DataFrame(numbered, columns=["key", "place", "edit", "role", "text"])

    return _stream(turns, found).mapInPandas(run, "key string, place long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of conversations that keep a turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for rows in _edited(batches):
            done = []
            for key, _, role, text in rows:
                if key != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["key", "repaired_sha256"])

    return _stream(turns, found).mapInPandas(run, "key string, repaired_sha256 string")


def repaired(turns: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turn symbols, parts with their audits, turns with digests) of ``turns``
    (key, turn, role, text, copies)."""
    text_batches(turns.sparkSession)
    rows = saved(symbols(turns), "chat-repair-symbols")
    cuts = saved(parts(rows, part), "chat-repair-parts")
    found = saved(cuts.join(audits(cuts), ["key", "range", "part"]), "chat-repair-audits")
    return rows, found, hashed(turns)


_LEGAL = ("su", "ua", "au")


def report(conversations: DataFrame, part: int = PART) -> DataFrame:
    """What the contract asks of every conversation, after its damage."""
    rows, found, turns = repaired(damaged(conversations), part)

    def number(fault: str) -> Column:
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)

    counts = rows.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *map(number, ("blank", "duplicate", "truncated"))
    )
    # one entry per part; a row holds the whole audit anyway
    chain = F.array_sort(F.collect_list(F.struct("range", "part", "first", "last", "audit")))
    whole = found.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("inside"), chain.alias("chain"))
    n = F.size("chain") - 1
    seams = F.zip_with(F.slice("chain", 1, n), F.slice("chain", 2, n), lambda a, b: F.concat(a["last"], b["first"]))
    whole = whole.select(
        "key", "cost", (F.col("inside") + F.size(F.filter(seams, lambda s: ~s.isin(*_LEGAL)))).alias("illegal"),
        F.array_join(F.transform("chain", lambda c: c["audit"]), "").alias("audit"),
    )
    out = conversations.select(id_key("conv_id").alias("key")).distinct()
    for more in (counts, whole, repaired_digests(turns, found)):
        out = out.join(more, "key", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select(
        F.when(F.col("key") != "null", F.col("key").cast("long")).alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
