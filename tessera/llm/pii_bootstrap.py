"""Personal data: base patterns, and unseen identifiers by bootstrapped context.

Base spans (e-mail, IP, card, phone) come from fixed rules and always stay.
They seed the bootstrap: the two words before and after each span are lexical
patterns. Patterns that at least ``SUPPORT`` different seeds share are counted
over the whole corpus: how often each occurs, and which identifier-like runs of
words fill its slot. Spark then scores the graph of patterns and instances until
it settles: a pattern scores the share of its occurrences that hold trusted
instances, an instance the noisy-or of the patterns that hold it. What fills
slots of patterns of at least ``PATTERN_SCORE``, itself at ``INSTANCE_SCORE`` or
above, is a new span of the pattern's kind. Wherever else such an instance
stands, as one word or as a whole run, its contexts count like those of a seed
in the next turn; turns end when they bring no new pattern.

A slot holds one word, or the run of words with a digit or an @ that starts
there; a run ends where a base span begins.

Which contexts matter is told to the second scan by a bitmap of fixed size;
what passes it by chance is dropped by an exact join. Graph and counts stay
in Spark.

Defined cases: a null text counts as empty; texts are read whole and the rules
take time in proportion to their length; repeated rows have equal spans; a
pattern needs different instances, so copies of one text make none; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.llm.common import documents, id_key, saved, text_batches, whole, worker_cache
from tessera.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SUPPORT, EPSILON, PATTERN_SCORE, INSTANCE_SCORE = 3, 1e-6, 0.8, 0.9
#: How far below its fixed point a score may be when it has settled.
_NEAR = 1e-5
_BITS = 1 << 22
_REMEMBERED = 500_000
# Fixed rules, written so that no part of a text is read again and again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order of start, then kind as listed."""
    found = []
    done = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


class _Hashes(dict):
    """Hashes of lower-case words; bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        return h


def _mixed(two: np.ndarray, near: np.ndarray, side: int) -> np.ndarray:
    """Bit numbers of contexts from the hashes of their words."""
    x = two * np.uint64(0x9E3779B97F4A7C15) + near * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(side)
    return (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)


def identifier_like(word: str) -> bool:
    return len(word) >= 6 and bears(word)


def bears(word: str) -> bool:
    """Whether the word may be a part of an identifier."""
    return "@" in word or any("0" <= c <= "9" for c in word)


def free_words(text: str, words: list[str], places: list[tuple[int, int]]) -> list[bool]:
    """Per word whether it may be a part of an unseen identifier: it bears a digit or @ and no base span covers it."""
    base, at = sorted((a, b) for a, _, b in base_spans(text)), 0
    out, end = [], -1  # ``end`` of the spans that begin before the word's end
    for word, (a, b) in zip(words, places):
        while at < len(base) and base[at][0] < b:
            end, at = max(end, base[at][1]), at + 1
        out.append(end <= a and bears(word))
    return out


def _runs(free: list[bool]) -> tuple[list[int], list[int]]:
    """Per word the first and the last of its run."""
    first, last = list(range(len(free))), list(range(len(free)))
    for i in range(1, len(free)):
        if free[i] and free[i - 1]:
            first[i] = first[i - 1]
    for i in range(len(free) - 2, -1, -1):
        if free[i] and free[i + 1]:
            last[i] = last[i + 1]
    return first, last


_SEED = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("side", T.StringType()), T.StructField("context", T.StringType()),
    T.StructField("bit", T.IntegerType()), T.StructField("instance", T.StringType()),
])
_BASE = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("spans", T.ArrayType(T.StringType())),
    T.StructField("base_sha256", T.StringType()), T.StructField("seeds", T.ArrayType(_SEED)),
])


_SIDES = (("L", -1), ("R", 1))


def _seeds(text: str, spans: list[tuple[int, str, int]], hashes: _Hashes) -> list[dict]:
    """Patterns around the spans: the two words before and the two after."""
    words, starts = [], []
    for m in _WORD.finditer(text):
        words.append(m.group())
        starts.append(m.start())
    out = []
    first, last = np.searchsorted(starts, [s[0] for s in spans], side="right") - 1, np.searchsorted(starts, [s[2] for s in spans], side="left") - 1
    for (a, kind, b), i, j in zip(spans, first.tolist(), last.tolist()):
        for n, (side, step) in enumerate(_SIDES):
            near, two = (i - 1, i - 2) if step < 0 else (j + 1, j + 2)
            if 0 <= two < len(words):
                bit = _mixed(*(np.array([hashes[words[x]]], np.uint64) for x in (two, near)), n)
                out.append({"kind": kind, "side": side, "context": f"{words[two].lower()} {words[near].lower()}", "bit": int(bit[0]), "instance": text[a:b]})
    return out


@F.pandas_udf(_BASE)
def _base(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = worker_cache("pii", _Hashes)
    for texts in batches:
        rows = []
        for text in texts:
            spans = base_spans(text)
            counts = Counter(k for _, k, _ in spans)
            names = [f"{k}:{a}:{b}" for a, k, b in spans]
            rows.append((*(counts[k] for k in KINDS), names, hashlib.sha256(",".join(names).encode()).hexdigest(), _seeds(text, spans, hashes) if spans else []))
        yield pd.DataFrame(rows, columns=[f.name for f in _BASE.fields])


def _bitmap(rows: DataFrame) -> bytes:
    """The set of bit numbers, one bit each; of fixed size however many rows there are."""
    words = rows.groupBy((F.col("bit") / 32).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int"))).alias("bits")
    ).collect()  # at most _BITS / 32
    out = np.zeros(_BITS // 32, np.uint32)
    for r in words:
        out[r["at"]] = r["bits"]
    return out.tobytes()


#: A row tells how often a pattern occurred (``n``), or a place of an instance.
_SLOTS = "key string, h long, side string, context string, n long, instance string, start int, end int"
_COUNTED = 100_000


def slots(text: str, hashes: _Hashes, wanted: np.ndarray, counts: Counter) -> list[tuple[str, str, str, int, int]]:
    """Adds up in ``counts`` how often each wanted pattern occurs; returns the
    identifier-like words in slots that no base span covers."""
    words = _WORD.findall(text)
    if len(words) < 3:
        return []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hits = []
    for n, (side, step) in enumerate(_SIDES):
        outer, slot = (0, 2) if step < 0 else (2, 0)
        two = h[:-2] if step < 0 else h[2:]
        for at in np.nonzero(wanted[_mixed(two, h[1:-1], n)])[0].tolist():
            context = f"{words[at + outer].lower()} {words[at + 1].lower()}"
            counts[side, context] += 1
            if bears(words[at + slot]):
                hits.append((side, context, at + slot))
    found = []
    if hits:
        places = [m.span() for m in _WORD.finditer(text)]
        free = free_words(text, words, places)
        first, last = _runs(free)
        for side, context, slot in hits:
            if free[slot]:
                i, j = (slot, last[slot]) if side == "L" else (first[slot], slot)
                unit = " ".join(words[i:j + 1])
                if identifier_like(unit):
                    found.append((side, context, unit, places[i][0], places[j][1]))
    return found


def _name(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "surrogatepass")) % _BITS


_OCCURS = "side string, context string, bit int, instance string"


def occurrences(text: str, hashes: _Hashes, wanted: np.ndarray) -> list[tuple[str, str, int, str]]:
    """Contexts of the words and whole runs that may be among the wanted instances."""
    words = _WORD.findall(text)
    if len(words) < 3 or not any(map(bears, words)):
        return []
    free = free_words(text, words, [m.span() for m in _WORD.finditer(text)])
    last = _runs(free)[1]
    out = []
    for i, own in enumerate(free):
        ends = ({i, last[i]} if not i or not free[i - 1] else {i}) if own else ()
        for j in ends:
            unit = " ".join(words[i:j + 1])
            if identifier_like(unit) and wanted[_name(unit)]:
                for n, (side, step) in enumerate(_SIDES):
                    near, two = (i - 1, i - 2) if step < 0 else (j + 1, j + 2)
                    if 0 <= two < len(words):
                        bit = _mixed(*(np.array([hashes[words[x]]], np.uint64) for x in (two, near)), n)
                        out.append((side, f"{words[two].lower()} {words[near].lower()}", int(bit[0]), unit))
    return out


def _slots(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often patterns occur and what fills their slots, as in ``_SLOTS``."""
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(patterns))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, wanted = worker_cache("pii", _Hashes), np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        names = ["key", "h", "side", "context", "n", "instance", "start", "end"]
        counts: Counter = Counter()

        def counted() -> pd.DataFrame:
            out = pd.DataFrame([(None, None, side, context, n, None, None, None) for (side, context), n in counts.items()], columns=names)
            counts.clear()
            return out

        for batch in batches:
            found = []
            for key, h, text in zip(batch["key"], batch["h"], batch["text"]):
                found += [(key, h, side, context, None, *place) for side, context, *place in slots(text, hashes, wanted, counts)]
            yield pd.DataFrame(found, columns=names)
            if len(counts) > _COUNTED:
                yield counted()
        yield counted()

    return saved(rows.select("key", "h", "text").mapInPandas(scan, _SLOTS), "pii-slots")


def _contexts(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """(kind, side, context, bit, instance): where trusted instances (kind, instance) stand."""
    named = trusted.select(F.pmod(F.crc32(F.col("instance").cast("binary")), F.lit(_BITS)).cast("int").alias("bit"))
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(named))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, wanted = worker_cache("pii", _Hashes), np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            yield pd.DataFrame([o for text in batch["text"] for o in occurrences(text, hashes, wanted)], columns=["side", "context", "bit", "instance"])

    return rows.select("text").mapInPandas(scan, _OCCURS).distinct().join(trusted.select("kind", "instance"), "instance")


def _settled(edges: DataFrame, known: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and trust of instances: the least fixed point, to ``epsilon``."""
    on = ["side", "context"]
    trusted = cut_lineage(edges.select("kind", "instance").distinct().withColumn("trust", F.lit(0.0)))
    while True:
        more = edges.join(trusted, ["kind", "instance"]).groupBy("kind", *on).agg(F.sum(F.col("n") * F.col("trust")).alias("more"))
        scores = known.join(more, ["kind", *on], "left").withColumn(
            "score", F.least(F.lit(1.0), (F.col("hits") + F.coalesce("more", F.lit(0.0))) / (F.col("total") + 1))
        )
        scores = cut_lineage(scores.select("kind", *on, "score"))
        good = scores.filter(F.col("score") >= 0.5)
        found = edges.join(good, ["kind", *on]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("now")
        )
        both = cut_lineage(trusted.join(found, ["kind", "instance"], "left").withColumn("now", F.coalesce("now", F.lit(0.0))))
        trusted = both.select("kind", "instance", F.col("now").alias("trust"))
        if (both.agg(F.max(F.abs(F.col("now") - F.col("trust")))).first()[0] or 0.0) <= epsilon:  # trust only ever rises
            return scores, trusted


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, epsilon: float = EPSILON) -> DataFrame:
    """One row per row of ``docs``: id, counts and digest of the base spans, ``spans`` (all), ``n_added``."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), id_key(doc_id).alias("key"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("text"))
    base = saved(rows.withColumn("r", _base("text")).select("id", "key", "h", "r.*"), "pii-base")
    seeds = base.select(F.explode("seeds").alias("s")).select("s.*")
    on = ["side", "context"]
    seeded = saved(seeds.groupBy("kind", *on, "bit", "instance").agg(F.count(F.lit(1)).alias("n")), "pii-seeded")
    more, before = None, -1
    while True:
        own = seeded if more is None else seeded.unionByName(more.withColumn("n", F.lit(0).cast("long")))
        patterns = saved(
            own.groupBy("kind", *on, "bit").agg(F.count_distinct("instance").alias("seeds"), F.sum("n").alias("hits")).filter(F.col("seeds") >= support), "pii-patterns",
        )
        n = patterns.count()
        if n <= before:  # patterns are only ever added
            break
        before = n
        seen = _slots(rows, patterns)
        total = seen.filter(F.col("instance").isNull()).groupBy(*on).agg(F.sum("n").alias("total"))
        known = saved(patterns.select("kind", *on, "hits").join(total, on), "pii-counted")
        places = seen.filter(F.col("instance").isNotNull()).drop("n")
        edges = saved(
            places.groupBy(*on, "instance").agg(F.count(F.lit(1)).alias("n")).join(known.select("kind", *on), on), "pii-edges"
        )
        scores, trusted = _settled(edges, known, epsilon)
        new = places.join(scores.filter(F.col("score") >= PATTERN_SCORE - _NEAR), on).join(
            trusted.filter(F.col("trust") >= INSTANCE_SCORE - _NEAR), ["kind", "instance"]
        )
        new = saved(new, "pii-new")
        held = new.select("kind", "instance").distinct()
        if held.isEmpty():
            break
        again = _contexts(rows, held)
        more = saved(again if more is None else more.unionByName(again.select(*more.columns)).distinct(), "pii-contexts")
    one = new.groupBy("key", "h", "start", "end").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    added = one.groupBy("key", "h").agg(F.collect_list(name).alias("added"))  # spans of one text
    out = base.drop("seeds").join(added, ["key", "h"], "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    part = lambda x, n: F.element_at(F.split(x, ":"), n)
    place = F.transform(F.concat("spans", "added"), lambda x: F.struct(
        part(x, 2).cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), part(x, 1)).alias("kind"), part(x, 3).cast("int").alias("end"), x.alias("name")
    ))
    spans = F.array_join(F.transform(F.array_sort(place), lambda x: x["name"]), ",")
    return out.select("id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.size("added").cast("long").alias("n_added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")
