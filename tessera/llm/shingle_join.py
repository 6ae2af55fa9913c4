"""Near-duplicate groups by the Jaccard similarity of word shingles, without loss.

A document is the set of its five-word shingles (64-bit hashes). Two sets of
similarity ``t`` or more share one of the first n - ceil(t * n) + 1 shingles of
each, whatever the common order of all shingles is. So each document is listed
under these first shingles only, documents that share one are candidates, and
candidates are verified on their complete sets. The order puts shingles that
occur often in a sample last, so that a common passage seldom makes candidates;
the sample has no influence on the result.

All documents under a shingle are first compared with its least document. Only
pairs that the links found so far leave in different components are listed
then, each at the first shingle that its documents share (as far as their first
``LEAD`` shingles tell), so a large group of copies costs little and no link is
lost. What remains quadratic are many documents that share most of their shingles and are still
less similar than ``t``.

Most shingles are in one document only. A narrow count of shortened hashes
finds the others, and a bitmap of fixed size keeps their rows alone for the
wide shuffles. Pairs are dropped if sketches of parity bits differ in more
bits than similar sets differ in shingles: first sketches of 512 bits, then ones
of two to four bits a shingle, which tell long texts apart too. For the comparison each text goes once per partner to the side
of the lesser document, whose partners are dealt to parts of bounded number;
shingle sets live in the task that compares and are not written. In the end only
texts of rows that are not alone in their group, or may be, are moved.

Defined cases: a null text counts as empty; texts without a word are alike;
shorter texts than a shingle are one shingle of all their words; repeated
shingles count once; repeated rows and null identifiers are grouped like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tessera.llm import simhash_mih
from tessera.llm.common import id_key, saved, text_batches, whole, worker_cache
from tessera.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Partners of one document that one part compares with it, about.
PARTNERS = 256
#: First shingles of a document that tell whether a pair has met before.
LEAD = 8
#: Texts of the sample, and how many of them a frequent shingle is in.
SAMPLE, OFTEN, MOST_OFTEN = 10_000, 4, 500_000


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct hashes of the word shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + width]), SEED) for i in range(n)), np.uint64, n).view(np.int64))


def first_shingles(found: np.ndarray, often: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Those of which a set of at least ``similarity`` shares one; frequent ones last."""
    if not len(found):
        return found
    if len(often):
        late = often[np.minimum(np.searchsorted(often, found), len(often) - 1)] == found
        found = np.concatenate((found[~late], found[late]))
    return found[:len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def _sets(width: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache("shingles", object)
        for texts in batches:
            yield pd.Series([shingles(t, width) for t in texts], dtype=object)

    return sets


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles of several texts of a sample, sorted. They steer the order only."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).dropDuplicates(["h"])
    counts = sample.select(F.explode(_sets(width)("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(np.array([r["s"] for r in counts.orderBy(F.desc("n"), "s").limit(MOST_OFTEN).select("s").collect()], np.int64))


_LISTED = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("first", T.ArrayType(T.LongType())),
    T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("wide", T.ArrayType(T.LongType())),
])
#: 64-bit words of a sketch, and of a wide one at most.
_WORDS, _MOST_WORDS = 8, 1 << 10


def sketch(found: np.ndarray) -> np.ndarray:
    """One parity bit per share of the hashes: two sets differ in at least as
    many shingles as their sketches in bits."""
    bits = np.bincount((found.view(np.uint64) >> np.uint64(55)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(found: np.ndarray) -> np.ndarray:
    """A sketch of two to four bits a shingle, by the low bits of the hashes: half
    of one, added to its other half, is the sketch of half as many bits."""
    bits = 64 * min(_MOST_WORDS, 1 << max(0, (2 * len(found) - 1) // 64).bit_length())
    odd = np.bincount((found.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _listed(spark, often: np.ndarray, width: int, similarity: float):
    shared = spark.sparkContext.broadcast(often.tobytes())

    @F.pandas_udf(_LISTED)
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache("shingles", object)
        order = np.frombuffer(shared.value, np.int64)
        for texts in batches:
            rows = []
            for text in texts:
                found = shingles(text, width)
                name = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))
                rows.append((name, len(found), first_shingles(found, order, similarity), sketch(found), wide_sketch(found)))
            yield pd.DataFrame(rows, columns=["doc", "n", "first", "sketch", "wide"])

    return listed


#: Bits of the maps of shared shingles (16 MB), of wanted texts (512 KB) and of rows in doubt (2 MB).
_SHARED_BITS, _WANTED_BITS, _DOUBT_BITS = 1 << 27, 1 << 22, 1 << 24


def _maybe(rows: DataFrame, column: str, wanted: DataFrame, bits: int, there: bool = True) -> DataFrame:
    """Rows whose ``column`` may be among ``wanted``, by a bitmap of fixed size; none of those is lost.
    Not ``there``: all other rows, none of which is among them."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    b = wanted.select(bit(F.col(column)).alias("b"))
    bitmap = b.groupBy((F.col("b") / 32768).cast("int").alias("__part")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("__bitmap"))
    how = "inner" if there else "left"
    out = rows.withColumns({"__part": (bit(F.col(column)) / 32768).cast("int"), "__bit": (bit(F.col(column)) % 32768).cast("int")}).join(F.broadcast(bitmap), "__part", how)
    byte = F.coalesce(F.conv(F.hex(F.expr("substring(__bitmap, __bit div 8 + 1, 1)")), 16, 10).cast("int"), F.lit(0))
    return out.withColumn("__byte", byte).filter(F.expr("shiftright(__byte, __bit % 8) & 1") == int(there)).select(*rows.columns)


def _may_reach(a: str, b: str, similarity: float) -> Column:
    """Whether two sets that first meet at these places can be similar enough."""
    na, nb, pa, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    return F.least(na - pa, nb - pb) * (1 + similarity) >= similarity * (na + nb) - 1e-6


def _possible(pairs: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule the similarity out."""
    for x in ("a", "b"):
        pairs = pairs.join(names.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")).hint("merge"), x)
    return pairs.filter(_near("sa", "sb", F.col("na") + F.col("nb"), similarity)).select("a", "b")


def _near(a: str, b: str, both: Column, similarity: float) -> Column:
    """Whether two sketches of sets of ``both`` shingles in all allow the similarity."""
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(_WORDS)])
    return _within(apart, both, similarity)


def _within(apart: Column, both: Column, similarity: float) -> Column:
    return apart * (1 + similarity) <= both * (1 - similarity) + 1e-6


def _wide_near(a: str, b: str, both: Column, similarity: float) -> Column:
    """The same by wide sketches; the wider one is folded once."""
    words = F.least(F.size(a), F.size(b))
    upper = lambda x, k: F.when(F.size(x) > words, F.col(x)[k + words]).otherwise(F.lit(0).cast("long"))
    word = lambda k: F.col(a)[k].bitwiseXOR(F.col(b)[k]).bitwiseXOR(upper(a, k)).bitwiseXOR(upper(b, k))
    apart = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda total, k: total + F.bit_count(word(k)))
    return (F.greatest(F.size(a), F.size(b)) > 2 * words) | _within(apart, both, similarity)


def _close(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose wide sketches do not rule the similarity out. ``sets``
    has (doc, n, wide), repeats allowed; only those of documents in pairs are moved."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    known = _maybe(sets, "doc", wanted, _WANTED_BITS).groupBy("doc").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
    for x in ("a", "b"):
        pairs = pairs.join(known.toDF(x, f"n{x}", f"w{x}").hint("merge"), x)
    return pairs.filter(_wide_near("wa", "wb", F.col("na") + F.col("nb"), similarity)).select("a", "b")


def _compare(width: int, similarity: float):
    """Each part's first row is the document that the others are compared with."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for batch in batches:
            found = []
            for a, part, doc, text in zip(batch["a"], batch["part"], batch["doc"], batch["text"]):
                s = shingles(text, width)
                if (a, part) != now:
                    now, own = (a, part), s
                    continue
                shared = len(np.intersect1d(own, s, assume_unique=True))
                if shared >= similarity * (len(own) + len(s) - shared) - 1e-9:
                    found.append((a, doc))
            yield pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return run


def _verified(pairs: DataFrame, texts: DataFrame, names: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose complete sets are similar enough, as (src, dst)."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(names.hint("merge"), "doc").select("doc", "h"), "shingle-wanted")
    found = _maybe(texts, "h", wanted, _WANTED_BITS).join(wanted.hint("merge"), "h").groupBy("h").agg(F.min("doc").alias("doc"), F.min("text").alias("text"))
    found = saved(found.select("doc", "text"), "shingle-texts")
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    partners = pairs.join(load.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("turn"), F.col("b").alias("doc"))
    heads = load.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), F.col("a").alias("doc"))
    rows = partners.unionByName(heads).join(found.hint("merge"), "doc").repartition("a", "part").sortWithinPartitions("a", "part", "turn", "doc")
    return rows.select("a", "part", "doc", "text").mapInPandas(_compare(width, similarity), "src long, dst long")


def links(listed: DataFrame, texts: DataFrame, names: DataFrame, width: int, similarity: float) -> DataFrame:
    """(src, dst): edges whose components are those of all pairs that are similar
    enough. ``listed`` has (doc, n, first, wide) of every set, repeats allowed,
    ``texts`` (h, text), ``names`` (doc, h, n, sketch, lead): one text per set."""
    places = listed.select("doc", "n", F.posexplode("first").alias("pos", "s"))
    short = F.shiftrightunsigned("s", 24)  # enough to tell single shingles; others come along and do no harm
    counts = places.select(short.alias("short")).groupBy("short").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("short")
    places = _maybe(places.withColumn("short", short), "short", counts, _SHARED_BITS).select("doc", "n", "pos", "s")
    places = saved(places, "shingle-places")
    least = places.groupBy("s").agg(F.min(F.struct("doc", "n", "pos")).alias("x"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("c"))
    shared = places.join(least.filter("x.doc != high").hint("merge"), "s").filter("x.doc != doc")
    shared = saved(shared.select("s", "c", "x", F.struct("doc", "n", "pos").alias("y")), "shingle-shared")
    pairs = shared.filter(_may_reach("x", "y", similarity)).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    pairs = saved(_possible(pairs, names, similarity), "shingle-pairs")
    near = saved(_close(pairs, listed.select("doc", "n", "wide"), similarity), "shingle-near")
    edges = saved(_verified(near, texts, names, width, similarity), "shingle-edges")
    # shingles whose documents are still in different components
    known = connected_components(edges).withColumnRenamed("node", "doc")
    others = shared.filter("c > 2")  # the least document has met all of them, so two are done
    rows = others.select("s", "y.*").join(known.hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rows = saved(rows, "shingle-components")
    mixed = rows.groupBy("s").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("s")
    rows = rows.join(mixed.hint("merge"), "s").distinct().join(names.select("doc", "sketch", "lead").hint("merge"), "doc")
    rows = saved(rows.withColumn("lead", F.expr("slice(lead, 1, pos)")), "shingle-mixed")
    # a pair that shares an earlier shingle meets there
    met = rows.alias("x").join(rows.alias("y").hint("merge"), "s").filter(
        (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component")) & _may_reach("x", "y", similarity)
        & _near("x.sketch", "y.sketch", F.col("x.n") + F.col("y.n"), similarity) & ~F.arrays_overlap("x.lead", "y.lead")
    )
    rest = met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti")
    rest = saved(_close(saved(rest, "shingle-rest"), listed.select("doc", "n", "wide"), similarity), "shingle-rest-near")
    return edges.unionByName(_verified(rest, texts, names, width, similarity))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) per row of ``docs``; the component is its least identifier."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text")).withColumn("h", F.xxhash64("text"))
    often = _frequent(texts.select("h", "text"), width)
    out = texts.withColumn("r", _listed(docs.sparkSession, often, width, similarity)("text")).select("id", "h", "r.*")
    out = saved(out, "shingle-listed")
    by_set = out.groupBy("doc").agg(F.min("id").alias("least"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
                                    F.first(F.slice("first", 1, LEAD)).alias("lead"))
    by_set = saved(by_set, "shingle-documents")
    edges = links(out.select("doc", "n", "first", "wide"), texts.select("h", "text"), by_set.select("doc", "h", "n", "sketch", "lead"), width, similarity)
    found = connected_components(edges).withColumnRenamed("node", "doc")
    root = by_set.join(found.hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    least = root.groupBy("component").agg(F.min("least").alias("component_id"))
    named = root.select("doc", "component").join(least.hint("merge"), "component").select("doc", "component_id")
    return out.select("id", "doc").join(named.hint("merge"), "doc").select("id", "component_id")


def joint_groups(picks: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) of ``picks`` (pick, text): components of the links by
    SimHash and multi-index hashing and of those between complete sets together.
    ``pick`` has the fields id and __h."""
    name = lambda c: F.concat_ws(":", id_key(f"{c}.id"), F.col(f"{c}.__h").cast("string"))
    by_bits = simhash_mih.groups(picks, "text", "pick", shingle=width).select(name("id").alias("key"), name("component_id").alias("src"))
    by_sets = groups(picks, "text", "pick", width, similarity).select("id", "component_id", name("id").alias("key"), name("component_id").alias("set"))
    by_bits, by_sets = saved(by_bits.distinct(), "near-bits"), saved(by_sets.distinct(), "near-sets")
    # a component is a node of the links between both kinds; each is named by its least row
    edges = by_sets.select("key", "set").join(by_bits.hint("merge"), "key").select("src", F.col("set").alias("dst")).distinct()
    joint = connected_components(edges).select(F.col("node").alias("set"), "component")
    rows = by_sets.join(joint.hint("merge"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = rows.groupBy("component").agg(F.min("component_id").alias("component_id"))
    return rows.select("id", "component").join(least.hint("merge"), "component").select("id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` per group, with the columns of ``docs`` only: the
    one with the least identifier (a null one last), then the least text hash."""
    rows = docs.withColumns({"__h": F.xxhash64(whole(text)), "__key": id_key(doc_id)})
    picks = rows.select(F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), "__h").alias("pick"), whole(text).alias("text"))
    kept = joint_groups(picks, width, similarity).groupBy("component_id").agg(F.min("id").alias("pick")).select(
        id_key("pick.id").alias("__key"), F.col("pick.__h").alias("__h")
    )
    kept = saved(kept, "shingle-kept")
    # the text of a row that is kept and not repeated stays where it is
    count = rows.groupBy("__key", "__h").agg(F.count(F.lit(1)).alias("__n")).join(kept.withColumn("__kept", F.lit(True)).hint("merge"), ["__key", "__h"], "left")
    spot = F.xxhash64("__key", "__h")
    doubt = saved(count.filter("__n > 1 OR __kept IS NULL").select(spot.alias("__spot")), "shingle-doubt")
    rows = rows.withColumn("__spot", spot)
    at = F.row_number().over(Window.partitionBy("__key", "__h").orderBy(F.lit(1)))
    again = _maybe(rows, "__spot", doubt, _DOUBT_BITS).join(kept.hint("merge"), ["__key", "__h"]).withColumn("__at", at).filter("__at = 1")
    return _maybe(rows, "__spot", doubt, _DOUBT_BITS, False).select(*docs.columns).unionByName(again.select(*docs.columns))
