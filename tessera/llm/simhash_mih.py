"""Near-duplicate groups by SimHash and multi-index hashing.

Fingerprints are computed in Arrow batches. Everything after works on distinct
fingerprints, so exact copies cost nothing. A fingerprint is split into two
32-bit segments. Two fingerprints at distance 2 or less either agree up to one
bit in the first segment, or agree fully in the second. So one table per
segment is probed with the Hamming ball of radius 1 around the first segment
and with the second segment itself, and complete distances are verified.

A segment value that more than ``bucket`` fingerprints share would yield too
many pairs. Fingerprints that probe such a bucket are linked another, equally
exact way: two fingerprints are at distance 2 or less exactly if some 64-bit
point is within one bit of both. Each goes to its 65 points, and each point has
at most 65 fingerprints, which are tied to the least of them. Pairs within a
group are never listed.

Defined cases: a null text counts as empty; texts without a word have
fingerprint 0, which links like any other; shorter texts than a shingle hash
the whole word sequence; repeated rows and null identifiers are grouped like
others (a null identifier names a group only if no other does).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from tessera.llm.common import documents, id_key, saved, text_batches, whole, worker_cache
from tessera.operators.graph import connected_components

SHINGLE = 3
SEED = 42
#: Fingerprints that may share a segment value before the other way is taken.
BUCKET = 64
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, as a signed 64-bit number."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[len(words) - n:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):  # long texts in pieces
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(shingle: int):
    @F.pandas_udf(T.LongType())
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache("simhash", object)
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return made


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row of ``docs``."""
    text_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("id"), _fingerprints(shingle)(whole(text)).alias("fp"))


def _segment(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _flips(bits: int, whole_ball: bool = True) -> Column:
    masks = ([0] if whole_ball else []) + [1 << b if b < 63 else -(1 << 63) for b in range(bits)]
    return F.array(*[F.lit(m).cast("long") for m in masks])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): edges whose connected components are those of all pairs of
    fingerprints ``fp`` at distance 2 or less. Each edge is itself such a pair
    or ties two fingerprints to a point that is within one bit of both.

    Spark sizes probes by the fingerprints they are exploded from, so joins here
    ask for a merge: none of these tables may go through the driver."""
    fp = F.col("fp")
    table = distinct.select(fp, F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), _segment(fp, 0).alias("val")), F.struct(F.lit(1).alias("seg"), _segment(fp, 1).alias("val"))
    )).alias("e")).select("e.seg", "e.val", "fp")
    probes = distinct.select(fp, F.explode(F.concat(
        F.transform(_flips(32), lambda m: F.struct(F.lit(0).alias("seg"), _segment(fp, 0).bitwiseXOR(m).alias("val"))),
        F.array(F.struct(F.lit(1).alias("seg"), _segment(fp, 1).alias("val"))),
    )).alias("e")).select("e.seg", "e.val", F.col("fp").alias("probe"))
    counts = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    own = (F.col("seg") == 1) | (F.col("val") == _segment(F.col("probe"), 0))
    found = saved(probes.join(counts.hint("merge"), ["seg", "val"]).filter(~own | (F.col("n") > 1)), "simhash-probes")
    # a pair is found from both ends; if the greater one's bucket is crowded, both ends probe it
    near = found.filter(F.col("n") <= bucket).join(table.hint("merge"), ["seg", "val"]).filter(
        (F.col("probe") < fp) & (F.bit_count(F.col("probe").bitwiseXOR(fp)) <= 2)
    ).select(F.col("probe").alias("src"), fp.alias("dst"))
    crowded = found.filter(F.col("n") > bucket).select(F.col("probe").alias("fp")).distinct()
    points = crowded.select(fp, F.explode(F.transform(_flips(64), lambda m: fp.bitwiseXOR(m))).alias("point"))
    tied = points.withColumn("least", F.min("fp").over(Window.partitionBy("point"))).filter("least != fp")
    return near.unionByName(tied.select(F.col("least").alias("src"), F.col("fp").alias("dst"))).distinct()


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; the component is its least identifier."""
    fps = saved(fingerprints(docs, text, doc_id, shingle), "simhash-fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    found = connected_components(links(distinct.select("fp"), bucket)).withColumnRenamed("node", "fp")
    root = distinct.join(found.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = root.groupBy("component").agg(F.min("least").alias("component_id"))
    named = root.select("fp", "component").join(least.hint("merge"), "component").select("fp", "component_id")
    return fps.join(named.hint("merge"), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` per group, with the columns of ``docs`` only: the
    one with the least identifier (a null one last), then the least text hash."""
    rows = docs.withColumns({"__h": F.xxhash64(whole(text)), "__key": id_key(doc_id)})
    fps = rows.select(F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), "__h").alias("pick"), whole(text).alias("text"))
    members = groups(fps, "text", "pick")
    kept = members.groupBy("component_id").agg(F.min("id").alias("pick")).select(
        id_key("pick.id").alias("__key"), F.col("pick.__h").alias("__h")
    )
    at = F.row_number().over(Window.partitionBy("__key", "__h").orderBy(F.lit(1)))
    return rows.join(kept.hint("merge"), ["__key", "__h"]).withColumn("__at", at).filter("__at = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
