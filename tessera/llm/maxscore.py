"""Exact top-k search by MaxScore over shards.

A vector's components are terms with whole-number impacts; positive and
negative impacts of one dimension are two posting lists. A query gains from the
lists of its components' signs and loses from the others. Terms are ordered by
their largest possible gain; those whose gains together stay below the score of
the k-th best so far are non-essential. Only essential postings are traversed,
the other terms are probed for documents that can still compete, and losses are
taken off last. Shards are merged by rank.

Candidates are dealt to shards of about ``SHARD`` rows and queries to blocks of
about ``QUERIES`` rows; each pair of shard and block is one bounded task group,
so no group grows with the data.

Defined cases: rows without an id, null vectors and vectors with null or
non-finite components take no part; vectors of unequal length are compared as
if the shorter ended in zeros; equal scores go to the smaller id; a query's own
id is no candidate; repeated candidate rows each count, repeated queries count
once; scores beyond 64 bits stop at the limit, and tie there; with fewer candidates than k all
are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

SHARD, QUERIES = 4096, 512
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Shard:
    """Posting lists of some vectors (rows of ``impacts``, whole numbers as floats)."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.impacts = ids[order], np.ascontiguousarray(impacts[order])
        self.postings = {}
        for d in range(self.impacts.shape[1]):
            column = self.impacts[:, d]
            for sign in (1, -1):
                at = np.nonzero(column * sign > 0)[0]
                if len(at):
                    value = np.abs(column[at])
                    self.postings[d, sign] = (at, value, value.max())

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to the smaller id."""
        gains = []
        for d in np.nonzero(query)[0]:
            found = self.postings.get((int(d), 1 if query[d] > 0 else -1))
            if found is not None:
                gains.append((abs(query[d]) * found[2], int(d), abs(query[d]), found))
        gains.sort(key=lambda g: g[:2])
        least = -np.inf
        others = self.ids != own
        if gains and others.sum() > k:  # a first bound, from the best postings of the best term
            at, value, _ = gains[-1][3]
            some = at[np.argpartition(-value, min(8 * k, len(at) - 1))[:8 * k]] if len(at) > 8 * k else at
            some = some[others[some]]
            if len(some) >= k:
                least = np.partition(self.impacts[some] @ query, len(some) - k)[len(some) - k]
        rest, first = 0.0, 0
        while first < len(gains) and rest + gains[first][0] < least:
            rest += gains[first][0]
            first += 1
        score = np.zeros(len(self.ids))
        for _, _, weight, (at, value, _) in gains[first:]:
            score[at] += weight * value
        alive = np.nonzero(others & (score + rest >= least))[0]
        score = score[alive]
        for bound, d, weight, _ in gains[:first][::-1]:
            score += weight * np.maximum(self.impacts[alive, d] * np.sign(query[d]), 0)
            rest -= bound
            keep = score + rest >= least
            alive, score = alive[keep], score[keep]
        score = self.impacts[alive] @ query  # losses included
        best = np.lexsort((alive, -score))[:k]
        return self.ids[alive[best]], score[best]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for n, v in enumerate(vectors):
        out[n, :len(v)] = np.floor(np.asarray(v, np.float64) * 256.0)
    return out


def _saturated(value) -> int:
    return int(min(max(int(value), _LEAST), _MOST))


def _group(k: int):
    columns = ["query_id", "vec_id", "score"]

    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or queries.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        width = max(shard["v"].map(len).max(), queries["v"].map(len).max())
        ids, c, q = shard["id"].to_numpy(), _matrix(shard["v"], width), _matrix(queries["v"], width)
        rows = []
        if np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * max(1, width) < _EXACT:
            index = Shard(ids, c)
            for own, vector in zip(queries["id"], q):
                found, score = index.search(vector, k, own)
                rows += [(own, i, int(s)) for i, s in zip(found.tolist(), score.tolist())]
        else:  # whole numbers of any size
            c = [[int(x) for x in v] for v in c]
            for own, vector in zip(queries["id"], q):
                vector = [int(x) for x in vector]
                scores = sorted((-_saturated(sum(a * b for a, b in zip(v, vector))), i) for v, i in zip(c, ids.tolist()) if i != own)[:k]
                rows += [(own, i, -s) for s, i in scores]
        return pd.DataFrame(rows, columns=columns).astype("int64")

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs have ``id`` and ``v`` (array of numbers)."""

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("v").cast("array<double>")
        # FALSE for null, NaN and infinite components
        fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        return df.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine).select(F.col("id").cast("long").alias("id"), v.alias("v"))

    candidates, asked = sound(vectors), sound(queries).distinct()
    shards = max(1, -(-candidates.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    left = candidates.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        _group(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_k(rows, rows.filter(F.col("id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
