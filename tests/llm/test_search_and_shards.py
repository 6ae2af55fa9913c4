"""Top-k search and sharding against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import extendible, maxscore
from tests.oracle import DATA, compare, connect


def brute(vectors, queries, k):
    out = []
    for qi, q in queries:
        exact = [(sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(q, v)), i) for i, v in vectors if i != qi]
        scores = sorted((-max(-2**63, min(2**63 - 1, s)), i) for s, i in exact)
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "negative", "huge"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(300, 9))
    if kind == "sparse":
        v = v * (rng.random(v.shape) < 0.2)
    if kind == "ties":
        v = np.round(v)
    if kind == "negative":
        v = np.abs(v)
        v[::50] *= -1
    if kind == "huge":
        v[::7] *= 1e9
        v = v[:60]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = maxscore.top_k(df, df.filter("id % 50 = 0"), 5, shard=64, block=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_rows_that_take_no_part(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (None, [9.0, 9.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5])],
        "id long, v array<double>",
    )
    got = maxscore.top_k(df, df.filter("id = 0"), 5)
    assert [tuple(r)[1:] for r in got.orderBy("rank").collect()] == [(1, 7, 131072), (2, 7, 131072), (3, 5, 65536), (4, 6, 0)]
    assert maxscore.top_k(df.limit(0), df, 5).count() == 0 and maxscore.top_k(df, df.limit(0), 5).count() == 0


def test_non_essential_terms_are_left_out():
    rng = np.random.default_rng(1)
    c = np.round(rng.normal(size=(500, 20)) * 10)
    q = np.array([1000.0, 900.0] + [1.0] * 18)
    ids, scores = maxscore.Shard(np.arange(500), c).search(q, 3, -1)
    want = np.lexsort((np.arange(500), -(c @ q)))[:3]
    assert ids.tolist() == want.tolist() and scores.tolist() == (c @ q)[want].tolist()


def test_search_query_agrees_with_sql(spark):
    folder = f"{DATA}/sf0.001"
    assert compare(spark, connect(folder), folder, "op4", maxscore.query, maxscore.SQL) == ""
    assert compare(spark, connect(folder), folder, "op5", extendible.query, extendible.SQL) == ""


def slow_leaves(sizes, limit):
    """Split oversized buckets bit by bit."""
    h = [(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), b) for i, b in sizes]
    out, todo = {}, [(0, 0, h)]
    while todo:
        depth, prefix, rows = todo.pop()
        if not rows:
            continue
        if sum(b for _, b in rows) <= limit or len(rows) == 1 or depth == 60:
            out[depth, prefix] = sum(b for _, b in rows)
            continue
        for bit in (0, 1):
            todo.append((depth + 1, prefix * 2 + bit, [r for r in rows if r[0] >> (59 - depth) & 1 == bit]))
    return out


@pytest.mark.parametrize("limit", [200, 3000, 10**6])
def test_only_oversized_buckets_split(spark, limit):
    rows = [(i, "x" * (i * 37 % 120)) for i in range(700)] + [(1000, "y" * 900)]
    got = extendible.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    want = slow_leaves([(i, len(t)) for i, t in rows], limit)
    assert len(got) == len(rows)
    assert {(r["depth"], int(r["shard"] or "0", 2)): r["shard_bytes"] for r in got} == want
    assert all(r["oversize"] == (r["shard_bytes"] > limit) for r in got)


def test_a_key_larger_than_a_shard_is_paged(spark, tmp_path):
    rows = [(7, "abcdefghij", 1)] * 900 + [(7, "z" * 200, 2), (8, None, 3), (None, "", 4), (9, "long" * 700, 5), (9, "more" * 700, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, depth int")
    got = extendible.shards(df, 1000)
    sums = got.groupBy("shard").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("m"), F.max("oversize").alias("o"), F.count("*").alias("n")).collect()
    assert got.count() == len(rows) and all(r["b"] == r["m"] for r in sums)
    assert all(r["b"] <= 1000 or (r["o"] and r["n"] == 1) for r in sums)
    extendible.write(df, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == ["depth", "doc_id", "shard", "text"] and back.count() == len(rows)
    sums = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all((r["b"] or 0) <= 1000 or r["n"] == 1 for r in sums)
    assert extendible.shards(df.limit(0)).count() == 0
