"""Near copies: exploded tables are sized too low by Spark and must not be broadcast."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import shingle_join, simhash_mih
from tessera.session import ensure_checkpoint_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_not_broadcast(spark, monkeypatch):
    seen = []
    saved = lambda df, name: seen.append(df) or df.checkpoint()
    monkeypatch.setattr(simhash_mih, "saved", saved)
    ensure_checkpoint_dir(spark)
    fps = spark.range(200).select((F.col("id") * 1_000_003).alias("fp"))
    near = simhash_mih.links(fps)
    for df in [*seen, near]:
        assert "BroadcastHashJoin" not in plan(df)
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two three"), F.col("id") % 20).alias("text"))
    assert "BroadcastHashJoin" not in plan(simhash_mih.groups(texts))


def test_sets_are_joined_by_merges(spark, monkeypatch):
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f g"), F.col("id") % 20).alias("text"))
    seen, saved = [], shingle_join.saved
    monkeypatch.setattr(shingle_join, "saved", lambda df, name: seen.append(df) or saved(df, name))
    got = shingle_join.keep_one(texts)
    assert got.count() == 20
    for df in [*seen, got]:  # what is broadcast are bitmaps of fixed size
        assert plan(df).count("BroadcastHashJoin") == plan(df).count("BroadcastHashJoin [__part")


def test_wide_sketches_lose_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (0, 1, 20, 33, 400, 513, 3000, 40_000):
        base = rng.integers(-2**63, 2**63 - 1, n)
        for away in {0, n // 9, n // 5, n // 2}:
            other = np.concatenate((base[away:], rng.integers(-2**63, 2**63 - 1, away)))
            for b in (other, other[: max(1, len(other) * 4 // 5)] if n else other):
                a, b = np.unique(base), np.unique(b)
                both = len(np.intersect1d(a, b))
                rows.append((len(a) + len(b), shingle_join.wide_sketch(a).tolist(), shingle_join.wide_sketch(b).tolist(), both >= 0.8 * (len(a) + len(b) - both) - 1e-9))
    df = spark.createDataFrame(rows, "n long, a array<long>, b array<long>, alike boolean")
    got = df.select("n", "alike", shingle_join._wide_near("a", "b", F.col("n"), 0.8).alias("may")).collect()
    assert all(r["may"] for r in got if r["alike"])
    assert sum(not r["may"] for r in got if r["n"] > 600 and not r["alike"]) > 0
    assert max(len(r[1]) for r in rows) == 1024


def test_far_long_texts_are_not_compared(spark, monkeypatch):
    """Long texts that share a passage and little else go no further than their sketches."""
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(900))
    texts = [(n, passage + " " + " ".join(f"w{k}" for k in rng.integers(0, 10**6, 600))) for n in range(8)]
    asked, verified = [], shingle_join._verified
    monkeypatch.setattr(shingle_join, "_verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    got = shingle_join.groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((r["id"], r["component_id"]) for r in got.collect()) == [(n, n) for n in range(8)]
    assert sum(asked) == 0


def test_kept_rows_are_whole_with_repeats(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "q r s t u v", "z"), (None, "k l m n o p", "n"), (3, "a b c d e f", "w"), (4, None, "v"), (5, "", "u")]
    got = shingle_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == [("1", "a b c d e f"), ("2", "q r s t u v"), ("4", ""), ("None", "k l m n o p")]
