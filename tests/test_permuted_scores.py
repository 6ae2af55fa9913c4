"""Permutations in tasks give the scores that windows over every place give."""

import numpy as np
from pyspark.sql import Window as W, functions as F

from tessera.operators import enrichment as E


def test_scores_equal_windows(spark):
    rng = np.random.default_rng(1)
    metric = [None if g % 17 == 5 else float(np.round(rng.normal(), 2)) for g in range(60)]
    placed = spark.createDataFrame([(g, m) for g, m in enumerate(metric)], "gene long, metric double")
    placed = placed.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_first("metric"), "gene")).cast("long"))
    pairs = {(f"s{k}", int(g)) for k in range(6) for g in rng.choice(60, 2 + 7 * k, replace=False)} | {("one", 3), ("none", 5)} | {("all", g) for g in range(60)}
    members = spark.createDataFrame(sorted(pairs), "term string, gene long")
    got = {(r["term"], r["perm"]): r["es"] for r in E.permuted_scores(placed, members, "gene", "term", 25, 7).collect()}
    perm = placed.select("gene", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("perm"))
    mixed = perm.withColumn("rank", F.row_number().over(W.partitionBy("perm").orderBy(F.unhex(F.md5(F.concat_ws("|", "gene", "perm", F.lit("7")))), "gene")).cast("long"))
    hits = members.join(mixed.join(placed.select("rank", "metric"), "rank"), "gene")
    want = E.enrichment_scores(placed.agg(F.count(F.lit(1)).alias("_n")), hits, ["term", "perm"], even=True).collect()
    assert len(got) == len(want) == 25 * 9
    for r in want:
        mine = got[r["term"], r["perm"]]
        assert (mine is None) == (r["es"] is None) and (mine is None or abs(mine - r["es"]) < 1e-12), r


def test_places_are_not_shuffled(spark):
    """Each task gets the list once, however many permutations it makes."""
    placed = spark.range(1, 51).select(F.col("id").alias("gene"), F.col("id").cast("double").alias("metric"), F.col("id").alias("rank"))
    members = placed.select(F.lit("t").alias("term"), "gene").filter("gene < 9")
    one, many = (E.permuted_scores(placed, members, "gene", "term", k, 7) for k in (8, 400))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(many).count("Exchange") == plan(one).count("Exchange") and "Window" not in plan(many)
    assert one.count() == 8 and many.count() == 400
