"""Tables that grow with the rows are never broadcast on an estimate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import crops, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_crops_are_not_broadcast(spark):
    px = spark.range(2).select(F.col("id").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"), F.lit(1).alias("value"))
    px = px.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    boxes = spark.range(2).select(F.col("id").alias("tile"), F.col("id").alias("crop"), *[F.lit(v).alias(n) for n, v in (("i0", 0), ("j0", 0), ("i1", 4), ("j1", 4))])
    got = crops.padded_crops(px, boxes, ["tile"], 1)
    assert "BroadcastHashJoin" not in plan(got)
    assert got.count() == 2 * 36 and got.agg(F.sum("value")).first()[0] == 2 * 25


def test_piles_are_not_broadcast(spark):
    px = spark.range(8).select((F.col("id") % 2).alias("pile"), F.col("id").alias("tile"), F.lit(0).alias("i"), F.col("id").cast("int").alias("j"), F.lit(1).alias("value"))
    got = crops.pile(px, ["pile"], "tile")
    assert plan(got).count("BroadcastHashJoin") <= 1  # the canvas of a pile
    assert got.count() == 4 * 7 + 4 * 8


def test_nearest_points_are_not_broadcast(spark):
    pts = spark.range(500).select(F.lit(0).alias("t"), F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("i"), (F.col("id") * 91 % 97).cast("double").alias("j"))
    got = spatial.knn(pts, pts, ["t"], ("i", "j"), 2)
    assert "BroadcastHashJoin" not in plan(got)
    assert got.count() == 1000


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_nearest_points_from_cells_in_several_lists(spark, monkeypatch, chunk):
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.uniform(0, 100, (60, 2)), rng.normal(50, 0.01, (60, 2)), [[500.0, 500.0]]])
    rows = [(int(n % 2), n, float(x), float(y)) for n, (x, y) in enumerate(a)]
    pts = spark.createDataFrame(rows, "t long, id long, i double, j double")
    got = {(r["id"], r["rank"]): r["neighbor"] for r in spatial.knn(pts, pts, ["t"], ("i", "j"), 3, crowd=8).collect()}
    want = {}
    for t, n, x, y in rows:
        near = sorted((np.sqrt((u - x) ** 2 + (v - y) ** 2), m) for s, m, u, v in rows if s == t)[:3]
        want |= {(n, k + 1): m for k, (_, m) in enumerate(near)}
    assert got == want


def test_piles_are_dealt_once(spark):
    px = spark.range(16).select((F.col("id") % 2).alias("pile"), F.floor(F.col("id") / 8).alias("plane"), (F.col("id") % 3).cast("int").alias("i"), F.floor(F.col("id") % 8 / 2).cast("int").alias("j"))
    px = px.withColumn("value", F.when(F.col("i") < 2, 5))
    got = crops.pile(px, ["pile"], "plane")
    assert plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan(got)
    want = {(r["pile"], r["plane"], r["i"], r["j"]): r["value"] or 0 for r in px.collect()}
    have = {(r["pile"], r["plane"], r["i"], r["j"]): r["value"] for r in got.collect()}
    assert len(have) == 2 * 2 * 3 * 4 and have == {k: want.get(k, 0) for k in have} and want.keys() <= have.keys()
    assert "BroadcastHashJoin" not in plan(crops.trim(got, ["pile"], "plane"))
