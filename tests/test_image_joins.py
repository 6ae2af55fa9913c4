"""Tables with a row per image or region grow with the images: none is broadcast on an estimate."""

from pyspark.sql import functions as F

from tessera.operators import raster as R, regions as G, spatial
from tessera.plans import workflows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def images(spark, n=4):
    px = spark.range(n).select(F.col("id").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    px = px.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return px.withColumn("value", F.pmod(F.xxhash64("tile", "i", "j"), F.lit(1000)))


def test_moves_and_sizes_of_images_are_merged(spark):
    px = images(spark)
    both = px.withColumn("frame", F.lit(0)).unionByName(px.withColumns({"i": (F.col("i") + 2) % 8, "frame": F.lit(1)}))
    off = R.registration_offsets(both, ["tile"], "frame", "tile long, frame int, oi double, oj double")
    moved = R.apply_offsets(both, off, ["tile", "frame"])
    scaled = R.normalize_by_percentile(px, ["tile"])
    for df in (off, moved, scaled, R.standardize_images(px, ["tile"]).filter("i = 0")):
        assert plan(df).count("BroadcastHashJoin") == 0
    assert {(r["frame"], r["oi"], r["oj"]) for r in off.collect()} == {(0, 0.0, 0.0), (1, 2.0, 0.0)}
    assert moved.count() == both.count()


def test_features_of_regions_are_merged(spark):
    px = images(spark, 2).withColumn("channel", F.col("tile") % 2).withColumn("tile", F.lit(0).cast("long"))
    quad = (1 + F.floor(F.col("i") / 4) * 2 + F.floor(F.col("j") / 4)).cast("int")
    labels = px.filter("channel = 0").select("tile", "i", "j", quad.alias("label"))
    wide = G.wide_pixels(px, ["tile"], [0, 1])
    parts = [G.order_features(labels, wide, ["tile"], "c0", "x"), G.zernike(labels, wide, ["tile"], "c0"), G.threshold_adjacency(labels, wide, ["tile"], "c0"), G.morphology(labels, ["tile"])]
    for df in [*parts, workflows.extended_phenotype(px, {"cell": labels}, 0, [1], ["tile"]), workflows.phenotype(px, labels, labels, [0, 1], ["tile"])]:
        assert "BroadcastHashJoin" not in plan(df)
        assert df.count() == 4


def test_pairs_of_near_points_stay_in_their_cell(spark, monkeypatch):
    """Lists of points go to the cell that asks, and are neither dealt again for the join nor for a query's state."""
    seen, cut = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda d: seen.append(d) or cut(d))
    pts = spark.range(300).select((F.col("id") % 2).alias("t"), F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("i"), (F.col("id") * 91 % 97).cast("double").alias("j"))
    assert spatial.knn(pts, pts, ["t"], ("i", "j"), 2, crowd=8).count() == 600
    states = [d for d in seen if "_done" in d.columns]
    assert states
    for d in states:  # asked cells, asked cells and points by cell, lists by asker, queries by cell
        assert plan(d).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 5
