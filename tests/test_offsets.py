"""Offsets and moves of images: pixels are dealt by tile once."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import raster as R


def planes(spark, tiles=3, side=6):
    px = spark.range(tiles).select(F.col("id").alias("tile"), F.explode(F.array(F.lit(0), F.lit(1))).alias("frame"))
    px = px.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return px.withColumn("value", F.pmod(F.xxhash64("tile", F.pmod(F.col("i") - F.col("frame"), F.lit(side)), "j"), F.lit(1000)).cast("double"))


def test_a_move_shuffles_one_row_per_pixel(spark):
    px = planes(spark)
    moves = px.select("tile", "frame").distinct().select("tile", "frame", F.lit(0.25).alias("oi"), F.lit(-1.5).alias("oj"))
    got = R.apply_offsets(px, moves, ["tile", "frame"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "i#" in line.split("ENSURE")[0]]
    found = {(r["tile"], r["frame"], r["i"], r["j"]): r["value"] for r in got.collect()}
    assert len(found) == 3 * 2 * 36
    raw = {(r["tile"], r["frame"], r["i"], r["j"]): r["value"] for r in px.collect()}
    for (t, f, i, j), v in found.items():
        at = lambda a, b: raw.get((t, f, a, b), 0.0)
        want = sum(wi * wj * at(i + a, j - 2 + b) for a, wi in ((0, 0.75), (1, 0.25)) for b, wj in ((0, 0.5), (1, 0.5)))
        assert np.isclose(v, want)


def test_the_first_frame_needs_no_python(spark):
    px = planes(spark)
    got = R.registration_offsets(px, ["tile"], "frame", "tile bigint, frame int, oi double, oj double")
    assert {tuple(r) for r in got.collect()} == {(t, f, -1.0 * f if f else 0.0, 0.0) for t in range(3) for f in (0, 1)} or {
        tuple(r) for r in got.collect()} == {(t, f, 1.0 * f, 0.0) for t in range(3) for f in (0, 1)}
    assert px.filter("frame = 0").transform(lambda p: R.registration_offsets(p, ["tile"], "frame", "tile bigint, frame int, oi double, oj double")).count() == 3
