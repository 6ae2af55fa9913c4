"""Labels and nuclei of whole images against flood fills, image by image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import planes, raster as R


def flood(mask, diagonal):
    """Labels in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    around = [(d, e) for d in (-1, 0, 1) for e in (-1, 0, 1) if (d or e) and (diagonal or not (d and e))]
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n, todo = n + 1, [start]
        out[start] = n
        while todo:
            i, j = todo.pop()
            for d, e in around:
                p = (i + d, j + e)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    todo.append(p)
    return out


def fields(seed, count=6):
    """Images of several sizes with smooth noise, some pixels missing or without a value."""
    rng = np.random.default_rng(seed)
    for n in range(count):
        shape = (30 + 5 * (n % 3), 41 - 3 * (n % 2))
        a = rng.normal(0, 1, shape)
        for _ in range(3):
            a = sum(np.roll(np.roll(a, d, 0), e, 1) for d in (-1, 0, 1) for e in (-1, 0, 1)) / 9
        value = np.round(1000 + 3000 * a)
        value[rng.random(shape) < 0.01] = np.nan
        yield n, value, rng.random(shape) > 0.01


def pixels(spark, images):
    rows = [(f"t{n}", n % 2, int(i), int(j), None if np.isnan(v[i, j]) else float(v[i, j])) for n, v, there in images for i, j in zip(*np.nonzero(there))]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(str(a), int(b), int(c), int(d), None if e is None else float(e)) for a, b, c, d, e in rows], "tile string, plate int, i int, j int, value double")


@pytest.fixture(params=[7, 10_000])
def batch(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels_equal_flood_fills(spark, batch, diagonal):
    images = list(fields(1))
    got = R.label_components(pixels(spark, images).filter("value > 1010"), ["tile", "plate"], diagonal).collect()
    for n, value, there in images:
        with np.errstate(invalid="ignore"):
            want = flood(there & (value > 1010), diagonal)
        have, area = np.zeros_like(want), np.zeros_like(want)
        for r in got:
            if r["tile"] == f"t{n}":
                have[r["i"], r["j"]], area[r["i"], r["j"]] = r["label"], r["area"]
        assert (have == want).all() and want.max() > 3
        assert (area == np.where(want > 0, np.bincount(want.ravel())[want], 0)).all()
    assert R.label_components(pixels(spark, images).filter("value > 1e9"), ["tile", "plate"]).count() == 0


def slow_nuclei(value, there, threshold, radius, low, high):
    """The steps on one image, the last split by the operator's own rule per object."""
    shape = value.shape
    ii, jj = np.indices(shape)
    known = there & ~np.isnan(value)
    above = np.zeros(shape, bool)
    for p in zip(*np.nonzero(known)):
        disk = known & ((ii - p[0]) ** 2 + (jj - p[1]) ** 2 <= radius * radius)
        above[p] = value[p] > value[disk].sum() / disk.sum()
    small = flood(above, False)
    area = np.bincount(small.ravel())
    objects = flood((small > 0) & (area[small] >= low), True)
    bright = np.zeros(shape, bool)
    for k in range(1, objects.max() + 1):
        if value[(objects == k) & known].mean() >= threshold:
            bright |= objects == k
    h, w = np.nonzero(there)[0].max(), np.nonzero(there)[1].max()
    ground = flood(there & ~bright, False)
    for k in range(1, ground.max() + 1):
        hole = ground == k
        edge = hole & ((ii == 0) | (jj == 0) | (ii == h) | (jj == w))
        if not edge.any() and hole.sum() < low:
            bright |= hole
    return flood(bright, True)


def test_nuclei_equal_single_steps(spark, batch):
    images = list(fields(4))
    px = pixels(spark, images)
    low, high = 6, 120
    got = R.segment_nuclei(px, ["tile", "plate"], "tile string, plate int", 1010, radius=6, area_min=low, area_max=high)
    have = {(r["tile"], r["i"], r["j"]): r["label"] for r in got.collect()}
    whole = [(f"t{n}", n % 2, int(i), int(j), int(found[i, j])) for n, v, t in images for found in [slow_nuclei(v, t, 1010, 6, low, high)] for i, j in zip(*np.nonzero(found))]
    parts = R.split_touching(spark.createDataFrame(whole, "tile string, plate int, i int, j int, label int"), ["tile", "plate"], "tile string, plate int, i int, j int, label int, part int")
    kept = R.filter_regions(parts, px, ["tile", "plate"], (F.col("area") > low) & (F.col("area") < high))
    want = {(r["tile"], r["i"], r["j"]): r["label"] for r in kept.collect()}
    assert have == want and max(want.values()) > 3


def test_segmentation_runs_no_jobs_before_it_is_asked(spark):
    """The steps do not write images in between."""
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = R.segment_nuclei(pixels(spark, list(fields(2, 2))), ["tile", "plate"], "tile string, plate int", 1010, radius=6, area_min=6)
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_image_numbers_and_empty_images(spark):
    assert planes.label(*[np.zeros(0, np.int64)] * 3)[0].size == 0
    one = spark.createDataFrame([(3, 5, 2.0)], "i int, j int, value double")
    assert R.label_components(one, []).collect()[0]["area"] == 1
    assert R.segment_nuclei(one, [], "", 1).count() == 0


def test_nuclei_come_with_their_values(spark):
    px = pixels(spark, list(fields(3, 3))).withColumn("value", F.col("value").cast("long"))
    options = {"radius": 6, "area_min": 6, "area_max": 120}
    got = R.segment_nuclei(px, ["tile", "plate"], "tile string, plate int", 1010, values=True, **options)
    assert got.schema["value"].dataType == px.schema["value"].dataType
    plain = R.segment_nuclei(px, ["tile", "plate"], "tile string, plate int", 1010, **options)
    want = plain.join(px, ["tile", "plate", "i", "j"]).select(*got.columns)
    assert got.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
