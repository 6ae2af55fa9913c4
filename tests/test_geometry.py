"""Spatial, raster and alignment operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment, graph, raster as R, regions as G, spatial, tracking


def points(spark, xy, key=0):
    return spark.createDataFrame([(key, n, float(a), float(b)) for n, (a, b) in enumerate(xy)], "k int, id long, x double, y double")


def brute(a, b, k):
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("shape", ["uniform", "clustered", "line", "same"])
def test_knn(spark, shape):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 100, (300, 2))
    if shape == "clustered":  # a third of all points in a tiny spot
        xy[:100] = [50, 50] + rng.normal(0, 1e-4, (100, 2))
    if shape == "line":
        xy[:, 1] = 3
    if shape == "same":
        xy[:150] = [10, 10]
    df = points(spark, xy)
    got = spatial.knn(df, df, ["k"], ("x", "y"), 3, crowd=8).orderBy("id", "rank").collect()
    d = np.array([r["distance"] for r in got]).reshape(300, 3)
    assert np.allclose(d, brute(xy, xy, 3))


def test_knn_fewer_points_than_k_and_outside_queries(spark):
    a, b = np.array([[500., 500.], [0., 0.]]), np.array([[1., 1.], [2., 5.]])
    got = spatial.knn(points(spark, a), points(spark, b), ["k"], ("x", "y"), 3)
    assert got.groupBy("id").count().filter("count = 2").count() == 2
    near = spatial.knn(points(spark, a), points(spark, b), ["k"], ("x", "y"), 1, max_distance=3.0).collect()
    assert [(r["id"], r["neighbor"]) for r in near] == [(1, 0)]


def components(n, edges):
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(n, n + 1) for n in range(60)] + [(100, x) for x in range(101, 140)] + [tuple(map(int, e)) for e in rng.integers(150, 250, (60, 2))]
    want = components(250, edges)
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert all(want[r["node"]] == r["component"] for r in got)


def test_clusters_with_a_dense_spot(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 60, (240, 2))
    xy[:80] = [30, 30] + rng.normal(0, .8, (80, 2))
    df = points(spark, xy).withColumn("barcode", F.col("id") % 2)
    r = 3.0
    edges = [(a, b) for a in range(240) for b in range(a) if (a - b) % 2 == 0 and np.hypot(*(xy[a] - xy[b])) <= r]
    want = components(240, edges)
    single = {n for n in range(240) if not any(n in e for e in edges)}
    got = spatial.clusters(df, ["barcode"], ("x", "y"), r, "id").collect()
    assert len(got) == 240
    assert all(row["cluster"] == (-1 if row["id"] in single else want[row["id"]]) for row in got)


def image(spark, a):
    return spark.createDataFrame([(0, int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], "tile int, i int, j int, value double")


def array(df, shape, col="value"):
    out = np.zeros(shape)
    for r in df.select("i", "j", col).collect():
        out[r["i"], r["j"]] = r[col]
    return out


def window(a, w, f):
    lo = w // 2
    p = np.full((a.shape[0] + w, a.shape[1] + w), np.nan)
    p[lo:lo + a.shape[0], lo:lo + a.shape[1]] = a
    return np.array([[f(p[i:i + w, j:j + w]) for j in range(a.shape[1])] for i in range(a.shape[0])])


def test_filters_and_peaks(spark):
    a = np.random.default_rng(4).integers(0, 99, (14, 11)).astype(float)
    px = image(spark, a)
    top, low = window(a, 3, np.nanmax), window(a, 3, np.nanmin)
    assert np.array_equal(array(R.max_filter(px, ["tile"], 3), a.shape), top)
    want = np.where(a == top, top - low, 0)
    edge = np.ones(a.shape, bool)
    edge[3:-3, 3:-3] = False
    want[edge] = 0
    assert np.array_equal(array(R.find_peaks(px, ["tile"], 3), a.shape), want)


def test_log_and_disk(spark):
    a = np.random.default_rng(6).integers(0, 2000, (12, 13)).astype(float)
    g0, g2 = (np.array(R.gaussian_weights(1.0, o)) for o in (0, 2))
    p = np.pad(a, 4, "symmetric")
    conv = lambda wi, wj: np.array([[wi @ p[i:i + 9, j:j + 9] @ wj for j in range(13)] for i in range(12)])
    want = np.rint(np.clip(-(conv(g2, g0) + conv(g0, g2)), 0, 65535))
    assert np.array_equal(array(R.laplacian_of_gaussian(image(spark, a), ["tile"]), a.shape), want)
    ii, jj = np.indices(a.shape)
    mean = np.array([[a[(ii - i) ** 2 + (jj - j) ** 2 <= 4].mean() for j in range(13)] for i in range(12)])
    assert np.allclose(array(R.disk_mean(image(spark, a), ["tile"], 2), a.shape, "mean"), mean)


def test_rolling_ball_keeps_small_spots(spark):
    a = np.fromfunction(lambda i, j: 50 + i, (40, 40))
    a[20, 20] += 500
    got = array(R.rolling_ball(image(spark, a), ["tile"], 12), a.shape)
    assert got[20, 20] > 400 and got.min() >= 0 and got[15:25, 25:35].max() < 50


def test_registration_round_trip(spark):
    a = np.random.default_rng(8).integers(0, 255, (24, 24)).astype(float)
    b = np.roll(a, (3, -2), (0, 1))
    px = image(spark, a).withColumn("frame", F.lit(0)).unionByName(image(spark, b).withColumn("frame", F.lit(1)))
    off = R.registration_offsets(px, ["tile"], "frame", "tile int, frame int, oi double, oj double", upsample=4)
    assert {(r["frame"]): (r["oi"], r["oj"]) for r in off.collect()} == {0: (0, 0), 1: (3, -2)}
    back = array(R.apply_offsets(px, off, ["tile", "frame"]).filter("frame = 1"), a.shape)
    assert np.allclose(back[:20, 3:], a[:20, 3:])


def test_labels_holes_and_growth(spark):
    a = np.zeros((12, 12))
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    a[8:10, 8:10] = 1
    a[10, 10] = 1
    px = image(spark, a)
    mask = px.filter("value > 0")
    eight, four = (array(R.label_components(mask, ["tile"], d), a.shape, "label") for d in (True, False))
    assert eight.max() == 2 and four.max() == 3 and eight[1, 1] == 1 and eight[10, 10] == 2
    assert array(R.fill_holes(mask, px, ["tile"]).withColumn("one", F.lit(1)), a.shape, "one")[3, 3] == 1
    grown = array(R.grow_cells(R.label_components(mask, ["tile"]), px, ["tile"]), a.shape, "label")
    assert (grown > 0).all() and grown[0, 0] == 1 and grown[11, 11] == 2
    none = R.grow_cells(R.label_components(mask, ["tile"]), px.filter("value > 0"), ["tile"])
    strip = spark.range(500).select(F.lit(1).alias("tile"), F.lit(0).alias("i"), F.col("id").cast("int").alias("j"))
    seeds = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 499, 3)], "tile int, i int, j int, label int")
    far = {r["j"]: r["label"] for r in R.grow_cells(seeds, strip, ["tile"]).collect()}
    assert far == {j: 7 if j < 250 else 3 for j in range(500)}
    assert none.count() == int(a.sum())


def test_segmentation_splits_touching_disks(spark):
    ii, jj = np.indices((40, 60))
    a = np.where(((ii - 20) ** 2 + (jj - 18) ** 2 < 70) | ((ii - 20) ** 2 + (jj - 33) ** 2 < 70), 1000.0, 10.0)
    labels = R.segment_nuclei(image(spark, a), ["tile"], "tile int", 100, radius=15, area_min=50, area_max=500, smooth=2)
    sizes = [r["count"] for r in labels.groupBy("label").count().orderBy("label").collect()]
    assert len(sizes) == 2 and all(150 < s < 300 for s in sizes)


def test_region_shape(spark):
    a = np.zeros((9, 9))
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    labels = image(spark, a).withColumn("label", F.col("value").cast("int"))
    m = G.morphology(labels, ["tile"]).first()
    assert m["area"] == 24 and m["euler"] == 0 and abs(m["eccentricity"]) < 1e-9 and m["extent"] == 24 / 25
    solid = image(spark, np.ones((4, 6))).withColumn("label", F.lit(1))
    assert G.euler_numbers(solid, ["tile"]).first()["euler"] == 1
    assert abs(G.perimeters(solid, ["tile"]).first()["perimeter"] - 16) < 1e-9


def test_tracking_prefers_disjoint_cheap_paths(spark):
    rows = [(0, f, 1 + n, 10.0 * n + f, 5.0) for f in range(3) for n in range(3)] + [(0, 0, 9, 500.0, 500.0)]
    tracks = tracking.track_nuclei(spark.createDataFrame(rows, "well int, frame int, label long, i double, j double"), ["well"], 3)
    got = {(r["track"], r["frame"]): r["label"] for r in tracks.collect()}
    assert got == {(k, f): k for k in (1, 2, 3) for f in range(3)}


def test_delaunay_circles_are_empty():
    xy = np.random.default_rng(0).uniform(0, 100, (60, 2))
    tri = alignment.delaunay(xy)
    for t in tri:
        a, b, c = xy[t]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [(b @ b - a @ a), (c @ c - a @ a)])
        others = np.delete(xy, t, axis=0)
        assert (np.hypot(*(others - m).T) > np.hypot(*(a - m)) - 1e-7).all()
    assert len(tri) > 90


def test_triangle_hash_is_turn_and_shift_aware(spark):
    xy = np.random.default_rng(9).uniform(0, 1000, (80, 2))
    rotation = 1.07 * np.array([[np.cos(.05), -np.sin(.05)], [np.sin(.05), np.cos(.05)]])
    moved = xy @ rotation.T + [7, -3]
    rows = lambda z: spark.createDataFrame([(0, float(a), float(b)) for a, b in z], "t int, i double, j double")
    a, b = (alignment.find_triangles(rows(z), ["t"], "t int").toPandas() for z in (xy, moved))
    got, shift, score = alignment.evaluate_pair(a, b)
    assert np.allclose(got, rotation, atol=1e-6) and np.allclose(shift, [7, -3], atol=1e-3) and score == 1.0


def test_cycles_and_acquisitions_are_aligned(spark):
    from tessera.operators import registration

    a = np.random.default_rng(11).integers(1, 255, (20, 20)).astype(float)
    frame = lambda z, cycle, channel: image(spark, z).withColumns({"cycle": F.lit(cycle), "channel": F.lit(channel)})
    moved = np.roll(a, (2, 1), (0, 1))
    px = frame(a, 1, "DAPI").unionByName(frame(a * 2, 1, "A")).unionByName(frame(moved, 2, "DAPI")).unionByName(frame(moved * 2, 2, "A"))
    for method in ("stain", "bases"):
        got = registration.align_cycles(px, ["tile"], "DAPI", method, within=False, upsample=1, window=1.0, cutoff=9.0)
        back = array(got.filter("cycle = 2 AND channel = 'A'"), a.shape)
        assert np.allclose(back[:17, :18], 2 * a[:17, :18])
    one, two = (image(spark, z).withColumn("channel", F.lit(0)) for z in (a, moved))
    both = registration.align_acquisitions([one, two], [0, 0], None, ["tile"], window=1.0)
    assert np.allclose(array(both.filter("channel = 1"), a.shape)[:17, :18], a[:17, :18])
    flat = registration.register_and_offset(one.withColumn("frame", F.lit(0)).unionByName(two.withColumn("frame", F.lit(1))), ["tile"], "frame", limit=1)
    assert flat.filter("value <> 0").isEmpty()
