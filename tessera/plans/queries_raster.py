"""Queries for raster and region operators: every embedding is an 8 x 8 tile
with its values as pixels and the reversed vector as a second channel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import raster as R, regions as G, registration, shapes
from tessera.plans.registry import query

r = F.round
TILE = ["tile"]


def spread(df, key):
    """Few rows that are drawn to many pixels, dealt to all tasks: a small file is one split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def tiles(t):
    e = t.embeddings.select(F.col("vec_id").alias("tile"), F.col("embedding").alias("_e"), F.posexplode("embedding").alias("_k", "_v"))
    px = lambda v: r((v.cast("double") + 1) * 1000).cast("bigint")
    return e.select("tile", F.floor(F.col("_k") / 8).cast("int").alias("i"), (F.col("_k") % 8).alias("j"), px(F.col("_v")).alias("value"),
                    px(F.col("_e")[63 - F.col("_k")]).alias("c1"))


def plane(t):
    return tiles(t).drop("c1")


PX = """
px AS (SELECT vec_id AS tile, (k // 8)::INTEGER AS i, (k % 8)::INTEGER AS j, round((embedding[k + 1]::DOUBLE + 1) * 1000)::BIGINT AS value,
  round((embedding[64 - k]::DOUBLE + 1) * 1000)::BIGINT AS c1 FROM embeddings, (SELECT unnest(range(64)) AS k))"""


def near(kind, lo, hi):
    """Square neighbourhood by equi-joins on a list of offsets, to differ from the window form."""
    steps = f"(SELECT unnest(range({lo}, {hi} + 1)) AS d)"
    return f"(SELECT a.tile, a.i, a.j, {kind}(b.value) AS v FROM px a CROSS JOIN {steps} o CROSS JOIN {steps} p JOIN px b ON a.tile = b.tile AND b.i = a.i + o.d AND b.j = a.j + p.d GROUP BY ALL)"


@query("max_filter", f"WITH {PX} SELECT tile, i, j, v AS value FROM {near('max', -1, 1)}")
def _(t):
    return R.max_filter(plane(t), TILE, 3)


NEAR = "RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING"
#: ``ext``: greatest and least value of the 3 x 3 neighbourhood, along rows and then along columns.
EXTREMES = f"""
line AS (SELECT *, max(value) OVER w AS a, min(value) OVER w AS b FROM px WINDOW w AS (PARTITION BY tile, i ORDER BY j {NEAR})),
ext AS (SELECT tile, i, j, value, max(a) OVER w AS hi, min(b) OVER w AS lo FROM line WINDOW w AS (PARTITION BY tile, j ORDER BY i {NEAR}))"""


@query("find_peaks", f"""
WITH {PX}, {EXTREMES} SELECT tile, i, j, CASE WHEN value = hi AND i BETWEEN 3 AND 4 AND j BETWEEN 3 AND 4 THEN hi - lo ELSE 0 END AS value FROM ext""")
def _(t):
    return R.find_peaks(plane(t), TILE, 3)


def log_ctes():
    """``col``: the unrounded filter response of every pixel."""
    g0, g2 = R.gaussian_weights(1.0), R.gaussian_weights(1.0, 2)
    w = ", ".join(f"({k - 4}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(zip(g0, g2)))
    fold = lambda x: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} > 7 THEN 15 - ({x}) ELSE {x} END"
    return f"""w(d, g0, g2) AS (VALUES {w}),
row AS (SELECT a.tile, a.i, a.j, sum(b.value * g2) AS p, sum(b.value * g0) AS q FROM px a CROSS JOIN w JOIN px b ON a.tile = b.tile AND a.i = b.i AND b.j = {fold('a.j + d')} GROUP BY ALL),
col AS (SELECT a.tile, a.i, a.j, -(sum(b.p * g0) + sum(b.q * g2)) AS v FROM row a CROSS JOIN w JOIN row b ON a.tile = b.tile AND a.j = b.j AND b.i = {fold('a.i + d')} GROUP BY ALL)"""


CLIPPED = "round(greatest(0, least(65535, v)))::DOUBLE"


@query("laplacian_of_gaussian", f"WITH {PX}, {log_ctes()} SELECT tile, i, j, {CLIPPED} AS value FROM col")
def _(t):
    return R.laplacian_of_gaussian(plane(t), TILE).select("tile", "i", "j", "value")


@query("cycle_std", f"""
WITH {PX}, s AS (SELECT tile // 8 AS tile, tile % 2 AS channel, i, j, stddev_pop(value) AS s FROM px GROUP BY ALL) SELECT tile, i, j, round(avg(s), 6) AS value FROM s GROUP BY ALL""")
def _(t):
    p = plane(t).select(F.floor(F.col("tile") / 8).alias("tile"), (F.col("tile") % 2).alias("channel"), F.floor(F.col("tile") / 2).alias("cycle"), "i", "j", "value")
    return R.cycle_std(p, TILE).withColumn("value", r("value", 6))


@query("max_projection", f"WITH {PX} SELECT tile // 4 AS tile, i, j, max(value) AS value FROM px GROUP BY ALL")
def _(t):
    return R.project(plane(t).withColumn("tile", F.floor(F.col("tile") / 4)), TILE, "max")


@query("percentile_normalized", f"WITH {PX} SELECT tile, i, j, round(value / quantile_cont(value, 0.7) OVER (PARTITION BY tile), 6) AS value FROM px")
def _(t):
    return R.normalize_by_percentile(plane(t), TILE).withColumn("value", r("value", 6))


@query("standardized_images", f"""
WITH {PX}, s AS (SELECT tile, i, j, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS v FROM px)
SELECT tile, i, j, round((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w), 9) AS value FROM s WINDOW w AS (PARTITION BY tile)""")
def _(t):
    return R.standardize_images(plane(t), TILE).withColumn("value", r("value", 9))


@query("disk_mean", f"""
WITH {PX} SELECT a.tile, a.i, a.j, round(avg(b.value), 6) AS mean FROM px a JOIN px b ON a.tile = b.tile AND (a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) <= 9 GROUP BY ALL""")
def _(t):
    return R.disk_mean(plane(t), TILE, 3).select("tile", "i", "j", r("mean", 6).alias("mean"))


def ball_sql(radius):
    """Leads and lags along rows per ball line, then over the lines."""
    _, ball = R.ball_offsets(radius)
    side = max(a for a, _, _ in ball) + 1
    lines = {a: [(b, z) for x, b, z in ball if x == a] for a in sorted({a for a, _, _ in ball})}
    low = ", ".join(f"least({', '.join(f'lead(value, {b}) OVER w - {z}' for b, z in p)}) AS g{a}" for a, p in lines.items())
    high = ", ".join(f"greatest({', '.join(f'lag(gap, {b}) OVER w + {z}' for b, z in p)}) AS s{a}" for a, p in lines.items())
    down = ", ".join(f"lead(g{a}, {a}) OVER w" for a in lines)
    up = ", ".join(f"lag(s{a}, {a}) OVER w" for a in lines)
    return f"""WITH {PX}, row AS (SELECT *, {low} FROM px WINDOW w AS (PARTITION BY tile, i ORDER BY j)),
gap AS (SELECT tile, i, j, value, CASE WHEN i <= {8 - side} AND j <= {8 - side} THEN least({down}) END AS gap FROM row WINDOW w AS (PARTITION BY tile, j ORDER BY i)),
top AS (SELECT *, {high} FROM gap WINDOW w AS (PARTITION BY tile, i ORDER BY j)), bg AS (SELECT tile, i, j, value, greatest({up}) AS bg FROM top WINDOW w AS (PARTITION BY tile, j ORDER BY i))
SELECT tile, i, j, value - least(bg, value) AS value FROM bg"""


@query("rolling_ball", ball_sql(3))
def _(t):
    return R.rolling_ball(plane(t), TILE, 3).select("tile", "i", "j", F.col("value").cast("bigint").alias("value"))


@query("bilinear_shift", f"""
WITH {PX}, c(a, b, w) AS (VALUES (0, 0, 0.75 * 0.5), (0, 1, 0.75 * 0.5), (1, 0, 0.25 * 0.5), (1, 1, 0.25 * 0.5))
SELECT p.tile, p.i, p.j, round(coalesce(sum(s.value * w), 0), 6)::DOUBLE AS value FROM px p CROSS JOIN c LEFT JOIN px s ON p.tile = s.tile AND s.i = p.i + 1 + a AND s.j = p.j - 1 + b GROUP BY ALL""")
def _(t):
    p = plane(t)
    o = p.select("tile").distinct().select("tile", F.lit(1.25).alias("oi"), F.lit(-0.5).alias("oj"))
    return R.apply_offsets(p, o, TILE).select("tile", "i", "j", r("value", 6).alias("value"))


@query("phase_offsets", """
SELECT vec_id AS tile, 0::INTEGER AS frame, 0.0::DOUBLE AS oi, 0.0::DOUBLE AS oj FROM embeddings UNION ALL SELECT vec_id, 1, 2.0, -1.0 FROM embeddings""")
def _(t):
    p = plane(t)
    moved = p.withColumns({"i": ((F.col("i") + 2) % 8).cast("int"), "j": ((F.col("j") + 7) % 8).cast("int")})
    both = p.withColumn("frame", F.lit(0)).unionByName(moved.withColumn("frame", F.lit(1)))
    return R.registration_offsets(both, TILE, "frame", "tile bigint, frame int, oi double, oj double")


# the second cycle is the first one moved by (2, 1) around the edges
@query("aligned_cycles", f"""
WITH {PX} SELECT tile, 1 AS cycle, i, j, value::DOUBLE AS value FROM px UNION ALL SELECT tile, 2, i, j, CASE WHEN i < 6 AND j < 7 THEN value ELSE 0 END FROM px""")
def _(t):
    p = plane(t)
    moved = p.withColumns({"i": ((F.col("i") + 2) % 8).cast("int"), "j": ((F.col("j") + 1) % 8).cast("int")})
    both = p.withColumn("cycle", F.lit(1)).unionByName(moved.withColumn("cycle", F.lit(2))).withColumn("channel", F.lit("DAPI"))
    return registration.align_between_cycles(both, TILE, F.col("channel") == "DAPI", upsample=1).select("tile", "cycle", "i", "j", "value")


@query("montage", f"WITH {PX} SELECT tile // 16 AS tile, (((tile % 16) // 4) * 8 + i)::INTEGER AS i, ((tile % 4) * 8 + j)::INTEGER AS j, value FROM px")
def _(t):
    return R.montage(plane(t), F.col("tile") % 16, 4, 8, 8).withColumn("tile", F.floor(F.col("tile") / 16))


@query("crop_cells", f"""
WITH {PX}, big AS (SELECT tile // 16 AS tile, ((tile % 16) // 4) * 8 + i AS i, (tile % 4) * 8 + j AS j, value FROM px),
cells AS (SELECT s_suppkey AS cell, s_suppkey % 20 AS tile, s_suppkey % 29 + 2 AS ci, (s_suppkey * 7) % 31 + 1 AS cj FROM supplier)
SELECT tile, cell, (i - c.ci + 3)::INTEGER AS ci, (j - c.cj + 3)::INTEGER AS cj, value FROM big JOIN cells c USING (tile)
WHERE c.ci BETWEEN 3 AND 29 AND c.cj BETWEEN 3 AND 29 AND i BETWEEN c.ci - 3 AND c.ci + 2 AND j BETWEEN c.cj - 3 AND c.cj + 2""")
def _(t):
    big = R.montage(plane(t), F.col("tile") % 16, 4, 8, 8).withColumn("tile", F.floor(F.col("tile") / 16))
    k = F.col("s_suppkey")
    cells = t.supplier.select(k.alias("cell"), (k % 20).alias("tile"), (k % 29 + 2).alias("ci"), ((k * 7) % 31 + 1).alias("cj"))
    return R.crop_cells(big, cells, TILE, 3, 32)


MASK = "mk AS (SELECT tile, i, j FROM px WHERE value > 1080)"
COMPONENTS = f"""
WITH RECURSIVE {PX}, {MASK}, e AS (SELECT a.tile, a.i * 8 + a.j AS x, b.i * 8 + b.j AS y FROM mk a JOIN mk b ON a.tile = b.tile AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
reach AS (SELECT tile, x, y FROM e UNION SELECT r.tile, r.x, e.y FROM reach r JOIN e ON r.tile = e.tile AND r.y = e.x),
root AS (SELECT tile, x, min(y) AS root, count(*) AS area FROM reach GROUP BY ALL),
lab AS (SELECT tile, (x // 8)::INTEGER AS i, (x % 8)::INTEGER AS j, dense_rank() OVER (PARTITION BY tile ORDER BY root)::INTEGER AS label, area FROM root)"""


def mask(t):
    return plane(t).filter("value > 1080")


@query("label_components", f"{COMPONENTS} SELECT tile, i, j, label, area FROM lab")
def _(t):
    return R.label_components(mask(t), TILE)


@query("filter_regions", f"""
{COMPONENTS}, s AS (SELECT tile, label, avg(value) AS m, count(*) AS n FROM lab JOIN px USING (tile, i, j) GROUP BY ALL HAVING count(*) >= 3 AND avg(value) >= 1150),
k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY label)::INTEGER AS new FROM s) SELECT tile, i, j, new AS label FROM lab JOIN k USING (tile, label)""")
def _(t):
    return R.filter_regions(R.label_components(mask(t), TILE), plane(t), TILE, (F.col("area") >= 3) & (F.col("mean_intensity") >= 1150))


@query("grow_cells", f"""
{COMPONENTS}, o AS (SELECT unnest([-1, 0, 1]) AS d), free AS (SELECT tile, i, j FROM px WHERE value > 950),
g(tile, i, j, label) USING KEY (tile, i, j) AS (
  SELECT tile, i, j, label FROM lab UNION
  SELECT f.tile, f.i, f.j, min(g.label) FROM g CROSS JOIN o CROSS JOIN o AS p JOIN free f ON f.tile = g.tile AND f.i = g.i + o.d AND f.j = g.j + p.d
  LEFT JOIN recurring.g AS r ON r.tile = f.tile AND r.i = f.i AND r.j = f.j WHERE r.tile IS NULL GROUP BY ALL)
SELECT tile, i, j, label FROM g""")
def _(t):
    return R.grow_cells(R.label_components(mask(t), TILE), plane(t).filter("value > 950"), TILE)


DISK = "(i - ci) * (i - ci) + (j - cj) * (j - cj) <= radius * radius"
DISKS = """
c AS (SELECT s_suppkey AS tile, k, (12 + 24 * (k // 2))::INTEGER AS ci, (12 + 24 * (k % 2))::INTEGER AS cj, (4 + (s_suppkey + k) % 3)::INTEGER AS radius, 1500 + 100 * (s_suppkey % 7) AS value
  FROM supplier, (SELECT unnest(range(4)) AS k))"""


def disks(t):
    """A field of 48 x 48 pixels per supplier with four bright disks of known place and size."""
    s = spread(t.supplier, "s_suppkey").select(F.col("s_suppkey").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    c = s.select("tile", "k", (12 + 24 * F.floor(F.col("k") / 2)).cast("int").alias("ci"), (12 + 24 * (F.col("k") % 2)).cast("int").alias("cj"),
                 (4 + (F.col("tile") + F.col("k")) % 3).alias("radius"), (1500 + 100 * (F.col("tile") % 7)).alias("bright"))
    px = c.withColumn("i", F.explode(F.sequence(F.col("ci") - 12, F.col("ci") + 11))).withColumn("j", F.explode(F.sequence(F.col("cj") - 12, F.col("cj") + 11)))
    return px.select("tile", "i", "j", F.when(F.expr(DISK), F.col("bright")).otherwise(100).cast("bigint").alias("value"))


# on a level background the objects are the disks, numbered by their first pixel in reading order
@query("segment_nuclei", f"""
WITH {DISKS}, p AS (SELECT c.*, i, j FROM c, (SELECT unnest(range(48))::INTEGER AS i), (SELECT unnest(range(48))::INTEGER AS j) WHERE {DISK}),
f AS (SELECT tile, k, min(i * 48 + j) AS first FROM p GROUP BY ALL), n AS (SELECT tile, k, row_number() OVER (PARTITION BY tile ORDER BY first)::INTEGER AS label FROM f)
SELECT tile, i, j, label FROM p JOIN n USING (tile, k)""")
def _(t):
    return R.segment_nuclei(disks(t), TILE, "tile bigint", 1000, radius=15, area_min=20, area_max=300).select("tile", "i", "j", "label")


# --- regions -----------------------------------------------------------------

def blocks(t):
    """Bright pixels, labelled by image quadrant."""
    label = 1 + F.floor(F.col("i") / 4) * 2 + F.floor(F.col("j") / 4)
    return tiles(t).select("tile", "i", "j", F.when(F.col("value") > 1000, label).otherwise(F.lit(0)).cast("int").alias("label"))


def channels(t):
    return tiles(t).withColumnRenamed("value", "c0")


LAB = "lab AS (SELECT *, CASE WHEN value > 1000 THEN 1 + (i // 4) * 2 + (j // 4) ELSE 0 END::INTEGER AS cell FROM px)"


@query("region_features", f"""
WITH {PX}, {LAB} SELECT tile, cell, count(*) AS area, round(avg(i), 6) AS i, round(avg(j), 6) AS j, min(i) || ',' || min(j) || ',' || (max(i) + 1) || ',' || (max(j) + 1) AS bounds,
  round(avg(value), 6) AS dapi_mean, sum(value)::BIGINT AS dapi_int, min(value) AS dapi_min, max(value) AS dapi_max, round(stddev_pop(value), 6) AS dapi_sd FROM lab WHERE cell > 0 GROUP BY ALL""")
def _(t):
    d = G.feature_table(blocks(t), channels(t), TILE, {**G.geometry(), **G.intensity("c0", "dapi")})
    return d.withColumns({c: r(c, 6) for c in ("i", "j", "dapi_mean", "dapi_sd")}).withColumn("bounds", F.concat_ws(",", "bounds.i0", "bounds.j0", "bounds.i1", "bounds.j1"))


@query("region_order_statistics", f"""
WITH {PX}, {LAB}, q AS (SELECT tile, cell, quantile_cont(value::DOUBLE, 0.5) AS m, quantile_cont(value::DOUBLE, 0.25) AS a, quantile_cont(value::DOUBLE, 0.75) AS b FROM lab WHERE cell > 0 GROUP BY ALL)
SELECT tile, cell, any_value(m) AS x_median, any_value(a) AS x_25, any_value(b) AS x_75, quantile_cont(abs(value - m), 0.5) AS x_mad FROM lab JOIN q USING (tile, cell) GROUP BY ALL""")
def _(t):
    return G.order_features(blocks(t), channels(t), TILE, "c0", "x")


@query("channel_correlation", f"""
WITH {PX}, {LAB}, box AS (SELECT tile, cell, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM lab WHERE cell > 0 GROUP BY ALL)
SELECT b.tile, b.cell, round(CASE WHEN isnan(corr(value, c1)) THEN NULL ELSE corr(value, c1) END, 6) AS corr FROM box b JOIN px p ON p.tile = b.tile AND p.i BETWEEN i0 AND i1 AND p.j BETWEEN j0 AND j1 WHERE value > 0
GROUP BY ALL""")
def _(t):
    return G.channel_correlation(blocks(t), channels(t), TILE, "c0", "c1").withColumn("corr", r("corr", 6))


@query("compartment_join", f"""
WITH {PX}, {LAB}, cyt AS (SELECT *, CASE WHEN value <= 1000 THEN 1 + (i // 4) * 2 + (j // 4) END AS cyto FROM px),
a AS (SELECT tile, cell, count(*) AS area_nuclear, max(c1) AS gfp_max_nuclear FROM lab WHERE cell > 0 GROUP BY ALL), b AS (SELECT tile, cyto AS cell, count(*) AS area_cyto, max(c1) AS gfp_max_cyto FROM cyt WHERE cyto IS NOT NULL GROUP BY ALL)
SELECT * FROM a JOIN b USING (tile, cell)""")
def _(t):
    f = lambda: {"area": F.count(F.lit(1)), "gfp_max": F.max("c1")}
    label = 1 + F.floor(F.col("i") / 4) * 2 + F.floor(F.col("j") / 4)
    cyto = tiles(t).select("tile", "i", "j", F.when(F.col("value") <= 1000, label).otherwise(F.lit(0)).cast("int").alias("label"))
    return G.compartments({"nuclear": G.feature_table(blocks(t), channels(t), TILE, f()), "cyto": G.feature_table(cyto, channels(t), TILE, f())}, TILE)


@query("region_morphology", f"""
WITH {PX}, {LAB}, c AS (SELECT tile, cell, avg(i) AS ci, avg(j) AS cj FROM lab WHERE cell > 0 GROUP BY ALL),
m AS (SELECT tile, cell, count(*) AS n, (max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS box, sum(pow(i - ci, 2)) AS m20, sum((i - ci) * (j - cj)) AS m11, sum(pow(j - cj, 2)) AS m02,
  sum(pow(i - ci, 3)) / pow(count(*), 2.5) AS h30, sum(pow(i - ci, 2) * (j - cj)) / pow(count(*), 2.5) AS h21, sum((i - ci) * pow(j - cj, 2)) / pow(count(*), 2.5) AS h12, sum(pow(j - cj, 3)) / pow(count(*), 2.5) AS h03 FROM lab JOIN c USING (tile, cell) GROUP BY ALL),
t AS (SELECT *, m02 / n + 1.0::DOUBLE / 12 AS a, -m11 / n AS b, m20 / n + 1.0::DOUBLE / 12 AS c FROM m),
e AS (SELECT *, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 AS l1, greatest(0, (a + c - sqrt(pow(a - c, 2) + 4 * b * b)) / 2) AS l2 FROM t)
SELECT tile, cell, n AS area, round(n / box, 6) AS extent, round(4 * sqrt(l1), 5) AS major_axis, round(4 * sqrt(l2), 5) AS minor_axis, round(sqrt(1 - l2 / l1), 5) AS eccentricity,
  [round((m20 + m02) / pow(n, 2), 6) + 0.0, round(pow(m20 / pow(n, 2) - m02 / pow(n, 2), 2) + 4 * pow(m11 / pow(n, 2), 2), 6) + 0.0,
   round(pow(h30 - 3 * h12, 2) + pow(3 * h21 - h03, 2), 6) + 0.0, round(pow(h30 + h12, 2) + pow(h21 + h03, 2), 6) + 0.0,
   round((h30 - 3 * h12) * (h30 + h12) * (pow(h30 + h12, 2) - 3 * pow(h21 + h03, 2)) + (3 * h21 - h03) * (h21 + h03) * (3 * pow(h30 + h12, 2) - pow(h21 + h03, 2)), 6) + 0.0,
   round((m20 - m02) / pow(n, 2) * (pow(h30 + h12, 2) - pow(h21 + h03, 2)) + 4 * m11 / pow(n, 2) * (h30 + h12) * (h21 + h03), 6) + 0.0,
   round((3 * h21 - h03) * (h30 + h12) * (pow(h30 + h12, 2) - 3 * pow(h21 + h03, 2)) - (h30 - 3 * h12) * (h21 + h03) * (3 * pow(h30 + h12, 2) - pow(h21 + h03, 2)), 6) + 0.0] AS hu FROM e""")
def _(t):
    d = G.morphology(blocks(t), TILE)
    return d.select("tile", "cell", "area", r("extent", 6).alias("extent"), *[r(c, 5).alias(c) for c in ("major_axis", "minor_axis", "eccentricity")],
                    F.transform("hu_moments", lambda x: r(x, 6) + 0.0).alias("hu"))  # no negative zeros


# vertices - edges + faces of the union of pixel squares
@query("euler_numbers", f"""
WITH {PX}, {LAB}, c AS (SELECT * FROM lab WHERE cell > 0), s AS (SELECT unnest([0, 1]) AS s),
v AS (SELECT tile, cell, count(DISTINCT (i + a.s, j + b.s)) AS n FROM c, s a, s b GROUP BY ALL),
h AS (SELECT tile, cell, count(DISTINCT (i + s, j)) AS n FROM c, s GROUP BY ALL), w AS (SELECT tile, cell, count(DISTINCT (i, j + s)) AS n FROM c, s GROUP BY ALL),
f AS (SELECT tile, cell, count(*) AS n FROM c GROUP BY ALL)
SELECT tile, cell, v.n - h.n - w.n + f.n AS euler FROM v JOIN h USING (tile, cell) JOIN w USING (tile, cell) JOIN f USING (tile, cell)""")
def _(t):
    return G.euler_numbers(blocks(t), TILE)


@query("perimeters", f"""
WITH {PX}, {LAB}, c AS (SELECT tile, cell, i, j FROM lab WHERE cell > 0),
b AS (SELECT c.* FROM c LEFT JOIN c n ON c.tile = n.tile AND c.cell = n.cell AND abs(c.i - n.i) + abs(c.j - n.j) = 1 GROUP BY ALL HAVING count(n.i) < 4),
k AS (SELECT b.tile, b.cell, b.i, b.j, 1 + sum(CASE WHEN abs(b.i - n.i) + abs(b.j - n.j) = 1 THEN 2 WHEN abs(b.i - n.i) = 1 AND abs(b.j - n.j) = 1 THEN 10 ELSE 0 END) AS code
  FROM b JOIN b n ON b.tile = n.tile AND b.cell = n.cell AND abs(b.i - n.i) <= 1 AND abs(b.j - n.j) <= 1 GROUP BY ALL)
SELECT tile, cell, round(sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM k GROUP BY ALL""")
def _(t):
    return G.perimeters(blocks(t), TILE).withColumn("perimeter", r("perimeter", 6))


def zernike_sql(n, m):
    """Magnitude of one moment from its definition, over pixels (v, rho, phi)."""
    f = math.factorial
    terms = " + ".join(
        f"({(-1) ** k * f(n - k) // (f(k) * f((n + m) // 2 - k) * f((n - m) // 2 - k))}) * pow(rho, {n - 2 * k})" for k in range((n - m) // 2 + 1))
    return f"round({n + 1} / pi() * sqrt(pow(sum(v * ({terms}) * cos({m} * phi)), 2) + pow(sum(v * ({terms}) * sin({m} * phi)), 2)), 5)"


ORDERS = [(n, m) for n in range(10) for m in range(n + 1) if (n - m) % 2 == 0]


@query("zernike_moments", f"""
WITH {PX}, {LAB}, c AS (SELECT tile, cell, sum(value * i) / sum(value) AS ci, sum(value * j) / sum(value) AS cj, sum(value) AS s FROM lab WHERE cell > 0 GROUP BY ALL),
p AS (SELECT tile, cell, value / s AS v, sqrt(pow(i - ci, 2) + pow(j - cj, 2)) / 9 AS rho, atan2(i - ci, j - cj) AS phi FROM lab JOIN c USING (tile, cell))
SELECT tile, cell, [{", ".join(zernike_sql(*o) for o in ORDERS)}] AS zernike FROM p WHERE rho <= 1 GROUP BY ALL""")
def _(t):
    z = G.zernike(blocks(t), channels(t), TILE, "c0")
    return z.select("tile", "cell", F.transform("zernike", lambda x: r(x, 5)).alias("zernike"))


@query("threshold_adjacency", f"""
WITH {PX}, {LAB}, box AS (SELECT tile, cell, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM lab WHERE cell > 0 GROUP BY ALL),
p AS (SELECT p.tile, b.cell, p.i, p.j, p.value AS v FROM box b JOIN px p ON p.tile = b.tile AND p.i BETWEEN i0 AND i1 AND p.j BETWEEN j0 AND j1),
o AS (SELECT a.tile, a.cell, a.v AS t, count(*) FILTER (b.v <= a.v) AS n0, count(*) FILTER (b.v > a.v) AS n1, avg(b.v) FILTER (b.v <= a.v) AS m0, avg(b.v) FILTER (b.v > a.v) AS m1
  FROM (SELECT DISTINCT tile, cell, v FROM p) a JOIN p b USING (tile, cell) GROUP BY ALL),
t AS (SELECT tile, cell, t FROM o QUALIFY row_number() OVER (PARTITION BY tile, cell ORDER BY round(coalesce(n0 * n1 * (m0 - m1) * (m0 - m1), -1), 6) DESC, t) = 1),
l AS (SELECT tile, cell, avg(v) AS mu, stddev_pop(v) AS sd FROM p JOIN t USING (tile, cell) WHERE v > t GROUP BY ALL),
m AS (SELECT tile, cell, i, j, (v > mu)::INT AS c, (v > mu - sd)::INT AS b FROM p JOIN l USING (tile, cell)),
n AS (SELECT x.tile, x.cell, x.i, x.j, any_value(x.c) AS c, any_value(x.b) AS b, sum(y.c) FILTER (y.i <> x.i OR y.j <> x.j) AS nc, sum(1 - y.b) FILTER (y.i <> x.i OR y.j <> x.j) AS nb
  FROM m x JOIN m y ON x.tile = y.tile AND x.cell = y.cell AND abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 GROUP BY ALL)
SELECT tile, cell, round(coalesce(count(*) FILTER (c = 1 AND coalesce(nc, 0) = 0) / nullif(count(*) FILTER (c = 1), 0), 0), 6) AS lone, round(coalesce(count(*) FILTER (b = 0 AND coalesce(nb, 0) = 3) / nullif(count(*) FILTER (b = 0), 0), 0), 6) AS dark3 FROM n GROUP BY ALL""")
def _(t):
    d = G.threshold_adjacency(blocks(t), channels(t), TILE, "c0")
    # mask above the mean, no neighbours; negative of the lower-bound mask, three neighbours
    return d.select("tile", "cell", r(F.col("tas")[18], 6).alias("lone"), r(F.col("tas")[27 + 9 + 3], 6).alias("dark3"))


@query("ring_masks", f"""
WITH {PX}, {LAB}, d AS (SELECT a.tile, a.i, a.j, max(b.cell) AS label FROM lab a JOIN lab b ON a.tile = b.tile AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL),
e AS (SELECT a.tile, a.i, a.j, min(b.cell) AS low FROM lab a JOIN lab b ON a.tile = b.tile AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL)
SELECT 'outer' AS ring, tile, i, j, label FROM d JOIN lab USING (tile, i, j) WHERE cell = 0 AND label > 0 UNION ALL SELECT 'inner', tile, i, j, cell FROM lab JOIN e USING (tile, i, j) WHERE cell > 0 AND low = 0""")
def _(t):
    outer, inner = R.rings(blocks(t).filter("label > 0"), plane(t), TILE, 3)
    return outer.withColumn("ring", F.lit("outer")).unionByName(inner.withColumn("ring", F.lit("inner")))


@query("extract_bases", f"""
WITH {PX}, {EXTREMES}, sp AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY i, j) - 1 AS read FROM ext WHERE value = hi AND value > 1200)
SELECT tile, i, j, 1 AS cycle, 'G' AS channel, hi AS intensity, read, CASE WHEN value > 1000 THEN 1 + (i // 4) * 2 + (j // 4) ELSE 0 END::INTEGER AS cell FROM sp""")
def _(t):
    p = plane(t)
    top = R.max_filter(p, TILE, 3)
    peaks = R.extreme_filter(p, TILE, 3).withColumn("value", F.when(F.col("value") == F.col("max"), F.col("value")).otherwise(0)).drop("max")
    maxed = top.withColumns({"cycle": F.lit(1), "channel": F.lit("G")})
    return R.extract_bases(maxed, peaks, blocks(t), TILE, 1200)


@query("thresholded_channel_correlation", f"""
WITH {PX} SELECT tile // 10 AS plate, round(avg(c), 6) AS r FROM (SELECT tile, corr(value, c1) AS c FROM px WHERE value > 900 AND c1 > 900 GROUP BY 1) GROUP BY 1""")
def _(t):
    per = tiles(t).filter("value > 900 AND c1 > 900").groupBy("tile").agg(F.corr("value", "c1").alias("c"))
    return per.groupBy(F.floor(F.col("tile") / 10).alias("plate")).agg(r(F.avg("c"), 6).alias("r"))


# --- outlines ------------------------------------------------------------------

@query("region_hulls", f"""
WITH {PX}, {LAB}, rw AS (SELECT tile, cell, i, min(j) AS a, max(j) AS b, count(*) AS n FROM lab WHERE cell > 0 GROUP BY ALL),
p AS (SELECT DISTINCT tile, cell, 2 * i + d AS y, 2 * CASE e WHEN 0 THEN a ELSE b END + CASE WHEN d <> 0 THEN 0 WHEN e = 0 THEN -1 ELSE 1 END AS x FROM rw, (SELECT unnest([-1, 0, 1]) AS d), (SELECT unnest([0, 1]) AS e)),
e AS (SELECT a.tile, a.cell, a.y AS ay, a.x AS ax, b.y AS zy, b.x AS zx FROM p a JOIN p b ON a.tile = b.tile AND a.cell = b.cell AND (a.y <> b.y OR a.x <> b.x) JOIN p c ON a.tile = c.tile AND a.cell = c.cell
  GROUP BY ALL HAVING min((b.y - a.y) * (c.x - a.x) - (b.x - a.x) * (c.y - a.y)) >= 0),
o AS (SELECT tile, cell, ay, ax, arg_min(zy, (zy - ay) ** 2 + (zx - ax) ** 2) AS zy, arg_min(zx, (zy - ay) ** 2 + (zx - ax) ** 2) AS zx FROM e GROUP BY ALL),
ar AS (SELECT tile, cell, abs(sum(ay * zx - zy * ax)) / 8 AS hull_area FROM o GROUP BY ALL),
inside AS (SELECT px.tile, e.cell, px.i, px.j FROM px JOIN e USING (tile) GROUP BY ALL HAVING min((zy - ay) * (2 * px.j - ax) - (zx - ax) * (2 * px.i - ay)) >= 0),
cv AS (SELECT tile, cell, count(*) AS convex_area FROM inside GROUP BY ALL), n AS (SELECT tile, cell, sum(n)::BIGINT AS area FROM rw GROUP BY ALL)
SELECT tile, cell, area, hull_area::DOUBLE AS hull_area, convex_area, area::DOUBLE / convex_area AS solidity FROM n JOIN ar USING (tile, cell) JOIN cv USING (tile, cell)""")
def _(t):
    return shapes.hulls(blocks(t), TILE, band=2).drop("hull")


SIDES_SQL = " UNION ALL ".join(
    f"SELECT tile, cell, {d} AS d, i + {s[0]} AS y, j + {s[1]} AS x, i + {e[0]} AS ty, j + {e[1]} AS tx FROM spot ANTI JOIN (SELECT tile, cell, i - {n[0]} AS i, j - {n[1]} AS j FROM spot) USING (tile, cell, i, j)"
    for d, (s, e, n) in enumerate(shapes.SIDES))


@query("region_contours", f"""
WITH RECURSIVE {PX}, {LAB}, spot AS (SELECT tile, cell, i, j FROM lab WHERE cell > 0), sd AS ({SIDES_SQL}),
nx AS (SELECT a.tile, a.cell, (a.y * 100 + a.x) * 4 + a.d AS s, arg_min((b.y * 100 + b.x) * 4 + b.d, (b.d - a.d + 5) % 4) AS t FROM sd a JOIN sd b ON a.tile = b.tile AND a.cell = b.cell AND a.ty = b.y AND a.tx = b.x GROUP BY ALL),
w AS (SELECT tile, cell, s AS head, s AS here, 0 AS place FROM nx UNION ALL SELECT w.tile, w.cell, w.head, nx.t, place + 1 FROM w JOIN nx ON w.tile = nx.tile AND w.cell = nx.cell AND w.here = nx.s WHERE nx.t <> w.head),
l AS (SELECT tile, cell, head, count(*) AS length FROM w GROUP BY ALL HAVING min(here) = head), o AS (SELECT *, row_number() OVER (PARTITION BY tile, cell ORDER BY head)::INTEGER AS loop FROM l)
SELECT w.tile, w.cell, loop, length, place::BIGINT AS place, (here // 400)::INTEGER AS y, ((here // 4) % 100)::INTEGER AS x FROM w JOIN o USING (tile, cell, head)""")
def _(t):
    return shapes.contours(blocks(t), TILE)
