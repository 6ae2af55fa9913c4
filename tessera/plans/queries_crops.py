"""Queries for crops: boxes around the disks of the suppliers' fields and around bright tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import crops
from tessera.plans.queries_raster import DISK, DISKS, PX, TILE, disks, plane
from tessera.plans.registry import query

r = F.round

# the box of the bright pixels of each tile
BOX = "bx AS (SELECT tile, min(i) AS i0, min(j) AS j0, max(i) + 1 AS i1, max(j) + 1 AS j1 FROM px WHERE value > 1150 GROUP BY 1)"


def boxes(t):
    on = plane(t).filter("value > 1150").groupBy("tile").agg(
        F.min("i").alias("i0"), F.min("j").alias("j0"), (F.max("i") + 1).alias("i1"), (F.max("j") + 1).alias("j1"))
    return on.withColumn("crop", F.col("tile"))


@query("padded_crops", f"""
WITH {PX}, {BOX}, s AS (SELECT tile, i0, j0, unnest(range(i1 - i0 + 6))::INTEGER AS i, j1 - j0 + 6 AS w FROM bx), q AS (SELECT *, unnest(range(w))::INTEGER AS j FROM s)
SELECT q.tile, q.i, q.j, coalesce(value, 0) AS value FROM q LEFT JOIN px ON px.tile = q.tile AND px.i = q.i + i0 - 3 AND px.j = q.j + j0 - 3""")
def _(t):
    return crops.padded_crops(plane(t), boxes(t), TILE, 3).drop("crop")


# sixteen tiles are a pile; masks are numbered by tile
@query("piled_masks", f"""
WITH {PX}, {BOX}, n AS (SELECT *, tile // 16 AS pile, row_number() OVER (PARTITION BY tile // 16 ORDER BY tile)::INTEGER AS number FROM bx), z AS (SELECT pile, max(i1 - i0) + 3 AS h, max(j1 - j0) + 3 AS w FROM n GROUP BY 1),
s AS (SELECT n.*, w, unnest(range(h))::INTEGER AS i FROM n JOIN z USING (pile)), q AS (SELECT *, unnest(range(w))::INTEGER AS j FROM s)
SELECT pile, tile, i, j, CASE WHEN i < i1 - i0 + 3 AND j < j1 - j0 + 3 THEN number ELSE 0 END AS value FROM q""")
def _(t):
    b = boxes(t).withColumn("pile", F.floor(F.col("tile") / 16))
    masks = crops.crop_masks(b, ["pile"], [F.col("tile")], 3).withColumnRenamed("crop", "tile")
    return crops.pile(masks, ["pile"], "tile").select("pile", "tile", "i", "j", "value")


FIELD = f"""
{DISKS}, f AS (SELECT tile, i, j, max(CASE WHEN {DISK} THEN value ELSE 100 END) AS value FROM c, (SELECT unnest(range(48))::INTEGER AS i), (SELECT unnest(range(48))::INTEGER AS j)
  WHERE i BETWEEN ci - 12 AND ci + 11 AND j BETWEEN cj - 12 AND cj + 11 GROUP BY ALL)"""


def sampled(side, wanted, source):
    """Bilinear resampling of ``source`` (tile, i, j, value), images of ``side``, with a dark rim and clipped values."""
    at = f"(o + 0.5::DOUBLE) * {side} / {wanted} - 0.5"
    return f"""
o AS (SELECT o::INTEGER AS o, floor({at})::INTEGER AS k, {at} - floor({at}) AS w FROM (SELECT unnest(range({wanted})) AS o)), tap AS (SELECT o, k, 1 - w AS w FROM o UNION ALL SELECT o, k + 1, w FROM o),
h AS (SELECT tile, o AS i, j, sum(value * w) AS v FROM {source} s JOIN tap ON s.i = tap.k GROUP BY ALL), g AS (SELECT tile, i, o AS j, sum(v * w) AS v FROM h JOIN tap ON h.j = tap.k GROUP BY ALL),
e AS (SELECT tile, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY 1), rs AS (SELECT tile, i, j, CASE WHEN v = 0 THEN 0 ELSE greatest(lo, least(hi, v)) END AS v FROM g JOIN e USING (tile))"""


# one crop per field, around its first disk: it reaches over the edge by 11 pixels
@query("resized_crops_64", f"""
WITH {FIELD}, n AS (SELECT s_suppkey AS tile, unnest(range(46))::INTEGER AS i FROM supplier), q AS (SELECT *, unnest(range(46))::INTEGER AS j FROM n),
cr AS (SELECT q.tile, q.i, q.j, coalesce(value, 0)::DOUBLE AS value FROM q LEFT JOIN f ON f.tile = q.tile AND f.i = q.i - 11 AND f.j = q.j - 11), {sampled(46, 64, "cr")}
SELECT tile, i, j, round(v, 4)::DOUBLE AS value FROM rs""")
def _(t):
    cells = t.supplier.select(F.col("s_suppkey").alias("tile"), F.lit(1).alias("cell"), F.lit(12.4).alias("ci"), F.lit(12.9).alias("cj"))
    return crops.cell_crops(disks(t), cells, TILE, 23, 64).select("tile", "i", "j", r("value", 4).alias("value"))


# all pixels of the large crops, as moments of every field
@query("resized_crops_299", f"""
WITH {FIELD}, cr AS (SELECT tile, i - 1 AS i, j - 1 AS j, value::DOUBLE AS value FROM f WHERE i BETWEEN 1 AND 46 AND j BETWEEN 1 AND 46), {sampled(46, 299, "cr")}
SELECT tile, count(*) AS n, round(sum(v), 2)::DOUBLE AS s, round(sum(v * i) / 1000, 3)::DOUBLE AS si, round(sum(v * j) / 1000, 3)::DOUBLE AS sj, round(sum(v * v) / 1000, 2)::DOUBLE AS ss, round(sum(v * i * j) / 1000000, 3)::DOUBLE AS sij,
  round(max(v), 4)::DOUBLE AS most FROM rs GROUP BY 1""")
def _(t):
    cells = t.supplier.select(F.col("s_suppkey").alias("tile"), F.explode(F.array(F.lit(24.0), F.lit(22.0))).alias("ci")).select(
        "tile", F.when(F.col("ci") == 24, 1).otherwise(2).alias("cell"), "ci", F.lit(24.0).alias("cj"))
    v, i, j = F.col("value"), F.col("i"), F.col("j")
    large = crops.cell_crops(disks(t), cells, TILE, 23, 299, "drop")  # the second cell is too near the edge
    return large.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(v), 2).alias("s"), r(F.sum(v * i) / 1000, 3).alias("si"), r(F.sum(v * j) / 1000, 3).alias("sj"),
        r(F.sum(v * v) / 1000, 2).alias("ss"), r(F.sum(v * i * j) / 1000000, 3).alias("sij"), r(F.max(v), 4).alias("most"))


# shrinking smooths first
@query("shrunk_fields", f"""
WITH {FIELD}, w AS (SELECT x - 2 AS d, exp(-0.5 * ((x - 2) / 0.5) ** 2) AS g FROM (SELECT unnest(range(5))::DOUBLE AS x)), bell AS (SELECT d::INTEGER AS d, g / (SELECT sum(g) FROM w) AS g FROM w),
a AS (SELECT tile, f.i - d AS i, j, sum(value * g) AS v FROM f, bell WHERE f.i - d BETWEEN 0 AND 47 GROUP BY ALL), b AS (SELECT tile, i, a.j - d AS j, sum(v * g) AS v FROM a, bell WHERE a.j - d BETWEEN 0 AND 47 GROUP BY ALL),
m AS (SELECT tile, (i // 2)::INTEGER AS i, (j // 2)::INTEGER AS j, avg(v) AS v FROM b GROUP BY ALL), e AS (SELECT tile, min(value) AS lo, max(value) AS hi FROM f GROUP BY 1)
SELECT tile, i, j, round(greatest(lo, least(hi, v)), 4)::DOUBLE AS value FROM m JOIN e USING (tile)""")
def _(t):
    return crops.resize(disks(t), TILE, (48, 48), (24, 24)).select("tile", "i", "j", r("value", 4).alias("value"))


# all rectangles of a tile by the sums over its corner blocks; those without a dark pixel count
@query("inscribed_rectangles", f"""
WITH {PX}, c AS (SELECT tile, i + 1 AS i, j + 1 AS j, sum(s) OVER (PARTITION BY tile, j ORDER BY i) AS s FROM (SELECT tile, i, j, sum((value <= 850)::INTEGER) OVER (PARTITION BY tile, i ORDER BY j) AS s FROM px)),
l AS (SELECT tile, list(s ORDER BY i, j) AS s FROM (SELECT tile, i, j, s FROM c UNION ALL SELECT vec_id, 0, k, 0 FROM embeddings, (SELECT unnest(range(9)) AS k) UNION ALL SELECT vec_id, k, 0, 0 FROM embeddings, (SELECT unnest(range(1, 9)) AS k)) GROUP BY 1),
e AS (SELECT a::INTEGER AS a, b::INTEGER AS b FROM (SELECT unnest(range(8)) AS a), (SELECT unnest(range(1, 9)) AS b) WHERE a < b), q AS (SELECT tile, y.a AS i0, x.a AS j0, y.b AS i1, x.b AS j1, s FROM l, e y, e x),
f AS (SELECT *, ((i1 - i0) * (j1 - j0))::BIGINT AS area FROM q WHERE s[i1 * 9 + j1 + 1] - s[i0 * 9 + j1 + 1] - s[i1 * 9 + j0 + 1] + s[i0 * 9 + j0 + 1] = 0)
SELECT tile, i0, j0, i1, j1, area FROM f QUALIFY row_number() OVER (PARTITION BY tile ORDER BY area DESC, i0, j0, i1, j1) = 1""")
def _(t):
    return crops.inscribed(plane(t).withColumn("good", F.col("value") > 850), TILE)


# three copies of a tile on one canvas, moved by up to three pixels: what is left is their common part
@query("trimmed_piles", f"""
WITH {PX}, m AS (SELECT tile, f, ((tile + f * 2) % 4)::INTEGER AS di, ((tile // 4 + f) % 4)::INTEGER AS dj FROM (SELECT DISTINCT tile FROM px), (SELECT unnest([0, 1, 2])::INTEGER AS f)),
b AS (SELECT tile, max(di) AS i0, max(dj) AS j0, min(di) + 8 AS i1, min(dj) + 8 AS j1 FROM m GROUP BY 1)
SELECT px.tile, f AS frame, i + di - i0 AS i, j + dj - j0 AS j, value + 1 AS value FROM px JOIN m USING (tile) JOIN b USING (tile) WHERE i + di >= i0 AND i + di < i1 AND j + dj >= j0 AND j + dj < j1""")
def _(t):
    k, f = F.col("tile"), F.col("frame")
    moved = plane(t).withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("value", F.col("value") + 1)
    moved = moved.withColumns({"i": (F.col("i") + (k + f * 2) % 4).cast("int"), "j": (F.col("j") + (F.floor(k / 4) + f) % 4).cast("int")})
    return crops.trim(crops.pile(moved, TILE, "frame"), TILE, "frame").select("tile", "frame", "i", "j", "value")
