"""Queries for triangle hashing and tile alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.plans.queries_spatial import POINTS, order_points
from tessera.plans.registry import query

# second acquisition: turned a little and 1.07 times larger
TURN = ((1.0695, 0.0327), (-0.0327, 1.0695))


PER_TILE = 600


def tile_points(t):
    """Fields of view of fixed size: more orders make more tiles."""
    return order_points(t).select(F.floor(F.col("id") / PER_TILE).alias("tile"), "i", "j")


def site_points(t):
    return tile_points(t).select(F.col("tile").alias("site"), (F.col("i") * TURN[0][0] + F.col("j") * TURN[0][1] + 12).alias("i"),
                                 (F.col("i") * TURN[1][0] + F.col("j") * TURN[1][1] + 40).alias("j"))


def positions(t, name):
    k = F.floor(F.col("o_orderkey") / PER_TILE)
    return t.orders.select(k.alias(name)).distinct().select(
        name, (F.col(name) % 5 * 1000).cast("double").alias("x"), (F.floor(F.col(name) / 5) * 1000).cast("double").alias("y"))


SMALL = 15
_MOVES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a.o"), ("b", "a.o"), ("b", "b.o"), ("c", "b.o"), ("c", "c.o"), ("a", "c.o")]


# small fields of view: a triangle belongs to the triangulation if no point lies inside its circle
@query("find_triangles", f"""
WITH {POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY i, j) AS n FROM (SELECT DISTINCT id // {SMALL} AS tile, i, j FROM pt)),
t0 AS (SELECT a.tile, a.n AS a, b.n AS b, c.n AS c, (b.i - a.i) * (c.j - a.j) - (b.j - a.j) * (c.i - a.i) AS turn FROM p a JOIN p b ON a.tile = b.tile AND a.n < b.n JOIN p c ON b.tile = c.tile AND b.n < c.n),
t AS (SELECT tile, row_number() OVER () AS t, a, CASE WHEN turn > 0 THEN b ELSE c END AS b, CASE WHEN turn > 0 THEN c ELSE b END AS c FROM t0 WHERE turn <> 0),
r AS (SELECT t.tile, t, t.a, t.b, t.c, a.i - d.i AS ai, a.j - d.j AS aj, b.i - d.i AS bi, b.j - d.j AS bj, c.i - d.i AS ci, c.j - d.j AS cj FROM t
  JOIN p a ON a.tile = t.tile AND a.n = t.a JOIN p b ON b.tile = t.tile AND b.n = t.b JOIN p c ON c.tile = t.tile AND c.n = t.c JOIN p d ON d.tile = t.tile AND d.n NOT IN (t.a, t.b, t.c)),
e AS (SELECT tile, t, a, b, c FROM r GROUP BY ALL
  HAVING max((ai * ai + aj * aj) * (bi * cj - ci * bj) - (bi * bi + bj * bj) * (ai * cj - ci * aj) + (ci * ci + cj * cj) * (ai * bj - bi * aj)) <= 0),
h AS (SELECT tile, t, 0 AS side, a AS u, b AS v, c AS w FROM e UNION ALL SELECT tile, t, 1, b, c, a FROM e UNION ALL SELECT tile, t, 2, c, a, b FROM e),
m AS (SELECT h.tile, h.t, h.side, u.i, u.j, v.i AS vi, v.j AS vj, q.i AS oi, q.j AS oj FROM h JOIN h o ON o.tile = h.tile AND o.u = h.v AND o.v = h.u
  JOIN p u ON u.tile = h.tile AND u.n = h.u JOIN p v ON v.tile = h.tile AND v.n = h.v JOIN p q ON q.tile = h.tile AND q.n = o.w),
g AS (SELECT tile, t, arg_max(side, (vi - i) * (vi - i) + (vj - j) * (vj - j)) AS l, list({{'i': i, 'j': j, 'o': {{'i': oi, 'j': oj}}}} ORDER BY side) AS s FROM m GROUP BY ALL HAVING count(*) = 3),
k AS (SELECT tile, s[l % 3 + 1] AS a, s[(l + 1) % 3 + 1] AS b, s[(l + 2) % 3 + 1] AS c FROM g)
SELECT tile, [{", ".join(f"round({q}.{d} - {o}.{d}, 4)" for o, q in _MOVES for d in "ij")}] AS v, [round((a.i + b.i + c.i) / 3, 4), round((a.j + b.j + c.j) / 3, 4)] AS c,
  round(sqrt(pow(b.i - a.i, 2) + pow(b.j - a.j, 2)), 4) AS magnitude FROM k""")
def _(t):
    points = order_points(t).select(F.floor(F.col("id") / SMALL).alias("tile"), "i", "j")
    d = A.find_triangles(points, ["tile"], "tile bigint")
    return d.select("tile", F.transform("v", lambda x: F.round(x, 4)).alias("v"), F.transform("c", lambda x: F.round(x, 4)).alias("c"), F.round("magnitude", 4).alias("magnitude"))


# every site is a moved copy of the tile of the same number
@query("multistep_alignment", "SELECT DISTINCT o_orderkey // 600 AS tile, o_orderkey // 600 AS site, 1.0::DOUBLE AS score, 1.1449::DOUBLE AS determinant FROM orders")
def _(t):
    tri_0 = A.find_triangles(tile_points(t), ["tile"], "tile bigint")
    tri_1 = A.find_triangles(site_points(t), ["site"], "site bigint")
    d = A.multistep_alignment(tri_0, tri_1, positions(t, "tile"), positions(t, "site"), initial_sites=5, batch_size=40)
    d = d.filter("score > 0.1 AND determinant BETWEEN 1.125 AND 1.186")
    return d.select("tile", "site", F.round("score", 4).alias("score"), F.round("determinant", 4).alias("determinant"))
