"""Queries for registration and small stack operators, and table helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corners, raster as R, registration, statistics as S, tabular as T
from tessera.plans import workflows
from tessera.plans.queries_raster import DISK, DISKS, PX, TILE, disks, plane, spread
from tessera.plans.registry import query

r = F.round


def turned(p, di, dj):
    """Every 8 x 8 tile moved around its edges."""
    return p.withColumns({"i": ((F.col("i") + di) % 8).cast("int"), "j": ((F.col("j") + dj) % 8).cast("int")})


def back(di, dj, value="value"):
    """The tile again after a move by (di, dj) around the edges and a zero-filled one back."""
    inside = f"i BETWEEN {max(0, -di)} AND {7 - max(0, di)} AND j BETWEEN {max(0, -dj)} AND {7 - max(0, dj)}"
    return f"CASE WHEN {inside} THEN {value} ELSE 0 END::DOUBLE"


@query("aligned_within_cycle", f"""
WITH {PX} SELECT tile, 1 AS cycle, 'A' AS channel, i, j, value::DOUBLE AS value FROM px UNION ALL SELECT tile, 1, 'C', i, j, {back(2, -1)} FROM px""")
def _(t):
    p = plane(t)
    both = p.withColumn("channel", F.lit("A")).unionByName(turned(p, 2, 7).withColumn("channel", F.lit("C"))).withColumn("cycle", F.lit(1))
    return registration.align_within_cycle(both, TILE, upsample=1).select("tile", "cycle", "channel", "i", "j", "value")


# two base channels and a stain; the second cycle is moved as a whole
@query("aligned_by_bases", f"""
WITH {PX}, s AS (SELECT tile, i, j, value, c1 FROM px) SELECT tile, 1 AS cycle, channel, i, j, v::DOUBLE AS value FROM s, (SELECT unnest(['A', 'C', 'DAPI']) AS channel), LATERAL (SELECT CASE channel WHEN 'C' THEN value + 5 ELSE value END AS v)
UNION ALL SELECT tile, 2, channel, i, j, {back(1, 2, "v")} FROM s, (SELECT unnest(['A', 'C', 'DAPI']) AS channel), LATERAL (SELECT CASE channel WHEN 'C' THEN value + 5 ELSE value END AS v)""")
def _(t):
    p = plane(t).withColumn("channel", F.explode(F.array(*map(F.lit, ("A", "C", "DAPI")))))
    p = p.withColumn("value", F.when(F.col("channel") == "C", F.col("value") + 5).otherwise(F.col("value")))
    both = p.withColumn("cycle", F.lit(1)).unionByName(turned(p, 1, 2).withColumn("cycle", F.lit(2)))
    d = registration.align_cycles(both, TILE, "DAPI", "bases", within=False, upsample=1, window=1.0, cutoff=100.0)
    return d.select("tile", "cycle", "channel", "i", "j", "value")


@query("aligned_acquisitions", f"""
WITH {PX} SELECT tile, 0 AS channel, i, j, value::DOUBLE AS value FROM px UNION ALL SELECT tile, 1, i, j, {back(1, 6 - 8)} FROM px UNION ALL SELECT tile, 2, i, j, {back(1, 6 - 8, "(value * 2)")} FROM px""")
def _(t):
    p = plane(t)
    second = turned(p, 1, 6)
    second = second.withColumn("channel", F.lit(0)).unionByName(second.withColumns({"channel": F.lit(1), "value": F.col("value") * 2}))
    d = registration.align_acquisitions([p.withColumn("channel", F.lit(0)), second], [0, 0], [[0], [0, 1]], TILE, window=1.0)
    return d.select("tile", "channel", "i", "j", "value")


# odd tiles move too far and become zeros
@query("registered_or_failed", f"""
WITH {PX} SELECT tile, f AS frame, i, j, CASE WHEN tile % 2 = 1 THEN 0 WHEN f = 0 THEN value ELSE {back(2, -1)} END::DOUBLE AS value FROM px, (SELECT unnest([0, 1]) AS f)""")
def _(t):
    p = plane(t)
    far = turned(p, 3, 3).filter("tile % 2 = 1").unionByName(turned(p, 2, 7).filter("tile % 2 = 0"))
    both = p.withColumn("frame", F.lit(0)).unionByName(far.withColumn("frame", F.lit(1)))
    return registration.register_and_offset(both, TILE, "frame", limit=5).select("tile", "frame", "i", "j", "value")


def turned_spots(t, side=96, number=140, sigma=1.7):
    """A field of bright spots per supplier, and the same field turned by 1 to
    10 degrees about its centre and moved by whole pixels; spots are drawn at
    their exact places."""
    k, n = F.col("s_suppkey"), F.col("n")
    place = lambda salt: F.pmod(F.xxhash64(k, n, F.lit(salt)), F.lit(1000 * side)) / 1000.0
    supplier = spread(t.supplier, "s_suppkey")
    spots = supplier.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).select(
        k.alias("tile"), place(1).alias("y0"), place(2).alias("x0"), (300 + F.pmod(F.xxhash64(k, n, F.lit(3)), F.lit(2000))).alias("a"),
        F.radians((1 + k % 10) * (1 - 2 * (k % 2))).alias("turn"), (k % 5 - 2).alias("di"), (k % 3 - 1).alias("dj"))
    mid = (side - 1) / 2
    y, x, c, s = F.col("y0") - mid, F.col("x0") - mid, F.cos("turn"), F.sin("turn")
    both = spots.select("tile", "a", F.lit(0).alias("cycle"), F.col("y0").alias("y"), F.col("x0").alias("x")).unionByName(
        spots.select("tile", "a", F.lit(1).alias("cycle"), (y * c - x * s + mid + F.col("di")).alias("y"), (y * s + x * c + mid + F.col("dj")).alias("x")))
    near = F.sequence(F.lit(-6), F.lit(6))
    px = both.withColumn("i", F.explode(F.transform(near, lambda d: F.round("y").cast("int") + d))).withColumn("j", F.explode(F.transform(near, lambda d: F.round("x").cast("int") + d)))
    px = px.filter((F.col("i") >= 0) & (F.col("i") < side) & (F.col("j") >= 0) & (F.col("j") < side))
    light = F.col("a") * F.exp(-(F.pow(F.col("i") - F.col("y"), 2) + F.pow(F.col("j") - F.col("x"), 2)) / (2 * sigma * sigma))
    line = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    ground = supplier.select(k.alias("tile"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cycle")).withColumn("i", line).withColumn("j", line).withColumn("v", F.lit(0.0))
    drawn = px.select("tile", "cycle", "i", "j", light.alias("v")).unionByName(ground).groupBy("tile", "cycle", "i", "j").agg(F.sum("v").alias("v"))
    return drawn.select("tile", "cycle", "i", "j", F.round("v").cast("bigint").alias("value"))


# the turn in degrees, where the middle of the first cycle lies in the second one, and how far off the farthest corner is
@query("rotated_cycles", """
SELECT s_suppkey AS tile, ((1 + s_suppkey % 10) * (1 - 2 * (s_suppkey % 2)))::BIGINT AS turn, s_suppkey % 5 - 2 AS di, s_suppkey % 3 - 1 AS dj, TRUE AS within_half FROM supplier""")
def _(t):
    moves = corners.rigid_moves(turned_spots(t), TILE, "cycle").filter("cycle = 1")
    k, mid = F.col("tile"), 47.5
    truth = F.radians((1 + k % 10) * (1 - 2 * (k % 2)))

    def goes(y, x):
        """Where a place goes by the move, less where it goes in truth."""
        c, s = F.cos("turn"), F.sin("turn")
        tc, ts = F.cos(truth), F.sin(truth)
        di = y * c - x * s + F.col("si") - ((y - mid) * tc - (x - mid) * ts + mid + k % 5 - 2)
        dj = y * s + x * c + F.col("sj") - ((y - mid) * ts + (x - mid) * tc + mid + k % 3 - 1)
        return di, dj

    far = F.greatest(*[F.sqrt(a * a + b * b) for a, b in (goes(y, x) for y in (0, 95) for x in (0, 95))])
    di, dj = goes(mid, mid)
    return moves.select(
        "tile", r(F.degrees("turn")).cast("bigint").alias("turn"), r(di + k % 5 - 2).cast("bigint").alias("di"), r(dj + k % 3 - 1).cast("bigint").alias("dj"), (far < 0.5).alias("within_half"))


@query("fill_holes", f"""
WITH RECURSIVE {PX}, bg AS (SELECT tile, i, j FROM px WHERE value <= 950), o(d, e) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
outside AS (SELECT tile, i, j FROM bg WHERE i IN (0, 7) OR j IN (0, 7) UNION SELECT b.tile, b.i, b.j FROM outside s CROSS JOIN o JOIN bg b ON b.tile = s.tile AND b.i = s.i + o.d AND b.j = s.j + o.e)
SELECT tile, i, j FROM px WHERE value > 950 UNION ALL SELECT tile, i, j FROM (FROM bg ANTI JOIN outside USING (tile, i, j))""")
def _(t):
    p = plane(t)
    return R.fill_holes(p.filter("value > 950"), p, TILE)


@query("split_tiles", f"WITH {PX} SELECT tile, i // 3 AS part_i, j // 3 AS part_j, i % 3 AS i, j % 3 AS j, value FROM (SELECT tile, i::BIGINT AS i, j::BIGINT AS j, value FROM px)")
def _(t):
    d = R.split_tiles(plane(t), 3)
    return d.select("tile", "part_i", "part_j", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "value")


# parts of 3 pixels that reach 1 pixel over, summed: pixels near a cut count several times
@query("overlapping_parts", f"""
WITH {PX}, k AS (SELECT unnest(range(3)) AS k) SELECT tile, i, j, sum(value)::BIGINT AS value FROM px JOIN k a ON i BETWEEN a.k * 3 - 1 AND a.k * 3 + 3 JOIN k b ON j BETWEEN b.k * 3 - 1 AND b.k * 3 + 3 GROUP BY ALL""")
def _(t):
    return R.merge_chunks(R.split_overlapping(plane(t), 3, 1), TILE, "sum")


@query("remove_channels", "SELECT vec_id, label AS channel FROM embeddings WHERE label NOT IN (2, 5)")
def _(t):
    return R.remove_channels(t.embeddings.select("vec_id", F.col("label").alias("channel")), [2, 5])


@query("tracked_nuclei_from_pixels", f"""
WITH {DISKS}, p AS (SELECT c.*, i, j FROM c, (SELECT unnest(range(48))::INTEGER AS i), (SELECT unnest(range(48))::INTEGER AS j) WHERE {DISK}),
f AS (SELECT tile, k, min(i * 48 + j) AS first, count(*) AS area, any_value(value) AS v FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY first) AS label FROM f)
SELECT tile, label AS track, frame, label::INTEGER AS label, area, v::DOUBLE AS mean FROM n, (SELECT unnest([0, 1])::INTEGER AS frame)""")
def _(t):
    px = disks(t)
    moved = px.withColumn("j", (F.col("j") + 1) % 48).withColumn("frame", F.lit(1))
    both = px.withColumn("frame", F.lit(0)).unionByName(moved)
    d = workflows.live_tracks(both, 1000, 2, "tile bigint", TILE, radius=15, area_min=20, area_max=300)
    return d.select("tile", "track", F.col("frame").cast("int").alias("frame"), F.col("label").cast("int").alias("label"), "area", "mean")


# --- table helpers --------------------------------------------------------------

@query("category_codes", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def _(t):
    return T.category_codes(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("reindex", "SELECT n_nationkey AS place, c_custkey * 2 AS key, c_acctbal FROM nation LEFT JOIN customer ON c_custkey = n_nationkey * 7 WHERE c_custkey IS NOT NULL UNION ALL SELECT n_nationkey, n_nationkey * 14, NULL FROM nation WHERE n_nationkey * 7 NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    index = t.nation.select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey").cast("bigint") * 14).alias("key"))
    return T.reindex(t.customer.select((F.col("c_custkey") * 2).alias("key"), "c_acctbal"), index, "key").select("place", "key", "c_acctbal")


@query("matching_terms", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, 'BRASS$|^(PROMO|SMALL)|TIN')")
def _(t):
    return T.matching_terms(t.part.select("p_partkey", "p_type"), "p_type", ["BRASS$", "^(PROMO|SMALL)", "TIN"])


@query("log_ratios", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'nan'::DOUBLE WHEN l_tax = 0 THEN 'inf'::DOUBLE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE round(log2(l_discount / l_tax), 6) END AS ratio FROM lineitem""")
def _(t):
    ratio = T.log_ratio(F.col("l_discount"), F.col("l_tax"))
    finite = ~F.isnan(ratio) & (F.abs(ratio) < float("inf"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(finite, r(ratio, 6)).otherwise(ratio).alias("ratio"))


@query("lower_envelope", """
WITH d AS (SELECT event_type AS g, value AS x, count(*) AS n FROM events GROUP BY ALL),
k0 AS (SELECT g, x, sum(n) OVER (PARTITION BY g ORDER BY x) / sum(n) OVER (PARTITION BY g) AS y FROM d), q AS (SELECT unnest(range(101)) * 2.0::DOUBLE AS x),
v AS (SELECT k0.g, q.x, max(k0.x) FILTER (k0.x <= q.x) AS x0, arg_max(k0.y, k0.x) FILTER (k0.x <= q.x) AS y0, min(k0.x) FILTER (k0.x >= q.x) AS x1, arg_min(k0.y, k0.x) FILTER (k0.x >= q.x) AS y1 FROM k0, q GROUP BY ALL)
SELECT x, round(min(CASE WHEN x0 IS NULL THEN 0 WHEN x1 IS NULL THEN 1 ELSE y0 + (y1 - y0) * coalesce((x - x0) / nullif(x1 - x0, 0), 0) END), 6)::DOUBLE AS envelope FROM v GROUP BY 1""")
def _(t):
    return S.lower_envelope(t.events, "event_type", "value", 0.0, 200.0, 101).select(r("x", 6).alias("x"), r("envelope", 6).alias("envelope"))
