"""Queries for spatial joins, clusters and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import spatial, tabular as T, tracking
from tessera.plans.queries_reads import LINE, LINE_SQL
from tessera.plans.registry import query
from tessera.plans.sqltext import inverse4

r = F.round


def order_points(t):
    """Every order is a point in one of 20 tiles of 1000 x 1000 pixels."""
    return t.orders.select(
        (F.col("o_custkey") % 20).alias("tile"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("barcode"),
        ((F.round(F.col("o_totalprice") * 100).cast("bigint") % 100000) / 100.0).alias("i"),
        ((F.col("o_orderkey") * 37) % 1000).cast("double").alias("j"))


POINTS = """
pt AS (SELECT o_custkey % 20 AS tile, o_orderkey AS id, o_orderpriority AS barcode, (round(o_totalprice * 100)::BIGINT % 100000) / 100.0::DOUBLE AS i,
  ((o_orderkey * 37) % 1000)::DOUBLE AS j FROM orders)"""
DIST = "sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))"


@query("nearest_distance", f"WITH {POINTS} SELECT a.tile, a.id, round(min({DIST}), 6) AS min_dist FROM pt a JOIN pt b ON a.tile = b.tile AND a.id <> b.id GROUP BY ALL")
def _(t):
    d = spatial.nearest_distance(order_points(t), ["tile"], ("i", "j"), "id")
    return d.withColumn("min_dist", r("min_dist", 6))


@query("crowding_gate", f"""
WITH {POINTS}, d AS (SELECT a.id, min({DIST}) AS min_dist FROM pt a JOIN pt b ON a.tile = b.tile AND a.id <> b.id GROUP BY ALL)
SELECT pt.id, i, j FROM pt JOIN d USING (id) WHERE min_dist > 13 AND i - 23 >= 0 AND i + 23 <= 1000 AND j - 23 >= 0 AND j + 23 <= 1000""")
def _(t):
    p = order_points(t)
    far = spatial.nearest_distance(p, ["tile"], ("i", "j"), "id").filter("min_dist > 13")
    inside = p.filter("i - 23 >= 0 AND i + 23 <= 1000 AND j - 23 >= 0 AND j + 23 <= 1000")
    return inside.join(far.hint("merge"), ["tile", "id"], "left_semi").select("id", "i", "j")


@query("three_nearest", f"""
WITH {POINTS}, a AS (SELECT * FROM pt WHERE barcode = '1-URGENT'), b AS (SELECT * FROM pt WHERE barcode = '2-HIGH')
SELECT a.tile, a.id, b.id AS neighbor, round({DIST}, 6) AS distance, row_number() OVER (PARTITION BY a.tile, a.id ORDER BY {DIST}, b.id)::INTEGER AS rank FROM a JOIN b ON a.tile = b.tile
QUALIFY row_number() OVER (PARTITION BY a.tile, a.id ORDER BY {DIST}, b.id) <= 3""")
def _(t):
    p = order_points(t)
    d = spatial.knn(p.filter("barcode = '1-URGENT'"), p.filter("barcode = '2-HIGH'"), ["tile"], ("i", "j"), 3)
    return d.withColumn("distance", r("distance", 6))


@query("neighbor_lists", """
WITH s AS (SELECT p_partkey AS site, (p_partkey % 50 * 100)::DOUBLE AS i, (p_partkey // 50 * 100 + CASE WHEN p_size = 7 THEN 35 ELSE 0 END)::DOUBLE AS j FROM part),
n AS (SELECT a.site, b.site AS o, sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) AS d FROM s a, s b
  QUALIFY row_number() OVER (PARTITION BY a.site ORDER BY d, b.site) <= 9),
l AS (SELECT site, max(d) AS reach, list_sort(list(o)) AS ix FROM n GROUP BY 1),
m AS (SELECT trunc(reach) AS m FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT s.site, array_to_string(k.ix, ',') AS ix FROM s LEFT JOIN (SELECT l.* FROM l, m WHERE reach < m + 10) k USING (site)""")
def _(t):
    s = t.part.select(F.col("p_partkey").alias("site"), (F.col("p_partkey") % 50 * 100).cast("double").alias("i"),
                      (F.floor(F.col("p_partkey") / 50) * 100 + F.when(F.col("p_size") == 7, 35).otherwise(0)).cast("double").alias("j"))
    d = spatial.neighbor_lists(s, "site", ("i", "j"))
    return d.select("site", F.when(F.col("ix").isNotNull(), F.array_join("ix", ",")).alias("ix"))


@query("merge_matched_points", f"""
WITH {POINTS}, a AS (SELECT tile, id AS cell_0, i AS i_0, j AS j_0, 0.98 * i - 0.02 * j + 5 AS i, 0.02 * i + 0.98 * j - 3 AS j FROM pt WHERE id % 2 = 0),
b AS (SELECT tile, id AS cell_1, i, j FROM pt WHERE id % 2 = 1)
SELECT b.tile, cell_0, i_0, j_0, cell_1, b.i AS i_1, b.j AS j_1, round({DIST}, 6) AS distance FROM a JOIN b ON a.tile = b.tile
WHERE {DIST} < 12 QUALIFY row_number() OVER (PARTITION BY b.tile, cell_1 ORDER BY {DIST}, cell_0) = 1""")
def _(t):
    p = order_points(t).withColumnRenamed("id", "cell").drop("barcode")
    model = {"rotation": F.array(F.array(F.lit(0.98), F.lit(-0.02)), F.array(F.lit(0.02), F.lit(0.98))), "translation": F.array(F.lit(5.0), F.lit(-3.0))}
    left = p.filter("cell % 2 = 0").withColumns(model)
    d = spatial.merge_matched_points(left, p.filter("cell % 2 = 1"), ["tile"], 12.0)
    return d.withColumn("distance", r("distance", 6))


CLUSTERS = f"""
WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS x, b.id AS y FROM pt a JOIN pt b ON a.barcode = b.barcode AND a.id <> b.id AND {DIST} <= 8),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x AS id, least(x, min(y)) AS cluster FROM reach GROUP BY x)"""


@query("barcode_clusters", f"{CLUSTERS} SELECT id, coalesce(cluster, -1) AS cluster FROM pt LEFT JOIN c USING (id)")
def _(t):
    return spatial.clusters(order_points(t), ["barcode"], ("i", "j"), 8.0, "id").select("id", "cluster")


@query("index_singletons", f"""
{CLUSTERS}, d AS (SELECT id, coalesce(cluster, -1) AS cluster FROM pt LEFT JOIN c USING (id))
SELECT id, CASE WHEN cluster >= 0 THEN cluster ELSE (SELECT max(cluster) FROM d) + row_number() OVER (PARTITION BY cluster = -1 ORDER BY id) END AS cluster FROM d""")
def _(t):
    from tessera.session import cut_lineage
    d = cut_lineage(spatial.clusters(order_points(t), ["barcode"], ("i", "j"), 8.0, "id").select("id", "cluster"))
    return spatial.index_singletons(d, "cluster", [F.col("id")])


# --- tracking ------------------------------------------------------------

FRAMES = 7


def line_nuclei(t):
    """Line items are nuclei; those of an order lie close, one frame per line number."""
    k = F.col("l_orderkey")
    return t.lineitem.select((k % 40).alias("tile"), (F.col("l_linenumber") - 1).alias("frame"), F.expr(LINE).alias("label"),
                             ((k * 37) % 1000 + F.col("l_quantity") / 10).alias("i"), ((k * 91) % 997 + F.col("l_discount") * 50).alias("j"))


NUCLEI = f"""
li AS (SELECT l_orderkey AS k, l_linenumber, {LINE_SQL} AS label, l_quantity AS q, l_discount AS d FROM lineitem),
n AS (SELECT k % 40 AS tile, l_linenumber - 1 AS frame, label, (k * 37) % 1000 + q / 10 AS i, (k * 91) % 997 + d * 50 AS j FROM li),
e AS (SELECT a.tile, a.frame, a.label, b.label AS prev, {DIST} AS distance FROM n a JOIN n b ON a.tile = b.tile AND a.frame = b.frame + 1
  QUALIFY row_number() OVER (PARTITION BY a.tile, a.frame, a.label ORDER BY {DIST}, b.label) <= 3)"""


def layers():
    out = ["d0 AS (SELECT tile, label, 0.0::DOUBLE AS cost, [label] AS path FROM n WHERE frame = 0)"]
    for f in range(1, FRAMES):
        out.append(f"""d{f} AS (SELECT tile, label, cost, list_append(path, label) AS path FROM (SELECT e.tile, e.label, cost + distance AS cost, path FROM e JOIN d{f - 1} p ON e.tile = p.tile AND e.prev = p.label
  WHERE e.frame = {f} AND cost + distance <= 100) QUALIFY row_number() OVER (PARTITION BY tile, label ORDER BY cost, path) = 1)""")
    return ",\n".join(out)


TRACKS = f"""{NUCLEI}, {layers()},
st AS (SELECT tile, label AS fin, cost, unnest(range({FRAMES})) AS frame, unnest(path) AS label FROM d{FRAMES - 1}),
bad AS (SELECT DISTINCT tile, fin FROM st JOIN (SELECT tile, frame, label FROM st GROUP BY ALL HAVING count(*) > 1) USING (tile, frame, label)),
good AS (SELECT d.*, row_number() OVER (PARTITION BY d.tile ORDER BY path[1]) AS track FROM d{FRAMES - 1} d LEFT JOIN bad ON d.tile = bad.tile AND d.label = bad.fin WHERE bad.fin IS NULL AND cost <= {8 * FRAMES})"""


@query("frame_edges", f"WITH {NUCLEI} SELECT tile, frame, label, prev, round(distance, 6) AS distance FROM e")
def _(t):
    return tracking.frame_edges(line_nuclei(t), ["tile"]).withColumn("distance", r("distance", 6))


@query("track_nuclei", f"WITH {TRACKS} SELECT tile, track, round(cost, 6) AS cost, unnest(range({FRAMES}))::INTEGER AS frame, unnest(path) AS label FROM good")
def _(t):
    return tracking.track_nuclei(line_nuclei(t), ["tile"], FRAMES).withColumn("cost", r("cost", 6))


@query("relabel_by_track", f"""
WITH {TRACKS}, tr AS (SELECT tile, track, unnest(range({FRAMES})) AS frame, unnest(path) AS label FROM good)
SELECT n.tile, n.frame::INTEGER AS frame, i, j, coalesce(track, 0) AS label FROM n LEFT JOIN tr USING (tile, frame, label)""")
def _(t):
    from tessera.session import cut_lineage
    n = cut_lineage(line_nuclei(t))
    return tracking.relabel(n, tracking.track_nuclei(n, ["tile"], FRAMES), ["tile"])


# --- time courses --------------------------------------------------------

def live_cells(t):
    e = t.events
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return e.select("event_id", day.alias("frame"), "event_type", F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("well"),
                    (F.col("user_id") % 5).alias("site"), F.col("user_id").alias("cell_ph"), F.col("value").alias("dapi_max"), (F.col("value") / 500).alias("corr"))


LIVE = """
lv AS (SELECT event_id, datediff('day', TIMESTAMP '2024-01-01', ts)::INTEGER AS frame, event_type, 'w' || (user_id % 3)::VARCHAR AS well, user_id % 5 AS site, user_id AS cell_ph, value AS dapi_max, value / 500 AS corr FROM events)"""
STAMP = "(180.0 + (dense_rank() OVER (ORDER BY frame, well, site) - 1) * (1440.0::DOUBLE / 728)) / 3600"


@query("estimated_timestamps", f"WITH {LIVE} SELECT event_id, round({STAMP}, 8)::DOUBLE AS timestamp FROM lv")
def _(t):
    return tracking.add_timestamps(live_cells(t)).select("event_id", r("timestamp", 8).alias("timestamp"))


@query("relative_range", f"""
WITH {LIVE}, p AS (SELECT well, site, cell_ph, frame, avg(dapi_max) AS v FROM lv GROUP BY ALL), q AS (SELECT *, v / avg(v) OVER (PARTITION BY frame) AS rel FROM p),
s AS (SELECT well, site, cell_ph, max(rel) - min(rel) AS dapi_diff FROM q GROUP BY ALL) SELECT event_id, round(dapi_diff, 6) AS dapi_diff FROM lv JOIN s USING (well, site, cell_ph)""")
def _(t):
    return tracking.add_range(live_cells(t), "dapi_max").select("event_id", r("dapi_diff", 6).alias("dapi_diff"))


_DET, _INVERSE = inverse4("g")


@query("control_baseline", f"""
WITH {LIVE}, ts AS (SELECT event_id, event_type, corr, {STAMP} AS ts FROM lv), mn AS (SELECT ts, avg(corr) AS y FROM ts WHERE event_type = 'view' GROUP BY 1),
sp AS (SELECT min(ts) AS t0, max(ts) - min(ts) AS tw FROM mn), u AS (SELECT (ts - t0) / tw * 2 - 1 AS u, y FROM mn, sp),
sm AS (SELECT [{", ".join(f"sum(pow(u, {a + b}))" for a in range(4) for b in range(4))}] AS g, [{", ".join(f"sum(y * pow(u, {a}))" for a in range(4))}] AS h FROM u),
dt AS (SELECT g, h, {_DET} AS det FROM sm), cf AS (SELECT list_transform([{_INVERSE}], lambda row: list_dot_product(row, h)) AS c FROM dt),
f AS (SELECT event_id, corr, c, (ts - t0) / tw * 2 - 1 AS u FROM ts, sp, cf)
SELECT event_id, round(c[1] + c[2] * u + c[3] * u * u + c[4] * u * u * u, 6) AS splined, round(corr - (c[1] + c[2] * u + c[3] * u * u + c[4] * u * u * u), 6) AS spline_diff FROM f""")
def _(t):
    d = tracking.add_baseline(tracking.add_timestamps(live_cells(t)), "corr", F.col("event_type") == "view")
    return d.select("event_id", r("splined", 6).alias("splined"), r("spline_diff", 6).alias("spline_diff"))
