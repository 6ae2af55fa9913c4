"""Queries that run whole workflows and the intake of stage metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import workflows
from tessera.plans.queries_raster import CLIPPED, ORDERS, PX, log_ctes, plane, zernike_sql
from tessera.plans.queries_reads import base, quality_sql
from tessera.plans.registry import query
from tessera.sources import intake
from tessera.sources.tiles import sharpest_plane, slice_series

r = F.round


def stack(t):
    """Twenty embeddings are one site: 5 cycles of 4 base channels."""
    k = F.col("tile") % 20
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    return plane(t).select(
        F.lit("A1").alias("well"), F.floor(F.col("tile") / 20).alias("site"), (F.floor(k / 4) + 1).cast("int").alias("cycle"),
        F.element_at(letters, (k % 4 + 1).cast("int")).alias("channel"), "i", "j", "value")


def stack_cells(t):
    s = stack(t).select("well", "site", "i", "j").distinct()
    return s.withColumn("label", (F.floor(F.col("i") / 2)).cast("int"))


READS_SQL = f"""{PX}, {log_ctes()},
lg AS (SELECT tile // 20 AS site, ((tile % 20) // 4 + 1)::INTEGER AS cycle, (tile % 4)::INTEGER AS ch, i, j, {CLIPPED} AS v FROM col),
sd AS (SELECT site, i, j, avg(s) AS v FROM (SELECT site, ch, i, j, stddev_pop(v) AS s FROM lg GROUP BY ALL) GROUP BY ALL),
pk AS (SELECT a.site, a.i, a.j, any_value(a.v) AS v, max(b.v) AS hi, min(b.v) AS lo FROM sd a JOIN sd b ON a.site = b.site AND b.i BETWEEN a.i - 1 AND a.i AND b.j BETWEEN a.j - 1 AND a.j GROUP BY ALL),
spot AS (SELECT site, i, j, row_number() OVER (PARTITION BY site ORDER BY i, j) - 1 AS read FROM pk WHERE v = hi AND hi - lo > 10 AND i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5),
mx AS (SELECT s.site, s.i, s.j, s.read, cycle, ch, max(l.v) AS v FROM spot s JOIN lg l ON s.site = l.site AND abs(s.i - l.i) <= 1 AND abs(s.j - l.j) <= 1 GROUP BY ALL),
x AS (SELECT site, i, j, read, cycle, list(v ORDER BY ch) AS x FROM mx GROUP BY ALL),
rd AS (SELECT 'A1' AS well, site, read, (i // 2)::INTEGER AS cell, i, j, string_agg({base('x')}, '' ORDER BY cycle) AS barcode, min({quality_sql('x')}) AS q FROM x GROUP BY ALL)"""


@query("sequencing_reads_from_pixels", f"WITH {READS_SQL} SELECT well, site, read, cell, i, j, barcode, round(q, 6) AS Q_min FROM rd")
def _(t):
    return workflows.sequencing_reads(stack(t), stack_cells(t), 5, "ACGT", peak_width=2, threshold_peaks=10, correction="none").select(
        "well", "site", "read", "cell", "i", "j", "barcode", r("Q_min", 6).alias("Q_min"))


@query("sequencing_cells_from_pixels", f"""
WITH {READS_SQL}, n AS (SELECT well, site, cell, barcode, count(*) AS n FROM rd GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY well, site, cell ORDER BY n DESC, barcode) AS rk FROM n)
SELECT well, site, cell, max(barcode) FILTER (rk = 1) AS cell_barcode_0, max(n) FILTER (rk = 1) AS cell_barcode_count_0, max(barcode) FILTER (rk = 2) AS cell_barcode_1,
  max(n) FILTER (rk = 2) AS cell_barcode_count_1, sum(n)::BIGINT AS barcode_count FROM k GROUP BY ALL""")
def _(t):
    return workflows.sequencing_cells(stack(t), stack_cells(t), 5, "ACGT", peak_width=2, threshold_peaks=10, correction="none")


def compartment_sql(label):
    return f"""(WITH l AS (SELECT *, {label} AS cell FROM w), b AS (SELECT site, cell, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM l WHERE cell > 0 GROUP BY ALL),
  c AS (SELECT b.site, b.cell, corr(c0, c1) AS r FROM b JOIN w ON w.site = b.site AND w.i BETWEEN i0 AND i1 AND w.j BETWEEN j0 AND j1 WHERE c0 > 0 GROUP BY ALL)
  SELECT site, cell, avg(c1) AS gfp_mean, sum(c0)::BIGINT AS dapi_int, max(c1) AS gfp_max, count(*) AS area, any_value(CASE WHEN NOT isnan(r) THEN r END) AS corr, quantile_cont(c1::DOUBLE, 0.5) AS gfp_median FROM l JOIN c USING (site, cell) GROUP BY ALL)"""


QUAD = "1 + (i // 4) * 2 + (j // 4)"


@query("phenotype_from_pixels", f"""
WITH {PX}, w AS (SELECT tile // 2 AS site, i, j, max(value) FILTER (tile % 2 = 0) AS c0, max(value) FILTER (tile % 2 = 1) AS c1 FROM px GROUP BY ALL),
n AS {compartment_sql(f"CASE WHEN c0 > 1000 THEN {QUAD} ELSE 0 END")}, c AS {compartment_sql(QUAD)}
SELECT 'A1' AS well, site, cell::INTEGER AS cell, {", ".join(f"round({a}.{x}, 6) AS {y}_{s}" if x in ("gfp_mean", "corr") else f"{a}.{x} AS {y}_{s}"
  for a, s in (("n", "nuclear"), ("c", "cell")) for x, y in (("gfp_mean", "gfp_mean"), ("dapi_int", "dapi_int"), ("gfp_max", "gfp_max"), ("area", "area"), ("corr", "dapi_gfp_corr"), ("gfp_median", "gfp_median")))}
FROM n JOIN c USING (site, cell)""")
def _(t):
    p = plane(t).select(F.lit("A1").alias("well"), F.floor(F.col("tile") / 2).alias("site"), (F.col("tile") % 2).alias("channel"), "i", "j", "value")
    spots = p.filter("channel = 0")
    quad = (1 + F.floor(F.col("i") / 4) * 2 + F.floor(F.col("j") / 4)).cast("int")
    cells = spots.select("well", "site", "i", "j", quad.alias("label"))
    nuclei = spots.select("well", "site", "i", "j", F.when(F.col("value") > 1000, quad).otherwise(F.lit(0)).alias("label"))
    d = workflows.phenotype(p, nuclei, cells, [0, 1])
    kept = [f"{c}_{s}" for s in ("nuclear", "cell") for c in ("gfp_mean", "dapi_int", "gfp_max", "area", "dapi_gfp_corr", "gfp_median")]
    return d.select("well", "site", "cell", *[r(c, 6).alias(c) if "mean" in c or "corr" in c else F.col(c) for c in kept])


def extended_sql(x, label):
    """Common tables of one compartment: ``f`` features, ``o`` order statistics, ``r`` correlation, ``z`` moments, ``n`` texture."""
    return f"""
lab_{x} AS (SELECT *, {label}::INTEGER AS cell FROM w), f_{x} AS (SELECT site, cell, avg(c0) AS mean, sum(c0)::BIGINT AS total, min(c0) AS least, max(c0) AS most, stddev_pop(c0) AS sd, count(*) AS area,
  count(*) / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1)) AS extent, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, quantile_cont(c0::DOUBLE, 0.5) AS q50, quantile_cont(c0::DOUBLE, 0.25) AS q25, quantile_cont(c0::DOUBLE, 0.75) AS q75
  FROM lab_{x} WHERE cell > 0 GROUP BY ALL),
o_{x} AS (SELECT site, cell, quantile_cont(abs(c0 - q50), 0.5) AS mad FROM lab_{x} JOIN f_{x} USING (site, cell) GROUP BY ALL),
b_{x} AS (SELECT f.site, f.cell, w.i, w.j, w.c0 AS v, w.c1 FROM f_{x} f JOIN w ON w.site = f.site AND w.i BETWEEN i0 AND i1 AND w.j BETWEEN j0 AND j1),
r_{x} AS (SELECT site, cell, corr(c1, v) AS r FROM b_{x} WHERE c1 > 0 GROUP BY ALL),
k_{x} AS (SELECT site, cell, sum(c0 * i) / sum(c0) AS ci, sum(c0 * j) / sum(c0) AS cj, sum(c0) AS s FROM lab_{x} WHERE cell > 0 GROUP BY ALL),
p_{x} AS (SELECT site, cell, c0 / s AS v, sqrt(pow(i - ci, 2) + pow(j - cj, 2)) / 9 AS rho, atan2(i - ci, j - cj) AS phi FROM lab_{x} JOIN k_{x} USING (site, cell)),
z_{x} AS (SELECT site, cell, [{", ".join(zernike_sql(*n) for n in ORDERS)}] AS zernike FROM p_{x} WHERE rho <= 1 GROUP BY ALL),
g_{x} AS (SELECT a.site, a.cell, a.v AS t, count(*) FILTER (b.v <= a.v) AS n0, count(*) FILTER (b.v > a.v) AS n1, avg(b.v) FILTER (b.v <= a.v) AS m0, avg(b.v) FILTER (b.v > a.v) AS m1
  FROM (SELECT DISTINCT site, cell, v FROM b_{x}) a JOIN b_{x} b USING (site, cell) GROUP BY ALL),
t_{x} AS (SELECT site, cell, t FROM g_{x} QUALIFY row_number() OVER (PARTITION BY site, cell ORDER BY round(coalesce(n0 * n1 * (m0 - m1) * (m0 - m1), -1), 6) DESC, t) = 1),
l_{x} AS (SELECT site, cell, avg(v) AS mu FROM b_{x} JOIN t_{x} USING (site, cell) WHERE v > t GROUP BY ALL),
m_{x} AS (SELECT site, cell, i, j, (v > mu)::INT AS c FROM b_{x} JOIN l_{x} USING (site, cell)),
y_{x} AS (SELECT u.site, u.cell, u.i, u.j, any_value(u.c) AS c, sum(y.c) FILTER (y.i <> u.i OR y.j <> u.j) AS nc, sum(1 - y.c) FILTER (y.i <> u.i OR y.j <> u.j) AS nd
  FROM m_{x} u JOIN m_{x} y ON u.site = y.site AND u.cell = y.cell AND abs(u.i - y.i) <= 1 AND abs(u.j - y.j) <= 1 GROUP BY ALL),
n_{x} AS (SELECT site, cell, [{", ".join(f"round(coalesce(count(*) FILTER (c = {on} AND coalesce({near}, 0) = {k}) / nullif(count(*) FILTER (c = {on}), 0), 0), 6)" for on, near in ((1, "nc"), (0, "nd")) for k in range(9))}] AS texture FROM y_{x} GROUP BY ALL),
c_{x} AS (SELECT site, cell, round(mean, 6) AS mean_{x}, total AS total_{x}, least AS least_{x}, most AS most_{x}, round(sd, 6) AS sd_{x}, area AS area_{x}, round(extent, 6) AS extent_{x}, round(q25, 6) AS q25_{x}, round(q50, 6) AS q50_{x}, round(q75, 6) AS q75_{x},
  round(mad, 6) AS mad_{x}, CASE WHEN NOT isnan(r) THEN round(r, 6) END AS corr_{x}, zernike AS zernike_{x}, texture AS texture_{x}
  FROM f_{x} JOIN o_{x} USING (site, cell) JOIN r_{x} USING (site, cell) JOIN z_{x} USING (site, cell) LEFT JOIN n_{x} USING (site, cell))"""


PARTS = {"nuclear": f"CASE WHEN c0 > 1000 THEN {QUAD} ELSE 0 END", "cell": QUAD, "cyto": f"CASE WHEN c0 <= 1000 THEN {QUAD} ELSE 0 END"}


# texture: shares of pixels above the mean of the bright ones, and of the others, with 0 to 8 neighbours of their kind
@query("extended_phenotype_from_pixels", f"""
WITH {PX}, w AS (SELECT tile // 2 AS site, i, j, max(value) FILTER (tile % 2 = 0) AS c0, max(value) FILTER (tile % 2 = 1) AS c1 FROM px GROUP BY ALL), {", ".join(extended_sql(x, label) for x, label in PARTS.items())}
SELECT * EXCLUDE (cell), cell FROM c_nuclear JOIN c_cell USING (site, cell) JOIN c_cyto USING (site, cell)""")
def _(t):
    p = plane(t).select(F.floor(F.col("tile") / 2).alias("site"), (F.col("tile") % 2).alias("channel"), "i", "j", "value")
    spots = p.filter("channel = 0")
    quad = (1 + F.floor(F.col("i") / 4) * 2 + F.floor(F.col("j") / 4)).cast("int")
    bright = F.col("value") > 1000
    labels = {"nuclear": F.when(bright, quad).otherwise(0), "cell": quad, "cyto": F.when(bright, 0).otherwise(quad)}
    d = workflows.extended_phenotype(p, {n: spots.select("site", "i", "j", c.alias("label")) for n, c in labels.items()}, 0, [1], ["site"])
    out = []
    for x in labels:
        named = {"mean": "channel_mean", "total": "channel_int", "least": "channel_min", "most": "channel_max", "sd": "channel_sd", "area": "area", "extent": "extent",
                 "q25": "channel_25", "q50": "channel_median", "q75": "channel_75", "mad": "channel_mad", "corr": "channel_corrch1"}
        out += [(F.col(f"{c}_{x}") if n in ("total", "least", "most", "area") else r(f"{c}_{x}", 6)).alias(f"{n}_{x}") for n, c in named.items()]
        tas = F.concat(F.slice(f"tas_{x}", 19, 9), F.slice(f"tas_{x}", 46, 9))  # the third mask and its negative
        out += [F.transform(f"zernike_{x}", lambda v: r(v, 5)).alias(f"zernike_{x}"), F.transform(tas, lambda v: r(v, 6)).alias(f"texture_{x}")]
    return d.select("site", "cell", *out)


STAGE = """
st AS (SELECT o_orderpriority AS file, o_orderkey // 10 AS t, o_orderkey % 10 AS m, CASE WHEN o_orderkey < 10 OR o_orderkey % 10 IN (0, 9) THEN o_totalprice END AS x_um,
  CASE WHEN o_orderkey % 10 IN (0, 9) THEN o_orderkey * 1.5::DOUBLE END AS t_ms FROM orders)"""


@query("stage_metadata", f"""
WITH {STAGE}, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY t, m) AS pos, last_value(x_um IGNORE NULLS) OVER (PARTITION BY file, m ORDER BY t ROWS UNBOUNDED PRECEDING) AS x FROM st),
y AS (SELECT *, last_value(t_ms IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN t_ms IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pa,
  first_value(t_ms IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN t_ms IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS na FROM a
  WINDOW p AS (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY file ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT file, t, m, x AS x_um, round(coalesce(t_ms, pv + (nv - pv) / nullif(na - pa, 0) * (pos - pa), pv), 6) AS t_ms FROM y""")
def _(t):
    k = F.col("o_orderkey")
    s = t.orders.select(F.col("o_orderpriority").alias("file"), F.floor(k / 10).alias("t"), (k % 10).alias("m"),
                        F.when((k < 10) | (k % 10).isin(0, 9), F.col("o_totalprice")).alias("x_um"), F.when((k % 10).isin(0, 9), k * 1.5).alias("t_ms"))
    return intake.fill_metadata(s, cols=["x_um"]).withColumn("t_ms", r("t_ms", 6))


@query("series_slices", """
SELECT (vec_id % 7)::BIGINT AS site, (vec_id // 7)::INTEGER AS t, count(*) AS n FROM embeddings WHERE vec_id % 7 BETWEEN 2 AND 4 GROUP BY ALL""")
def _(t):
    p = t.embeddings.select(F.col("vec_id").alias("page"))
    return slice_series(p, 7, 2, 5).groupBy("site", "t").agg(F.count(F.lit(1)).alias("n"))


@query("sharpest_plane", """
WITH px AS (SELECT vec_id // 20 AS tile, (vec_id % 20)::INTEGER AS z, (k // 8)::INTEGER AS i, (k % 8)::INTEGER AS j, round((embedding[k + 1]::DOUBLE + 1) * 1000)::BIGINT AS value FROM embeddings, (SELECT unnest(range(64)) AS k)),
s AS (SELECT tile, z, i, j, sum(value) OVER (PARTITION BY tile, z, j ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) + sum(value) OVER (PARTITION BY tile, z, i ORDER BY j RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 6 * value AS lap FROM px),
v AS (SELECT tile, z, var_pop(lap) AS v FROM s GROUP BY ALL), best AS (SELECT tile, arg_max(z, v) AS z FROM v GROUP BY 1)
SELECT tile, z, i, j, value FROM px JOIN best USING (tile, z)""")
def _(t):
    p = plane(t).select(F.floor(F.col("tile") / 20).alias("tile"), (F.col("tile") % 20).cast("int").alias("z"), "i", "j", "value")
    return sharpest_plane(p, ["tile"])
