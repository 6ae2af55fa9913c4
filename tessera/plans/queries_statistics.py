"""Queries for screen statistics: line items stand for cells of a screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import statistics as S
from tessera.plans.registry import query
from tessera.plans.sqltext import chi2_even, hypergeometric, t_two_sided

r = F.round


def screen_cells(t):
    gene = F.when(F.col("l_suppkey") % 25 == 0, "nontargeting").otherwise(
        F.concat(F.lit("g"), (F.col("l_suppkey") % 25).cast("string")))
    return t.lineitem.select(
        gene.alias("gene"),
        F.concat(gene, F.lit("_"), (F.col("l_partkey") % 3).cast("string")).alias("sgRNA"),
        (F.col("l_linenumber") % 4).alias("rep"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"),
        F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y"),
    )


CELLS = """
cells AS (
  SELECT gene, gene || '_' || (l_partkey % 3)::VARCHAR AS sgRNA, l_linenumber % 4 AS rep, l_extendedprice AS x, l_discount AS y
  FROM (SELECT *, CASE WHEN l_suppkey % 25 = 0 THEN 'nontargeting' ELSE 'g' || (l_suppkey % 25)::VARCHAR END AS gene FROM lineitem))"""

AUCS = f"""{CELLS},
rng AS (SELECT quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM cells),
b AS (SELECT gene, sgRNA, rep, CASE WHEN x BETWEEN lo AND hi THEN least(floor((x - lo) / (hi - lo) * 50), 49) END AS bin FROM cells, rng),
g AS (SELECT gene, sgRNA, rep, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT gene, sgRNA, rep, bin, count(*) AS c FROM b WHERE bin IS NOT NULL GROUP BY ALL),
k AS (SELECT unnest(range(50)) AS k),
ctrl AS (SELECT k, (SELECT count(*) FROM b WHERE sgRNA IN ('nontargeting_0', 'nontargeting_1') AND bin <= k)
  / (SELECT count(*) FROM b WHERE sgRNA IN ('nontargeting_0', 'nontargeting_1')) AS f FROM k),
cum AS (SELECT g.gene, g.sgRNA, g.rep, k.k, (SELECT coalesce(sum(c), 0) FROM h WHERE h.sgRNA = g.sgRNA AND h.rep = g.rep AND h.bin <= k.k) / g.n AS f FROM g CROSS JOIN k),
aucs AS (SELECT gene, sgRNA, rep, (sum(ctrl.f - cum.f) - (max(ctrl.f - cum.f) FILTER (k = 0) + max(ctrl.f - cum.f) FILTER (k = 49)) / 2) / 50 AS x
  FROM cum JOIN ctrl USING (k) GROUP BY ALL)"""
GENES = f"""{AUCS},
grp AS (SELECT sgRNA, any_value(split_part(sgRNA, '_', 1)) AS gene, count(*) AS n1, avg(x) AS m1, coalesce(var_samp(x), 0) AS v1 FROM aucs GROUP BY 1),
ctl AS (SELECT count(*) AS n2, avg(x) AS m2, var_samp(x) AS v2 FROM aucs WHERE gene = 'nontargeting'),
tt AS (SELECT gene, sgRNA, (n1 + n2 - 2)::BIGINT AS nu, (m1 - m2) / sqrt((v1 * (n1 - 1) + v2 * (n2 - 1)) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM grp, ctl),
p AS (SELECT gene, sgRNA, {t_two_sided('t', 'nu')} AS p FROM tt),
f AS (SELECT gene, count(*) AS n_sg, -2 * sum(ln(p)) AS chi FROM p GROUP BY 1),
q AS (SELECT gene, n_sg, chi, {chi2_even('chi', 'n_sg')} AS pval FROM f),
adj AS (SELECT *, least(1, min(pval * m / rk) OVER (ORDER BY pval DESC ROWS UNBOUNDED PRECEDING)) AS bh
  FROM (SELECT *, row_number() OVER (ORDER BY pval) AS rk, count(*) OVER () AS m FROM q))"""

NT = ["nontargeting_0", "nontargeting_1"]


def barplot(t):
    return S.gene_statistics(screen_cells(t), "x", NT)


@query("delta_auc", f"WITH {AUCS} SELECT gene, sgRNA, rep, round(x, 6) AS x, 'sg' || split_part(sgRNA, '_', 2) AS sgRNA_num FROM aucs")
def _(t):
    return barplot(t)[0].withColumn("x", r("x", 6))


@query("gene_barplot_statistics", f"""
WITH {GENES} SELECT gene, n_sg, round(chi, 5) AS fisher_combined_chi, round(pval, 6) AS pval, round(bh, 6) AS fdr_bh_adj_p, bh <= 0.05 AS significant,
  CASE WHEN pval < 1e-4 THEN '****' WHEN pval < 1e-3 THEN '***' WHEN pval < 1e-2 THEN '**' WHEN bh < 0.05 THEN '*' ELSE '' END AS pval_text FROM adj""")
def _(t):
    g = barplot(t)[1]
    return g.withColumns({"fisher_combined_chi": r("fisher_combined_chi", 5), "pval": r("pval", 6), "fdr_bh_adj_p": r("fdr_bh_adj_p", 6)})


@query("auto_range", "SELECT round(quantile_cont(l_extendedprice, 0.005), 3) AS low, round(quantile_cont(l_extendedprice, 0.995), 3) AS high FROM lineitem")
def _(t):
    low, high = S.auto_range(t.lineitem, "l_extendedprice")
    return t.spark.range(1).select(r(F.lit(low), 3).alias("low"), r(F.lit(high), 3).alias("high"))


T_TEST = """
s AS (SELECT o_orderpriority AS grp, count(*) AS n1, avg(o_totalprice) AS m1, var_samp(o_totalprice) AS v1 FROM orders GROUP BY 1),
tt AS (SELECT s.grp, s.n1, s.m1, (s.m1 - c.m1) / nullif(sqrt((s.v1 * (s.n1 - 1) + c.v1 * (c.n1 - 1)) / (s.n1 + c.n1 - 2) * (1 / s.n1 + 1 / c.n1)), 0) AS t, s.n1 + c.n1 - 2 AS nu
  FROM s, s c WHERE c.grp = '1-URGENT')"""


@query("t_test_to_control", f"""
WITH {T_TEST} SELECT grp, n1 AS count, round(m1, 4) AS mean, round(t, 6) AS statistic, nu AS dof, round({t_two_sided('t', 'nu')}, 6) AS pval FROM tt""")
def _(t):
    o = t.orders.select(F.col("o_orderpriority").alias("grp"), "o_totalprice")
    d = S.t_test_to_control(o, "grp", "o_totalprice", F.col("grp") == "1-URGENT")
    return d.withColumns({"mean": r("mean", 4), "statistic": r("statistic", 6), "pval": r("pval", 6)})


# mean per (gene, cell) first, then the test per gene with both adjustments
@query("gene_cell_statistics", f"""
WITH {CELLS.replace("l_linenumber % 4 AS rep", "l_orderkey AS cell")}, m AS (SELECT gene, cell, avg(y) AS y FROM cells GROUP BY ALL),
s AS (SELECT gene, count(*) AS n1, avg(y) AS m1, var_samp(y) AS v1 FROM m GROUP BY 1),
tt AS (SELECT s.gene, s.n1, s.m1, (s.m1 - c.m1) / nullif(sqrt((s.v1 * (s.n1 - 1) + c.v1 * (c.n1 - 1)) / (s.n1 + c.n1 - 2) * (1 / s.n1 + 1 / c.n1)), 0) AS t, s.n1 + c.n1 - 2 AS nu
  FROM s, s c WHERE c.gene = 'nontargeting'),
p AS (SELECT *, {t_two_sided('t', 'nu')} AS pv FROM tt),
k AS (SELECT *, row_number() OVER (ORDER BY pv) AS rk, count(pv) OVER () AS mm FROM p)
SELECT gene, n1 AS count, round(m1, 6) AS mean, round(pv, 5) AS pval,
  round(least(1, min(pv * mm / rk) OVER (ORDER BY pv DESC ROWS UNBOUNDED PRECEDING)), 5) AS pval_bh,
  round(least(1, max(1 - pow(1 - pv, mm - rk + 1)) OVER (ORDER BY pv ROWS UNBOUNDED PRECEDING)), 5) AS pval_hs FROM k""")
def _(t):
    cells = screen_cells(t).withColumn("cell", F.floor(F.col("cell") / 10))
    means = cells.groupBy("gene", "cell").agg(F.avg("y").alias("y"))
    d = S.t_test_to_control(means, "gene", "y", F.col("gene") == "nontargeting")
    d = S.adjust_pvalues(d, "pval", bh="pval_bh", holm_sidak="pval_hs")
    return d.select("gene", "count", r("mean", 6).alias("mean"), *[r(c, 5).alias(c) for c in ("pval", "pval_bh", "pval_hs")])


P_VALUES = "p AS (SELECT o_orderkey AS id, o_orderstatus AS family, ((o_orderkey * 7919) % 99991 + 1) / 100000.0::DOUBLE AS p FROM orders)"


def p_values(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("family"),
                           (((F.col("o_orderkey") * 7919) % 99991 + 1) / F.lit(100000.0)).alias("p"))


@query("adjust_bh", f"""
WITH {P_VALUES}, k AS (SELECT *, rank() OVER w - 1 + count(*) OVER (PARTITION BY family, p) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p WINDOW w AS (PARTITION BY family ORDER BY p))
SELECT id, round(least(1, min(p * m / rk) OVER (PARTITION BY family ORDER BY p DESC)), 6) AS bh FROM k""")
def _(t):
    return S.adjust_pvalues(p_values(t), "p", ["family"], bh="bh").select("id", r("bh", 6).alias("bh"))


@query("adjust_holm_sidak", f"""
WITH {P_VALUES}, k AS (SELECT *, rank() OVER w AS rk, count(*) OVER (PARTITION BY family) AS m FROM p WINDOW w AS (PARTITION BY family ORDER BY p))
SELECT id, round(least(1, max(1 - pow(1 - p, m - rk + 1)) OVER (PARTITION BY family ORDER BY p)), 6) AS hs FROM k""")
def _(t):
    return S.adjust_pvalues(p_values(t), "p", ["family"], holm_sidak="hs").select("id", r("hs", 6).alias("hs"))


@query("fisher_combine", f"""
WITH p AS (SELECT l_suppkey AS gene, ((l_orderkey * 7919 + l_linenumber) % 997 + 1) / 1000.0::DOUBLE AS p FROM lineitem),
f AS (SELECT gene, count(*) AS n_sg, -2 * sum(ln(p)) AS chi FROM p GROUP BY 1)
SELECT gene, n_sg, round(chi, 5) AS fisher_combined_chi, round({chi2_even('chi', 'n_sg')}, 6) AS pval FROM f""")
def _(t):
    p = t.lineitem.select(F.col("l_suppkey").alias("gene"), (((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 997 + 1) / F.lit(1000.0)).alias("p"))
    d = S.fisher_combine(p, "gene", "p")
    return d.withColumns({"fisher_combined_chi": r("fisher_combined_chi", 5), "pval": r("pval", 6)})


# thousands of p-values per group: the tail must not over- or underflow
@query("fisher_combine_large", f"""
WITH p AS (SELECT l_returnflag AS gene, ((l_orderkey * 7919 + l_linenumber) % 997 + 1) / 1000.0::DOUBLE AS p FROM lineitem),
f AS (SELECT gene, count(*) AS n_sg, -2 * sum(ln(p)) AS chi FROM p GROUP BY 1)
SELECT gene, n_sg, round(chi, 3) AS fisher_combined_chi, round({chi2_even('chi', 'n_sg')}, 6) AS pval FROM f""")
def _(t):
    p = t.lineitem.select(F.col("l_returnflag").alias("gene"), (((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 997 + 1) / F.lit(1000.0)).alias("p"))
    d = S.fisher_combine(p, "gene", "p")
    return d.withColumns({"fisher_combined_chi": r("fisher_combined_chi", 3), "pval": r("pval", 6)})


@query("wasserstein_to_control", """
WITH c AS (SELECT value AS v FROM events WHERE event_type = 'view'), x AS (SELECT event_type AS g, value AS v FROM events),
pts AS (SELECT DISTINCT g, v FROM (SELECT g, v FROM x UNION ALL SELECT DISTINCT x.g, c.v FROM (SELECT DISTINCT g FROM x) x CROSS JOIN c)),
xc AS (SELECT g, v, count(*) AS n FROM x GROUP BY ALL), cc AS (SELECT v, count(*) AS n FROM c GROUP BY 1),
j AS (SELECT p.g, p.v, coalesce(xc.n, 0) AS a, coalesce(cc.n, 0) AS b FROM pts p LEFT JOIN xc USING (g, v) LEFT JOIN cc USING (v)),
k AS (SELECT g, lead(v) OVER w - v AS dv, sum(a) OVER w / sum(a) OVER (PARTITION BY g) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY g) AS fb FROM j WINDOW w AS (PARTITION BY g ORDER BY v))
SELECT g AS event_type, round(sum(abs(fa - fb) * dv), 6) AS distance FROM k GROUP BY 1""")
def _(t):
    d = S.wasserstein_to_control(t.events, "event_type", "value", F.col("event_type") == "view")
    return d.select("event_type", r("distance", 6).alias("distance"))


@query("pearson_with_line", f"""
WITH g AS (SELECT c_nationkey, count(*) AS n, corr(c_acctbal, c_custkey) AS rr, regr_slope(c_acctbal, c_custkey) AS slope, regr_intercept(c_acctbal, c_custkey) AS intercept FROM customer GROUP BY 1),
h AS (SELECT *, rr * sqrt((n - 2) / (1 - rr * rr)) AS t, n - 2 AS nu FROM g)
SELECT c_nationkey, n, round(rr, 6) AS r, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round({t_two_sided('t', 'nu')}, 6) AS pval FROM h""")
def _(t):
    d = S.pearson(t.customer, "c_custkey", "c_acctbal", ["c_nationkey"])
    return d.select("c_nationkey", "n", *[r(c, 6).alias(c) for c in ("r", "slope", "pval")], r("intercept", 4).alias("intercept"))


@query("ecdf_curve", """
SELECT event_type, v AS value, round(max(cd), 6) AS ecdf FROM (SELECT event_type, value AS v, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS cd FROM events) GROUP BY ALL""")
def _(t):
    return S.ecdf(t.events, ["event_type"], "value").withColumn("ecdf", r("ecdf", 6))


@query("over_representation", f"""
WITH uni AS (SELECT DISTINCT p_partkey AS gene FROM part), sets AS (SELECT p_type AS lib, p_brand || p_type AS term, p_partkey AS gene FROM part),
hits AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.08),
tot AS (SELECT (SELECT count(*) FROM uni) AS u, (SELECT count(*) FROM hits SEMI JOIN uni USING (gene)) AS h),
per AS (SELECT lib, term, count(*) AS s, count(h.gene) AS k FROM sets LEFT JOIN hits h USING (gene) GROUP BY ALL HAVING count(h.gene) > 0),
p AS (SELECT lib, term, s, k, h, u, {hypergeometric('k', 's', 'h', 'u')} AS p FROM per, tot),
q AS (SELECT *, rank() OVER w - 1 + count(*) OVER (PARTITION BY lib, round(p, 12)) AS rk, count(*) OVER (PARTITION BY lib) AS m FROM p WINDOW w AS (PARTITION BY lib ORDER BY round(p, 12)))
SELECT term, s AS n_set, k AS overlap, round(p, 6) AS pval, round(least(1, min(p * m / rk) OVER (PARTITION BY lib ORDER BY round(p, 12) DESC)), 6) AS fdr_bh_adj_p FROM q""")
def _(t):
    sets = t.part.select(F.col("p_type").alias("lib"), F.concat("p_brand", "p_type").alias("term"), F.col("p_partkey").alias("gene"))
    hits = t.lineitem.filter("l_quantity >= 48 AND l_discount >= 0.08").select(F.col("l_partkey").alias("gene"))
    d = S.over_representation(hits, sets, sets, "gene", "term", ["lib"])
    return d.select("term", "n_set", "overlap", r("pval", 6).alias("pval"), r("fdr_bh_adj_p", 6).alias("fdr_bh_adj_p"))
