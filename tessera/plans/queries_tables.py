"""Queries for the tabular kit, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import deep, hitsets, regions, tabular as T
from tessera.operators.ordered import scan
from tessera.operators.quantiles import quantiles
from tessera.plans.registry import query

r = F.round


@query("cast_columns", """
SELECT p_partkey::VARCHAR AS p_partkey, p_size::DOUBLE AS p_size, trunc(p_retailprice)::BIGINT AS p_retailprice FROM part""")
def _(t):
    p = t.part.select("p_partkey", "p_size", "p_retailprice")
    return T.cast_columns(p, ints=["p_retailprice"], floats=["p_size"], strings=["p_partkey"])


@query("replace_columns", """
SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, round(abs(c_acctbal) * 2, 4) AS c_acctbal FROM customer""")
def _(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return T.replace_columns(c, c_mktsegment=F.upper, c_acctbal=lambda x: r(F.abs(x) * 2, 4))


@query("gate_expression", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_quantity > 10 AND l_quantity < 20 AND (l_returnflag IN ('A', 'R') OR l_linestatus = 'O')""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    text = "(10 < l_quantity < 20) & (l_returnflag == @flags | l_linestatus == @status)"
    return T.gate(li, text, flags=["A", "R"], status="O").drop("l_returnflag", "l_linestatus")


@query("predicate_composition", """
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 100000 AND o_custkey % 2 = 0""")
def _(t):
    either = T.any_of([F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"])
    both = T.all_of([either, F.col("o_totalprice") >= 100000, F.col("o_custkey") % 2 == 0])
    return t.orders.filter(both).select("o_orderkey")


@query("string_template", """
SELECT c_custkey, c_name || '@' || n_name || '/' || n_regionkey::VARCHAR AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return T.format_template(j, "{c_name}@{n_name}/{n_regionkey}", "tag").select("c_custkey", "tag")


@query("expand_separated", """
SELECT p_partkey, trim(word) AS p_name FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)""")
def _(t):
    return T.expand_separated(t.part.select("p_partkey", "p_name"), "p_name", " ")


@query("first_seen_codes", """
WITH f AS (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY 1),
c AS (SELECT p_type, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT p_partkey, code FROM part JOIN c USING (p_type)""")
def _(t):
    return T.first_seen_codes(t.part, "p_type", F.col("p_partkey"), "code").select("p_partkey", "code")


@query("column_selection_suffix", """
SELECT l_orderkey, l_linenumber, l_returnflag AS l_returnflag_nuclear, l_tax AS l_tax_nuclear FROM lineitem""")
def _(t):
    li = t.lineitem
    cols = [c for c in li.columns if c in T.columns_like(li, contains="tax") + T.columns_like(li, suffix="flag")]
    return T.add_suffix(li.select("l_orderkey", "l_linenumber", *cols), "_nuclear", ["l_orderkey", "l_linenumber"])


@query("conditional_rekey", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS class FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "fast")
                           .when(F.col("o_orderstatus") == "F", "done").otherwise(F.col("o_orderstatus")).alias("class"))


@query("append_relabelled_rows", """
SELECT n_nationkey, n_name, 0.5::DOUBLE AS p FROM nation UNION ALL SELECT n_nationkey, 'control' AS n_name, 1.0::DOUBLE AS p FROM nation WHERE n_regionkey = 0""")
def _(t):
    n = t.nation.select("n_nationkey", "n_name", F.lit(0.5).alias("p"), "n_regionkey")
    extra = n.filter("n_regionkey = 0").withColumns({"n_name": F.lit("control"), "p": F.lit(1.0)})
    return n.unionByName(extra).drop("n_regionkey")


@query("union_missing_columns", """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def _(t):
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


# --- reductions ----------------------------------------------------------

@query("reduce_groups", """
WITH x AS (SELECT o_orderstatus, o_orderkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_orderstatus, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 4) AS median,
  round(stddev_samp(v), 4) AS std, round(stddev_samp(v) / sqrt(count(v)), 4) AS sem, count(*) AS size, round(sum(v), 2) AS sum,
  max(v) FILTER (rn = 1) AS first, max(v) FILTER (rn = 2) AS second, round(max(v) - min(v), 4) AS spread
FROM x GROUP BY 1""")
def _(t):
    d = T.reduce_groups(
        t.orders, ["o_orderstatus"], "o_totalprice", "mean", "min", "max", "median", "std", "sem", "size", "sum",
        "first", "second", order=[F.col("o_orderkey")], spread=lambda c: F.max(c) - F.min(c))
    return T.replace_columns(d, **{c: (lambda x: r(x, 4)) for c in ("mean", "median", "std", "sem", "spread")},
                             sum=lambda x: r(x, 2))


@query("reduce_counts", """
SELECT user_id, sum(event_id % 50)::BIGINT AS sum_int, count(*) AS count, count(*) AS size FROM events GROUP BY 1""")
def _(t):
    e = t.events.select("user_id", (F.col("event_id") % 50).cast("double").alias("v"))
    return T.reduce_groups(e, ["user_id"], "v", "sum_int", "count", "size")


HIST = """
WITH edges AS (SELECT unnest([0, 10, 20, 30, 40]::DOUBLE[]) AS bin),
x AS (SELECT l_returnflag, CASE WHEN l_quantity >= 40 THEN 40 WHEN l_quantity >= 30 THEN 30 WHEN l_quantity >= 20 THEN 20
  WHEN l_quantity >= 10 THEN 10 WHEN l_quantity >= 0 THEN 0 END::DOUBLE AS bin FROM lineitem),
g AS (SELECT l_returnflag, e.bin, count(x.bin) AS n FROM (SELECT DISTINCT l_returnflag FROM x) CROSS JOIN edges e
  LEFT JOIN x USING (l_returnflag, bin) GROUP BY ALL)
SELECT l_returnflag, bin, {expr} FROM g"""
EDGES = [0, 10, 20, 30, 40]
for _name, _args, _expr in [
    ("histogram_count", {}, "n AS count"),
    ("histogram_fraction", {"normalize": True}, "n / sum(n) OVER (PARTITION BY l_returnflag) AS fraction"),
    ("histogram_cumulative", {"cumulative": True}, "(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin))::BIGINT AS csum"),
    ("histogram_cumulative_fraction", {"cumulative": True, "normalize": True},
     "sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) / sum(n) OVER (PARTITION BY l_returnflag) AS csum_fraction"),
]:
    query(_name, HIST.format(expr=_expr))(
        lambda t, args=_args: T.histogram(t.lineitem, ["l_returnflag"], "l_quantity", EDGES, **args))


@query("exact_quantiles", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem GROUP BY 1""")
def _(t):
    q = quantiles(t.lineitem, ["l_suppkey"], F.col("l_extendedprice"), [0.25, 0.5, 0.75])
    return q.select("l_suppkey", *[r(F.col("q")[n], 4).alias(c) for n, c in enumerate(["q25", "q50", "q75"])])


@query("mode_per_group", """
SELECT l_returnflag, l_linestatus, min(q)::BIGINT AS mode FROM (SELECT l_returnflag, l_linestatus, q, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC) AS rk
  FROM (SELECT l_returnflag, l_linestatus, l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rk = 1 GROUP BY ALL""")
def _(t):
    n = t.lineitem.groupBy("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q")).count()
    return n.groupBy("l_returnflag", "l_linestatus").agg(F.min_by("q", F.struct(-F.col("count"), "q")).alias("mode"))


@query("having_two_levels", """
WITH g AS (SELECT l_returnflag AS gene, l_suppkey AS guide, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 195),
k AS (SELECT gene FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT gene, guide, n FROM g SEMI JOIN k USING (gene)""")
def _(t):
    li = t.lineitem.select(F.col("l_returnflag").alias("gene"), F.col("l_suppkey").alias("guide"))
    guides = li.groupBy("gene", "guide").agg(F.count(F.lit(1)).alias("n")).filter("n >= 195")
    return T.drop_small_groups(guides, ["gene"], 2)


# --- reshaping -----------------------------------------------------------

@query("pivot_statistics", """
WITH s AS (SELECT n_nationkey, c_mktsegment AS stat, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, c_acctbal AS statistic,
  c_custkey % 100 AS pval, c_custkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_nationkey, """ + ", ".join(
    f"round(avg({v}) FILTER (stat = '{s}' AND grp = '{g}'), 6) AS {v}_{s}_{g}"
    for v in ("statistic", "pval") for s in ("BUILDING", "MACHINERY") for g in ("even", "odd")) + """,
  round(avg(n) FILTER (grp = 'even'), 6) AS cells_even, round(avg(n) FILTER (grp = 'odd'), 6) AS cells_odd FROM s GROUP BY 1""")
def _(t):
    s = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_nationkey", F.col("c_mktsegment").alias("stat"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("grp"),
        F.col("c_acctbal").alias("statistic"), (F.col("c_custkey") % 100).alias("pval"), F.col("c_custkey").alias("n"))
    w = T.pivot_statistics(s, "n_nationkey", "stat", "grp", ["statistic", "pval"], "n", ["BUILDING", "MACHINERY"], ["even", "odd"])
    return w.select("n_nationkey", *[r(c, 6).alias(c) for c in w.columns[1:]])


@query("scale_columns", """
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part""")
def _(t):
    d = T.scale_columns(t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])
    return T.replace_columns(d, p_size=lambda x: r(x, 6), p_retailprice=lambda x: r(x, 6))


@query("melt", """
SELECT p_partkey, name, value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) UNPIVOT (value FOR name IN (p_size, p_retailprice))""")
def _(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return T.melt(p, ["p_partkey"], ["p_size", "p_retailprice"], "name", "value")


@query("column_group_mean", """
SELECT l_orderkey * 10 + l_linenumber AS k, round((l_quantity + l_extendedprice) / 2, 6) AS amount, round((l_discount + l_tax) / 2, 6) AS rate FROM lineitem""")
def _(t):
    li = t.lineitem.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    m = T.column_group_mean(li, "k", {"amount": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]})
    return m.select("k", r("amount", 6).alias("amount"), r("rate", 6).alias("rate"))


@query("transpose_named_columns", """
SELECT s_suppkey, split_part(name, '_', 2) AS part, value FROM (SELECT s_suppkey, s_nationkey::DOUBLE AS s_nationkey, s_acctbal FROM supplier) UNPIVOT (value FOR name IN (s_nationkey, s_acctbal))""")
def _(t):
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    long = T.melt(s, ["s_suppkey"], ["s_nationkey", "s_acctbal"], "name", "value")
    return long.select("s_suppkey", F.split("name", "_")[1].alias("part"), "value")


# --- ranks, fills and series ---------------------------------------------

@query("rank_by_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rank FROM orders")
def _(t):
    return T.rank_by_order(t.orders, ["o_orderstatus"], [F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("rank_method_first", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part""")
def _(t):
    return T.rank_by_order(t.part, ["p_brand"], [-F.col("p_size"), F.col("p_partkey")]).select("p_partkey", "rank")


@query("top_n_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) <= 3""")
def _(t):
    from pyspark.sql import Window as W
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_quantity")
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return li.withColumn("n", F.row_number().over(w)).filter("n <= 3").drop("n", "l_quantity")


@query("distinct_on_key", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return T.distinct_on(li, ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])


@query("forward_fill", """
SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""")
def _(t):
    e = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return T.forward_fill(e, ["user_id"], [F.col("event_id")], ["value"]).drop("user_id")


@query("interpolate", """
WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 1 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
y AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pa,
  first_value(v IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS na FROM x
  WINDOW p AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, pv + (nv - pv) / nullif(na - pa, 0) * (pos - pa), pv), 6) AS value FROM y""")
def _(t):
    e = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 4 == 1, F.col("value")).alias("value"))
    return T.interpolate(e, ["user_id"], [F.col("event_id")], "value").select("event_id", r("value", 6).alias("value"))


@query("displacement", """
SELECT event_id, round(sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id % 97 - lag(event_id % 97) OVER w, 2)), 6) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(t):
    e = t.events.select("event_id", "user_id", F.col("value").alias("x"), (F.col("event_id") % 97).alias("y"))
    d = T.displacement(e, ["user_id"], [F.col("event_id")], "x", "y", "step")
    return d.select("event_id", r("step", 6).alias("step"))


@query("running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 2) AS total FROM orders")
def _(t):
    s = scan(t.orders, ["o_orderstatus"], [F.col("o_orderkey")], {"total": ("sum", F.col("o_totalprice"))})
    return s.select("o_orderkey", r("total", 2).alias("total"))


@query("zscore_rows", """
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def _(t):
    return T.zscore(t.orders, ["o_custkey"], "o_totalprice", "z").select("o_orderkey", r("z", 6).alias("z"))


@query("natural_order", """
SELECT page_id, row_number() OVER (ORDER BY regexp_extract(x, '^([^0-9]*)', 1), regexp_extract(x, '([0-9]+)', 1)::BIGINT, x, page_id) AS place
FROM (SELECT page_id, 'site_' || (page_id * 37 % 1000)::VARCHAR || '.csv' AS x FROM pages)""")
def _(t):
    name = F.concat(F.lit("site_"), (F.col("page_id") * 37 % 1000).cast("string"), F.lit(".csv"))
    p = t.pages.select("page_id", T.natural_key(name).alias("k"))
    order = [F.col("k.number"), F.col("k.text"), F.col("k.whole"), F.col("page_id")]
    return scan(p, [], order, {"place": ("count", None)}).select("page_id", "place")


@query("custom_order_rank", """
SELECT o_orderkey, list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], o_orderpriority)::BIGINT AS place FROM orders""")
def _(t):
    wanted = ["3-MEDIUM", "1-URGENT", "5-LOW"]
    return t.orders.select("o_orderkey", T.custom_order(F.col("o_orderpriority"), wanted).alias("place"))


@query("seeded_sample", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY substr(md5(concat_ws('|', o_orderkey::VARCHAR, '7')), 1, 15), o_orderkey LIMIT 50""")
def _(t):
    return T.hash_sample(t.orders, 50, ["o_orderkey"], seed=7).select("o_orderkey", "o_totalprice")


# --- joins ---------------------------------------------------------------

@query("left_join_suffixes", """
SELECT c.c_custkey, s.s_suppkey, c.c_acctbal AS acctbal_x, s.s_acctbal AS acctbal_y FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def _(t):
    c, s = t.customer, t.supplier
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left").select(
        "c_custkey", "s_suppkey", F.col("c_acctbal").alias("acctbal_x"), F.col("s_acctbal").alias("acctbal_y"))


@query("right_join_info", """
SELECT o_orderkey, o_custkey, c_name FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0""")
def _(t):
    cells = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return deep.join_features(cells, t.orders, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_name")


@query("inner_join_compartments", """
WITH a AS (SELECT l_orderkey, sum(l_quantity) AS area FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey, sum(l_quantity) AS area FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, a.area AS area_nuclear, b.area AS area_cell FROM a JOIN b USING (l_orderkey)""")
def _(t):
    sums = t.lineitem.groupBy("l_returnflag", F.col("l_orderkey").alias("cell")).agg(F.sum("l_quantity").alias("area"))
    part = lambda flag: sums.filter(F.col("l_returnflag") == flag).select("cell", "area")
    return regions.compartments({"nuclear": part("A"), "cell": part("R")}, []).withColumnRenamed("cell", "l_orderkey")


@query("semi_join_members", """
SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def _(t):
    b = t.customer.filter("c_mktsegment = 'BUILDING'")
    return t.orders.join(b, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("anti_join_pairs", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem ANTI JOIN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') k USING (l_partkey, l_suppkey)""")
def _(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey")
    known = t.lineitem.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey")
    return hitsets.remove_overlap(pairs.distinct(), known, ["l_partkey", "l_suppkey"])


@query("lookup_join", """
SELECT s_suppkey, coalesce(r_name, 'none') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def _(t):
    look = t.nation.join(t.region.filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    j = t.supplier.join(look, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("s_suppkey", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("wildcard_product", "SELECT r_name || '/' || s.site::VARCHAR AS path FROM region CROSS JOIN (SELECT unnest(range(6)) AS site) s")
def _(t):
    # dimension lists only: one row per (plate, site)
    sites = F.explode(F.sequence(F.lit(0), F.lit(5)))
    return t.region.select("r_name", sites.alias("site")).select(F.concat_ws("/", "r_name", F.col("site").cast("string")).alias("path"))


@query("cogroup_pairs", """
WITH a AS (SELECT c_nationkey AS k, sum(c_acctbal) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, sum(s_acctbal) AS y FROM supplier GROUP BY 1)
SELECT k::BIGINT AS k, round(x - y, 2) AS diff FROM a JOIN b USING (k)""")
def _(t):
    import pandas as pd

    def pair(key, a, b):
        return pd.DataFrame({"k": [key[0]], "diff": [round(a.x.sum() - b.y.sum(), 2)]})

    # partial sums per key keep the cogrouped sides small
    a = t.customer.groupBy(F.col("c_nationkey").cast("bigint").alias("k")).agg(F.sum("c_acctbal").alias("x"))
    b = t.supplier.groupBy(F.col("s_nationkey").cast("bigint").alias("k")).agg(F.sum("s_acctbal").alias("y"))
    return T.apply_pairs(a, b, ["k"], pair, "k bigint, diff double")


# --- sets ----------------------------------------------------------------

def year_customers(t, *priorities):
    return t.orders.filter(F.col("o_orderpriority").isin(*priorities)).select("o_custkey").distinct()


def _set(*p):
    return "(SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority IN (" + ", ".join(f"'{x}'" for x in p) + "))"


A, B, C = ("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)


@query("set_intersection", f"SELECT * FROM {_set(*A)} INTERSECT SELECT * FROM {_set(*B)} INTERSECT SELECT * FROM {_set(*C)}")
def _(t):
    return year_customers(t, *A).intersect(year_customers(t, *B)).intersect(year_customers(t, *C))


@query("set_union", f"SELECT * FROM {_set(*A)} UNION SELECT * FROM {_set(*B)}")
def _(t):
    return year_customers(t, *A).union(year_customers(t, *B)).distinct()


@query("set_difference", f"SELECT * FROM {_set(*A)} EXCEPT SELECT * FROM {_set(*B)}")
def _(t):
    return year_customers(t, *A).subtract(year_customers(t, *B))


@query("set_symmetric_difference", f"(SELECT * FROM {_set(*A)} EXCEPT SELECT * FROM {_set(*B)}) UNION ALL (SELECT * FROM {_set(*B)} EXCEPT SELECT * FROM {_set(*A)})")
def _(t):
    return hitsets.symmetric_difference(year_customers(t, *A), year_customers(t, *B))


@query("venn_counts", f"""
WITH f AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS in_a, bool_or(o_orderpriority = '2-HIGH') AS in_b, bool_or(o_orderpriority = '3-MEDIUM') AS in_c
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1) SELECT in_a, in_b, in_c, count(*) AS n FROM f GROUP BY ALL""")
def _(t):
    return hitsets.venn_counts({"a": year_customers(t, *A), "b": year_customers(t, *B), "c": year_customers(t, *C)})


@query("hit_gate_top_n", """
WITH g AS (SELECT l_suppkey, avg(l_discount) AS effect, avg(l_tax) AS fdr FROM lineitem GROUP BY 1)
(SELECT l_suppkey, round(effect, 6) AS effect, 'up' AS side FROM g WHERE fdr < 0.0405 ORDER BY round(effect, 9) DESC, l_suppkey LIMIT 10)
UNION ALL (SELECT l_suppkey, round(effect, 6), 'down' FROM g WHERE fdr < 0.0405 ORDER BY round(effect, 9), l_suppkey LIMIT 10)""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("effect"), F.avg("l_tax").alias("fdr")).filter("fdr < 0.0405")
    one = lambda key, side: g.orderBy(key, "l_suppkey").limit(10).select("l_suppkey", r("effect", 6).alias("effect"), F.lit(side).alias("side"))
    return one(-r("effect", 9), "up").unionByName(one(r("effect", 9), "down"))
