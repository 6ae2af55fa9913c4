"""Queries around reads and cells, on line items seen as sequencing reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bases as B
from tessera.operators import cells, reads as reads_op
from tessera.plans.registry import query
from tessera.plans.sqltext import inverse4


# the columns that tell line items apart, in one number
_LINE = "substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT))), 1, 15)"
LINE, LINE_SQL = f"CAST(conv({_LINE}, 16, 10) AS BIGINT)", f"CAST('0x' || {_LINE} AS BIGINT)"


def line_reads(t):
    """One read per line item; the return flag stands for the well."""
    li = t.lineitem
    return li.select(
        F.col("l_returnflag").alias("well"),
        F.lit(0).cast("bigint").alias("site"),
        F.expr(LINE).alias("read"),
        (F.col("l_orderkey") % 4000).alias("cell"),
        F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity") % 3).cast("int").cast("string")).alias("barcode"),
        (F.lit(1) - F.col("l_discount") * 8).alias("Q_min"),
    )


READS = f"""
reads AS (
  SELECT l_returnflag AS well, 0::BIGINT AS site, {LINE_SQL} AS read, l_orderkey % 4000 AS cell,
         l_returnflag || l_linestatus || (l_quantity % 3)::INT::VARCHAR AS barcode, 1 - l_discount * 8 AS Q_min
  FROM lineitem)"""

COUNTS = """
uniq AS (
  SELECT well, site, read, cell, barcode FROM (
    SELECT *, row_number() OVER (PARTITION BY well, site, read ORDER BY cell, barcode) AS rn FROM kept) WHERE rn = 1),
counts AS (SELECT well, site, cell, barcode, count(*) AS n FROM uniq {where} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY well, site, cell ORDER BY n DESC, barcode) AS rk FROM counts)"""


def top_sql(k, kept, where=""):
    picks = ",\n".join(
        f"max(barcode) FILTER (rk = {r + 1}) AS cell_barcode_{r}, max(n) FILTER (rk = {r + 1}) AS cell_barcode_count_{r}"
        for r in range(k)
    )
    return (
        f"WITH {READS}, kept AS ({kept}), {COUNTS.format(where=where)}\n"
        f"SELECT well, site, cell, {picks}, sum(n)::BIGINT AS barcode_count FROM ranked GROUP BY well, site, cell"
    )


@query("cell_top2_barcodes", top_sql(2, "SELECT * FROM reads WHERE Q_min >= 0.5"))
def _(t):
    return cells.top_barcodes(line_reads(t), k=2, min_quality=0.5)


@query("cell_top10_barcodes", top_sql(10, "SELECT * FROM reads", "WHERE cell > 0"))
def _(t):
    return cells.top_barcodes(line_reads(t), k=10, in_cells_only=True)


# --- base calling --------------------------------------------------------

LETTERS = "ACGT"
N_CYCLES = 3


def line_bases(t):
    """Long bases table: 3 cycles x 4 channels per line item."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.expr(LINE).alias("read"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
                           F.col("l_tax").alias("x"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    q, d, x, n = F.col("q"), F.round(F.col("d") * 500), F.round(F.col("x") * 600), F.col("l_linenumber") * 7.0
    p, s = (F.col("p") % 50).cast("double"), (F.col("s") % 50).cast("double")
    signal = F.array(F.array(q, d, x, n), F.array(x, n, q, d), F.array(p, s, q, n))
    reads = li.select(
        F.concat(F.lit("w"), (F.col("l_orderkey") % 3).cast("string")).alias("well"), (F.col("l_orderkey") % 4).alias("site"),
        "read", (F.col("l_orderkey") % 50).alias("cell"),
        F.col("p").alias("i"), F.col("s").alias("j"), signal.alias("signal"))
    return reads_op.unpack_bases(reads, LETTERS, ["well", "site", "read", "cell", "i", "j"])


BASES = f"""
li AS (SELECT l_orderkey, l_linenumber, {LINE_SQL} AS read, l_quantity AS q, l_discount AS d, l_tax AS x, l_partkey AS p, l_suppkey AS s FROM lineitem),
li2 AS (SELECT *, round(d * 500) AS d2, round(x * 600) AS x2, l_linenumber * 7.0::DOUBLE AS n FROM li),
r AS (SELECT 'w' || (l_orderkey % 3)::VARCHAR AS well, l_orderkey % 4 AS site, read, l_orderkey % 50 AS cell, p AS i, s AS j,
  [[q, d2, x2, n], [x2, n, q, d2], [(p % 50)::DOUBLE, (s % 50)::DOUBLE, q, n]] AS sig FROM li2),
c AS (SELECT well, site, read, cell, i, j, k AS cycle, sig[k] AS x FROM r, (SELECT unnest(range(1, 4)) AS k))"""


def base(x):
    return f"['A', 'C', 'G', 'T'][list_position({x}, list_max({x}))]"


def quality_sql(x):
    second, first = f"abs(list_sort({x})[3])", f"abs(list_sort({x})[4])"
    return f"greatest(0.0, least(1.0, 2 * (1 - ln(2 + {second}) / ln(2 + {first}))))"


def calls_sql(source, digits=6):
    return f"""q AS (SELECT well, site, read, any_value(cell) AS cell, string_agg({base('x')}, '' ORDER BY cycle) AS barcode,
  {", ".join(f"round(max({quality_sql('x')}) FILTER (cycle = {k + 1}), {digits}) AS Q_{k}" for k in range(3))}, round(min({quality_sql('x')}), {digits}) AS Q_min
  FROM {source} GROUP BY ALL) SELECT well, site, read, cell, barcode, Q_0, Q_1, Q_2, Q_min FROM q"""


def fit_sql(keys, rows="c"):
    """Class medians, unit columns and the 4x4 inverse by cofactors."""
    det, inverse = inverse4("m")
    return f"""
l AS (SELECT {keys}, list_position(x, list_max(x)) AS cls, unnest([1, 2, 3, 4]) AS ch, unnest(x) AS v FROM {rows}),
med AS (SELECT {keys}, cls, ch, quantile_cont(v, 0.5) AS v FROM l GROUP BY ALL),
unit AS (SELECT {keys}, cls, ch, v / sum(v) OVER (PARTITION BY {keys}, cls) AS v FROM med),
mix AS (SELECT {keys}, list(v ORDER BY ch, cls) AS m FROM unit GROUP BY ALL),
dt AS (SELECT {keys}, m, {det} AS det FROM mix),
w AS (SELECT {keys}, [{inverse}] AS w FROM dt)"""


APPLY = "y AS (SELECT c.*, list_transform(list_transform(w, lambda a: list_dot_product(a, c.x)), lambda v: CASE WHEN abs(v - round(v)) < 1e-7 THEN round(v) ELSE trunc(v) END + 0.0) AS y FROM c JOIN w USING ({keys})), z AS (SELECT * EXCLUDE (x, y), y AS x FROM y)"


def final(d):
    return d.select("well", "site", "read", "cell", "barcode", *[F.round(c, 6).alias(c) for c in ("Q_0", "Q_1", "Q_2", "Q_min")])


@query("reads_uncorrected", f"WITH {BASES}, {calls_sql('c')}")
def _(t):
    return final(reads_op.call_reads(line_bases(t), LETTERS, N_CYCLES, "none"))


@query("crosstalk_fit", f"WITH {BASES}, {fit_sql('well, site')} SELECT well, site, list_transform(list_concat(w[1], w[2], w[3], w[4]), lambda v: round(v, 6)) AS w FROM w")
def _(t):
    fit = reads_op.fit_crosstalk(reads_op.pack_bases(line_bases(t), LETTERS, N_CYCLES), 4)
    return fit.select("well", "site", F.transform(F.flatten("unmix"), lambda v: F.round(v, 6)).alias("w"))


@query("reads_median_corrected", f"WITH {BASES}, {fit_sql('well, site')}, {APPLY.format(keys='well, site')}, {calls_sql('z')}")
def _(t):
    return final(reads_op.call_reads(line_bases(t), LETTERS, N_CYCLES, "median"))


@query("reads_corrected_by_cycle", f"WITH {BASES}, cin AS (SELECT * FROM c WHERE cell > 0), {fit_sql('well, site, cycle', 'cin')}, {APPLY.format(keys='well, site, cycle')}, {calls_sql('z')}")
def _(t):
    return final(reads_op.call_reads(line_bases(t), LETTERS, N_CYCLES, "median", by_cycle=True, in_cells_only=True))


@query("reads_first_two_cycles", f"""
WITH {BASES}, q AS (SELECT well, site, read, string_agg({base('x')}, '' ORDER BY cycle) AS barcode, round(min({quality_sql('x')}), 6) AS Q_min FROM c WHERE cycle <= 2 GROUP BY ALL) SELECT * FROM q""")
def _(t):
    d = reads_op.call_reads(line_bases(t), LETTERS, 2, "none")
    return d.select("well", "site", "read", "barcode", F.round("Q_min", 6).alias("Q_min"))


PERCENTILE = """
s AS (SELECT well, site, x, unnest([1, 2, 3, 4]) AS cls, unnest(x) AS v, list_sum(x) AS t FROM c),
cut AS (SELECT well, site, cls, quantile_cont(v / nullif(t, 0), 0.98) AS cut FROM s GROUP BY ALL),
hi AS (SELECT s.well, s.site, s.cls, unnest([1, 2, 3, 4]) AS ch, unnest(s.x) AS v FROM s JOIN cut USING (well, site, cls) WHERE s.v / nullif(s.t, 0) >= cut),
med AS (SELECT well, site, cls, ch, quantile_cont(v, 0.5) AS v FROM hi GROUP BY ALL)"""


@query("crosstalk_percentile_axes", f"WITH {BASES}, {PERCENTILE}, {fit_sql('well, site').split('med AS')[1].split('GROUP BY ALL),', 1)[1]} SELECT well, site, list_transform(list_concat(w[1], w[2], w[3], w[4]), lambda v: round(v, 6)) AS w FROM w")
def _(t):
    fit = reads_op.fit_crosstalk(reads_op.pack_bases(line_bases(t), LETTERS, N_CYCLES), 4, method="percentile")
    return fit.select("well", "site", F.transform(F.flatten("unmix"), lambda v: F.round(v, 6)).alias("w"))


@query("format_bases", f"""
WITH {BASES}, l AS (SELECT well, site, read, cell, i, j, cycle, unnest(['A', 'C', 'G', 'T']) AS channel, unnest(x) AS intensity FROM c)
SELECT well, site, read, cell, i, j, cycle::INTEGER AS cycle, channel, intensity FROM l""")
def _(t):
    return line_bases(t)


@query("fastq_lines", f"""
WITH {BASES}, q AS (SELECT well, site, read, any_value(cell) AS cell, any_value(i) AS i, any_value(j) AS j, string_agg({base('x')}, '' ORDER BY cycle) AS barcode,
  string_agg((SELECT chr(CASE n WHEN 43 THEN 44 WHEN 58 THEN 59 ELSE n END) FROM (SELECT trunc({quality_sql('x')} * 30 + 33)::INT AS n)), '' ORDER BY cycle) AS ph FROM c GROUP BY ALL),
t AS (SELECT well, site, row_number() OVER (ORDER BY well || '_' || site::VARCHAR) - 1 AS number FROM (SELECT DISTINCT well, site FROM q))
SELECT read, '@MN:DS:FC:' || concat_ws(':', well, cell, number, read, i, j) || chr(10) || barcode || chr(10) || '+' || chr(10) || ph AS value FROM q JOIN t USING (well, site)""")
def _(t):
    d = reads_op.call_reads(line_bases(t), LETTERS, N_CYCLES, "none")
    return reads_op.fastq_records(d, N_CYCLES, tile="site").select("read", "value")


@query("signal_quality", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_discount * 100, l_tax * 100, l_linenumber::DOUBLE] AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, """ + f"{base('x')} AS base, round({quality_sql('x')}, 6) AS q FROM s")
def _(t):
    x = F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber").cast("double"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", B.call_base(x, LETTERS).alias("base"), F.round(B.quality(x), 6).alias("q"))
