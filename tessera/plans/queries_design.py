"""Queries for sequences, guide design, plates and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths, plates, sequences as Q
from tessera.operators import design
from tessera.plans.registry import query
from tessera.sources import tables

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"


def dna(key, n=20):
    """A deterministic sequence of n bases for a key."""
    return F.substring(F.translate(F.md5(key), HEX, DNA), 1, n)


def dna_sql(key, n=20):
    return f"substring(translate(md5({key}), '{HEX}', '{DNA}'), 1, {n})"


TEXT_FROM, TEXT_TO = "abcdefghijklmnopqrstuvwxyz", "ACGTNUacgtnuACGTACGTACGTAC"
TEXT_SQL = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{TEXT_FROM}', '{TEXT_TO}')"


def text_dna():
    return F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), TEXT_FROM, TEXT_TO)


@query("reverse_complement", f"SELECT doc_id, reverse(translate({TEXT_SQL}, 'ACGTUNacgtun', 'TGCAANtgcaan')) AS rc FROM documents")
def _(t):
    return t.documents.select("doc_id", Q.reverse_complement(text_dna()).alias("rc"))


@query("sequence_flags", f"""
WITH s AS (SELECT doc_id, {TEXT_SQL} AS s FROM documents)
SELECT doc_id, (contains(s, 'AAAAA') OR contains(s, 'TTTTT') OR contains(s, 'GGGGG') OR contains(s, 'CCCCC')) AS homopolymer,
  (contains('CACCG' || upper(s) || 'GTTT', 'CGTCTC') OR contains('CACCG' || upper(s) || 'GTTT', 'GAGACG')) AS site FROM s""")
def _(t):
    d = t.documents.select("doc_id", text_dna().alias("s"))
    return d.select("doc_id", Q.has_homopolymer(F.col("s"), 5).alias("homopolymer"), Q.has_restriction_site(F.col("s")).alias("site"))


GUIDES = f"""
guides AS (SELECT p_partkey % 400 AS gene_id, p_partkey // 400 + 1 AS rank, {dna_sql("p_partkey::VARCHAR")} AS sgRNA FROM part)"""


def guides(t):
    return t.part.select((F.col("p_partkey") % 400).alias("gene_id"), (F.floor(F.col("p_partkey") / 400) + 1).alias("rank"),
                         dna(F.col("p_partkey").cast("string")).alias("sgRNA"))


@query("filter_guides", f"""
WITH {GUIDES} SELECT gene_id, rank, sgRNA FROM guides WHERE NOT (contains(sgRNA, 'AAA') OR contains(sgRNA, 'TTT') OR contains(sgRNA, 'GGG') OR contains(sgRNA, 'CCC')
  OR contains('CACCG' || sgRNA || 'GTTT', 'CGTCTC') OR contains('CACCG' || sgRNA || 'GTTT', 'GAGACG'))""")
def _(t):
    return design.filter_guides(guides(t), 3)


SELECTED = f"""
{GUIDES}, genes AS (SELECT DISTINCT p_size AS gene_id, p_brand AS subpool, 3 AS sgRNAs_per_gene FROM part),
j AS (SELECT g.*, n.subpool, n.sgRNAs_per_gene FROM guides g JOIN genes n USING (gene_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY gene_id) AS per_id FROM j),
best AS (SELECT sgRNA FROM k QUALIFY row_number() OVER (PARTITION BY substring(sgRNA, 1, 5) ORDER BY rank, per_id, sgRNA) = 1),
sel AS (SELECT * FROM j WHERE sgRNA IN (SELECT sgRNA FROM best))"""


def genes(t):
    return t.part.select(F.col("p_size").cast("bigint").alias("gene_id"), F.col("p_brand").alias("subpool"), F.lit(3).alias("sgRNAs_per_gene")).distinct()


@query("select_guides", f"WITH {SELECTED} SELECT gene_id, subpool, rank, sgRNA FROM sel")
def _(t):
    return design.select_guides(guides(t).join(genes(t), "gene_id"), 5).select("gene_id", "subpool", "rank", "sgRNA")


@query("select_prefix_group", f"WITH {SELECTED} SELECT gene_id, subpool, rank, sgRNA FROM sel QUALIFY row_number() OVER (PARTITION BY subpool, gene_id ORDER BY rank, sgRNA) <= sgRNAs_per_gene")
def _(t):
    return design.select_prefix_group(genes(t), guides(t), 5).select("gene_id", "subpool", "rank", "sgRNA")


@query("design_conflicts", """
SELECT p_brand AS "group", count(DISTINCT (p_size % 7, p_type)) AS n FROM part GROUP BY 1 HAVING count(DISTINCT (p_size % 7, p_type)) > 1""")
def _(t):
    return design.conflicts(t.part.select(F.col("p_brand").alias("group"), (F.col("p_size") % 7).alias("prefix_length"), F.col("p_type").alias("edit_distance")))


OLIGOS = f"""
pr AS (SELECT s_suppkey::INTEGER AS dialout, {dna_sql("'f' || s_suppkey::VARCHAR", 15)} AS fwd, {dna_sql("'r' || s_suppkey::VARCHAR", 15)} AS rev FROM supplier),
o AS (SELECT p_partkey, sgRNA, dialout, fwd || 'CGTCTCgCACCg' || sgRNA || 'GTTTcGAGACG' || reverse(translate(rev, 'ACGT', 'TGCA')) AS oligo
  FROM (SELECT p_partkey, {dna_sql("p_partkey::VARCHAR")} AS sgRNA, (p_partkey % 10)::INTEGER AS dialout FROM part) JOIN pr USING (dialout))"""


def primers(t):
    k = F.col("s_suppkey").cast("string")
    return t.supplier.select(F.col("s_suppkey").cast("int").alias("dialout"), dna(F.concat(F.lit("f"), k), 15).alias("fwd"), dna(F.concat(F.lit("r"), k), 15).alias("rev"))


def oligos(t):
    g = t.part.select("p_partkey", dna(F.col("p_partkey").cast("string")).alias("sgRNA"), (F.col("p_partkey") % 10).cast("int").alias("dialout"))
    return design.build_oligos(g, primers(t))


@query("build_oligos", f"WITH {OLIGOS} SELECT p_partkey, dialout, oligo FROM o")
def _(t):
    return oligos(t).select("p_partkey", "dialout", "oligo")


@query("parse_oligos", f"""
WITH {OLIGOS}, x AS (SELECT *, regexp_extract(upper(oligo), '(.*)CGTCTC.CACCG(.*)GTTT.GAGACG(.*)', ['f', 's', 'r']) AS m FROM o),
y AS (SELECT p_partkey, sgRNA, nullif(m.f, '') AS dialout_fwd, nullif(m.s, '') AS sgRNA_cloned, reverse(translate(nullif(m.r, ''), 'ACGT', 'TGCA')) AS dialout_rev FROM x)
SELECT p_partkey, sgRNA, dialout_fwd, sgRNA_cloned, dialout_rev, 'fwd_' || a.dialout AS dialout_fwd_ix, 'rev_' || b.dialout AS dialout_rev_ix, a.dialout AS dialout_ix
FROM y LEFT JOIN pr a ON dialout_fwd = a.fwd LEFT JOIN pr b ON dialout_rev = b.rev""")
def _(t):
    return design.parse_oligos(oligos(t), primers(t)).select(
        "p_partkey", "sgRNA", "dialout_fwd", "sgRNA_cloned", "dialout_rev", "dialout_fwd_ix", "dialout_rev_ix", "dialout_ix")


# --- plates --------------------------------------------------------------

PLACES = "pl AS (SELECT l_orderkey, l_linenumber, chr(65 + (l_suppkey % 8)::INT) || (1 + l_suppkey % 12)::VARCHAR AS well, l_partkey % 9 AS tile, l_quantity AS i, l_discount * 100 AS j FROM lineitem)"


def places(t):
    well = F.concat(F.chr((F.lit(65) + F.col("l_suppkey") % 8).cast("int")), (F.lit(1) + F.col("l_suppkey") % 12).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", well.alias("well"), (F.col("l_partkey") % 9).alias("tile"),
                             F.col("l_quantity").alias("i"), (F.col("l_discount") * 100).alias("j"))


@query("plate_coordinates", f"""
WITH {PLACES}, x AS (SELECT DISTINCT well, tile FROM pl)
SELECT well, tile, (ascii(well) - 65) * 39120 + 1280 * (tile // 3) - 1280.0::DOUBLE AS i, (substring(well, 2)::INT - 1) * 39120 + 1280 * (tile % 3) - 1280.0::DOUBLE AS j FROM x""")
def _(t):
    i, j = plates.plate_coordinate(F.col("well"), F.col("tile"), "6w", "10X", (3, 3))
    return places(t).select("well", "tile").distinct().select("well", "tile", i.alias("i"), j.alias("j"))


@query("global_positions", f"""
WITH {PLACES} SELECT l_orderkey, l_linenumber, round((substring(well, 2)::INT - 1) * 9000 + 640 * (tile % 3) - 640.0 + j * 0.5, 6)::DOUBLE AS global_x,
  round(-((ascii(well) - 65) * 9000 + 640 * (tile // 3) - 640.0 + i * 0.5), 6)::DOUBLE AS global_y FROM pl""")
def _(t):
    d = plates.add_global_xy(places(t), "96w", (3, 3), "20X", 0.5)
    return d.select("l_orderkey", "l_linenumber", F.round("global_x", 6).alias("global_x"), F.round("global_y", 6).alias("global_y"))


@query("remap_snake", """
SELECT o_orderkey, (CASE WHEN (s // 5) % 2 = 1 THEN (s // 5) * 5 + 4 - s % 5 ELSE s END)::VARCHAR AS site FROM (SELECT o_orderkey, o_orderkey % 20 AS s FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", plates.remap_snake(F.col("o_orderkey") % 20, (4, 5)).alias("site"))


# --- file names ----------------------------------------------------------

def order_paths(t):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    well = F.concat(F.chr((F.lit(65) + k % 8).cast("int")), text(1 + k % 12))
    return t.orders.select("o_orderkey", F.when(k % 4 == 0, F.concat(
        F.lit("/lab/data/20190813_plate/input/10X_c"), text(k % 12), F.lit("-SBS/10X_c"), text(k % 12), F.lit("-SBS_"), well, F.lit("_Tile-"), text(k), F.lit(".max.tif"),
    )).when(k % 4 == 1, F.concat(
        F.lit("process/20X_dapi-gfp_"), well, F.lit("_Site-"), text(k), F.lit(".phenotype.csv"),
    )).when(k % 4 == 2, F.concat(
        F.lit("/lab/20180101_x/10X_c1-SBS/"), well, F.lit("_Site_"), text(k), F.lit("/"),
    )).otherwise(F.concat(F.lit("40X_c3/"), well, F.lit("-Site-"), text(k))).alias("path"))


PATHS = """
paths AS (SELECT k AS o_orderkey, CASE k % 4
  WHEN 0 THEN '/lab/data/20190813_plate/input/10X_c' || k % 12 || '-SBS/10X_c' || k % 12 || '-SBS_' || well || '_Tile-' || k || '.max.tif'
  WHEN 1 THEN 'process/20X_dapi-gfp_' || well || '_Site-' || k || '.phenotype.csv'
  WHEN 2 THEN '/lab/20180101_x/10X_c1-SBS/' || well || '_Site_' || k
  ELSE '40X_c3/' || well || '-Site-' || k END AS path
  FROM (SELECT o_orderkey AS k, chr(65 + (o_orderkey % 8)::INT) || (1 + o_orderkey % 12)::VARCHAR AS well FROM orders))"""
PART_NAMES = ["home", "dataset", "date", "subdir", "mag", "cycle", "well", "site", "tile", "tag", "ext"]


@query("parse_filenames", f"""
WITH {PATHS} SELECT o_orderkey, path AS file,
  CASE k WHEN 0 THEN '/lab/data' WHEN 2 THEN '/lab' END AS home, CASE k WHEN 0 THEN '20190813_plate' WHEN 2 THEN '20180101_x' END AS dataset,
  CASE k WHEN 0 THEN '20190813' WHEN 2 THEN '20180101' END AS date,
  CASE k WHEN 0 THEN 'input/10X_c' || o_orderkey % 12 || '-SBS' WHEN 1 THEN 'process' END AS subdir,
  CASE k WHEN 1 THEN '20X' WHEN 3 THEN '40X' ELSE '10X' END AS mag, CASE k WHEN 0 THEN 'c' || o_orderkey % 12 || '-SBS' WHEN 1 THEN 'dapi-gfp' WHEN 2 THEN 'c1-SBS' ELSE 'c3' END AS cycle,
  regexp_extract(path, '[_/]([A-H][0-9]+)[-_]', 1) AS well, CASE WHEN k > 0 THEN o_orderkey::VARCHAR END AS site, CASE WHEN k = 0 THEN o_orderkey::VARCHAR END AS tile,
  CASE k WHEN 0 THEN 'max' WHEN 1 THEN 'phenotype' END AS tag, CASE k WHEN 0 THEN 'tif' WHEN 1 THEN 'csv' END AS ext
FROM (SELECT *, o_orderkey % 4 AS k FROM paths)""")
def _(t):
    p = order_paths(t).select("o_orderkey", paths.parse_filename(F.col("path")).alias("p"))
    return p.select("o_orderkey", "p.*")


@query("name_files", """
SELECT c_custkey, 'process/10X_c' || c_nationkey || '_A1_' || CASE WHEN c_custkey % 2 = 0 THEN 'Tile-' || c_custkey ELSE 'Site-' || c_nationkey END || '.log.tif' AS path FROM customer""")
def _(t):
    c = F.col("c_custkey")
    return t.customer.select("c_custkey", paths.guess_filename(
        "log", cycle=F.concat(F.lit("c"), F.col("c_nationkey").cast("string")), well="A1",
        tile=F.when(c % 2 == 0, c), site=F.col("c_nationkey")).alias("path"))


@query("parse_export_names", """
SELECT s_suppkey, (1 + s_suppkey % 6)::VARCHAR AS well_ix, lpad(s_suppkey::VARCHAR, 4, '0') AS seq, '10X' AS mag, 'c1' AS cycle, lpad(s_nationkey::VARCHAR, 4, '0') AS m,
  NULL::VARCHAR AS tag, 'nd2' AS ext, ['A1', 'A2', 'A3', 'B1', 'B2', 'B3'][1 + s_suppkey % 6] AS well FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("in/Well"), (1 + k % 6).cast("string"), F.lit("_x_Seq"), F.lpad(k.cast("string"), 4, "0"),
                    F.lit("_10X_c1_p_"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0"), F.lit(".nd2"))
    return t.supplier.select("s_suppkey", paths.parse_export(name).alias("p"), paths.export_well(name, ["A1", "A2", "A3", "B1", "B2", "B3"]).alias("well")).select("s_suppkey", "p.*", "well")


@query("url_path_pieces", r"""
SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS piece, nullif(regexp_extract(url, '/([0-9]+)', 1), '')::BIGINT AS number FROM pages""")
def _(t):
    keys = tables.path_keys(F.col("url"), 2, 3, "/([0-9]+)")
    named = {n: F.coalesce(keys[k], F.lit("")) for n, k in (("host", "plate"), ("piece", "well"))}
    return t.pages.select("page_id", *[c.alias(n) for n, c in named.items()], keys["site"].alias("number"))
