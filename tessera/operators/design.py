"""Guide library design: filters, selection, oligos and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions import sequences as Q
from tessera.operators.cells import first_per_key


def conflicts(design: DataFrame) -> DataFrame:
    """(group, n): groups with several (prefix_length, edit_distance)."""
    spec = F.count_distinct(F.struct("prefix_length", "edit_distance"))
    return design.groupBy("group").agg(spec.alias("n")).filter("n > 1")


def validate_design(design: DataFrame) -> DataFrame:
    """Every group has one (prefix_length, edit_distance)."""
    bad = conflicts(design).limit(10).collect()
    if bad:
        raise ValueError(f"multiple prefix specifications for groups {sorted(r['group'] for r in bad)}")
    return design


def validate_genes(genes: DataFrame, guides: DataFrame) -> DataFrame:
    missing = genes.select("gene_id").distinct().join(guides, "gene_id", "left_anti")
    n = missing.count()
    if n:
        shown = [r[0] for r in missing.limit(20).collect()]
        raise ValueError(f"{n} gene ids missing from the guide table, such as {shown}")
    twice = genes.groupBy("subpool", "gene_id").count().filter("count > 1").limit(20).collect()
    if twice:
        raise ValueError(f"duplicate genes for the same subpool: {[(r['subpool'], r['gene_id']) for r in twice]}")
    return genes


def filter_guides(guides: DataFrame, homopolymer: int = 5) -> DataFrame:
    seq = F.col("sgRNA")
    return guides.filter(~(Q.has_homopolymer(seq, homopolymer) | Q.has_restriction_site(seq)))


def select_guides(candidates: DataFrame, prefix_length: int, edit_distance: int = 1) -> DataFrame:
    """Guides with unique prefixes: the best rank wins, then the gene with
    fewer guides, then the lower sequence."""
    if edit_distance != 1:
        raise NotImplementedError("only prefixes at edit distance 1 are supported")
    sizes = candidates.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_per_id"))
    ranked = candidates.join(sizes, "gene_id").select(
        F.substring("sgRNA", 1, prefix_length).alias("_prefix"), "rank", "_per_id", "sgRNA")
    kept = first_per_key(ranked, ["_prefix"], [F.col("rank"), F.col("_per_id"), F.col("sgRNA")])
    return candidates.join(kept.select("sgRNA").distinct(), "sgRNA", "left_semi")


def select_prefix_group(genes: DataFrame, guides: DataFrame, prefix_length: int, edit_distance: int = 1) -> DataFrame:
    """The first ``sgRNAs_per_gene`` selected guides of every (subpool, gene)."""
    joined = guides.join(genes, "gene_id")
    chosen = select_guides(joined, prefix_length, edit_distance)
    place = F.row_number().over(W.partitionBy("subpool", "gene_id").orderBy("rank", "sgRNA"))
    return chosen.withColumn("_place", place).filter(F.col("_place") <= F.col("sgRNAs_per_gene")).drop("_place")


def build_oligos(guides: DataFrame, primers: DataFrame, left: str = "CGTCTCgCACCg", right: str = "GTTTcGAGACG") -> DataFrame:
    """``oligo`` = forward primer, left arm, guide, right arm, reverse primer's
    reverse complement. ``primers`` is (dialout, fwd, rev)."""
    joined = guides.join(primers, "dialout")
    oligo = F.concat("fwd", F.lit(left), "sgRNA", F.lit(right), Q.reverse_complement(F.col("rev")))
    return joined.withColumn("oligo", oligo).drop("fwd", "rev")


def parse_oligos(oligos: DataFrame, primers: DataFrame) -> DataFrame:
    """Read guide and primers back from each oligo by pattern."""
    if "vector" in oligos.columns and not oligos.filter(F.col("vector") != "CROPseq").isEmpty():
        raise ValueError("can only validate CROPseq designs")
    site, other = Q.RESTRICTION_SITES
    pattern = f"(.*){site}.{Q.CLONING_LEFT}(.*){Q.CLONING_RIGHT}.{other}(.*)"
    part = lambda n: F.nullif(F.regexp_extract("oligo", pattern, n), F.lit(""))
    read = oligos.withColumns({"sgRNA": F.upper("sgRNA"), "oligo": F.upper("oligo")})
    read = read.withColumns({"dialout_fwd": part(1), "sgRNA_cloned": part(2), "dialout_rev": Q.reverse_complement(part(3))})
    number = F.col("dialout").cast("string")
    names = primers.select(F.col("fwd").alias("primer"), F.concat(F.lit("fwd_"), number).alias("name")).unionByName(
        primers.select(F.col("rev").alias("primer"), F.concat(F.lit("rev_"), number).alias("name")))
    names = names.groupBy("primer").agg(F.max("name").alias("name"))
    for side in ("fwd", "rev"):
        look = names.withColumnsRenamed({"primer": f"dialout_{side}", "name": f"dialout_{side}_ix"})
        read = read.join(look, f"dialout_{side}", "left")
    return read.withColumn("dialout_ix", F.split("dialout_fwd_ix", "_")[1].cast("int"))


def validate_oligos(parsed: DataFrame) -> DataFrame:
    """Cloned guide and both primers agree with the design."""
    number = lambda c: F.split(c, "_")[1]
    good = (
        (F.col("sgRNA_cloned") == F.col("sgRNA"))
        & (number("dialout_fwd_ix") == number("dialout_rev_ix"))
        & (F.col("dialout_ix") == F.col("dialout"))
    )
    if not parsed.filter(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError("some oligos do not match their design")
    return parsed
