"""Readers for guide libraries and gene lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.operators import ordered

CONTROL_NAME, CONTROL_ID, CONTROL_SYMBOL = "Non-Targeting Control", -1, "nontargeting"


def _tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, **options)


def _reassign_controls(df: DataFrame) -> DataFrame:
    control = F.col("gene_id") == CONTROL_NAME
    return df.withColumns({
        "gene_symbol": F.when(control, CONTROL_SYMBOL).otherwise(F.col("gene_symbol")),
        "gene_id": F.when(control, CONTROL_ID).otherwise(F.expr("try_cast(gene_id AS bigint)")),
    })


def import_scored_library(spark: SparkSession, path: str) -> DataFrame:
    """Guides ranked per gene by score, best first; equal scores by file order."""
    raw = _tsv(spark, path).withColumnsRenamed({
        "Target Gene ID": "gene_id", "Target Gene Symbol": "gene_symbol", "sgRNA Target Sequence": "sgRNA",
        "Rule Set 2 score": "score", "Combined rank": "score"})
    df = _reassign_controls(raw.withColumn("_at", F.monotonically_increasing_id()))
    df = df.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    return ordered.scan(df, ["gene_id"], [-F.col("score"), F.col("_at")], {"rank": ("count", None)}).select(
        "gene_id", "gene_symbol", "rank", "sgRNA")


def import_ranked_library(spark: SparkSession, path: str) -> DataFrame:
    """Guides whose rank comes with the file."""
    raw = _tsv(spark, path).withColumnsRenamed({
        "Target Gene ID": "gene_id", "Target Gene Symbol": "gene_symbol", "sgRNA Sequence": "sgRNA", "Combined Rank": "rank"})
    return _reassign_controls(raw).select("gene_id", "gene_symbol", F.col("rank").cast("bigint").alias("rank"), "sgRNA")


def import_symbol_library(spark: SparkSession, path: str, symbols: DataFrame) -> DataFrame:
    """Guides by gene symbol, ranked in file order; unknown symbols are left out."""
    raw = _tsv(spark, path).select(F.col("GENE").alias("gene_symbol"), F.col("SEQUENCE").alias("sgRNA"),
                                   F.monotonically_increasing_id().alias("_at"))
    named = raw.join(symbols.select("gene_symbol", "gene_id"), "gene_symbol")
    return named.select("gene_symbol", "sgRNA", "gene_id",
                        F.row_number().over(W.partitionBy("gene_id").orderBy("_at")).alias("rank"))


def import_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Approved symbols with their numeric ids; rows with gaps are dropped."""
    raw = _tsv(spark, path, comment="#").withColumnsRenamed({
        "Approved symbol": "gene_symbol", "NCBI Gene ID(supplied by NCBI)": "gene_id"})
    return raw.dropna().withColumn("gene_id", F.col("gene_id").cast("double").cast("bigint"))


def load_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, with the file's stem as the design name."""
    df = spark.read.schema("gene_id bigint").csv(path)
    return df.withColumn("design", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:\.[^./]*)?$", 1))


def import_primers(spark: SparkSession, path: str) -> DataFrame:
    """Primer pairs numbered in file order: (dialout, fwd, rev)."""
    raw = spark.read.schema("fwd string, rev string").csv(path, header=True)
    at = raw.withColumn("_at", F.monotonically_increasing_id())
    numbered = ordered.scan(at, [], [F.col("_at")], {"dialout": ("count", None)})
    return numbered.select((F.col("dialout") - 1).cast("int").alias("dialout"), "fwd", "rev")
