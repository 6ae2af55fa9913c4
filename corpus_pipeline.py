"""The corpus pipeline: raw documents to token counts and digests.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the runner writes its result as Parquet and reads it back for the next.
All stages but the last return the columns of ``documents``.

Defined cases: null texts count as empty and null sources and ids are values
like others; repeated rows fall to the exact stage; an empty table passes every
stage; without labels no document is rejected; further columns go along up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, entropy_mix, exact_dedup, shingle_join, toxicity_knn
from tessera.llm.common import documents, saved


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity_knn.clean(docs, labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents one stays. Links are fingerprints of five-word
    shingles at 2 or fewer differing bits, found by multi-index hashing, and
    five-word shingle similarities of 0.8 or more: fingerprints alone miss most
    such pairs (they differ in 7 to 10 of 64 bits)."""
    return shingle_join.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return entropy_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: token count and digests per document."""
    return byte_bpe.token_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixing),
    ("byte_bpe", tokens),
]

#: The classifier, the Newton iterations and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
