"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the white space of all contracts, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``; on a local master
    without that setting, below a temporary folder."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_ROOT: list[str] = []


def _local_root() -> str:
    if not _ROOT or not os.path.isdir(_ROOT[0]):
        _ROOT[:] = [tempfile.mkdtemp(prefix="tessera-llm-")]
    return _ROOT[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it is not
    computed again, and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes that one Arrow batch of texts holds at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold few texts: they are long, and each
    batch is in memory several times on its way to Python and back."""
    for name, most in BATCH.items():
        now = str(spark.conf.get(name, None) or "")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


_WORKER: dict = {}


def worker_cache(key, make):
    """What a Python worker remembers from task to task; of one operator at a
    time, so that the memory of one is free for the next."""
    if key not in _WORKER:
        _WORKER.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _WORKER[key] = make()
    return _WORKER[key]


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    """A join key that is never null, so that plain equality matches null ids too."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, limit: int) -> DataFrame:
    """(id, label, text) of at most ``limit`` labelled rows outside ``held_out``, equal texts once."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "label", "text")).alias("r")).select("r.doc_id", "r.label", "r.text")
    return saved(rows.groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("r")).select(F.col("doc_id").alias("id"), "r.label", "r.text"), "labelled")
