"""Exact deduplication by stateful streaming.

Each document becomes a narrow key row: digest of its normalised text,
identifier and content locator. A streaming aggregation over the key rows
holds, per digest and without expiry, the smallest identifier, its locator and
the number of rows. The state is RocksDB's, on disk, and is checkpointed in the
shared folder. Rows of one digest are combined before the shuffle, so a group
with a third of all rows costs one row per task.

Digests that were hit again are checked on the full bytes: of all texts of
such a digest the least and the greatest must be the same text. Only these
texts are shuffled; a bitmap of fixed size tells which. A digest that two
texts share (never seen with SHA-256) is regrouped by the text itself.

Only DataFrame and SQL functions are used.

Defined cases: a null text counts as empty; empty texts form one group; a null
identifier loses against every other; of rows that repeat both identifier and
text exactly one is kept; an empty table gives an empty result; columns other
than the two named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE, documents, id_key, saved, shared_folder, whole

#: The state lives in RocksDB; many small stores must neither reserve disk space
#: ahead nor hold memory of their own.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: The filter of hit digests has this many buckets of 32 768 bits (4 KB): 2 MB at most.
_BUCKETS = 512


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(whole(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def key_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256) -> DataFrame:
    """(id, digest, locator): what the state needs of each document."""
    return docs.select(
        F.col(doc_id).alias("id"), digest(normalised(text)).alias("digest"),
        F.struct(F.input_file_name().alias("file"), F.octet_length(whole(text)).alias("bytes")).alias("locator"),
    )


class DedupState:
    """Keyed state on disk in ``folder``. ``absorb`` may be called again and
    again; key rows of earlier calls are remembered."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.keys_path, self.checkpoint = spark, f"{folder}/keys", f"{folder}/state"

    def absorb(self, keys: DataFrame, files_per_batch: int | None = None) -> None:
        """Append the key rows and run the stream until it has seen them."""
        keys.write.mode("append").parquet(self.keys_path)
        source = self.spark.readStream.schema(keys.schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        rows = source.parquet(self.keys_path)
        state = rows.groupBy("digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "locator")).alias("first"),
            F.count(F.lit(1)).alias("size"),
        )
        before = {k: self.spark.conf.get(k, None) for k in _STATE_CONF}
        for k, v in _STATE_CONF.items():
            self.spark.conf.set(k, v)
        try:
            run = (
                state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                .option("checkpointLocation", self.checkpoint).start()
            )
            run.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(self.keys_path)

    def groups(self) -> DataFrame:
        """(digest, keep_id, locator, group_size) as the state holds them."""
        state = self.spark.read.format("statestore").load(self.checkpoint)
        first = F.col("value").getField("min")
        return state.select(
            F.col("key.digest").alias("digest"), first["id"].alias("keep_id"), first["locator"].alias("locator"),
            F.col("value").getField("count").alias("group_size"),
        )


def _bucket(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(_BUCKETS * 32768))


def _maybe_hit(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose digest may be among ``hits``; none of those is lost."""
    bits = hits.select(_bucket(F.col("digest")).alias("b"))
    # bit positions of the SQL bitmap functions count from 0 within buckets of 32 768
    bitmap = bits.groupBy((F.col("b") / 32768).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("b") % 32768)).alias("bitmap")
    )
    b = _bucket(F.col("digest"))
    at = (b % 32768).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bitmap, at div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, at % 8) & 1") == 1
    return (
        texts.withColumns({"bucket": (b / 32768).cast("int"), "at": at}).join(F.broadcast(bitmap), "bucket")
        .withColumn("byte", byte).filter(bit).drop("bucket", "at", "bitmap", "byte")
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256) -> DataFrame:
    """One row (id, digest, keep_id, group_size, kept, bytes_checked) per row of ``docs``."""
    spark = docs.sparkSession
    state = DedupState(spark, shared_folder(spark, "exact-dedup"))
    state.absorb(key_rows(docs, text, doc_id, digest))
    groups = saved(state.groups(), "exact-dedup-groups")
    hits = groups.filter("group_size > 1").select("digest")
    texts = docs.select(F.col(doc_id).alias("id"), normalised(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    texts = _maybe_hit(texts, hits)
    clash = saved(
        texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo != hi").select("digest"),
        "exact-dedup-clash",
    )
    rows = state.keys().groupBy("digest", "id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    out = rows.join(groups.select("digest", "keep_id", "group_size").hint("merge"), "digest").withColumn("variant", F.lit(None).cast("string"))
    if not clash.isEmpty():
        own = texts.join(clash, "digest", "left_semi").groupBy("digest", "norm", "id").agg(F.count(F.lit(1)).alias("n"))
        own = saved(own, "exact-dedup-clash-texts")
        by_text = own.groupBy("digest", "norm").agg(
            F.min(F.struct(F.col("id").isNull().alias("absent"), "id"))["id"].alias("keep_id"), F.sum("n").alias("group_size")
        )
        again = own.join(by_text.hint("merge"), ["digest", "norm"]).select(
            "digest", "id", F.col("n").cast("int"), "keep_id", "group_size", F.sha2("norm", 512).alias("variant")
        )
        out = out.join(clash, "digest", "left_anti").unionByName(again)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    )
    return out.select("id", "digest", "variant", "keep_id", "group_size", "kept", (F.col("group_size") > 1).alias("bytes_checked"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    kept = deduplicate(docs, text, doc_id).filter("kept").select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("__key"), F.col("digest").alias("__digest")
    )
    rows = docs.withColumns({"__key": id_key(doc_id), "__digest": sha256(normalised(text))}).join(kept.hint("merge"), ["__key", "__digest"])
    first = F.row_number().over(Window.partitionBy("__key", "__digest").orderBy(F.lit(1)))
    return rows.withColumn("__row", first).filter("__row = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
