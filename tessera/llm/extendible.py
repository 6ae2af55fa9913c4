"""Sharding by extendible hashing.

A directory maps hash prefixes to shards. A bucket that exceeds its byte limit
is split on the next bit of the hash; all other buckets stay as they are. Sizes
are summed once per cell of ``bits`` leading bits, so splitting works on counts
and not on documents; the few cells that are still too large are summed again
with more bits. Rows of equal key cannot be told apart by any bit: if they
exceed the limit, they are dealt to slots and cut into pages by running sums.

Defined cases: a null text has 0 bytes; a null key hashes as an empty one; a
single document larger than the limit has a shard of its own and is marked
``oversize``; an empty table has no shards. The shard of a document depends on
the table alone; only rows of one key that exceeds the limit are dealt by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import documents, saved, whole
from tessera.session import cut_lineage

#: Bytes of text that a shard holds at most.
LIMIT = 16 << 20
#: Bits of a hash in use; the first 60 bits of the MD5 digest of the key.
BITS = 60


def key_hash(key: Column) -> Column:
    hexa = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexa, 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - bits).cast("int"))


def directory(sizes: DataFrame, limit: int = LIMIT, step: int = 8) -> DataFrame:
    """(depth, prefix, bytes, rows, full): the leaves. ``sizes`` has h and bytes.
    ``full`` marks leaves of all bits that still exceed the limit."""
    total = sizes.agg(F.sum("bytes").alias("bytes")).first()["bytes"]
    if total is None:
        return sizes.select(F.lit(0).alias("depth"), F.col("h").alias("prefix"), "bytes", F.lit(1).cast("long").alias("rows"), F.lit(False).alias("full"))
    start, leaves = 0, None
    bits = min(BITS, max(0, (total // limit).bit_length()) + step)
    todo = sizes
    while True:  # nearly always once: cells of ``bits`` bits are small
        cells = cut_lineage(todo.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")))
        ancestors = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(bits)))).withColumn(
            "prefix", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int"))
        )
        nodes = ancestors.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1)  # one row cannot be split
        found = ancestors.select("cell", "depth", "prefix").join(
            nodes.filter(fits if bits < BITS else fits | (F.col("depth") == BITS)), ["depth", "prefix"]
        ).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "bytes", "rows")).alias("leaf"))
        found = cut_lineage(found)
        own = found.select("leaf.*").distinct().withColumn("full", (F.col("bytes") > limit) & (F.col("rows") > 1))
        leaves = own if leaves is None else leaves.unionByName(own)
        open_cells = cut_lineage(cells.join(found.select("cell"), "cell", "left_anti").select("cell"))
        if bits == BITS or open_cells.isEmpty():
            return cut_lineage(leaves)
        todo = todo.withColumn("cell", _prefix(F.col("h"), bits)).join(open_cells, "cell", "left_semi").drop("cell")
        start, bits = bits + 1, min(BITS, bits + 2 * step)


def _leaves_of(sizes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``sizes`` with the depth, shard name, shard_bytes and full of its leaf."""
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()] or [0]  # at most BITS + 1
    # each row has exactly one leaf among the depths in use
    tries = sizes.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))).withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
    rows = tries.join(leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), "full"), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), 64, "0").substr(F.lit(65) - F.col("depth"), F.col("depth")))
    return rows.withColumn("shard", name).drop("prefix")


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bytes, depth, shard, shard_bytes, oversize) per row. ``shard`` is the prefix in binary
    digits, followed by slot and page where the rows of one hash exceed the limit."""
    sizes = saved(docs.select(
        F.col(key).alias("id"), key_hash(F.col(key)).alias("h"), F.octet_length(whole(text)).cast("long").alias("bytes"), F.xxhash64(whole(text)).alias("t")
    ), "extendible-sizes")
    rows = _leaves_of(sizes, directory(sizes, limit))
    out = ["id", "bytes", "depth", "shard", "shard_bytes", "oversize"]
    pages = _pages(rows.filter("full"), limit)
    total = pages.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    pages = pages.drop("shard_bytes").join(total, "shard")
    return rows.filter("NOT full").withColumn("oversize", F.col("bytes") > limit).select(*out).unionByName(pages.select(*out))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Cut the rows of each full hash (columns shard, shard_bytes, bytes, t) into pages.
    Slots hold about a quarter of the limit each, so no window gathers a whole key."""
    slots = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") * 4 / limit)).cast("long")
    rows = rows.withColumn("oversize", F.col("bytes") > limit)
    rows = rows.withColumn("slot", F.when(F.col("oversize"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), slots)))
    w = Window.partitionBy("shard", "slot").orderBy("t", "bytes")
    run = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a page takes up half a limit and the row that crosses its end, which is no larger than the other half
    half = F.floor((run - 1) / (limit / 2)).cast("long")
    page = F.when(F.col("oversize"), F.row_number().over(w)).when(F.col("bytes") > limit / 2, -F.row_number().over(w)).otherwise(half)
    rows = rows.withColumn("page", page)
    return rows.withColumn("shard", F.concat_ws("_", "shard", F.col("slot").cast("string"), F.col("page").cast("string"))).drop("slot", "page")


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` in one folder per shard (column ``shard``); a task writes whole shards."""
    rows = docs.withColumns({"__h": key_hash(F.col(key)), "__bytes": F.octet_length(whole(text)).cast("long"), "__t": F.xxhash64(whole(text))})
    sizes = saved(rows.select(F.col("__h").alias("h"), F.col("__bytes").alias("bytes")), "extendible-sizes")
    at = _leaves_of(sizes.select("h").distinct(), directory(sizes, limit))  # all rows of a hash share its leaf
    rows = rows.join(at.select(F.col("h").alias("__h"), "shard", "shard_bytes", "full"), "__h")
    cut = _pages(rows.filter("full").withColumnsRenamed({"__bytes": "bytes", "__t": "t"}), limit)
    out = [*docs.columns, "shard"]
    rows.filter("NOT full").select(*out).unionByName(cut.select(*out)).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.col("bytes").alias("size"), "depth", "shard", "shard_bytes", "oversize")


#: No key of the tables exceeds a shard alone, so pages do not occur.
SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), n AS (
  SELECT depth, h >> (60 - depth) AS prefix, CAST(sum(size) AS BIGINT) AS shard_bytes, count(*) AS n
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 61)) GROUP BY ALL
), leaf AS (
  SELECT d.doc_id, d.size, d.h, min(n.depth) AS depth FROM d JOIN n ON n.prefix = d.h >> (60 - n.depth)
  WHERE n.shard_bytes <= {LIMIT} OR n.n = 1 OR n.depth = 60 GROUP BY ALL
)
SELECT leaf.doc_id, leaf.size, leaf.depth,
       CASE WHEN leaf.depth = 0 THEN '' ELSE right(lpad(bin(n.prefix), 64, '0'), leaf.depth) END AS shard,
       n.shard_bytes, n.shard_bytes > {LIMIT} AS oversize
FROM leaf JOIN n ON n.depth = leaf.depth AND n.prefix = leaf.h >> (60 - leaf.depth)
"""
