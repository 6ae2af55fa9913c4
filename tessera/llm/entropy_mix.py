"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and 2, those nearest to 1 in relative entropy
that meet each source's token target are exponentially tilted:
``rate = min(2, exp(tilt * size / largest size of the source))``. The tilts
solve a convex dual, one variable per source; Newton steps, kept inside a
bracket, run as aggregates over the histogram (source, size, documents), which
is combined before any shuffle. Rates become copies by systematic rounding in
order of size, in blocks of bounded length, so a source with a third of all
rows is dealt out; a few single documents of fitting size then close the gap.

Only DataFrame and SQL functions are used. Sizes count words; the driver sees
totals, never rows.

Defined cases: a null text has size 0; documents of size 0 are taken as 0
words; the null source comes last and is a source like any other; equal rows
are rounded one by one; empty tables give empty results. Rates depend on the
rows alone, and ties are broken by identifier, then text hash, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, documents, id_key, saved, whole
from tessera.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Rows of one rounding block, about.
BLOCK = 20_000
_UNIT = 1 << 20
#: Parts that the rows of a source are dealt to where they meet its row of aims.
_SALT = 64


def words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ranked(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``rank`` from 1 by ``column`` (unique values, null last),
    by ranges and their row counts."""
    lastly = F.col(column).isNull()
    parts = cut_lineage(df.repartitionByRange(lastly, F.col(column)).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ahead = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(lastly, column))
    return parts.withColumn("within", within).join(ahead, "part").withColumn("rank", F.col("within") + F.col("ahead")).drop(
        "part", "within", "ahead"
    )


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """``sources`` (source, total, ...) with ``target``: ``share`` of all
    totals dealt by weight, none above ``most`` times its own."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = cut_lineage(ranked(sources, "source").withColumn("weight", weight).withColumn("cap", F.col("total") * most).drop("rank"))
    level = 0.0
    while True:  # the level rises until no further source is at its cap
        full = F.col("weight") * level >= F.col("cap")
        row = t.agg(
            F.sum("total").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        whole_size = float(row["all"] or 0) * share
        if not row["open"]:
            break
        above = (whole_size - float(row["capped"] or 0)) / row["open"]
        if above <= level:
            break
        level = above
    return t.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def tilts(histogram: DataFrame, aims: DataFrame, most: float = MOST, max_steps: int = 80) -> DataFrame:
    """(key, tilt, full): the dual optimum per source. ``histogram`` has key,
    size, n; ``aims`` has key, target, total, largest, least (the smallest
    size above 0). Sources that take ``most`` times everything are ``full``."""
    small = F.col("least") / F.col("largest")
    state = aims.filter("total > 0 AND target > 0").select(
        "key", "target", "largest", (F.col("target") >= most * F.col("total")).alias("full"), F.lit(0.0).alias("tilt"),
        (-F.greatest(F.lit(0.0), F.log(F.col("total") / F.col("target"))) / small).alias("lo"), (F.log(F.lit(most)) / small).alias("hi"),
        F.lit(False).alias("done"),
    )
    state = cut_lineage(state)
    x, tilt = F.col("size") / F.col("largest"), F.col("tilt")
    raw = F.exp(tilt * x)

    def exact(value: Column) -> Column:  # decimals add up alike in any order, so reruns agree
        return F.sum(value.cast("decimal(28,9)")).cast("double")

    for _ in range(max_steps):
        running = state.filter("NOT full AND NOT done")
        if running.isEmpty():
            return state.select("key", "tilt", "full")
        sums = histogram.join(running.select("key", "tilt", "largest"), "key").groupBy("key").agg(
            exact(F.col("size") * F.col("n") * F.least(F.lit(most), raw)).alias("value"),
            exact(F.when(raw < most, F.col("size") * F.col("n") * x * raw).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("value") - F.col("target")
        lo, hi = F.when(gap < 0, tilt).otherwise(F.col("lo")), F.when(gap > 0, tilt).otherwise(F.col("hi"))
        newton = tilt - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (newton > lo) & (newton < hi)
        done = (F.abs(gap) <= 1e-9 * F.col("target")) | (hi - lo <= 1e-12 * (F.abs(hi) + F.abs(lo)))
        going = F.col("value").isNotNull()
        state = cut_lineage(state.join(sums, "key", "left").select(
            "key", "target", "largest", "full",
            F.when(going & ~done, F.when(inside, newton).otherwise((lo + hi) / 2)).otherwise(tilt).alias("tilt"),
            F.when(going, lo).otherwise(F.col("lo")).alias("lo"), F.when(going, hi).otherwise(F.col("hi")).alias("hi"),
            F.when(going, done).otherwise(F.col("done")).alias("done"),
        ))
    raise RuntimeError("Newton iterations did not settle")


def _rounded(rows: DataFrame, aims: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``copies``: systematic rounding in order of size, per
    block, in whole units so that the order of additions does not matter."""
    salted = aims.select("key", "target", "tilt", "full", "largest", "docs", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "h", "row"), F.lit(_SALT)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    rate = F.when(F.col("full"), F.lit(MOST)).when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(MOST), F.exp(F.col("tilt") * F.col("size") / F.col("largest")))
    )
    part = F.pmod(F.xxhash64("id", "h"), F.ceil(F.col("docs") / F.lit(block))).cast("int")
    dealt = dealt.withColumns({"rate": rate, "part": part}).withColumn("units", F.round(F.col("rate") * _UNIT).cast("long"))
    run = Window.partitionBy("key", "part").orderBy(F.col("size").desc(), "id", "h", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("units").over(run) + F.lit(_UNIT // 2)
    copies = F.shiftright(upto, 20) - F.shiftright(upto - F.col("units"), 20)
    return dealt.withColumn("copies", copies.cast("int")).drop("part", "units", "tilt", "full", "largest", "docs")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", share: float = SHARE,
        weights=WEIGHTS, block: int = BLOCK, closing_rounds: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, h (hash of the text), size, source_size, target, rate, copies."""
    name = F.col(source).cast("string")
    rows = saved(docs.select(
        F.concat(F.when(name.isNull(), "0").otherwise("1"), F.coalesce(name, F.lit(""))).alias("key"), name.alias("source"),
        F.col(doc_id).alias("id"), F.xxhash64(whole(text)).alias("h"), words(text).alias("size"), F.monotonically_increasing_id().alias("row"),
    ), "mix-sizes")
    histogram = cut_lineage(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = histogram.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.sum("n").alias("docs"),
    )
    aims = cut_lineage(targets(sources, share, MOST, weights))
    aims = aims.join(tilts(histogram.filter("size > 0"), aims), "key", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    aims = cut_lineage(aims)
    rows = saved(_rounded(rows, aims, block), "mix-copies")
    for _ in range(closing_rounds):  # per source, the one document whose size best closes what is left
        left = rows.groupBy("key").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("left"))
        able = F.when(F.col("left") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        off = F.abs(F.col("size") - F.abs("left"))
        picks = rows.join(left, "key").filter(able & (F.col("size") > 0) & (off < F.abs("left"))).groupBy("key").agg(
            F.min(F.struct(off.alias("off"), "id", "h", "row")).alias("best"), F.first("left").alias("left")
        ).select(F.col("best.row").alias("row"), F.signum("left").cast("int").alias("change"))
        rows = saved(
            rows.join(picks, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change"), "mix-closing"
        )
    return rows.join(aims.select("key", F.col("total").alias("source_size")), "key").drop("key", "row")


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns only."""
    rates = mix(docs, text, doc_id, **options)
    taken = rates.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("__key"), F.col("h").alias("__h")).agg(
        F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows")
    ).filter("__all > 0")
    rows = docs.withColumns({"__key": id_key(doc_id), "__h": F.xxhash64(whole(text))}).join(taken.hint("merge"), ["__key", "__h"])
    at = F.row_number().over(Window.partitionBy("__key", "__h").orderBy(F.lit(1)))
    rows = rows.withColumn("__at", at).withColumn("__times", F.expr("cast(__all div __rows + if(__at <= __all % __rows, 1, 0) as int)"))
    return rows.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )
