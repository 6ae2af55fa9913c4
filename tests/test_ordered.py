"""Scans and quantiles must not depend on blocks or strategy."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from tessera.functions.special import chi2_tail_even
from tessera.operators.ordered import attach, blocked, scan
from tessera.operators.quantiles import quantiles
from tessera.operators.statistics import adjust_pvalues
from tessera.operators.tabular import interpolate


def skewed(spark, n=6000):
    # a third of the rows has key 0
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"), F.col("id").alias("o"),
        ((F.col("id") * 7919) % 1009).cast("double").alias("v"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("s"))


def test_scan_equals_window(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("o")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select("o", F.row_number().over(w).alias("a"), F.sum("v").over(up).alias("b"), F.min("v").over(up).alias("c"),
                     F.last("s", True).over(up).alias("d"), F.lag("v").over(w).alias("e"), F.max("v").over(up).alias("f"))
    for blocks in (2, 7, 64):
        got = scan(df, ["k"], [F.col("o")], {
            "a": ("count", None), "b": ("sum", F.col("v")), "c": ("min", F.col("v")), "d": ("last", F.col("s")),
            "e": ("lag", F.col("v")), "f": ("max", F.col("v"))}, blocks).select("o", *"abcdef")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_scan_without_keys_and_with_null_order(spark):
    df = spark.createDataFrame([(None, 1), (2.0, 2), (1.0, 3), (None, 4)], "x double, id int")
    rows = scan(df, [], [F.col("x"), F.col("id")], {"n": ("count", None)}).orderBy("n").collect()
    assert [r["id"] for r in rows] == [1, 4, 3, 2]


def test_scan_both_ways_and_with_null_keys(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") == 7, F.lit(None)).otherwise(F.col("k")))
    w = W.partitionBy("k").orderBy(F.col("v").desc(), F.col("o").desc())
    up = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select("o", F.sum("v").over(up).alias("a"), F.min("v").over(up).alias("b"), F.last("s", True).over(up).alias("c"),
                     F.lag("v").over(w).alias("d"), F.row_number().over(w).cast("long").alias("e"))
    got = scan(df, ["k"], [F.col("v"), F.col("o")], {
        "a": ("sum", F.col("v"), "back"), "b": ("min", F.col("v"), "back"), "c": ("last", F.col("s"), "back"), "d": ("lag", F.col("v"), "back"),
        "e": ("count", None, "back")}, 9).select("o", *"abcde")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ties_and_one_key_with_nearly_all_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.lit(1).alias("x"), "id")
    got = scan(df, ["k"], [F.col("x"), F.col("id")], {"n": ("count", None)}, 16)
    assert got.filter("k = -1").agg(F.max("n")).first()[0] == 18_000
    parts = blocked(df, [F.col("x"), F.col("id")], 16).groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert parts < 3_000  # the ties on x are split


def test_totals_must_be_one_row(spark):
    with pytest.raises(Exception, match="single row"):
        attach(spark.range(3), spark.range(2).withColumnRenamed("id", "n"), []).collect()
    assert attach(spark.range(3), spark.range(1).withColumnRenamed("id", "n"), []).count() == 3


def test_quantiles_equal_builtin(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("o") % 4 == 0, 5.0).otherwise(F.col("v")))
    df = df.withColumn("v", F.when(F.col("k") != 9, F.col("v"))).withColumn("k", F.when(F.col("k") != 8, F.col("k")))
    probs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    a = {r["k"]: r["q"] for r in quantiles(df, ["k"], F.col("v"), probs).collect()}
    b = {r["k"]: r["q"] for r in quantiles(df, ["k"], F.col("v"), probs, bounded=True).collect()}
    assert a.keys() == b.keys() and a[9] is None and b[9] is None
    assert all(np.allclose(a[k], b[k]) for k in a if k != 9)
    every = quantiles(df, [], F.col("v"), probs).first()["q"]
    assert np.allclose(every, np.percentile([r["v"] for r in df.filter("v IS NOT NULL").select("v").collect()], [p * 100 for p in probs]))
    assert quantiles(df.limit(0), [], F.col("v"), probs).first()["q"] is None


def test_large_chi_square_tails(spark):
    def slow(x, m):
        e = [k * math.log(x / 2) - x / 2 - math.lgamma(k + 1) for k in range(m)]
        top = max(e)
        return min(1.0, math.exp(top + math.log(math.fsum(math.exp(v - top) for v in e))))

    cases = [(float(x), m) for m in (1, 700, 800, 1000) for x in (1, 10, 500, 1400, 1500, 1600, 2000, 5000)]
    df = spark.createDataFrame([*cases, (0.0, 1000), (float("inf"), 3)], "x double, m int")
    got = {(r["x"], r["m"]): r["p"] for r in df.withColumn("p", chi2_tail_even(F.col("x"), F.col("m"))).collect()}
    assert got[0.0, 1000] == 1 and got[float("inf"), 3] == 0
    assert all(math.isclose(got[c], slow(*c), rel_tol=1e-9, abs_tol=1e-300) for c in cases)


def test_nan_p_values_stay_out_of_the_family(spark):
    df = spark.createDataFrame([(1, 0.001), (2, 0.01), (3, 0.04), (4, float("nan")), (5, None)], "id int, p double")
    got = {r["id"]: (r["bh"], r["hs"]) for r in adjust_pvalues(df, "p", bh="bh", holm_sidak="hs").collect()}
    assert got[4] == (None, None) and got[5] == (None, None)
    assert np.allclose([got[i][0] for i in (1, 2, 3)], [0.003, 0.015, 0.04])


def test_interpolate_edges(spark):
    df = spark.createDataFrame([(n, v) for n, v in enumerate([None, 1.0, None, 4.0, None, None])], "o int, v double")
    got = [r["v"] for r in interpolate(df, [], [F.col("o")], "v").orderBy("o").collect()]
    assert got == [None, 1.0, 2.5, 4.0, 4.0, 4.0]


def test_groups_that_share_one_value_are_split(spark):
    """100 000 groups with one zero each and 300 000 other values."""
    zeros = spark.range(100_000).select(F.col("id").alias("k"), F.lit(0.0).alias("v"))
    others = spark.range(300_000).select((F.col("id") % 100_000).alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    df = zeros.unionByName(others)
    sizes = [r["n"] for r in blocked(df, [F.col("v")], 8, ["k"]).groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 80_000
    want = df.groupBy("k").agg(F.percentile("v", 0.5).alias("m"))
    got = quantiles(df, ["k"], F.col("v"), [0.5]).select("k", F.col("q")[0].alias("m"))
    assert got.join(want, "k").filter(F.abs(got["m"] - want["m"]) > 1e-9).isEmpty() and got.count() == 100_000
