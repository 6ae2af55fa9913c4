"""Incremental screens: only what a changed tile reaches runs again."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.plans.queries_screens import screen_of, scene
from tessera.plans.registry import Tables
from tessera.streaming.screen import Screen, Source, Step

SCHEMA = "well string, site int, value long"


@pytest.fixture
def plan(spark, tmp_path):
    """Three steps: double the values, sum them (hides some changes), and join both."""
    calls = []

    def make(**versions):
        def note(name, out):
            calls.append(name)
            return out

        schema = spark.createDataFrame([], SCHEMA).schema
        return Screen(spark, f"{tmp_path}/steps", ["well", "site"], [Source("raw", f"{tmp_path}/raw", schema)], [
            Step("double", ("raw",), lambda d: note("double", d.withColumn("value", F.col("value") * 2).filter("value > 0")), versions.get("double", "1")),
            Step("total", ("double",), lambda d: note("total", d.groupBy("well", "site").agg(F.sum("value").alias("total"))), versions.get("total", "1")),
            Step("share", ("double", "total"), lambda d, s: note("share", d.join(s, ["well", "site"]).withColumn("share", F.col("value") / F.col("total")))),
            Step("report", ("total",), lambda s: note("report", s.withColumn("even", F.col("total") % 4 == 0))),
        ], buckets=4)

    def feed(rows, name):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")

    os.makedirs(f"{tmp_path}/raw")
    return make, feed


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_only_changed_tiles_run_again(spark, plan):
    make, feed = plan
    feed([(w, s, v) for w in "AB" for s in range(10) for v in (1, 2, 3)], "first")
    assert make().run() == {"raw": 20, "double": 20, "total": 20, "share": 20, "report": 20}
    assert make().run() == {"raw": 0, "double": 0, "total": 0, "share": 0, "report": 0}
    feed([("A", 3, 5), ("A", 3, 6)], "one tile")
    screen = make()
    assert screen.run() == {"raw": 1, "double": 1, "total": 1, "share": 1, "report": 1}
    assert rows(screen.table("total").filter("total <> 12"), "well", "site", "total") == [("A", 3, 22)]
    assert screen.table("share").count() == 19 * 3 + 2 and screen.table("raw").count() == 19 * 3 + 2
    # same sum, other values: what needs the sum only rests
    feed([("B", 1, 6)], "same sum")
    assert screen.run() == {"raw": 1, "double": 1, "total": 1, "share": 1, "report": 0}
    # same rows again in another order: nothing runs
    feed([("A", 3, 6), ("A", 3, 5)], "again")
    assert screen.run() == {"raw": 0, "double": 0, "total": 0, "share": 0, "report": 0}


def test_tile_that_loses_its_rows_and_new_version(spark, plan):
    make, feed = plan
    feed([("A", 1, 1), ("A", 2, 2)], "first")
    make().run()
    feed([("A", 1, -1)], "no rows behind the filter")
    screen = make()
    assert screen.run()["total"] == 1
    assert rows(screen.table("total"), "site", "total") == [(2, 4)] and rows(screen.table("share"), "site") == [(2,)]
    changed = make(total="2")
    assert changed.run() == {"raw": 0, "double": 0, "total": 2, "share": 2, "report": 2}


def test_wrong_graphs_raise(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    source = Source("raw", "/nowhere", schema)
    with pytest.raises(ValueError):
        Screen(spark, "/nowhere", ["well"], [source], [Step("a", ("b",), lambda d: d)])
    with pytest.raises(ValueError):
        Screen(spark, "/nowhere", ["well"], [source], [Step("raw", ("raw",), lambda d: d)])


def test_one_changed_tile_of_a_sequencing_screen(spark):
    px = scene(Tables(spark, "/root/testdata/sf0.001"))
    screen = screen_of(spark, px)
    tiles = px.select("well", "site").distinct().count()
    assert set(screen.run().values()) == {tiles}
    before = rows(screen.table("barcodes"), "well", "site", "cell", "cell_barcode_0")
    path = screen.sources["pixels"].path
    # one channel of one tile gets dark in one cycle
    dark = px.filter("site = 0").withColumn("value", F.when((F.col("cycle") == 2) & (F.col("channel") != "DAPI"), F.lit(400)).otherwise(F.col("value")))
    dark.coalesce(1).write.mode("append").parquet(path)
    assert set(screen.run().values()) <= {0, 1}
    after = rows(screen.table("barcodes"), "well", "site", "cell", "cell_barcode_0")
    assert [r for r in before if r[1] != 0] == [r for r in after if r[1] != 0] and before != after
