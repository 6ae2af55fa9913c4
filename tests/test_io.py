"""Readers, writers, steps and incremental runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import registry
from tessera.plans import workflows  # noqa: F401  (publishes steps)
from tessera.sources import library, tables, tiles
from tessera.streaming.incremental import process_new


def test_csv_sniffing_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,nan\n2,3.5\n")
    (tmp_path / "b.csv").write_text("x  y\n 4  5\n")
    (tmp_path / "e.csv").write_text("")
    a = tables.load_file(spark, str(tmp_path / "a.csv"), "x int, y double")
    assert [tuple(r) for r in a.orderBy("x").collect()] == [(1, None), (2, 3.5)]
    assert tables.load_file(spark, str(tmp_path / "b.csv"), "x int, y int").first()["y"] == 5
    many = tables.load_many(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "e.csv")], "x int, y double, z string")
    assert sorted(map(tuple, many.collect()), key=str) == [(1, None, None), (2, 3.5, None), (4, 5.0, None)]
    with pytest.raises(ValueError, match="schema"):
        tables.load_file(spark, str(tmp_path / "a.csv"))
    (tmp_path / "q.csv").write_text('y,x\n"1,5",2\n,3\n')
    assert sorted(map(tuple, tables.load_file(spark, str(tmp_path / "q.csv"), "x int, y string").collect())) == [(2, "1,5"), (3, None)]
    (tmp_path / "w.csv").write_text("x,y\nfive,1\n")
    with pytest.raises(Exception, match="(?i)cast"):
        tables.load_file(spark, str(tmp_path / "w.csv"), "x int, y double").collect()
    with pytest.raises(TypeError):
        tables.load_file(spark, 3)
    with pytest.raises(IOError):
        tables.load_file(spark, "x.nd2x")


def test_save_and_step(spark, tmp_path):
    src, out = str(tmp_path / "cells.parquet"), str(tmp_path / "out.csv")
    spark.range(4).write.parquet(src)
    if "double" not in registry.STEPS:
        registry.step("double")(lambda df, factor=2: df.select((F.col("id") * factor).alias("id")))
    registry.run(spark, "double", output=out, df=src, factor=3)
    assert sorted(r["id"] for r in spark.read.csv(out, header=True, schema="id long").collect()) == [0, 3, 6, 9]
    with pytest.raises(TypeError, match="no arguments"):
        registry.run(spark, "double", df=src, radius=15)


def test_tiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 60000, (2, 5, 7))
    px = spark.createDataFrame([(3, int(p), int(i), int(j), int(v)) for (p, i, j), v in np.ndenumerate(a)], "site int, page int, i int, j int, value int")
    path = tiles.write_tiff(px, str(tmp_path), ["site"], "page").first()["path"]
    got = tiles.read_tiff(spark, path).orderBy("page", "i", "j").collect()
    assert [int(r["value"]) for r in got] == a.ravel().tolist()
    assert tiles.storage_type(np.array([70000])).dtype == np.float32


def test_vectors_and_matrix(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1 2 3\n4 5 6\n")
    assert tables.load_vectors(spark, str(tmp_path / "v.txt"), 3).orderBy("line").first()["features"] == [1, 2, 3]
    with pytest.raises(Exception, match="expected 4"):
        tables.load_vectors(spark, str(tmp_path / "v.txt"), 4).collect()
    (tmp_path / "m.csv").write_text(",s1,s2\nTP53,1,2\n")
    assert tuple(tables.load_matrix(spark, str(tmp_path / "m.csv"), ["s1", "s2"]).first()) == ("TP53", 1.0, 2.0)


def test_thousands_of_small_files_are_one_scan(spark, tmp_path):
    paths = []
    for n in range(5000):
        paths.append(str(tmp_path / f"{n}.csv"))
        with open(paths[-1], "w") as f:
            f.write(f"cell,area\n{n},{n * 2}\n" if n % 2 else f"area cell\n{n * 2} {n}\n")
    rows = tables.load_many(spark, paths, "cell int, area int")
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # lines, and their heads
    assert rows.filter("area = cell * 2").count() == 5000


def test_side_car_by_line_number(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1 2\n3 4\n5 6\n")
    (tmp_path / "c.txt").write_text("x\ny\nz\n")
    f, c = (tables.numbered_lines(spark, str(tmp_path / n)).drop("file") for n in ("f.txt", "c.txt"))
    both = tables.join_by_line(f, c.withColumnRenamed("value", "cell")).orderBy("line").collect()
    assert [tuple(r) for r in both] == [(0, "1 2", "x"), (1, "3 4", "y"), (2, "5 6", "z")]
    with pytest.raises(Exception, match="without a partner"):
        tables.join_by_line(f, c.withColumnRenamed("value", "cell").filter("line < 2")).collect()


def test_a_missing_file_is_not_an_option(spark, tmp_path):
    registry.STEPS.setdefault("same", lambda df: df)
    with pytest.raises(Exception, match="(?i)exist"):
        registry.run(spark, "same", df=[str(tmp_path / "none.parquet")])


def test_library_readers(spark, tmp_path):
    f = tmp_path / "lib.tsv"
    f.write_text("Target Gene ID\tTarget Gene Symbol\tsgRNA Target Sequence\tRule Set 2 score\n"
                 "1\tA1BG\tAAAC\t0.2\n1\tA1BG\tCCCA\t0.9\n1\tA1BG\tGGGA\t\n\tNon-Targeting Control\tTTTA\t\n")
    rows = library.import_scored_library(spark, str(f)).orderBy("gene_id", "rank").collect()
    assert [(r["gene_id"], r["rank"], r["sgRNA"]) for r in rows][-3:] == [(1, 1, "CCCA"), (1, 2, "AAAC"), (1, 3, "GGGA")]
    (tmp_path / "sym.tsv").write_text("# note\nApproved symbol\tNCBI Gene ID(supplied by NCBI)\nA1BG\t1\nXX\t\n")
    symbols = library.import_symbols(spark, str(tmp_path / "sym.tsv"))
    (tmp_path / "t.tsv").write_text("GENE\tSEQUENCE\nA1BG\tACGT\nA1BG\tTTTT\nNOPE\tCCCC\n")
    got = library.import_symbol_library(spark, str(tmp_path / "t.tsv"), symbols).orderBy("rank").collect()
    assert [(r["rank"], r["sgRNA"]) for r in got] == [(1, "ACGT"), (2, "TTTT")]
    (tmp_path / "genes.csv").write_text("5\n6\n")
    assert {r["design"] for r in library.load_gene_list(spark, str(tmp_path / "genes.csv")).collect()} == {"genes"}


def test_only_new_files_are_processed(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    seen = []

    def work(df):
        seen.append(df.count())
        return df.groupBy("tile").agg(F.sum("v").alias("v"))

    schema = spark.createDataFrame([], "tile long, v long").schema
    for tile in (1, 2):
        spark.range(10).select(F.lit(tile).cast("long").alias("tile"), F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(src)
        process_new(spark, src, schema, work, out, ck)
    assert seen == [10, 10]
    assert sorted((r["tile"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, 45), (2, 45)]
