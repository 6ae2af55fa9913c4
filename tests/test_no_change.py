"""A change of exactly zero has no sign, however its mean is added up."""

from functools import reduce
from operator import add

from tessera.plans.catalog import QUERIES


def test_zero_change_has_no_sign(spark, tmp_path):
    x = [0.1, 0.02, 0.03]
    assert reduce(add, x) / 3 > 0.05  # a sum of doubles misses the mean
    rows = [(1, "A", v, 0.0) for v in x] + [(1, "R", v, 0.0) for v in (0.09, 0.05)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["differential_overlap"](spark, str(tmp_path)).collect()
    assert [(r["logFC_x"], r["same_sign"]) for r in got] == [(0.0, False)]
