"""Quantiles of large groups sort each block in one direction only."""

import re

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantiles


def test_blocks_are_sorted_once(spark):
    rows = [(int(n % 3), None if n % 17 == 0 else float(n * 37 % 101)) for n in range(600)] + [(7, None), (8, 2.5)]
    df = spark.createDataFrame(rows, "g long, x double").repartition(5)
    got = quantiles(df, ["g"], F.col("x"), [0.0, 0.3, 0.5, 1.0])
    assert not re.search(r"_o0#\d+ DESC", got._jdf.queryExecution().optimizedPlan().toString())
    have = {r["g"]: r["q"] for r in got.collect()}
    assert have[7] is None and have[8] == [2.5] * 4
    for g in range(3):
        want = np.quantile([x for k, x in rows if k == g and x is not None], [0.0, 0.3, 0.5, 1.0])
        assert np.allclose(have[g], want)
