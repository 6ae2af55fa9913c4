"""Resampling: images as products with two matrices, also when pixels are missing."""

import numpy as np
import pytest

from tessera.operators import crops
from tests.test_large_joins import plan


@pytest.mark.parametrize("pixels", [1, 1 << 20])
def test_images_are_resampled_whole_in_one_stage(spark, monkeypatch, pixels):
    monkeypatch.setattr(crops, "PIXELS", pixels)
    rng = np.random.default_rng(2)
    rows = [(t, i, j, float(rng.integers(1, 90))) for t in range(5) for i in range(6) for j in range(8) if t or (i > 3 and j > 4)]
    rows += [(9, 40, 1, 7.0), (4, 0, 0, None)]
    df = spark.createDataFrame(rows, "tile long, i int, j long, value double")
    got = crops.resize(df, ["tile"], (6, 8), (3, 5))
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    want = {}
    for t in range(5):
        own = {(i, j): v for s, i, j, v in rows if s == t and v is not None}
        sums = {}
        for a, i, w in crops.resize_weights(6, 3):
            for b, j, u in crops.resize_weights(8, 5):
                if (i, j) in own:
                    sums[a, b] = sums.get((a, b), 0.0) + w * u * own[i, j]
        want |= {(t, *k): min(max(v, min(own.values())), max(own.values())) for k, v in sums.items()}
    found = {(r["tile"], r["i"], r["j"]): r["value"] for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
