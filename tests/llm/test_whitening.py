"""Whitening against a dense computation in whole numbers."""

import math

import numpy as np
import pytest

from tessera.llm import whitening


def slow(vectors, components=16):
    """n, deviations per row, eigenvalues, eigenvectors, means of the fit list, all rows as whole numbers."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    centred = [[n * v[j] - s[j] for j in range(d)] for v in fit]
    cov = [[sum(c[i] * c[j] for c in centred) / n ** 3 for j in range(d)] for i in range(d)]
    value, vector = np.linalg.eigh(np.array(cov))
    return n, deviation, value[::-1][:components], vector[:, ::-1][:, :components], cov, (np.array(x, object) * n - np.array(s, object)) / n


def check(rows, ids, vectors, components=16):
    n, deviation, value, vector, cov, centred = slow(vectors, components)
    k = min(components, len(vectors[0]))
    by = {(r["id"], r["component"]): r for r in rows}
    assert len(rows) == len(by) == len(ids) * k
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) <= 1e-9
    trace = sum(cov[i][i] for i in range(len(cov)))
    for c in range(1, k + 1):
        assert abs(by[ids[0], c]["explained"] - value[c - 1] / trace) <= 1e-9
        want = centred.astype(float) @ vector[:, c - 1] / math.sqrt(value[c - 1])
        got = np.array([by[i, c]["whitened"] for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
    assert [by[i, 1]["deviation"] for i in ids] == deviation


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = whitening.query(spark, folder).withColumnRenamed("vec_id", "id").collect()
    check(rows, [i for i, _ in table], [v for _, v in table])


def test_repeated_and_unsound_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=6).round(3).tolist() for _ in range(80)]
    vectors += [vectors[0]] * 40
    bad = [(900, None, "x"), (901, [1.0, None, 0, 0, 0, 0], "x"), (902, [float("nan")] * 6, "x"), (903, [float("inf")] + [0.0] * 5, "x")]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(i, None if v is None else [None if c is None else float(c) for c in v], t) for i, v, t in bad]
    df = spark.createDataFrame(rows, "id long, v array<double>, n string").repartition(4)
    check(whitening.whiten(df).collect(), list(range(120)), vectors)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in rng.integers(-(1 << 20), 1 << 20, 3)] for _ in range(30)]
    check(whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")).collect(), list(range(30)), vectors)


@pytest.mark.parametrize("large", [3, 1 << 30, 1 << 40])
def test_pair_sums(large):
    rng = np.random.default_rng(4)
    w = rng.integers(-large, large, (50, 4))
    got, exact = whitening.pair_sums(w), w.astype(object)
    for i in range(4):
        for j in range(i, 4):
            both = exact[:, i] if i == j else exact[:, i] + exact[:, j]
            assert got[i, j] == (both.sum(), (both * both).sum())


def test_no_variance_short_vectors_and_null_id(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "id long, v array<double>")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 6 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in rows} == {(0.0, 0.0, 0, 0.0)}
    short = spark.createDataFrame([(1, [1.0]), (2, [2.0, 1.0]), (3, [0.0, 0.5])], "id long, v array<float>")
    check(whitening.whiten(short).collect(), [1, 2, 3], [[1.0, 0.0], [2.0, 1.0], [0.0, 0.5]])
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], "id long, v array<double>")).collect() == []
