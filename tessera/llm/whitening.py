"""Whitening of embeddings from a polarisation covariance.

Components become whole numbers, so every sum below is exact and does not
depend on the order of its terms. The fit list is each distinct vector once.
One aggregate gives its size and the sum of every dimension; a second one gives
the squared centred values of every dimension and of every sum of two
dimensions. Covariances follow by polarisation,

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2,

as fractions of whole numbers, rounded to double precision once; ``eigh`` of
the assembled matrix gives the components. Squares are taken of values centred
on the whole number below the mean; what is left of the mean, less than one, is
then moved exactly: sum (n*w - f)^2 = n^2 sum w^2 - 2 n f sum w + n f^2.

A task holds one batch of vectors and the sums of all pairs. The driver gets
one row per pair of dimensions, whatever the number of vectors, and broadcasts
the leading components. The covariance of the whitened fit list is measured the
same way and compared with the identity.

Defined cases: rows whose vector is null or holds null or non-finite entries
are dropped; shorter vectors count as if they ended in zeros; repeated rows
each return their own; a null identifier is a row like any other; directions
without variance have whitened 0 and explained 0 and are left out of the
identity's error; an empty table gives no rows; deviations beyond 64 bits
raise; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import saved

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Directions below this part of the total variance have none.
_NO_VARIANCE = 1e-13
_MOST = (1 << 63) - 1


def whole_vector(v: Column) -> Column:
    """The vector as whole numbers; null for vectors that take no part."""
    v = v.cast("array<double>")
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")))


def padded(x: Column, width: int) -> Column:
    """``x`` with zero components up to ``width``."""
    return F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size(x)))


def _matrix(x: pd.Series, below: list[int]) -> np.ndarray:
    """Rows centred on ``below``."""
    return np.stack([np.asarray(v, np.int64) for v in x]) - np.asarray(below, np.int64)


def pair_sums(w: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """For every dimension (i, i) and pair i < j: sum and sum of squares of
    w_i, or of w_i + w_j, exact."""
    largest = max(1, int(np.abs(w).max(initial=0)))
    step = min(len(w), _MOST // (2 * largest) ** 2)
    if step < 1:  # beyond 64 bits already for one row
        w, step = w.astype(object), len(w)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    d = w.shape[1]
    for at in range(0, len(w), step or 1):
        part = w[at:at + step]
        for i in range(d):
            both = part[:, i:] + part[:, i:i + 1]
            both[:, 0] = part[:, i]
            linear, square = both.sum(axis=0).tolist(), (both * both).sum(axis=0).tolist()
            for j in range(i, d):
                s, q = out.get((i, j), (0, 0))
                out[i, j] = s + linear[j - i], q + square[j - i]
    return out


def polarised(fit: DataFrame, n: int, sums: list[int]) -> list[list[Fraction]]:
    """The exact covariance matrix (divisor n) of the fit list."""
    below = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, below)]

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            if len(batch):
                for pair, (s, q) in pair_sums(_matrix(batch["x"], below)).items():
                    a, b = total.get(pair, (0, 0))
                    total[pair] = a + s, b + q
        if total:
            yield pd.DataFrame(
                [(i, j, str(s), str(q)) for (i, j), (s, q) in total.items()], columns=["i", "j", "linear", "square"]
            )

    parts = fit.select("x").mapInPandas(squares, "i int, j int, linear string, square string")
    rows = parts.groupBy("i", "j").agg(
        F.sum(F.col("linear").cast("decimal(38,0)")).alias("linear"), F.sum(F.col("square").cast("decimal(38,0)")).alias("square")
    ).collect()  # one per pair of dimensions
    variance = {}
    for r in rows:
        f = rest[r["i"]] + (rest[r["j"]] if r["i"] != r["j"] else 0)
        centred = n * n * int(r["square"]) - 2 * n * f * int(r["linear"]) + n * f * f
        variance[r["i"], r["j"]] = Fraction(centred, n ** 3)
    d = len(sums)
    cov = [[Fraction(0)] * d for _ in range(d)]
    for (i, j), v in variance.items():
        cov[i][j] = cov[j][i] = v if i == j else (v - variance[i, i] - variance[j, j]) / 2
    return cov


def leading(cov: list[list[Fraction]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace), falling."""
    v = np.array([[float(c) for c in row] for row in cov], np.float64).reshape(len(cov), len(cov))
    value, vector = np.linalg.eigh(v)
    return value[::-1][:most], vector[:, ::-1][:, :most], float(sum(cov[i][i] for i in range(len(cov))))


class Whitener:
    """What a task needs to whiten rows; its size depends on the dimensions only."""

    def __init__(self, n: int, sums: list[int], cov: list[list[Fraction]], components: int):
        self.n = n
        self.below = [s // n for s in sums]
        self.rest = [s - n * b for s, b in zip(sums, self.below)]
        value, vector, trace = leading(cov, components)
        has = value > _NO_VARIANCE * max(trace, 0.0)
        self.has = has & (value > 0)
        self.explained = np.where(self.has, value / trace if trace > 0 else 0.0, 0.0)
        self.axes = np.where(self.has, vector / np.sqrt(np.where(self.has, value, 1.0)), 0.0)

    def whitened(self, x: pd.Series) -> np.ndarray:
        w = _matrix(x, self.below) - np.asarray([r / self.n for r in self.rest])
        return w @ self.axes

    def deviations(self, x: pd.Series) -> list[int]:
        w = _matrix(x, self.below)
        rest = np.asarray(self.rest, np.int64)
        if (self.n * (int(np.abs(w).max(initial=0)) + 1)) ** 2 * max(1, w.shape[1]) > _MOST:
            w, rest = w.astype(object), rest.astype(object)
        z = w * self.n - rest
        return [int(t) for t in (z * z).sum(axis=1)] if w.shape[1] else [0] * len(w)


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the measured covariance of the whitened fit
    list minus the identity, over directions with variance."""
    k = int(model.has.sum())
    if not k:
        return 0.0

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                y = model.whitened(batch["x"])[:, model.has]
                first += y.sum(axis=0)
                second += y.T @ y
        yield pd.DataFrame({"at": range(k + k * k), "value": np.concatenate([first, second.ravel()])})

    rows = fit.select("x").mapInPandas(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    got = np.zeros(k + k * k)
    for r in rows:
        got[r["at"]] = r["value"]
    mean = got[:k] / model.n
    return float(np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error);
    ``vectors`` has ``id`` and ``v`` (array of numbers)."""
    spark = vectors.sparkSession
    rows = vectors.select("id", whole_vector(F.col("v")).alias("x")).filter(F.col("x").isNotNull())
    width = rows.agg(F.max(F.size("x"))).first()[0]
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:  # no rows, or no dimension
        return spark.createDataFrame([], schema)
    rows = rows.select(F.col("id").cast("string").alias("id"), padded(F.col("x"), width).alias("x"))  # text: null beside long is a float in pandas
    fit = saved(rows.select("x").distinct(), "whitening-fit")
    totals = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")
    ).orderBy("at").collect()  # one per dimension
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    model = Whitener(n, sums, polarised(fit, n, sums), components)
    error = identity_error(fit, model)
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = m.axes.shape[1]
        for batch in batches:
            if len(batch):
                deviation = m.deviations(batch["x"])
                if max(deviation) > _MOST:
                    raise OverflowError("a deviation does not fit 64 bits")
                yield pd.DataFrame({
                    "id": batch["id"].repeat(k), "component": np.tile(np.arange(1, k + 1), len(batch)), "n": m.n,
                    "deviation": np.repeat(np.array(deviation, np.int64), k), "whitened": m.whitened(batch["x"]).ravel(),
                    "explained": np.tile(m.explained, len(batch)), "identity_error": error,
                })

    return rows.mapInPandas(project, schema.replace("id long", "id string")).withColumn("id", F.col("id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return whiten(rows).withColumnRenamed("id", "vec_id")
