"""Cubic smoothing splines of many groups at once.

Knots are inserted where the residuals are largest until the sum of squares is
within the bound; then, of all splines with these knots that keep the bound,
the smoothest one is taken (least jumps of the third derivative). The data meet
the knots in one aggregate per round: the sums of the four basis functions of
every interval between knots are all that the banded normal equations, the
residuals per interval and the smoothing need. What is solved per group has the
size of its knots, not of its data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.operators import ordered
from tessera.operators.ordered import attach
from tessera.session import cut_lineage

_PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]


def basis(x: Column, knots: Column, interval: Column) -> list[Column]:
    """The four cubic basis functions that are not zero in an interval (from 0)
    of ``knots`` (ends included); outside the knots their polynomials go on."""
    n = F.size(knots)
    knot = lambda k: F.element_at(knots, F.greatest(F.lit(1), F.least(n, interval + k + 1)).cast("int"))
    left = {j: x - knot(1 - j) for j in (1, 2, 3)}
    right = {j: knot(j) - x for j in (1, 2, 3)}
    out = [F.lit(1.0)]
    for degree in (1, 2, 3):
        new, saved = [], F.lit(0.0)
        for r in range(degree):
            part = out[r] / (right[r + 1] + left[degree - r])
            new.append(saved + right[r + 1] * part)
            saved = left[degree - r] * part
        out = [*new, saved]
    return out


def interval_of(x: Column, knots: Column) -> Column:
    """The interval of ``x``; the ends belong to the outermost ones."""
    inner = F.slice(knots, 2, F.size(knots) - 2)
    return F.size(F.filter(inner, lambda k: k <= x))


class Sums:
    """Gram blocks, right sides and squares per interval of one group."""

    def __init__(self, knots: np.ndarray, rows: pd.DataFrame):
        self.knots, m = knots, len(knots) - 1
        self.gram, self.rhs, self.square = np.zeros((m, 4, 4)), np.zeros((m, 4)), np.zeros(m)
        self.count = np.zeros(m, np.int64)
        for k, gram, rhs, square, count in zip(rows["interval"], rows["gram"], rows["rhs"], rows["square"], rows["n"]):
            for (a, b), v in zip(_PAIRS, gram):
                self.gram[k, a, b] = self.gram[k, b, a] = v
            self.rhs[k], self.square[k], self.count[k] = rhs, square, count

    def normal(self) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.square)
        matrix, side = np.zeros((m + 3, m + 3)), np.zeros(m + 3)
        for k in range(m):
            matrix[k:k + 4, k:k + 4] += self.gram[k]
            side[k:k + 4] += self.rhs[k]
        return matrix, side

    def residuals(self, c: np.ndarray) -> np.ndarray:
        """Sum of squared residuals per interval."""
        local = np.stack([c[k:k + 4] for k in range(len(self.square))])
        return np.maximum(self.square - 2 * (local * self.rhs).sum(1) + np.einsum("ka,kab,kb->k", local, self.gram, local), 0.0)

    def jumps(self) -> np.ndarray:
        """Jumps of the third derivative at the inner knots, as rows over the coefficients."""
        t = np.concatenate([[self.knots[0]] * 3, self.knots, [self.knots[-1]] * 3])
        d = np.eye(len(self.square) + 3)
        for degree in (3, 2, 1):
            t_low, t_high = t[1:len(d)], t[1 + degree:len(d) + degree]
            d = degree * np.diff(d, axis=0) / (t_high - t_low)[:, None]
            t = t[1:-1]
        return np.diff(d, axis=0)


def solve(matrix: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Coefficients; of many solutions (fewer points than coefficients) the shortest."""
    try:
        half = np.linalg.cholesky(matrix)
        if half.diagonal().min() > 1e-7 * half.diagonal().max():
            return np.linalg.solve(half.T, np.linalg.solve(half, side))
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(matrix, side, rcond=1e-13)[0]


def smoothest(sums: Sums, bound: float) -> np.ndarray:
    """The spline with the least jumps whose residuals keep ``bound``."""
    matrix, side = sums.normal()
    j = sums.jumps()
    penalty = j.T @ j
    penalty *= np.trace(matrix) / np.trace(penalty)
    low, high = -30.0, 30.0  # decimal logarithm of the weight of the jumps
    for _ in range(80):
        middle = (low + high) / 2
        rss = sums.residuals(solve(matrix + 10.0 ** middle * penalty, side)).sum()
        low, high = (middle, high) if rss <= bound else (low, middle)
    return solve(matrix + 10.0 ** low * penalty, side)


def more_knots(sums: Sums, residuals: np.ndarray, off: list[float], number: int) -> list[tuple[int, int]]:
    """(interval, points before the new knot in it) for ``number`` new knots,
    each in the middle of the interval with the largest residuals. ``off`` are
    the residuals at the inner knots, which count half for either side."""
    parts = [(float(r), k, 0, int(n)) for k, (r, n) in enumerate(zip(residuals, sums.count))]
    for k, e in enumerate(off):  # a knot is the first point of the interval behind it
        r, i, s, n = parts[k + 1]
        parts[k + 1] = (r - e * e / 2, i, s + 1, n - 1)
        r, i, s, n = parts[k]
        parts[k] = (r + e * e / 2, i, s, n)
    # the first and last points are ends already
    r, i, s, n = parts[0]
    parts[0] = (r, i, s + 1, n - 1)
    r, i, s, n = parts[-1]
    parts[-1] = (r, i, s, n - 1)
    out = []
    for _ in range(number):
        best = max((p for p in parts if p[3] > 0), key=lambda p: (p[0], -p[1], -p[2]), default=None)
        if best is None:
            break
        parts.remove(best)
        r, i, s, n = best
        before = n // 2
        out.append((i, s + before))
        parts += [(r * before / n, i, s, before), (r * (n - 1 - before) / n, i, s + before + 1, n - 1 - before)]
    return sorted(out)


def fit(points: DataFrame, keys: Sequence[str], x: str, y: str, bound: float, rounds: int = 40) -> DataFrame:
    """(keys, knots, coefficients, rss) of the smoothest cubic spline per group
    whose residuals' sum of squares is at most ``bound``. ``x`` is unique within
    a group; four points or fewer are met exactly."""
    keys = list(keys)
    rows = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    placed = cut_lineage(ordered.scan(rows, keys, [F.col("x")], {"place": ("count", None)}))
    ends = placed.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # knots with their data: place and y, for the residuals at the knots
    state = ends.select(
        *keys, F.array("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1)).alias("knots"),
        F.array().cast("array<double>").alias("ys"), F.lit(1).alias("plus"), F.lit(None).cast("double").alias("old"))
    named = [points.schema[k] for k in keys]
    number = lambda n: StructField(n, DoubleType())
    array = lambda n, t=DoubleType(): StructField(n, ArrayType(t))
    schema = StructType([
        *named, array("knots"), array("ys"), StructField("plus", IntegerType()), number("old"), array("coefficients"), number("rss"),
        StructField("done", BooleanType()), array("wanted", LongType())])

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        sums = Sums(np.asarray(head["knots"], float), pdf)
        matrix, side = sums.normal()
        c = solve(matrix, side)
        residuals = sums.residuals(c)
        rss = float(residuals.sum())
        wanted, plus = [], int(head["plus"])
        done = rss <= bound
        if done:
            if len(sums.knots) > 2:
                c = smoothest(sums, bound)
                rss = float(sums.residuals(c).sum())
        else:
            if len(sums.knots) > 2:  # as many as the last round's gain per knot suggests
                gain = head["old"] - rss
                guess = int(plus * (rss - bound) / gain) if gain > bound * 1e-3 else 2 * plus
                plus = min(2 * plus, max(guess, plus // 2, 1))
            t = np.concatenate([[sums.knots[0]] * 3, sums.knots, [sums.knots[-1]] * 3])
            off = [value_at(t, c, k) - v for k, v in zip(sums.knots[1:-1], head["ys"])]
            first = np.concatenate([[0], np.cumsum(sums.count)])
            wanted = [int(first[i]) + before + 1 for i, before in more_knots(sums, residuals, off, plus)]
            done = not wanted
        out = {k: [head[k]] for k in keys}
        return pd.DataFrame(out | {
            "knots": [list(sums.knots)], "ys": [list(head["ys"])], "plus": [plus], "old": [rss], "coefficients": [list(c)], "rss": [rss],
            "done": [done], "wanted": [wanted]})

    finished = []
    for _ in range(rounds):
        at = attach(placed, state.select(*keys, "knots"), keys).withColumn("interval", interval_of(F.col("x"), F.col("knots")))
        at = at.withColumn("b", F.array(*basis(F.col("x"), F.col("knots"), F.col("interval"))))
        b = [F.col("b")[k] for k in range(4)]
        sums = at.groupBy(*keys, "interval").agg(
            F.array(*[F.sum(b[p] * b[q]) for p, q in _PAIRS]).alias("gram"), F.array(*[F.sum(v * F.col("y")) for v in b]).alias("rhs"),
            F.sum(F.col("y") * F.col("y")).alias("square"), F.count(F.lit(1)).alias("n"))
        step = attach(sums, state, keys)
        step = cut_lineage(step.groupBy(*keys).applyInPandas(advance, schema))
        finished.append(step.filter("done").select(*keys, "knots", "coefficients", "rss"))
        going = step.filter("NOT done")
        if going.isEmpty():
            break
        new = attach(going.select(*keys, F.explode("wanted").alias("place")), placed, [*keys, "place"]).groupBy(*keys).agg(
            F.collect_list(F.struct("x", "y")).alias("_new"))  # a bounded number per round
        inner = F.arrays_zip(F.slice("knots", 2, F.size("knots") - 2).alias("x"), F.col("ys").alias("y"))
        all_ = F.array_sort(F.concat(inner, F.col("_new")))
        state = attach(going, new, keys).withColumn("_all", all_).select(
            *keys, F.concat(F.slice("knots", 1, 1), F.col("_all.x"), F.slice("knots", -1, 1)).alias("knots"), F.col("_all.y").alias("ys"), "plus", "old")
    else:
        raise RuntimeError("the splines did not settle")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def value_at(t: np.ndarray, c: np.ndarray, x: float) -> float:
    """de Boor's evaluation at one place; ``t`` repeats the ends."""
    k = int(min(max(np.searchsorted(t, x, "right") - 1, 3), len(t) - 5))
    d = [c[j] for j in range(k - 3, k + 1)]
    for r in (1, 2, 3):
        for j in range(3, r - 1, -1):
            low, high = t[j + k - 3], t[j + 1 + k - r]
            w = (x - low) / (high - low)
            d[j] = (1 - w) * d[j - 1] + w * d[j]
    return float(d[3])


def evaluate(df: DataFrame, fits: DataFrame, keys: Sequence[str], x: str, out: str) -> DataFrame:
    """``df`` with the spline's value at ``x``; outside its knots the outermost
    polynomials go on."""
    joined = attach(df, fits.select(*keys, F.col("knots").alias("_k"), F.col("coefficients").alias("_c")), list(keys), "left" if keys else "inner")
    at = F.col(x).cast("double")
    k = interval_of(at, F.col("_k"))
    value = sum((b * F.element_at("_c", k + n + 1) for n, b in enumerate(basis(at, F.col("_k"), k))), F.lit(0.0))
    return joined.withColumn(out, value).drop("_k", "_c")
