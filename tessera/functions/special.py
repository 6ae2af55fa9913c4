"""Distribution tails that Spark has no function for, as vectorised UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _beta_fraction(a, b, x, rounds=400):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x):
    """Regularised incomplete beta function for arrays of equal length."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    swap = xs > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - xs, xs)
    front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    part = front * _beta_fraction(aa, bb, xx)
    value = np.where(swap, 1.0 - part, part)
    return np.where(inside, value, np.where(x <= 0, 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    out = np.full(len(t), np.nan)
    ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
    if ok.any():
        tv, dv = t[ok].to_numpy(float), df[ok].to_numpy(float)
        out[ok] = betainc(dv / 2, np.full(len(dv), 0.5), dv / (dv + tv * tv))
    return pd.Series(out).where(ok, None)


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(k: pd.Series, n_set: pd.Series, n_hits: pd.Series, universe: pd.Series) -> pd.Series:
    """P(X >= k) when drawing ``n_hits`` from ``universe`` with ``n_set`` marked."""
    k, s, h, u = (v.to_numpy(float) for v in (k, n_set, n_hits, universe))

    def choose(n, r):
        return _lgamma(n + 1) - _lgamma(r + 1) - _lgamma(n - r + 1)

    x, last = np.maximum(np.maximum(k, h + s - u), 0), np.minimum(s, h)
    live = x <= last
    x = np.where(live, x, last)
    term = choose(s, x) + choose(u - s, h - x) - choose(u, h)
    total = np.where(live, np.exp(term), 0.0)
    while True:  # each term from the one before, for all rows at once
        live = x < last
        if not live.any():
            return pd.Series(np.minimum(total, 1.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (s - x) * (h - x) / ((x + 1) * (u - s - h + x + 1))
            term = np.where(live, term + np.log(ratio), term)
        total = total + np.where(live, np.exp(term), 0.0)
        x = np.where(live, x + 1, x)


def chi2_tail_even(x: Column, half_df: Column) -> Column:
    """Survival function of chi-square with an even number 2m of freedom:
    the sum of exp(k ln(x/2) - x/2 - ln k!) for k < m; x may be infinite. The
    largest exponent is taken out, so that neither end over- or underflows."""
    half = x / 2

    def added(acc: Column, exponent: Column) -> list[Column]:
        top = F.greatest(acc["top"], exponent)
        return [top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(exponent - top)).alias("sum")]

    def step(acc: Column, k: Column) -> Column:
        exponent = acc["exponent"] + F.ln(half) - F.ln(k)
        return F.struct(exponent.alias("exponent"), *added(acc, exponent))

    start = F.struct((-half).alias("exponent"), (-half).alias("top"), F.lit(1.0).alias("sum"))
    steps = F.filter(F.sequence(F.lit(0), half_df.cast("int") - 1), lambda k: k > 0)
    tail = F.aggregate(steps, start, step, lambda acc: F.least(F.lit(1.0), F.exp(acc["top"] + F.ln(acc["sum"]))))
    return F.when(x == float("inf"), 0.0).when(x <= 0, 1.0).otherwise(tail)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def invert_matrix(m: pd.Series) -> pd.Series:
    """Inverse of small square matrices; null when singular or undefined."""
    def inverse(rows):
        if rows is None:
            return None
        a = np.array([list(r) for r in rows], dtype=float)
        if not np.isfinite(a).all() or abs(np.linalg.det(a)) < 1e-12:
            return None
        return np.linalg.inv(a).tolist()

    return m.map(inverse)
