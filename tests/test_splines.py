"""Smoothing splines against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import splines, tracking


def design(x, knots):
    """All basis functions at all places, by the definition."""
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    b = np.array([[float(t[k] <= v < t[k + 1]) for k in range(len(t) - 1)] for v in x])
    b[np.asarray(x) >= t[-1], len(knots) + 1] = 1
    for d in (1, 2, 3):
        new = np.zeros((len(x), b.shape[1] - 1))
        for k in range(new.shape[1]):
            if t[k + d] > t[k]:
                new[:, k] += (x - t[k]) / (t[k + d] - t[k]) * b[:, k]
            if t[k + d + 1] > t[k + 1]:
                new[:, k] += (t[k + d + 1] - x) / (t[k + d + 1] - t[k + 1]) * b[:, k + 1]
        b = new
    return b


def third(knots):
    """Jumps of the third derivative at the inner knots per coefficient, by differences of exact cubics."""
    rows = []
    for a, b in zip(knots, knots[1:]):
        u = np.linspace(a, b, 9)[1:-1]
        at = design(u, knots)
        rows.append([6 * np.polyfit(u - a, at[:, k], 3)[0] for k in range(at.shape[1])])
    return np.diff(np.array(rows), axis=0)


def dense(x, y, knots, bound):
    b = design(x, knots)
    if len(knots) == 2:
        return b @ np.linalg.lstsq(b, y, rcond=None)[0]
    j = third(knots)
    j *= np.abs(b).sum() / np.abs(j).sum()
    low, high = -16.0, 16.0
    for _ in range(100):
        w = 10 ** ((low + high) / 2)
        c = np.linalg.lstsq(np.vstack([b, w * j]), np.concatenate([y, np.zeros(len(j))]), rcond=None)[0]
        low, high = ((low + high) / 2, high) if ((b @ c - y) ** 2).sum() <= bound else (low, (low + high) / 2)
    return b @ c


COURSES = {
    "cubic": (lambda x: 3 + x - 0.2 * x ** 2 + 0.01 * x ** 3, 1.0, 0),
    "wave": (lambda x: 10 * np.sin(x / 1.5), 20.0, 3),
    "steps": (lambda x: 20 * np.sin(x * 2.2) + 5 * (x > 6), 30.0, 10),
}


@pytest.fixture(scope="module")
def courses():
    rng = np.random.default_rng(3)
    out = {}
    for name, (f, bound, least) in COURSES.items():
        x = np.sort(rng.choice(np.arange(1, 400), 150, replace=False)) / 33.0
        out[name] = (x, f(x) + rng.normal(0, 0.05, len(x)), bound, least)
    return out


def test_courses_against_dense_solutions(spark, courses):
    for name, (x, y, bound, least) in courses.items():
        df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] , "g string, x double, y double").repartition(3)
        fits = splines.fit(df, ["g"], "x", "y", bound)
        row = fits.first()
        inner = len(row["knots"]) - 2
        assert (inner == 0) == (least == 0) and inner >= least, (name, inner)
        assert set(row["knots"][1:-1]) <= set(x)
        got = np.array([r["s"] for r in splines.evaluate(df, fits, ["g"], "x", "s").orderBy("x").collect()])
        want = dense(x, y, np.array(row["knots"]), bound)
        assert np.abs(got - want).max() < 1e-3 * np.abs(y).max(), name
        rss = ((got - y) ** 2).sum()
        assert abs(rss - row["rss"]) < 1e-6 * bound
        assert rss <= bound * 1.000001 and (not inner or rss > bound * 0.999)


def test_many_groups_have_their_own_knots(spark, courses):
    rows = [(name, k, float(a), float(b)) for name, (x, y, _, _) in courses.items() for k in range(2) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "name string, k int, x double, y double")
    got = {(r["name"], r["k"]): r for r in splines.fit(df, ["name", "k"], "x", "y", 25.0).collect()}
    assert len(got) == 6 and len(got["cubic", 0]["knots"]) == 2 < len(got["wave", 1]["knots"]) < len(got["steps", 0]["knots"])
    assert got["steps", 0]["knots"] == got["steps", 1]["knots"]


def test_tight_bound_interpolates_and_few_points(spark):
    df = spark.createDataFrame([(float(k), float((k * 7) % 5)) for k in range(12)], "x double, y double")
    fits = splines.fit(df, [], "x", "y", 0.0)
    assert max(abs(r["s"] - r["y"]) for r in splines.evaluate(df, fits, [], "x", "s").collect()) < 1e-6
    for n in (1, 2, 3):
        few = df.filter(F.col("x") < n)
        fits = splines.fit(few, [], "x", "y", 1.0)
        assert max(abs(r["s"] - r["y"]) for r in splines.evaluate(few, fits, [], "x", "s").collect()) < 1e-5


def test_baseline_of_a_control_that_needs_knots(spark, courses):
    x, y, _, _ = courses["wave"]
    rows = [("control", float(a), float(b)) for a, b in zip(x, y)] + [("g", float(a), float(b) + 2) for a, b in zip(x[::3], y[::3])] + [("g", 20.0, 1.0)]
    df = spark.createDataFrame(rows, "gene string, timestamp double, value double")
    out = tracking.add_baseline(df, "value", F.col("gene") == "control", 2.0).filter("gene = 'g' AND timestamp < 20").collect()
    assert len(out) == 50 and abs(np.mean([r["spline_diff"] for r in out]) - 2) < 0.1
