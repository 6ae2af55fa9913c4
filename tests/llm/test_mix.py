"""Source mixing: targets, rates and rounding."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import entropy_mix


def slow_targets(totals):
    """Share by weight, cap, reshare, until none is above."""
    names = sorted((n for n in totals if n is not None), key=lambda n: n.encode()) + ([None] if None in totals else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(totals.values())
    while free:
        w = sum(weight[n] for n in free)
        full = {n for n in free if left * weight[n] / w >= 2 * totals[n]}
        if not full:
            target |= {n: left * weight[n] / w for n in free}
            break
        for n in full:
            target[n] = 2.0 * totals[n]
            left -= 2 * totals[n]
        free -= full
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(3000):
        source = [None, "é", "a", "B", "b"][i % 5] if i % 3 else "hot"
        rows.append((i, " ".join(["w"] * (i * 7919 % 97)), source, i))
    rows += [(5, "q", "a", 1), (5, "q", "a", 1), (None, None, "a", 2), (7, "", "empty", 3), (8, "one two\tthree", "solo", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_are_met(spark, docs):
    rows = entropy_mix.mix(docs, block=200).collect()
    assert len(rows) == docs.count()
    totals, taken, target = {}, {}, {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2 and 0 <= r["rate"] <= 2
    want = slow_targets(totals)
    for s, t in target.items():
        assert math.isclose(t, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - t) <= max(3, 0.002 * t), s
    assert {r["source_size"] for r in rows if r["source"] == "solo"} == {2}


def test_rates_solve_the_dual(spark, docs):
    rows = [r for r in entropy_mix.mix(docs).collect() if r["source"] == "hot"]
    largest = max(r["size"] for r in rows)
    assert math.isclose(sum(r["rate"] * r["size"] for r in rows), rows[0]["target"], rel_tol=1e-7)
    tilt = {round(math.log(r["rate"]) / r["size"] * largest, 5) for r in rows if r["size"] and r["rate"] < 2}
    assert len(tilt) == 1  # one exponent for the whole source


def test_reruns_and_orders_agree(spark, docs):
    def table(df):
        return sorted((str(r["id"]), r["h"], r["copies"]) for r in entropy_mix.mix(df).collect())

    assert table(docs) == table(docs.repartition(7).orderBy(F.col("doc_id").desc()))


def test_stage_repeats_rows(spark, docs):
    out = entropy_mix.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == entropy_mix.mix(docs).agg(F.sum("copies")).first()[0]
    assert entropy_mix.mixed(docs.limit(0)).count() == 0 and entropy_mix.mix(docs.limit(0)).count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["id"], r["size"], r["target"]) for r in entropy_mix.mix(df).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
