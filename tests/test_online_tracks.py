"""Tracks of a stream against tracks of the whole table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import tracking
from tessera.streaming import tracks

N = 5
START = datetime.datetime(2024, 1, 1)
SCHEMA = "well string, site int, frame int, label long, i double, j double, time timestamp"


def points():
    """Wells of drifting objects; some cross, leave or come late."""
    rng = random.Random(4)
    rows = []
    for site in range(4):
        places = [(rng.uniform(0, 120), rng.uniform(0, 120)) for _ in range(14)]
        for frame in range(N):
            alive = [p for n, p in enumerate(places) if not (n == 3 and frame > 2) and not (n == 5 and frame < 2)]
            for label, (i, j) in enumerate(alive, 1):
                rows.append(("A1", site, frame, label, i, j, START + datetime.timedelta(minutes=24 * frame)))
            places = [(i + rng.gauss(1, 1.5), j + rng.gauss(0, 1.5)) for i, j in places]
    return rows


def streamed(spark, tmp_path, batches, name, **options):
    """Each batch of frames is a file; the rows of the stream's output."""
    source, target = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}-out"
    for n, rows in enumerate(batches):
        df = tracks.frames_of(spark.createDataFrame(rows, SCHEMA), ["well", "site"], "time")
        df.coalesce(1).write.mode("append").parquet(source)
        schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    out = tracks.online_tracks(stream, ["well", "site"], N, **options)
    q = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(target).collect()


def table(rows):
    return sorted((r["site"], r["track"], r["frame"], r["label"], round(r["cost"], 9)) for r in rows)


@pytest.fixture(scope="module")
def want(spark):
    df = spark.createDataFrame(points(), SCHEMA).drop("time")
    return table(tracking.track_nuclei(df, ["well", "site"], N, 8).collect())


def test_frames_in_order_and_out_of_order(spark, tmp_path, want):
    rows = points()
    assert len({r[:2] for r in want}) > 20
    got = streamed(spark, tmp_path, [[r for r in rows if r[2] == f] for f in range(N)], "ordered")
    assert {r["kind"] for r in got} == {"track"} and all(r["complete"] for r in got) and table(got) == want
    mixed = [[r for r in rows if r[2] in (0, 3)], [r for r in rows if r[2] == 2], [r for r in rows if r[2] in (1, 2)], [r for r in rows if r[2] == 4], [r for r in rows if r[2] == 1 and r[1] == 0]]
    got = streamed(spark, tmp_path, mixed, "mixed", delay="1 day", grace_ms=86_400_000)
    assert table(r for r in got if r["kind"] == "track") == want
    assert sorted((r["site"], r["frame"]) for r in got if r["kind"] == "late") == sorted([(s, 2) for s in range(4)] + [(0, 1)])


def test_missing_frame_closes_by_timer(spark, tmp_path):
    rows = [r for r in points() if not (r[1] == 2 and r[2] == 3)]
    later = [("B2", 9, 0, 1, 0.0, 0.0, START + datetime.timedelta(days=d)) for d in (2, 3, 4)]
    batches = [[r for r in rows if r[2] == f] for f in range(N)] + [[r] for r in later]
    got = streamed(spark, tmp_path, batches, "gap", grace_ms=3_600_000)
    open_ones = [r for r in got if r["kind"] == "track" and r["site"] == 2]
    assert open_ones and {r["complete"] for r in open_ones} == {False} and {r["frame"] for r in open_ones} == {0, 1, 2}
    assert {r["site"] for r in got if r["complete"]} == {0, 1, 3}


def test_nearest_and_ties():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, (700, 2)).astype(float), rng.integers(0, 6, (40, 2)).astype(float)
    at, far = tracks.nearest(a, b, 3)
    for n in range(700):
        d = np.sqrt(((b - a[n]) ** 2).sum(1))
        best = sorted(range(40), key=lambda k: (d[k], k))[:3]
        assert at[n].tolist() == best and far[n].tolist() == [d[k] for k in best]
    assert tracks.nearest(a, b[:0], 3)[0].shape == (700, 0)
