"""Online tracking: nuclei are followed while their frames come in.

The state of a tile is what the next frame needs: the cheapest path to every
object of the latest frame, and frames that came too early. A tile is closed
when its last frame is in, or when the watermark passes its timer. Paths and
tracks are those of ``operators.tracking`` for frames in order.

A frame is one row with all its objects, so it is never seen in part. Early
frames wait for those before them. A frame that comes again, or after its tile
is closed, changes nothing and is reported as ``late``. If frames are missing
when the timer fires, the tracks end before the gap and are not ``complete``.
The state of a closed tile is one flag.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: State stores on disk, which the operator needs.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


#: Objects whose distances are computed at a time.
_CHUNK = 256


def frames_of(points: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row per frame: (keys, frame, time, labels, i, j)."""
    o = F.array_sort(F.collect_list(F.struct(F.col("label").cast("long").alias("label"), F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"))))
    rows = points.groupBy(*keys, F.col("frame").cast("int").alias("frame")).agg(F.max(time).alias("time"), o.alias("o"))
    return rows.select(*keys, "frame", "time", *[F.col(f"o.{c}").alias(n) for c, n in (("label", "labels"), ("i", "i"), ("j", "j"))])


def nearest(now: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``before``, distances) of the k nearest, ties to the first."""
    k = min(k, len(before))
    at, far = np.zeros((len(now), k), np.int64), np.zeros((len(now), k))
    for start in range(0, len(now), _CHUNK):
        d = now[start:start + _CHUNK, None, :] - before[None, :, :]
        d = np.sqrt((d * d).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        at[start:start + _CHUNK], far[start:start + _CHUNK] = order, np.take_along_axis(d, order, 1)
    return at, far


def advance(front: dict[int, tuple[float, list[int]]], before: tuple, now: tuple, k: int, cutoff: float) -> dict[int, tuple[float, list[int]]]:
    """The cheapest paths one frame on; ``before`` and ``now`` are (labels, i, j) in order of their labels."""
    out: dict[int, tuple[float, list[int]]] = {}
    if not len(now[0]) or not len(before[0]):
        return out
    at, far = nearest(np.column_stack(now[1:]), np.column_stack(before[1:]), k)
    for label, places, distances in zip(now[0], at.tolist(), far.tolist()):
        ways = []
        for p, d in zip(places, distances):
            known = front.get(int(before[0][p]))
            if known is not None and d <= cutoff and known[0] + d <= cutoff:
                ways.append((known[0] + d, known[1]))
        if ways:
            cost, path = min(ways)
            out[int(label)] = (cost, [*path, int(label)])
    return out


def accepted(front: dict[int, tuple[float, list[int]]], most: float) -> list[tuple[float, list[int]]]:
    """Paths within ``most`` that share no object with another one, by their first label."""
    used: dict[tuple[int, int], int] = {}
    for _, path in front.values():
        for step in enumerate(path):
            used[step] = used.get(step, 0) + 1
    good = [(cost, path) for cost, path in front.values() if cost <= most and all(used[s] == 1 for s in enumerate(path))]
    return sorted(good, key=lambda t: t[1][0])


class Tracker(StatefulProcessor):
    def __init__(self, keys: Sequence[str], n_frames: int, tolerance: float, grace_ms: int, k: int, cutoff: float):
        self.keys, self.n_frames, self.tolerance, self.grace, self.k, self.cutoff = list(keys), n_frames, tolerance, grace_ms, k, cutoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", _struct(frame=IntegerType()))  # -1: closed
        self.front = handle.getListState("front", _struct(label=LongType(), cost=DoubleType(), path=ArrayType(LongType())))
        self.latest = handle.getListState("latest", _struct(label=LongType(), i=DoubleType(), j=DoubleType()))
        self.waiting = handle.getMapState(
            "waiting", _struct(frame=IntegerType()), _struct(labels=ArrayType(LongType()), i=ArrayType(DoubleType()), j=ArrayType(DoubleType())))

    def _rows(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["kind", "track", "cost", "frame", "label", "complete"]).astype(
                {"track": "Int64", "frame": "Int32", "label": "Int64"})
            for k, v in zip(self.keys, key):
                out[k] = v
            yield out[[*self.keys, "kind", "track", "cost", "frame", "label", "complete"]]

    def _close(self, frames: int) -> list[tuple]:
        front = {r[0]: (r[1], list(r[2])) for r in self.front.get()}
        complete = frames == self.n_frames
        rows = [("track", n, cost, f, label, complete) for n, (cost, path) in enumerate(accepted(front, self.tolerance * self.n_frames), 1) for f, label in enumerate(path)]
        for state in (self.front, self.latest, self.waiting):
            state.clear()
        self.next.update((-1,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        out, latest_time = [], None
        for batch in rows:
            for frame, time, *objects in zip(batch["frame"], batch["time"], batch["labels"], batch["i"], batch["j"]):
                frame = int(frame)
                if at < 0 or frame < at or frame >= self.n_frames or self.waiting.containsKey((frame,)):
                    out.append(("late", None, None, frame, None, None))
                    continue
                self.waiting.updateValue((frame,), tuple([list(map(float if n else int, o)) for n, o in enumerate(objects)]))
                ms = int(pd.Timestamp(time).timestamp() * 1000)
                latest_time = ms if latest_time is None else max(latest_time, ms)
        if at >= 0 and latest_time is not None:
            moved = False
            while at < self.n_frames and self.waiting.containsKey((at,)):
                labels, i, j = self.waiting.getValue((at,))
                now = (np.array(labels, np.int64), np.array(i, float), np.array(j, float))
                if at == 0:
                    front, moved = {int(label): (0.0, [int(label)]) for label in labels}, True
                else:
                    if not moved:
                        front = {r[0]: (r[1], list(r[2])) for r in self.front.get()}
                        kept = list(self.latest.get())
                        before, moved = tuple(np.array([r[n] for r in kept], np.int64 if n == 0 else float) for n in range(3)), True
                    front = advance(front, before, now, self.k, self.cutoff)
                before = now
                self.waiting.removeKey((at,))
                at += 1
            if moved:
                self.front.clear()
                self.latest.clear()
                if front:
                    self.front.put([(label, cost, path) for label, (cost, path) in front.items()])
                if len(before[0]):
                    self.latest.put([(int(a), float(b), float(c)) for a, b, c in zip(*before)])
            self.next.update((at,))
            if at == self.n_frames:
                out += self._close(at)
            else:
                timers = [*self.handle.listTimers(), latest_time + self.grace]
                for t in timers[:-1]:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(max(timers))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else -1
        if at >= 0:
            yield from self._rows(key, self._close(at))

    def close(self) -> None:
        pass


def online_tracks(
    frames: DataFrame, keys: Sequence[str], n_frames: int, delay: str = "10 minutes", grace_ms: int = 600_000, tolerance_per_frame: float = 8, k: int = 3, cutoff: float = 100,
) -> DataFrame:
    """Tracks of a stream of frames (keys, frame, time, labels, i, j), see
    ``frames_of``: (keys, kind, track, cost, frame, label, complete)."""
    spark = frames.sparkSession
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    keys = list(keys)
    more = _struct(kind=StringType(), track=LongType(), cost=DoubleType(), frame=IntegerType(), label=LongType(), complete=BooleanType())
    out = StructType([*[frames.schema[c] for c in keys], *more.fields])
    marked = frames.select(*keys, "frame", "time", "labels", "i", "j").withWatermark("time", delay)
    return marked.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Tracker(keys, n_frames, tolerance_per_frame, grace_ms, k, cutoff), outputStructType=out, outputMode="Append", timeMode="EventTime")
