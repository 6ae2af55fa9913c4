"""Crops of cells: padded rectangles, masks, piles and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.operators.ordered import attach
from tessera.operators.raster import gaussian_weights


def _rectangle(boxes: DataFrame, keys: Sequence[str], height, width) -> DataFrame:
    """All places (i, j) from 0 of each crop's rectangle."""
    lines = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), height - 1)))
    return lines.withColumn("j", F.explode(F.sequence(F.lit(0), width - 1)))


def padded_crops(px: DataFrame, boxes: DataFrame, keys: Sequence[str], pad: int = 0) -> DataFrame:
    """(keys, crop, i, j, value): each box (keys, crop, i0, j0, i1, j1), ends
    exclusive, with ``pad`` pixels on every side, from its own corner. What
    lies outside the image is 0."""
    keys = list(keys)
    size = boxes.filter((F.col("i1") - F.col("i0") + 2 * pad > 0) & (F.col("j1") - F.col("j0") + 2 * pad > 0))
    spots = _rectangle(size, keys, F.col("i1") - F.col("i0") + 2 * pad, F.col("j1") - F.col("j0") + 2 * pad)
    spots = spots.select(*keys, "crop", F.col("i").alias("_ci"), F.col("j").alias("_cj"), (F.col("i") + F.col("i0") - pad).alias("i"), (F.col("j") + F.col("j0") - pad).alias("j"))
    met = attach(spots, px.select(*keys, "i", "j", "value"), [*keys, "i", "j"], "left", large=True)
    return met.select(*keys, "crop", F.col("_ci").alias("i"), F.col("_cj").alias("j"), F.coalesce("value", F.lit(0).cast(px.schema["value"].dataType)).alias("value"))


def crop_masks(boxes: DataFrame, keys: Sequence[str], order: Sequence, pad: int = 0) -> DataFrame:
    """(keys, crop, i, j, value): rectangles of the boxes' sides plus ``pad``
    that hold the crop's number from 1 by ``order`` within ``keys``."""
    keys = list(keys)
    numbered = boxes.withColumn("value", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    spots = _rectangle(numbered, keys, F.col("i1") - F.col("i0") + pad, F.col("j1") - F.col("j0") + pad)
    return spots.select(*keys, "crop", "i", "j", "value")


def pile(px: DataFrame, keys: Sequence[str], image: str) -> DataFrame:
    """Images of one pile (``keys``) on canvases of one size: the greatest
    height and width, filled with 0."""
    keys = list(keys)
    # dealt by pile once; everything after stays there
    pixel = F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.coalesce("value", F.lit(0).cast(px.schema["value"].dataType)).alias("value"))
    images = px.select(*keys, image, "i", "j", "value").repartition(*keys).groupBy(*keys, image).agg(
        F.collect_list(F.when((F.col("i") >= 0) & (F.col("j") >= 0), pixel)).alias("_p"), (F.max("i") + 1).cast("int").alias("_h"), (F.max("j") + 1).cast("int").alias("_w"))
    whole = W.partitionBy(*keys)
    images = images.withColumns({c: F.max(c).over(whole) for c in ("_h", "_w")}).filter("_h > 0 AND _w > 0")
    w = F.col("_w")
    blank = F.array_except(F.sequence(F.lit(0), F.col("_h") * w - 1), F.transform("_p", lambda p: p["i"] * w + p["j"]))
    zero = lambda k: F.struct(F.floor(k / w).cast("int").alias("i"), (k % w).alias("j"), F.lit(0).cast(px.schema["value"].dataType).alias("value"))
    return images.select(*keys, image, F.explode(F.concat("_p", F.transform(blank, zero))).alias("_e")).select(*keys, image, "_e.*")


#: Pixels that are resampled at the same time, about; an image stays whole.
PIXELS = 1 << 20


def resize_weights(size: int, wanted: int, anti_aliasing: bool = True) -> list[tuple[int, int, float]]:
    """(to, from, weight) of bilinear resampling along one axis. The centres of
    the outermost pixels lie half a pixel inside; beyond them the image is 0.
    Shrinking smooths first, by a bell of half the surplus factor."""
    factor = size / wanted
    sigma = max(0.0, (factor - 1) / 2) if anti_aliasing else 0.0
    bell = gaussian_weights(sigma) if sigma > 0 else [1.0]
    r = len(bell) // 2
    out = []
    for to in range(wanted):
        at = (to + 0.5) * factor - 0.5
        low = math.floor(at)
        taps: dict[int, float] = {}
        for place, share in ((low, 1 - (at - low)), (low + 1, at - low)):
            if share and 0 <= place < size:
                for k, w in enumerate(bell):
                    if 0 <= place + k - r < size:
                        taps[place + k - r] = taps.get(place + k - r, 0.0) + share * w
        out += [(to, k, w) for k, w in sorted(taps.items())]
    return out


def resize(px: DataFrame, keys: Sequence[str], size: tuple[int, int], wanted: tuple[int, int], anti_aliasing: bool = True, clip: bool = True) -> DataFrame:
    """Images of ``size`` resampled to ``wanted`` (height, width): sums of
    weighted pixels along rows and along columns, as products of each image
    with two small matrices, many images at a time. Pixels without a value
    count as missing; where all of them are missing, there is no row. With
    ``clip`` values stay between the image's least and greatest, except exact
    zeros."""
    keys = list(keys)
    weights = [np.zeros((m, n)) for n, m in zip(size, wanted)]
    for table, n, m in zip(weights, size, wanted):
        for to, at, w in resize_weights(n, m, anti_aliasing):
            table[to, at] = w
    rows, columns = weights
    most = max(1, PIXELS // max(size[0] * size[1], wanted[0] * wanted[1]))

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                i, j, v = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_i", "_j", "_v"))
                length = part.column("_i").value_lengths().to_numpy()
                owner, start = np.repeat(np.arange(part.num_rows), length), np.cumsum(length) - length
                low, high = (f.reduceat(v, start)[:, None, None] for f in (np.minimum, np.maximum))
                on = (i >= 0) & (i < size[0]) & (j >= 0) & (j < size[1])
                place = (owner[on] * size[0] + i[on]) * size[1] + j[on]
                shape = (part.num_rows, *size)
                image = np.bincount(place, v[on], part.num_rows * size[0] * size[1]).reshape(shape)
                known = np.bincount(place, minlength=image.size).reshape(shape) > 0
                out = rows @ image @ columns.T
                if clip:
                    out = np.where(out == 0, 0.0, np.maximum(low, np.minimum(high, out)))
                seen = np.ones(out.shape, bool) if known.all() else (rows > 0).astype(float) @ known @ (columns > 0).astype(float).T > 0
                at, i, j = np.nonzero(seen)
                named = [part.column(k).take(pa.array(at)) for k in keys]
                yield pa.RecordBatch.from_arrays([*named, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[seen])], [*keys, "i", "j", "value"])

    spots = px.filter("i IS NOT NULL AND j IS NOT NULL AND value IS NOT NULL")
    spots = spots.groupBy(*keys).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("v"))).alias("_p"))
    schema = T.StructType([*px.select(*keys).schema, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])
    return spots.select(*keys, *[F.col(f"_p.{c}").alias(f"_{c}") for c in "ijv"]).mapInArrow(resampled, schema)


def cell_crops(px: DataFrame, cells: DataFrame, keys: Sequence[str], half: int, wanted: int, edge: str = "pad") -> DataFrame:
    """Square crops of side 2 * ``half`` around the centres (ci, cj) of cells,
    resampled to ``wanted``: (keys, crop, i, j, value) per channel of ``px``
    (among the keys). ``edge`` is ``pad`` or ``drop`` for cells near it."""
    keys = list(keys)
    i, j = F.floor("ci").cast("int"), F.floor("cj").cast("int")
    boxes = cells.select(*keys, F.col("cell").alias("crop"), (i - half).alias("i0"), (j - half).alias("j0"), (i + half).alias("i1"), (j + half).alias("j1"))
    if edge == "drop":
        size = px.groupBy(*keys).agg((F.max("i") + 1).alias("_h"), (F.max("j") + 1).alias("_w"))
        boxes = attach(boxes, size, keys).filter("i0 >= 0 AND j0 >= 0 AND i1 <= _h AND j1 <= _w").drop("_h", "_w")
    elif edge != "pad":
        raise ValueError(f"unknown edge rule: {edge}")
    return resize(padded_crops(px, boxes, keys), [*keys, "crop"], (2 * half, 2 * half), (wanted, wanted))


def inscribed(px: DataFrame, keys: Sequence[str], good: str = "good") -> DataFrame:
    """(keys, i0, j0, i1, j1, area): the largest rectangle of each image whose
    pixels all are ``good``, ends exclusive; of several the first by i0, then
    j0. Images without a good pixel have none.

    The height of the good run above each pixel is a window along columns. In a
    row the rectangles that end there come from one pass with a stack of rising
    heights; a row is one group, never more than the width of an image."""
    keys = list(keys)
    above = W.partitionBy(*keys, "j").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    wall = F.coalesce(F.max(F.when(~F.coalesce(F.col(good), F.lit(False)), F.col("i"))).over(above), F.min("i").over(above) - 1)
    heights = px.withColumn("h", (F.col("i") - wall).cast("int"))
    rows = heights.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), "h"))).alias("r"))
    end = F.struct((F.element_at("r", -1)["j"] + 1).alias("j"), F.lit(0).alias("h"))  # pops what is left
    block = lambda area, h, j0, j1: F.struct(area.alias("area"), h.alias("h"), j0.alias("j0"), j1.alias("j1"))
    none = block(F.lit(0).cast("long"), F.lit(0), F.lit(0), F.lit(0))
    start = F.struct(F.array().cast("array<struct<j:int,h:int>>").alias("stack"), none.alias("best"))

    def better(a, b):
        """The larger one; of equals the higher one, then the one farther left."""
        wins = (b["area"] > a["area"]) | ((b["area"] == a["area"]) & ((b["h"] > a["h"]) | ((b["h"] == a["h"]) & (b["j0"] < a["j0"]))))
        return F.when(wins, b).otherwise(a)

    def step(state, p):
        popped = F.filter(state["stack"], lambda s: s["h"] >= p["h"])
        done = F.transform(popped, lambda s: block(s["h"].cast("long") * (p["j"] - s["j"]), s["h"], s["j"], p["j"]))
        left = F.when(F.size(popped) > 0, popped[0]["j"]).otherwise(p["j"])
        stays = F.filter(state["stack"], lambda s: s["h"] < p["h"])
        stack = F.when(p["h"] > 0, F.concat(stays, F.array(F.struct(left.alias("j"), p["h"].alias("h"))))).otherwise(stays)
        return F.struct(stack.alias("stack"), F.aggregate(done, state["best"], better).alias("best"))

    found = rows.select(*keys, "i", F.aggregate(F.concat("r", F.array(end)), start, step)["best"].alias("b")).filter("b.area > 0")
    i0 = (F.col("i") + 1 - F.col("b.h")).cast("int")
    pick = F.min(F.struct((-F.col("b.area")).alias("a"), i0.alias("i0"), F.col("b.j0").alias("j0"), (F.col("i") + 1).cast("int").alias("i1"), F.col("b.j1").alias("j1")))
    return found.groupBy(*keys).agg(pick.alias("p")).select(*keys, "p.i0", "p.j0", "p.i1", "p.j1", (-F.col("p.a")).alias("area"))


def trim(px: DataFrame, keys: Sequence[str], plane: str) -> DataFrame:
    """The planes of every pile cut to the largest rectangle in which no plane
    is 0 or missing, from its own corner."""
    keys = list(keys)
    planes = px.groupBy(*keys).agg(F.count_distinct(plane).alias("_n"))
    seen = px.groupBy(*keys, "i", "j").agg(F.count_distinct(F.when(F.col("value") != 0, F.col(plane))).alias("_c"))
    box = inscribed(attach(seen, planes, keys, large=True).withColumn("good", F.col("_c") == F.col("_n")), keys).drop("area")
    inside = attach(px, box, keys, large=True).filter("i >= i0 AND i < i1 AND j >= j0 AND j < j1")
    return inside.withColumns({"i": F.col("i") - F.col("i0"), "j": F.col("j") - F.col("j0")}).select(*px.columns)

