"""Raster operators on the pixel relation (tile keys, i, j, value).

Images are rows, so filters are range windows and kernels are offset joins; the
tile keys are the partitioning. Where a pixel's result hangs on its whole image
(labels, nuclei, the phase correlation of two planes), images are dealt to tasks
once and NumPy kernels work on several at a time (``planes``); an image is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.operators import planes
from tessera.operators.ordered import attach
from tessera.operators.quantiles import quantiles
from tessera.session import cut_lineage


def _along(keys: Sequence[str], axis: str):
    return W.partitionBy(*keys, "i" if axis == "j" else "j").orderBy(axis)


def _by_tile(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring each tile together once; windows along rows and columns then need no further shuffle."""
    return px.repartition(*keys) if keys else px


def dealt(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles dealt to as many tasks as the session shuffles to, however few
    bytes they are: work in Python takes longer than the bytes tell."""
    return px.repartition(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else px


def by_image(px: DataFrame, keys: Sequence[str], work: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``work`` on tables of whole images, their rows in reading order."""
    rows = dealt(px, keys) if keys else px.repartition(1)
    return rows.sortWithinPartitions(*keys, "i", "j").mapInArrow(lambda batches: planes.whole_images(batches, keys, work), schema)


def image_size(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    return px.groupBy(*keys).agg((F.max("i") + 1).alias("_h"), (F.max("j") + 1).alias("_w"))


def _with_size(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``px`` with its tile's ``_h`` and ``_w``, partitioned by tile."""
    tile = W.partitionBy(*keys)
    return _by_tile(px, keys).withColumns({"_h": F.max("i").over(tile) + 1, "_w": F.max("j").over(tile) + 1})


# --- projections and arithmetic -------------------------------------------

def project(px: DataFrame, keys: Sequence[str], how: str = "max") -> DataFrame:
    """Collapse the axes that are not in ``keys`` (z, cycle or channel)."""
    return px.groupBy(*keys, "i", "j").agg(getattr(F, how)("value").alias("value"))


def cycle_std(px: DataFrame, keys: Sequence[str], cycle: str = "cycle", channel: str = "channel") -> DataFrame:
    """Population deviation over cycles, averaged over channels."""
    per = px.groupBy(*keys, channel, "i", "j").agg(F.stddev_pop("value").alias("_s"))
    return per.groupBy(*keys, "i", "j").agg(F.avg("_s").alias("value"))


def normalize_by_percentile(px: DataFrame, keys: Sequence[str], q: float = 0.70) -> DataFrame:
    cut = quantiles(px, keys, F.col("value"), [q], "_q")
    scaled = F.col("value") / F.nullif(F.col("_q")[0], F.lit(0.0))
    return attach(px, cut, keys, large=True).withColumn("value", scaled).drop("_q")


def standardize_images(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Network input: all pixels to mean 0 and deviation 1, then each image to
    0..255 by its own minimum and maximum."""
    every = px.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scaled = attach(px, every, []).withColumn("value", (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")
    ends = scaled.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    v = (F.col("value") - F.col("_lo")) * 255 / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return attach(scaled, ends, keys, large=True).withColumn("value", v).drop("_lo", "_hi")


def merge_chunks(px: DataFrame, keys: Sequence[str], how: str = "max") -> DataFrame:
    """Overlapping chunks back to one image."""
    return px.groupBy(*keys, "i", "j").agg(getattr(F, how)("value").alias("value"))


# --- neighbourhoods --------------------------------------------------------

def extreme_filter(px: DataFrame, keys: Sequence[str], width: int, kinds: Sequence[str] = ("max",)) -> DataFrame:
    """``max`` and/or ``min`` over a square of ``width`` pixels, as new columns."""
    low, high = -(width // 2), width - 1 - width // 2
    rows, cols = (_along(keys, a).rangeBetween(low, high) for a in ("j", "i"))
    half = _by_tile(px, keys).withColumns({f"_{k}": getattr(F, k)("value").over(rows) for k in kinds})
    return half.withColumns({k: getattr(F, k)(f"_{k}").over(cols) for k in kinds}).drop(*[f"_{k}" for k in kinds])


def max_filter(px: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    return extreme_filter(px, keys, width).withColumn("value", F.col("max")).drop("max")


def find_peaks(px: DataFrame, keys: Sequence[str], width: int = 5) -> DataFrame:
    """max - min of the neighbourhood where a pixel is its maximum, else 0;
    pixels closer than ``width`` to the edge are 0."""
    near = extreme_filter(_with_size(px, keys), keys, width, ("max", "min"))
    inside = (F.col("i") >= width) & (F.col("j") >= width) & (F.col("i") < F.col("_h") - width) & (F.col("j") < F.col("_w") - width)
    height = F.when(inside & (F.col("value") == F.col("max")), F.col("max") - F.col("min")).otherwise(F.lit(0) * F.col("value"))
    return near.withColumn("value", height).drop("max", "min", "_h", "_w")


def gaussian_weights(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    phi = np.exp(-0.5 * (x / sigma) ** 2)
    phi /= phi.sum()
    return list(map(float, phi if order == 0 else (x ** 2 / sigma ** 4 - 1 / sigma ** 2) * phi))


def _reflect(px: DataFrame, keys: Sequence[str], axis: str, r: int) -> DataFrame:
    """Mirror copies of the r outermost lines, so that lags reach over edges."""
    n = F.col("_h") if axis == "i" else F.col("_w")
    at = F.col(axis)
    copies = F.array(at, F.when(at < r, -1 - at), F.when(at >= n - r, 2 * n - 1 - at))
    return px.withColumn(axis, F.explode(F.filter(copies, lambda c: c.isNotNull())))


def _taps(column: str, weights: Sequence[float], over) -> Column:
    r = len(weights) // 2
    terms = [F.lit(w) * (F.lead(column, k - r).over(over) if k != r else F.col(column)) for k, w in enumerate(weights)]
    return reduce(lambda a, b: a + b, terms)


def convolve(px: DataFrame, keys: Sequence[str], kernels: dict[str, tuple[Sequence[float], Sequence[float]]]) -> DataFrame:
    """Separable kernels on whole images with mirrored edges: each output is
    (weights along j, weights along i) of ``value``."""
    r = max(len(w) // 2 for pair in kernels.values() for w in pair)
    sized = _with_size(px, keys)
    wide = _reflect(sized, keys, "j", r)
    rows = wide.withColumns({f"_{n}": _taps("value", wj, _along(keys, "j")) for n, (wj, _) in kernels.items()})
    rows = rows.filter((F.col("j") >= 0) & (F.col("j") < F.col("_w")))
    tall = _reflect(rows, keys, "i", r)
    cols = tall.withColumns({n: _taps(f"_{n}", wi, _along(keys, "i")) for n, (_, wi) in kernels.items()})
    return cols.filter((F.col("i") >= 0) & (F.col("i") < F.col("_h"))).drop("_h", "_w", *[f"_{n}" for n in kernels])


def laplacian_of_gaussian(px: DataFrame, keys: Sequence[str], sigma: float = 1.0) -> DataFrame:
    """Inverted, clipped to 0..65535 and rounded, as for 16-bit images."""
    g0, g2 = gaussian_weights(sigma), gaussian_weights(sigma, 2)
    both = convolve(px.withColumn("value", F.col("value").cast("double")), keys, {"_a": (g2, g0), "_b": (g0, g2)})
    log = -(F.col("_a") + F.col("_b"))
    return both.withColumn("value", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), log)))).drop("_a", "_b")


def disk_mean(px: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """``mean`` over the pixels of a disk that lie in the image."""
    half = [int(math.sqrt(radius * radius - d * d)) for d in range(-radius, radius + 1)]
    rows = _by_tile(px, keys)
    for w in sorted(set(half)):
        span = _along(keys, "j").rangeBetween(-w, w)
        rows = rows.withColumns({f"_s{w}": F.sum("value").over(span), f"_c{w}": F.count("value").over(span)})
    at = lambda name, d: F.coalesce(F.sum(name).over(_along(keys, "i").rangeBetween(d, d)), F.lit(0))
    total = reduce(lambda a, b: a + b, [at(f"_s{half[d + radius]}", d) for d in range(-radius, radius + 1)])
    count = reduce(lambda a, b: a + b, [at(f"_c{half[d + radius]}", d) for d in range(-radius, radius + 1)])
    return rows.withColumns({"_t": total, "_n": count}).select(*px.columns, (F.col("_t") / F.col("_n")).alias("mean"))


# --- background ------------------------------------------------------------

def ball_offsets(radius: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Shrink factor and trimmed ball profile as (di, dj, height)."""
    # fixed values: shrink factor and trim share by radius
    shrink, trim = (1, 0.12) if radius <= 10 else (2, 0.12) if radius <= 30 else (4, 0.16) if radius <= 100 else (8, 0.20)
    side = 2 * radius - 1
    cut = int(side * trim)
    lines = range(-radius + 1 + cut, radius - cut)
    ball = [(a, b, max(0, radius * radius - a * a - b * b)) for a in lines for b in lines]
    if shrink > 1:
        cells: dict[tuple[int, int], list[int]] = {}
        for a, b, z in ball:
            cells.setdefault((a // shrink, b // shrink), []).append(z)
        ball = [(a, b, int(sum(z) / len(z))) for (a, b), z in cells.items()]
    low = min(a for a, _, _ in ball)
    return shrink, [(a - low, b - low, z) for a, b, z in ball]


def rolling_ball(px: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Subtract the highest surface a ball reaches from below. Large balls work
    on block means and their background is spread over the block."""
    shrink, ball = ball_offsets(radius)
    side = max(a for a, _, _ in ball) + 1
    small = px
    if shrink > 1:
        block = [F.floor(F.col(c) / shrink).cast("int").alias(c) for c in ("i", "j")]
        small = px.select(*keys, *block, "value").groupBy(*keys, "i", "j").agg(F.avg("value").alias("value"))
    small = _with_size(small, keys)
    profiles: dict[int, tuple[tuple[int, int], ...]] = {}
    for a, b, z in sorted(ball):
        profiles[a] = (*profiles.get(a, ()), (b, z))
    kinds = {p: f"_p{n}" for n, p in enumerate(dict.fromkeys(profiles.values()))}
    along_j, along_i = _along(keys, "j"), _along(keys, "i")

    def most(f, terms: list[Column]) -> Column:
        return f(*terms) if len(terms) > 1 else terms[0]

    # where a ball at (i, j) touches from below: along rows per ball line, then over the lines
    low = small.withColumns({k: most(F.least, [F.lead("value", b).over(along_j) - z for b, z in p]) for p, k in kinds.items()})
    fits = (F.col("i") + side <= F.col("_h")) & (F.col("j") + side <= F.col("_w"))
    gap = most(F.least, [F.lead(kinds[p], a).over(along_i) for a, p in profiles.items()])
    low = low.withColumn("_gap", F.when(fits, gap)).drop(*kinds.values())
    # the highest surface that the balls reach
    high = low.withColumns({k: most(F.greatest, [F.lag("_gap", b).over(along_j) + z for b, z in p]) for p, k in kinds.items()})
    high = high.withColumn("bg", most(F.greatest, [F.lag(kinds[p], a).over(along_i) for a, p in profiles.items()])).drop("_gap", "_h", "_w", *kinds.values())
    if shrink > 1:
        high = high.select(*keys, F.col("i").alias("_bi"), F.col("j").alias("_bj"), "bg")
        placed = px.withColumns({"_bi": F.floor(F.col("i") / shrink).cast("int"), "_bj": F.floor(F.col("j") / shrink).cast("int")})
        joined = attach(placed, high, [*keys, "_bi", "_bj"], "left", large=True).drop("_bi", "_bj")
    else:
        joined = high
    # no ball fits in an image smaller than it: nothing is subtracted
    ground = F.least(F.coalesce("bg", F.lit(0) * F.col("value")), F.col("value"))
    return joined.withColumn("value", F.col("value") - ground).drop("bg")


# --- registration -----------------------------------------------------------

def phase_offset(target: np.ndarray, source: np.ndarray, upsample: int = 1) -> tuple[float, float]:
    """Shift that moves ``source`` onto ``target``: peak of the cross
    correlation, refined by a local discrete Fourier transform."""
    cross = np.fft.fft2(target) * np.conj(np.fft.fft2(source))
    corr = np.abs(np.fft.ifft2(cross))
    peak = np.array(np.unravel_index(np.argmax(corr), corr.shape), dtype=float)
    shape = np.array(corr.shape)
    peak = np.where(peak > shape // 2, peak - shape, peak)
    if upsample > 1:
        fine = np.arange(-upsample, upsample + 1) / upsample
        waves = [np.exp(2j * np.pi * np.outer(p + fine, np.fft.fftfreq(n))) for p, n in zip(peak, shape)]
        local = np.abs(waves[0] @ cross @ waves[1].T)
        a, b = np.unravel_index(np.argmax(local), local.shape)
        peak = peak + [fine[a], fine[b]]
    return float(peak[0]), float(peak[1])


def registration_offsets(px: DataFrame, keys: Sequence[str], frame: str, schema: str, upsample: int = 1, window: float = 1.0) -> DataFrame:
    """(keys, frame, oi, oj): offset of every frame to the first, measured on
    the centred 1/window part. One group holds one frame and the first one."""
    keys = list(keys)
    px = dealt(px, keys)
    size = image_size(px, keys)
    border = lambda n: F.floor(F.col(n) / 2 * (1 - 1 / window))
    inner = attach(px, size, keys, large=True).filter(
        (F.col("i") >= border("_h")) & (F.col("i") < F.col("_h") - border("_h"))
        & (F.col("j") >= border("_w")) & (F.col("j") < F.col("_w") - border("_w")))

    # every other frame meets the first one's plane, so a group is two planes however many frames there are
    first = inner.groupBy(*keys).agg(F.min(frame).alias("_first"))
    known = attach(inner.select(*keys, frame, "i", "j", "value"), first, keys, large=True)
    base = F.max(F.when(F.col(frame) == F.col("_first"), F.col("value"))).over(W.partitionBy(*keys, "i", "j"))
    pairs = known.withColumn("_base", base).filter(F.col("_base").isNotNull() & (F.col(frame) != F.col("_first"))).drop("_first")

    def measure(rows: pa.Table) -> pa.Table:
        i, j, value, origin = (rows.column(c).to_numpy() for c in ("i", "j", "value", "_base"))
        i, j = i - i.min(), j - j.min()
        planes = np.zeros((2, i.max() + 1, j.max() + 1))
        planes[0, i, j], planes[1, i, j] = value, origin
        found = rows.select([*keys, frame]).slice(0, 1)
        for name, offset in zip(("oi", "oj"), phase_offset(*planes, upsample)):
            found = found.append_column(name, pa.array([offset]))
        return found

    still = first.select(*keys, F.col("_first").alias(frame), F.lit(0.0).alias("oi"), F.lit(0.0).alias("oj"))
    return pairs.groupBy(*keys, frame).applyInArrow(measure, schema).unionByName(still)


def apply_offsets(px: DataFrame, offsets: DataFrame, keys: Sequence[str], on: Sequence[str] | None = None) -> DataFrame:
    """Move images by fractional offsets, bilinear, zero outside:
    out(i, j) = in(i + oi, j + oj). ``keys`` name a plane, ``on`` the keys of
    the offsets when several planes share one. Pixels are dealt by these keys
    once; what a pixel gives to its neighbours is added up where it lies."""
    on = list(on or keys)
    moves = offsets.select(*on, "oi", "oj")
    px = dealt(px.select(*keys, "i", "j", "value"), on)
    sized = attach(attach(px, image_size(px, keys), keys, large=True), moves, on, large=True)
    fi, fj = F.floor("oi").cast("int"), F.floor("oj").cast("int")
    wi, wj = F.col("oi") - F.floor("oi"), F.col("oj") - F.floor("oj")
    part = lambda i, j, w, v: F.struct(i.alias("i"), j.alias("j"), w.alias("w"), v.alias("v"))
    corners = [part(F.col("i") - fi - a, F.col("j") - fj - b, (wi if a else 1 - wi) * (wj if b else 1 - wj), F.col("value").cast("double")) for a in (0, 1) for b in (0, 1)]
    # a target without any source pixel still belongs to the image
    blank = part(F.col("i"), F.col("j"), F.lit(1.0), F.lit(0.0))
    inside = lambda o: (o["w"] != 0) & (o["i"] >= 0) & (o["j"] >= 0) & (o["i"] < F.col("_h")) & (o["j"] < F.col("_w"))
    parts = sized.withColumn("_o", F.explode(F.array(*corners, blank))).filter(inside(F.col("_o")))
    parts = parts.select(*keys, "_o.i", "_o.j", (F.col("_o.v") * F.col("_o.w")).alias("value"))
    return parts.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


# --- geometry of images ------------------------------------------------------

def split_tiles(px: DataFrame, side: int, row: str = "part_i", column: str = "part_j") -> DataFrame:
    """Cut images into square parts, keyed by row and column of the part, with
    their own coordinates."""
    parts = {row: F.floor(F.col("i") / side), column: F.floor(F.col("j") / side)}
    return px.withColumns(parts).withColumns({"i": F.col("i") % side, "j": F.col("j") % side})


def split_overlapping(px: DataFrame, width: int, overlap: int, row: str = "part_i", column: str = "part_j") -> DataFrame:
    """Cut images into parts of ``width`` that reach ``overlap`` pixels into
    their neighbours; a pixel goes to every part that covers it and keeps its
    place. ``merge_chunks`` puts the parts back together."""
    def parts(axis: str, end: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - width - overlap) / width) + 1)
        last = F.least(F.floor((F.col(axis) + overlap) / width), F.floor(F.col(end) / width))
        return F.sequence(first, last)

    ends = px.agg(F.max("i").alias("_ei"), F.max("j").alias("_ej"))
    wide = attach(px, ends, []).withColumn(row, F.explode(parts("i", "_ei")))
    return wide.withColumn(column, F.explode(parts("j", "_ej"))).drop("_ei", "_ej")


def remove_channels(px: DataFrame, channels: Sequence, channel: str = "channel") -> DataFrame:
    """Drop channels from a stack."""
    return px.filter(~F.col(channel).isin(*channels))


def montage(px: DataFrame, index: Column, columns: int, height: int, width: int) -> DataFrame:
    """Place images number 0, 1, .. row by row on one canvas."""
    return px.withColumns({
        "i": (F.floor(index / columns) * height + F.col("i")).cast("int"),
        "j": (index % columns * width + F.col("j")).cast("int")})


def shift(px: DataFrame, di: int, dj: int, keys: Sequence[str]) -> DataFrame:
    """Whole-pixel move with zero fill."""
    moved = px.select(*keys, (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("value").alias("_v"))
    joined = attach(px.drop("value"), moved, [*keys, "i", "j"], "left", large=True)
    return joined.withColumn("value", F.coalesce("_v", F.lit(0))).drop("_v")


def crop_cells(px: DataFrame, cells: DataFrame, keys: Sequence[str], half: int, size: int) -> DataFrame:
    """Square crops of side 2*half around cell centres; cells too close to the
    edge of a ``size`` image are left out. Rows: cell, ci, cj, value."""
    i, j = F.floor("ci").cast("int"), F.floor("cj").cast("int")
    whole = cells.filter((i - half >= 0) & (i + half <= size) & (j - half >= 0) & (j + half <= size))
    lines = F.explode(F.sequence(i - half, i + half - 1)).alias("i")
    rows = whole.select(*keys, "cell", i.alias("_i"), j.alias("_j"), lines)
    spots = rows.withColumn("j", F.explode(F.sequence(F.col("_j") - half, F.col("_j") + half - 1)))
    hit = attach(px, spots, [*keys, "i", "j"], large=True)
    return hit.select(*keys, "cell", (F.col("i") - F.col("_i") + half).alias("ci"), (F.col("j") - F.col("_j") + half).alias("cj"), "value")


# --- segmentation -------------------------------------------------------------

def label_components(mask: DataFrame, keys: Sequence[str], diagonal: bool = True) -> DataFrame:
    """Number the connected regions of the pixels in ``mask`` (keys, i, j) from
    1 per tile, by their first pixel in reading order. Runs of pixels in a row
    are tied where they touch; images are dealt to tasks once."""
    keys = list(keys)
    at = [*keys, "i", "j"]

    def number(rows: pa.Table) -> pa.Table:
        i, j = (rows.column(c).to_numpy() for c in ("i", "j"))
        found, area = planes.label(planes.image_numbers(rows, keys), i, j, diagonal)
        return rows.append_column("label", pa.array(found)).append_column("area", pa.array(area))

    schema = T.StructType([*[mask.schema[c] for c in at], T.StructField("label", T.IntegerType()), T.StructField("area", T.LongType())])
    return by_image(mask.select(*at), keys, number, schema)


def filter_regions(labels: DataFrame, px: DataFrame, keys: Sequence[str], keep: Column, measure: dict[str, Column] | None = None) -> DataFrame:
    """Keep regions whose measures satisfy ``keep`` (default measures are
    ``area`` and ``mean_intensity``), renumbered from 1."""
    keys = list(keys)
    measure = measure or {"area": F.count(F.lit(1)), "mean_intensity": F.avg("value")}
    joined = attach(labels.drop("area"), px, [*keys, "i", "j"], large=True)
    scored = joined.groupBy(*keys, "label").agg(*[c.alias(n) for n, c in measure.items()])
    kept = scored.filter(keep).withColumn("_new", F.row_number().over(W.partitionBy(*keys).orderBy("label")))
    return attach(labels.drop("area"), kept.select(*keys, "label", "_new"), [*keys, "label"], large=True).withColumn("label", F.col("_new")).drop("_new")


def fill_holes(mask: DataFrame, px: DataFrame, keys: Sequence[str], max_area: int | None = None) -> DataFrame:
    """Add background regions that do not reach the image edge (smaller than
    ``max_area`` pixels)."""
    keys = list(keys)
    background = px.select(*keys, "i", "j").join(mask.hint("merge"), [*keys, "i", "j"], "left_anti")
    regions = attach(label_components(background, keys, diagonal=False), image_size(px, keys), keys, large=True)
    edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("_h") - 1) | (F.col("j") == F.col("_w") - 1)
    open_ = regions.groupBy(*keys, "label").agg(F.max(edge).alias("_open"), F.first("area").alias("_a"))
    small = F.lit(True) if max_area is None else F.col("_a") < max_area
    holes = open_.filter(~F.col("_open") & small).select(*keys, "label")
    filled = regions.join(holes.hint("merge"), [*keys, "label"], "left_semi").select(*keys, "i", "j")
    return mask.select(*keys, "i", "j").unionByName(filled)


def split_touching(labels: DataFrame, keys: Sequence[str], schema: str, smooth: int = 1) -> DataFrame:
    """Split each object at the saddles of its distance map. An object is one
    task's group: it is never larger than a cell clump."""
    keys = list(keys)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        a, b = i - i.min() + 1, j - j.min() + 1
        mask = np.zeros((a.max() + 2, b.max() + 2), dtype=bool)
        mask[a, b] = True
        height = np.where(mask, np.sqrt(planes.squared_distance(mask[None])[0]), 0.0)
        for _ in range(smooth):
            around = sum(np.roll(np.roll(height, d, 0), e, 1) for d in (-1, 0, 1) for e in (-1, 0, 1))
            height = np.where(mask, around / 9, 0)
        # climb: every pixel follows its highest neighbour (the first in reading order) to a summit
        height = np.where(mask, height, -1.0)
        steps = [(d, e) for d in (-1, 0, 1) for e in (-1, 0, 1)]
        best = np.argmax([np.roll(np.roll(height, -d, 0), -e, 1) for d, e in steps], axis=0).ravel()
        at = np.arange(height.size) + np.array([d * height.shape[1] + e for d, e in steps])[best]
        at = np.where(mask.ravel(), at, np.arange(height.size))
        while (at != at[at]).any():
            at = at[at]
        _, part = np.unique(at.reshape(mask.shape)[a, b], return_inverse=True)
        return pdf[[*keys, "i", "j", "label"]].assign(part=part)

    parts = labels.select(*keys, "i", "j", "label").groupBy(*keys, "label").applyInPandas(split, schema)
    ids = parts.select(*keys, "label", "part").distinct()
    ids = ids.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("label", "part")))
    return attach(parts, ids, [*keys, "label", "part"], large=True).select(*keys, "i", "j", F.col("_n").alias("label"))


def segment_nuclei(
    px: DataFrame, keys: Sequence[str], key_schema: str, threshold: float, radius: int = 15, area_min: int = 50,
    area_max: int = 500, smooth: int = 1, values: bool = False,
) -> DataFrame:
    """Local mean threshold, intensity filter, hole filling, splitting of
    touching objects and area filter (both bounds exclusive). Images are dealt
    to tasks once and go through these steps there. With ``values`` the pixels
    of the nuclei come with their values."""
    keys = list(keys)
    fields = T.StructType.fromDDL(key_schema).fields if keys else []

    def find(rows: pa.Table) -> pa.Table:
        image = planes.image_numbers(rows, keys)
        i, j = (rows.column(c).to_numpy() for c in ("i", "j"))
        value = rows.column("value").cast(pa.float64()).to_numpy()
        number = np.zeros(len(i), np.int32)
        for at, (t, a, b), edge, shape in planes.stacks(image, i, j):
            plane, there = np.full(shape, np.nan), np.zeros(shape, bool)
            plane[t, a, b], there[t, a, b] = value[at], True
            number[at] = planes.nuclei(plane, there, edge, threshold, radius, area_min, area_max, smooth)[t, a, b]
        found = rows.select([*keys, "i", "j"]).append_column("label", pa.array(number))
        found = found.append_column("value", rows.column("value")) if values else found
        return found.filter(pa.array(number > 0))

    schema = T.StructType([*fields, *[T.StructField(c, T.IntegerType()) for c in ("i", "j", "label")], *([px.schema["value"]] if values else [])])
    rows = px.select(*[F.col(f.name).cast(f.dataType) for f in fields], *[F.col(c).cast("int").alias(c) for c in ("i", "j")], "value")
    return by_image(rows, keys, find, schema)


def nuclei_stack(px: DataFrame, keys: Sequence[str], frame: str, key_schema: str, threshold: float, **options) -> DataFrame:
    """Segment every frame of a time series on its own."""
    return segment_nuclei(px, [*keys, frame], f"{key_schema}, {frame} int", threshold, **options)


def grow_cells(nuclei: DataFrame, mask: DataFrame, keys: Sequence[str], drop_border: bool = False) -> DataFrame:
    """Grow labels over ``mask`` (keys, i, j) by chessboard steps until nothing
    is left to reach; each pixel goes to the nearest nucleus within the mask,
    ties to the lowest label.

    A round sweeps rows, columns and both diagonals in both directions: along a
    run of mask pixels the nearest label is a running minimum. So the rounds
    count the turns of the longest path, not its steps."""
    keys = list(keys)
    at = [*keys, "i", "j"]
    start = nuclei.select(*at, F.struct(F.lit(0).cast("bigint").alias("d"), F.col("label")).alias("best"))
    px = mask.select(*at).join(start.hint("merge"), at, "full").repartition(*map(F.col, keys)) if keys else mask.select(*at).join(start.hint("merge"), at, "full")
    lines = {"i": ("j", F.col("i")), "j": ("i", F.col("j")), "sum": ("i", F.col("i") + F.col("j")), "difference": ("i", F.col("i") - F.col("j"))}
    for name, (step, line) in lines.items():  # runs without a gap share step - position
        place = F.row_number().over(W.partitionBy(*keys, line).orderBy(step))
        px = px.withColumn(f"_run_{name}", F.col(step) - place)
    px, mark = cut_lineage(px), None
    while True:
        for name, (step, line) in lines.items():
            run = W.partitionBy(*keys, line, f"_run_{name}").orderBy(step)
            known = F.col("best").isNotNull()
            d, s = F.col("best.d"), F.col(step)
            there = F.min(F.when(known, F.struct((d - s).alias("d"), F.col("best.label").alias("label")))).over(run.rowsBetween(W.unboundedPreceding, 0))
            back = F.min(F.when(known, F.struct((d + s).alias("d"), F.col("best.label").alias("label")))).over(run.rowsBetween(0, W.unboundedFollowing))
            px = px.withColumns({"_a": there, "_b": back}).withColumn("best", F.least(
                F.when(F.col("_a").isNotNull(), F.struct((F.col("_a.d") + s).alias("d"), F.col("_a.label").alias("label"))),
                F.when(F.col("_b").isNotNull(), F.struct((F.col("_b.d") - s).alias("d"), F.col("_b.label").alias("label"))),
            )).drop("_a", "_b")
        px = cut_lineage(px)
        now = tuple(px.agg(F.count("best"), F.sum("best.d"), F.sum("best.label")).first())
        if now == mark:
            break
        mark = now
    cells = px.filter(F.col("best").isNotNull()).select(*at, F.col("best.label").alias("label"))
    if drop_border:
        sized = attach(cells, image_size(mask, keys), keys, large=True)
        edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("_h") - 1) | (F.col("j") == F.col("_w") - 1)
        cells = cells.join(sized.filter(edge).select(*keys, "label").distinct().hint("merge"), [*keys, "label"], "left_anti")
    return cells


def dilate(labels: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Labels spread by a square of ``width``; the highest label wins."""
    low, high = -(width // 2), width - 1 - width // 2
    span = F.explode(F.sequence(F.lit(-high), F.lit(-low)))
    wide = labels.withColumn("_d", span).withColumn("_e", span)
    return wide.groupBy(*keys, (F.col("i") + F.col("_d")).alias("i"), (F.col("j") + F.col("_e")).alias("j")).agg(F.max("label").alias("label"))


def rings(labels: DataFrame, px: DataFrame, keys: Sequence[str], width: int = 3) -> tuple[DataFrame, DataFrame]:
    """Outer ring (dilated minus nuclei) and inner ring (nuclei minus eroded)."""
    at = [*keys, "i", "j"]
    grown = dilate(labels.select(*at, "label"), keys, width).join(px.select(*at).hint("merge"), at, "left_semi")
    outer = grown.join(labels.hint("merge"), at, "left_anti")
    full = attach(px.select(*at), labels.select(*at, "label"), at, "left", large=True).withColumn("value", F.coalesce("label", F.lit(0)))
    low = extreme_filter(full, keys, width, ("min",)).filter("min > 0").select(*at)
    inner = labels.select(*at, "label").join(low.hint("merge"), at, "left_anti")
    return outer, inner


def extract_bases(maxed: DataFrame, peaks: DataFrame, labels: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Signal of every (cycle, channel) at the peaks above ``threshold``, with
    the cell label there (0 outside cells) and a read number per tile."""
    keys = list(keys)
    at = [*keys, "i", "j"]
    spots = peaks.filter(F.col("value") > threshold).select(*at)
    place = W.partitionBy(*keys).orderBy("i", "j")
    spots = spots.withColumn("read", (F.row_number().over(place) - 1).cast("bigint"))
    spots = attach(spots, labels.select(*at, F.col("label").alias("cell")), at, "left", large=True).fillna(0, ["cell"])
    return attach(maxed.withColumnRenamed("value", "intensity"), spots, at, large=True)
