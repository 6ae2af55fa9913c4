"""Workflows from pixels to tables. Building one runs jobs where a step iterates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.operators import cells as C, raster as R, reads, regions as G, shapes, tracking
from tessera.operators.ordered import attach
from tessera.operators.registry import step
from tessera.session import cut_lineage


@step("sbs")
def sequencing_cells(
    px: DataFrame, cells: DataFrame, n_cycles: int, channels: str = "GTAC", sigma: float = 1.0, peak_width: int = 5,
    max_width: int = 3, threshold_peaks: float = 50, q_min: float = 0, keys: Sequence[str] = ("well", "site"),
    correction: str = "median", by_cycle: bool = False,
) -> DataFrame:
    """Aligned sequencing pixels (keys, cycle, channel, i, j, value) and cell
    labels (keys, i, j, label) to barcodes per cell."""
    keys = list(keys)
    called = sequencing_reads(px, cells, n_cycles, channels, sigma, peak_width, max_width, threshold_peaks, keys, correction, by_cycle)
    return C.top_barcodes(called, k=2, min_quality=q_min)


@step("sbs_reads")
def sequencing_reads(
    px: DataFrame, cells: DataFrame, n_cycles: int, channels: str = "GTAC", sigma: float = 1.0, peak_width: int = 5,
    max_width: int = 3, threshold_peaks: float = 50, keys: Sequence[str] = ("well", "site"), correction: str = "median",
    by_cycle: bool = False,
) -> DataFrame:
    keys = list(keys)
    planes = [*keys, "cycle", "channel"]
    # all filters of a tile share its partitioning; the filtered stack is read
    # by the peak finder and by the base extraction, so it is written once
    spots = cut_lineage(R.laplacian_of_gaussian(px.repartition(*keys), planes, sigma).select(*planes, "i", "j", "value"))
    peaks = R.find_peaks(R.cycle_std(spots, keys), keys, peak_width)
    maxed = R.max_filter(spots, planes, max_width)
    bases = R.extract_bases(maxed, peaks, cells, keys, threshold_peaks)
    return reads.call_reads(bases, channels, n_cycles, correction, by_cycle, keys=keys, partial=True)  # the last stack may be short


@step("phenotype")
def phenotype(px: DataFrame, nuclei: DataFrame, cells: DataFrame, channels: Sequence, keys: Sequence[str] = ("well", "site")) -> DataFrame:
    """Translocation features of nucleus and cell, joined on the cell."""
    keys = list(keys)
    wide = cut_lineage(G.wide_pixels(px, keys, channels))
    a, b = (f"c{c}" for c in channels[:2])
    parts = {}
    for name, labels in (("nuclear", nuclei), ("cell", cells)):
        table = G.feature_table(labels, wide, keys, G.translocation(a, b))
        corr = G.channel_correlation(labels, wide, keys, a, b).withColumnRenamed("corr", "dapi_gfp_corr")
        table = table.join(corr.hint("merge"), [*keys, "cell"])
        median = G.order_features(labels, wide, keys, b, "gfp").select(*keys, "cell", "gfp_median")
        parts[name] = table.join(median.hint("merge"), [*keys, "cell"])
    return G.compartments(parts, keys)


@step("extended_phenotype")
def extended_phenotype(
    px: DataFrame, compartments: dict[str, DataFrame], channel, corr_channels: Sequence, keys: Sequence[str] = ("well", "site"),
    morphology: bool = True,
) -> DataFrame:
    """One channel's intensity, order, correlation, Zernike and texture
    features in every compartment (nuclear, cell, cyto), and the compartments'
    shapes."""
    keys = list(keys)
    at = [*keys, "cell"]
    wide = cut_lineage(G.wide_pixels(px, keys, [channel, *corr_channels]))
    c, parts = f"c{channel}", {}
    for name, labels in compartments.items():
        table = G.feature_table(labels, wide, keys, G.intensity(c, "channel"))
        table = table.join(G.order_features(labels, wide, keys, c, "channel").hint("merge"), at)
        # a region of one pixel has no texture, but stays
        table = table.join(G.zernike(labels, wide, keys, c).hint("merge"), at, "left").join(G.threshold_adjacency(labels, wide, keys, c).hint("merge"), at, "left")
        for n, other in enumerate(corr_channels, 1):
            corr = G.channel_correlation(labels, wide, keys, f"c{other}", c).withColumnRenamed("corr", f"channel_corrch{n}")
            table = table.join(corr.hint("merge"), at)
        # a row per region; one plan for all compartments would be too much at once
        parts[name] = cut_lineage(table.join(region_shapes(labels, keys).hint("merge"), at) if morphology else table)
    return G.compartments(parts, keys)


@step("region_shapes")
def region_shapes(labels: DataFrame, keys: Sequence[str] = ("well", "site")) -> DataFrame:
    """Moments, perimeter, Euler number and solidity of every region."""
    at = [*keys, "cell"]
    hulls = shapes.hulls(labels, keys).select(*at, "hull_area", "convex_area", "solidity")
    return G.morphology(labels, keys).join(G.perimeters(labels, keys).hint("merge"), at).join(hulls.hint("merge"), at)


@step("live")
def live_tracks(
    px: DataFrame, threshold: float, n_frames: int, key_schema: str, keys: Sequence[str] = ("well", "site"), ball: int | None = None,
    tolerance: float = 8, **segmentation,
) -> DataFrame:
    """Segment every frame, follow the nuclei and measure them by track."""
    keys = list(keys)
    planes = [*keys, "frame"]
    clean = R.rolling_ball(px, planes, ball) if ball else px
    # pixels are read once: nuclei come with their values, and only their measures are written
    labels = R.nuclei_stack(clean, keys, "frame", key_schema, threshold, values=True, **segmentation)
    nuclei = cut_lineage(labels.groupBy(*planes, "label").agg(
        F.avg("i").alias("i"), F.avg("j").alias("j"), F.count(F.lit(1)).alias("area"), F.avg("value").alias("mean"), F.max("value").alias("max")))
    tracks = tracking.track_nuclei(nuclei.select(*planes, "label", "i", "j"), keys, n_frames, tolerance)
    return attach(tracks, nuclei.drop("i", "j"), [*planes, "label"], large=True)
