"""Stage metadata of time series: sparse reads filled to every (t, m)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.functions import paths
from tessera.operators.tabular import forward_fill, interpolate


def needed_reads(frames: DataFrame, n_sites: int) -> DataFrame:
    """The (t, m) whose metadata must be read: all of t = 0, then only the
    first and last site."""
    return frames.filter((F.col("t") == 0) | F.col("m").isin(0, n_sites - 1))


def fill_metadata(info: DataFrame, keys: Sequence[str] = ("file",), cols: Sequence[str] = ("x_um", "y_um", "z_um")) -> DataFrame:
    """Positions are carried forward per site, times are linear in the imaging
    order (t, m)."""
    filled = forward_fill(info, [*keys, "m"], [F.col("t")], cols)
    return interpolate(filled, list(keys), [F.col("t"), F.col("m")], "t_ms")


def file_table(info: DataFrame, wells: Sequence[str], **parts) -> DataFrame:
    """Well, site and output file name of every stage position."""
    named = info.withColumns({"well": paths.export_well(F.col("file"), wells), "site": F.col("m")})
    return named.withColumn("file_", paths.name_file(**{**parts, "well": F.col("well"), "site": F.col("site")}))
