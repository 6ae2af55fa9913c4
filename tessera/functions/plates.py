"""Plate geometry: wells, tiles and global positions in microns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: distance between wells by plate format, and between tiles by magnification
WELL_SPACING = {"96w": 9000, "24w": 19300, "6w": 39120}
GRID_SPACING = {"10X": 1280, "20X": 640}


def well_to_row_col(well: Column) -> tuple[Column, Column]:
    return F.ascii(well) - 65, F.substring(well, 2, 10).cast("int") - 1


def plate_coordinate(well: Column, tile: Column, well_spacing, grid_spacing, grid_shape) -> tuple[Column, Column]:
    """(i, j) of a tile, with the grid centred on its well."""
    pitch = WELL_SPACING.get(well_spacing, well_spacing)
    delta = GRID_SPACING.get(grid_spacing, grid_spacing)
    height, width = grid_shape
    row, col = well_to_row_col(well)
    tile = tile.cast("bigint")
    i = row * pitch + F.floor(tile / width) * delta - delta * (height - 1) / 2
    j = col * pitch + (tile % width) * delta - delta * (width - 1) / 2
    return i.cast("double"), j.cast("double")


def add_global_xy(df: DataFrame, well_spacing, grid_shape, grid_spacing="10X", factor: float = 1.0) -> DataFrame:
    """``global_x`` and ``global_y``: local x/y win over i/j, else the tile centre;
    y points up."""
    y, x = plate_coordinate(F.col("well"), F.col("tile"), well_spacing, grid_spacing, grid_shape)
    if "x" in df.columns:
        x, y = x + F.col("x") * factor, y + F.col("y") * factor
    elif "i" in df.columns:
        x, y = x + F.col("j") * factor, y + F.col("i") * factor
    return df.withColumns({"global_x": x, "global_y": -y})


def remap_snake(site: Column, grid_shape) -> Column:
    """Serpentine site number to row-major site number, as text."""
    rows, cols = grid_shape
    site = site.cast("int")
    row, col = F.floor(site / cols), site % cols
    inside = (site >= 0) & (site < rows * cols)
    flipped = F.when(row % 2 == 1, cols - 1 - col).otherwise(col)
    bad = F.raise_error(F.lit("site outside the grid")).cast("bigint")
    return F.when(inside, row * cols + flipped).otherwise(bad).cast("string")
