"""Tile grids over images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_grid(images: DataFrame, tile: int | Column = 512, overlap: int | Column = 64) -> DataFrame:
    """One row a tile of images (width, height, ...), in row order: tile_row, tile_col, tile_index, x, y, tile_w, tile_h.

    There are ceil(size / stride) tiles along a side (stride: tile less overlap), so the last may lie within others.
    """
    tile, overlap = (v if isinstance(v, Column) else F.lit(v) for v in (tile, overlap))
    stride = tile - overlap
    cols, rows = (F.ceil(F.col(c) / stride).cast("int") for c in ("width", "height"))
    grid = images.withColumns({"cols": cols, "rows": rows})
    grid = grid.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    grid = grid.withColumns({"tile_index": F.col("tile_row") * F.col("cols") + F.col("tile_col"), "x": F.col("tile_col") * stride, "y": F.col("tile_row") * stride})
    return grid.withColumns({"tile_w": F.least(tile, F.col("width") - F.col("x")), "tile_h": F.least(tile, F.col("height") - F.col("y"))})


def buffer_ok(pixels, width, height, bands):
    """Whether a tile's pixels have the length that its size says."""
    return F.coalesce(F.length(pixels) == width.cast("long") * height * bands, F.lit(False))
