"""Contrast of the pixels that a sparse stack does not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.intensity import slice_ranges, stretched
from voxelgrain.operators.runs import BAND_ROWS, complement_runs, pixel_runs


def stretched_background(pixels: DataFrame, frames: DataFrame, *, band_rows: int = BAND_ROWS) -> DataFrame:
    """(stack_id, z, y, x0, x1, stretched): runs of absent pixels that a min-max stretch of their slice does not leave at zero.

    Absent pixels are zero, which is above the least value only in slices with negative ones. All of a slice get the same value,
    so they stay runs, the complement of the present pixels, and no image is spelt out.
    """
    key = ["stack_id", "z"]
    raised = slice_ranges(pixels, frames).withColumn("stretched", F.expr(stretched("0D"))).where("stretched <> 0")
    held = pixels.join(raised.select(*key), key, "left_semi").select(*key, "y", "x")
    lines = raised.select(*key, "nx", F.explode(F.expr("sequence(0, ny - 1)")).alias("y"))
    absent = complement_runs(pixel_runs(held, ["stack_id"], band_rows=band_rows), lines, ["stack_id"], band_rows=band_rows)
    return absent.join(raised.select(*key, "stretched"), key).select(*key, "y", "x0", "x1", "stretched")
