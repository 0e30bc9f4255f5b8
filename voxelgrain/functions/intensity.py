"""Intensity transforms: luminance, colour channels, contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: luminance weights of red, green, blue
LUMINANCE = (0.299, 0.587, 0.114)


def luminance(channels: DataFrame, dtype: str = "int") -> DataFrame:
    """Channel rows (stack_id, z, y, x, c, v) to grayscale pixels; alpha is ignored.

    The weighted sum is cast back to the source type, so integers lose their fraction.
    """
    r, g, b = LUMINANCE
    weight = F.expr(f"case c when 0 then {r}D when 1 then {g}D when 2 then {b}D else 0D end")
    # the three products are added in channel order, whatever order the rows arrive in
    parts = [F.max(F.when(F.col("c") == i, F.col("v") * weight)) for i in range(3)]
    return channels.where("c < 3").groupBy("stack_id", "z", "y", "x").agg(
        (parts[0] + parts[1] + parts[2]).cast(dtype).alias("v")
    )


def gray_to_color(pixels: DataFrame) -> DataFrame:
    """Grayscale pixels repeated as three equal channels."""
    return pixels.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))


def slice_ranges(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(stack_id, z, ny, nx, lo, hi) of slices with pixels; absent pixels are zero and count for the range."""
    key = ["stack_id", "z"]
    found = pixels.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    return frames.select(*key, "ny", "nx").join(found, key).select(
        *key, "ny", "nx",
        F.expr("if(n < cast(ny as bigint) * nx, least(lo, 0D), lo)").alias("lo"),
        F.expr("if(n < cast(ny as bigint) * nx, greatest(hi, 0D), hi)").alias("hi"),
    )


def stretched(value: str) -> str:
    """SQL for a value stretched from (lo, hi) to 0..255, truncated; zero where nothing varies."""
    return f"if(hi > lo, cast(floor(({value} - lo) / (hi - lo) * 255) as int), 0)"


def stretch_slices(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Min-max stretch of the present pixels of every slice; ``operators.contrast`` gives what becomes of absent ones."""
    key = ["stack_id", "z"]
    ranged = slice_ranges(pixels, frames)
    return pixels.join(ranged.select(*key, "lo", "hi"), key).select(*key, "y", "x", F.expr(stretched("v")).alias("stretched"))
