"""Outer-contour measures of components, read off 2 by 2 pixel blocks along runs.

The boundary polygon through pixel centres has area ``n4 + n3 / 2`` and a perimeter made of one
unit step per two-pixel side block, one diagonal per three-pixel block and two diagonals per
diagonal pair (Gray 1971). Blocks change kind only where a run starts or stops, so the counts come
from run ends rather than from pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.operators.runs import BAND_ROWS


def block_counts(filled: DataFrame, keys: Sequence[str], *, band_rows: int = BAND_ROWS) -> DataFrame:
    """Per component: counts of 2 by 2 block kinds (n4, n3, nh, nv, nd)."""
    keys = list(keys)
    owner = [*keys, "z", "label"]
    line = [*owner, "band", "cy"]
    # a run goes once to each band that its blocks lie in; its four ends are spelled out there
    band = f"cast(floor({{0}} / {band_rows}) as int)"
    laid_out = filled.select(
        *owner, "y", "x0", "x1", F.explode(F.expr(f"array_distinct(array({band.format('(y - 1)')}, {band.format('y')}))")).alias("band")
    ).repartition(*owner, "band")
    ends = laid_out.select(
        *owner, "band",
        F.explode(
            F.expr(
                "array(struct(y - 1 as cy, x0 as x, 2 as d), struct(y - 1 as cy, x1 + 1 as x, -2 as d), "
                "struct(y as cy, x0 as x, 1 as d), struct(y as cy, x1 + 1 as x, -1 as d))"
            )
        ).alias("e"),
    ).select(*owner, "band", "e.cy", "e.x", "e.d").where(f"{band.format('cy')} = band")
    steps = ends.groupBy(*line, "x").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*line).orderBy("x")
    states = steps.select(
        *owner,
        F.sum("d").over(order).cast("int").alias("now"),
        F.coalesce(F.lead("x").over(order) - F.col("x") - 1, F.lit(0)).alias("more"),
        F.col("d"),
    ).withColumn("was", F.expr("cast(now - d as int)"))
    # left column was/now, right column now: bit 1 is the upper row, bit 2 the lower row
    size = "bit_count(was) + bit_count(now)"
    return states.groupBy(*owner).agg(
        F.expr(f"sum(if({size} = 4, 1L, 0L) + if(now = 3, more, 0))").alias("n4"),
        F.expr(f"sum(if({size} = 3, 1L, 0L))").alias("n3"),
        F.expr("sum(if(was = now and now in (1, 2), 1L, 0L) + if(now in (1, 2), more, 0))").alias("nh"),
        F.expr("sum(if(was + now = 3 and (was = 3 or now = 3), 1L, 0L))").alias("nv"),
        F.expr("sum(if(was + now = 3 and was in (1, 2), 1L, 0L))").alias("nd"),
    )


def outline_measures(blocks: DataFrame) -> DataFrame:
    """Add pixel area, straight and diagonal step counts, perimeter and circularity."""
    return (
        blocks.withColumn("area_px2", F.expr("n4 + n3 / 2D"))
        .withColumn("steps_h", F.expr("cast(nh as double)"))
        .withColumn("steps_v", F.expr("cast(nv as double)"))
        .withColumn("steps_d", F.expr("cast(n3 + 2 * nd as double)"))
        .drop("n4", "n3", "nh", "nv", "nd")
        .withColumn("perimeter_px", F.expr("steps_h + steps_v + sqrt(2D) * steps_d"))
        .withColumn("circularity_px", F.expr("if(perimeter_px > 0, 4 * pi() * area_px2 / pow(perimeter_px, 2), 0D)"))
    )
