"""Queries on packed arrays of several shapes, and on the contrast of signed slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from voxelgrain.functions.intensity import stretch_slices
from voxelgrain.operators import masks
from voxelgrain.operators.contrast import stretched_background
from voxelgrain.sources.packed_arrays import array_stacks, color_pixels, gray_pixels
from voxelgrain.sources.table_stacks import ADAPTERS

# a vector of 64 entries read as seven kinds of arrays, by its number
SHAPES = ((8, 8), (2, 4, 8), (4, 4, 4), (2, 2, 4, 4), (2, 4, 4, 2), (1, 8, 1, 8), (1, 4, 1, 4, 4))


def _arrays(spark, folder):
    shapes = F.array(*[F.array(*[F.lit(n) for n in s]) for s in SHAPES])
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("stack_id"), F.element_at(shapes, (F.col("vec_id") % len(SHAPES) + 1).cast("int")).alias("shape"),
        F.expr("transform(embedding, e -> cast(floor(e * 1000) as int))").alias("data"),
    )


def gray(spark, folder):
    return gray_pixels(_arrays(spark, folder))


def color(spark, folder):
    return color_pixels(_arrays(spark, folder))


def shapes(spark, folder):
    return array_stacks(_arrays(spark, folder))


def signed_contrast(spark, folder):
    """Slices with negative values and absent pixels; absent ones come as runs, present ones as runs of one."""
    s = ADAPTERS["profiles"](spark, folder)
    pixels, frames = s.pixels.withColumn("v", F.col("v") - 40), masks.stack_frames(s.stacks)
    present = stretch_slices(pixels, frames).select("stack_id", "z", "y", F.col("x").alias("x0"), F.col("x").alias("x1"), "stretched", F.lit(True).alias("present"))
    return present.unionByName(stretched_background(pixels, frames, band_rows=7).withColumn("present", F.lit(False)))


QUERIES = {"slice_contrast_signed": signed_contrast, "array_gray_pixels": gray, "array_color_channels": color, "array_shapes": shapes}

# every kind spelt out: z, y, x, c of entry i, which counts from zero
_CASES = (
    ("0", "i // 8", "i % 8", "0"), ("i // 32", "i // 8 % 4", "i % 8", "0"), ("0", "i // 16", "i // 4 % 4", "i % 4"),
    ("i // 32", "i // 16 % 2", "i // 4 % 4", "i % 4"), ("i // 32", "i // 2 % 4", "i % 2", "i // 8 % 4"), ("0", "i // 8", "i % 8", "0"),
    ("0", "i // 16", "i // 4 % 4", "i % 4"),
)
_COLORED = "(2, 3, 4, 6)"


def _axis(n: int) -> str:
    return "CAST(CASE vec_id % 7 " + " ".join(f"WHEN {k} THEN {case[n]}" for k, case in enumerate(_CASES)) + " END AS INTEGER)"


_ENTRIES = (
    "e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(floor(embedding[i] * CAST(1000 AS DOUBLE)) AS INTEGER) AS v FROM embeddings, range(1, 65) AS r(i)), "
    f"p AS (SELECT vec_id AS stack_id, {_axis(0)} AS z, {_axis(1)} AS y, {_axis(2)} AS x, {_axis(3)} AS c, v FROM e)"
)
_LIGHT = (
    "CAST(trunc(max(CASE c WHEN 0 THEN v END) * CAST(0.299 AS DOUBLE) + max(CASE c WHEN 1 THEN v END) * CAST(0.587 AS DOUBLE) "
    "+ max(CASE c WHEN 2 THEN v END) * CAST(0.114 AS DOUBLE)) AS INTEGER)"
)

ORACLES = {
    "slice_contrast_signed": (
        f"WITH {sql.dense('profiles')}, sg AS (SELECT d.stack_id, d.z, d.y, d.x, p.v IS NOT NULL AS present, coalesce(p.v - 40, 0) AS v FROM dn d LEFT JOIN px p USING (stack_id, z, y, x)), "
        "ok AS (SELECT * FROM sg SEMI JOIN px USING (stack_id, z)), "
        "r AS (SELECT *, min(v) OVER (PARTITION BY stack_id, z) AS lo, max(v) OVER (PARTITION BY stack_id, z) AS hi FROM ok), "
        "t AS (SELECT stack_id, z, y, x, present, CASE WHEN hi > lo THEN CAST(floor((v - lo) / (hi - lo) * 255) AS INTEGER) ELSE 0 END AS stretched FROM r), "
        "g AS (SELECT *, x - row_number() OVER (PARTITION BY stack_id, z, y, present ORDER BY x) AS island FROM t) "
        "SELECT stack_id, z, y, x AS x0, x AS x1, stretched, present FROM g WHERE present UNION ALL "
        "SELECT stack_id, z, y, min(x), max(x), stretched, present FROM g WHERE NOT present AND stretched <> 0 GROUP BY stack_id, z, y, island, stretched, present"
    ),
    "array_gray_pixels": (
        f"WITH {_ENTRIES}, g AS (SELECT stack_id, z, y, x, CASE WHEN stack_id % 7 IN {_COLORED} THEN {_LIGHT} ELSE max(v) END AS v FROM p GROUP BY stack_id, z, y, x) "
        "SELECT * FROM g WHERE v <> 0"
    ),
    "array_color_channels": (
        f"WITH {_ENTRIES} SELECT stack_id, z, y, x, c, v FROM p WHERE stack_id % 7 IN {_COLORED} UNION ALL "
        f"SELECT stack_id, z, y, x, CAST(k AS INTEGER), v FROM p, range(0, 3) AS r(k) WHERE stack_id % 7 NOT IN {_COLORED}"
    ),
    "array_shapes": (
        "SELECT vec_id AS stack_id, CAST([1, 2, 1, 2, 2, 1, 1][vec_id % 7 + 1] AS INTEGER) AS nz, CAST([8, 4, 4, 2, 4, 8, 4][vec_id % 7 + 1] AS INTEGER) AS ny, "
        "CAST([8, 8, 4, 4, 2, 8, 4][vec_id % 7 + 1] AS INTEGER) AS nx FROM embeddings"
    ),
}
