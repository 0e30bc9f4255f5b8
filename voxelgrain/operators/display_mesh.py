"""Preparing masks and meshes for display: outlier frames, slice alignment, downsampling, tables.

The displayed mesh differs from the measured one, which skips all of these steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.operators import surface
from voxelgrain.operators.runs import pixel_runs
from voxelgrain.session import materialize

OUTLIER_FRACTION = 0.10
MAX_FACES = 12000


def drop_small_contours(contours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop frames whose contour area is below a tenth of the run's median (one value per frame)."""
    keys = list(keys)
    middle = contours.groupBy(*keys).agg(F.median("area_px2").alias("_m"))
    return contours.join(middle, keys).where(f"_m <= 0 or area_px2 >= _m * {OUTLIER_FRACTION}").drop("_m")


def run_pixels(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs back to pixels (keys, z, y, x)."""
    return mask.select(*keys, "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def slice_centroids(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centroid of every non-empty slice, from its runs."""
    n = "cast(x1 - x0 + 1 as double)"
    return mask.groupBy(*keys, "z").agg(F.expr(f"sum({n})").alias("_n"), F.expr(f"sum({n} * (x0 + x1) / 2)").alias("_x"), F.expr(f"sum({n} * y)").alias("_y")).select(
        *keys, "z", F.expr("_x / _n").alias("cx"), F.expr("_y / _n").alias("cy")
    )


def align_slices(mask: DataFrame, shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shift every slice so that its centroid meets that of the run's first non-empty slice.

    Sub-pixel shifts are taken in 1/32 pixel steps and weighted bilinearly; a pixel is set when at
    least half of it is covered. Pixels moved out of the image are lost.
    """
    keys = list(keys)
    centres = slice_centroids(mask, keys)
    first = centres.groupBy(*keys).agg(F.min_by(F.struct("cx", "cy"), "z").alias("first"))
    step = "cast(floor((bround(({0} - first.{0}) * 1024) + 16) / 32) as bigint)"
    moved = centres.join(first, keys).select(
        *keys, "z", F.expr(step.format("cx")).alias("_sx"), F.expr(step.format("cy")).alias("_sy")
    )
    parts = (
        "array(struct(cast({0} - floor({1} / 32) as int) as to, 32 - pmod({1}, 32) as w), "
        "struct(cast({0} - floor({1} / 32) - 1 as int) as to, pmod({1}, 32) as w))"
    )
    spread = (
        run_pixels(mask, keys).join(moved, [*keys, "z"])
        .withColumn("px", F.explode(F.expr(parts.format("x", "_sx"))))
        .withColumn("py", F.explode(F.expr(parts.format("y", "_sy"))))
        .where("px.w > 0 and py.w > 0")
        .groupBy(*keys, "z", F.col("py.to").alias("y"), F.col("px.to").alias("x"))
        .agg(F.expr("sum(px.w * py.w)").alias("w"))
        .where("w >= 512")
    )
    return spread.join(shapes.select(*keys, "ny", "nx"), keys).where("x >= 0 and y >= 0 and x < nx and y < ny").select(
        *keys, "z", "y", "x"
    )


def downsample(pixels: DataFrame, shapes: DataFrame, keys: Sequence[str], factor: int = 2) -> tuple[DataFrame, DataFrame]:
    """Shrink mask stacks by a factor with linear interpolation; more than half covered is set.

    Returns pixels and the new shapes, whose spacing grows by the factor. Stacks thinner than twice
    the factor on some axis stay as they are.
    """
    keys = list(keys)
    big = f"least(nz, ny, nx) >= {2 * factor}"
    sized = shapes.select(
        *keys, *[F.expr(f"if({big}, cast(bround({n} / {factor}D) as int), {n})").alias(f"_{n}") for n in ("nz", "ny", "nx")],
        *[F.expr(f"if({big}, if(bround({n} / {factor}D) > 1, ({n} - 1) / (bround({n} / {factor}D) - 1), 1D), 1D)").alias(f"_r{n}") for n in ("nz", "ny", "nx")],
    )
    spread = pixels.join(sized, keys)
    for axis in ("z", "y", "x"):
        ratio = f"_rn{axis}"
        places = (
            f"filter(sequence(cast(greatest(0, floor(({axis} - 1) / {ratio})) as int), "
            f"cast(least(_n{axis} - 1, ceil(({axis} + 1) / {ratio})) as int)), i -> abs(i * {ratio} - {axis}) < 1)"
        )
        spread = spread.where(f"floor(({axis} - 1) / {ratio}) <= _n{axis} - 1").withColumn(f"_o{axis}", F.explode(F.expr(places)))
    weight = " * ".join(f"(1 - abs(_o{a} * _rn{a} - {a}))" for a in "zyx")
    kept = (
        spread.groupBy(*keys, F.col("_oz").alias("z"), F.col("_oy").alias("y"), F.col("_ox").alias("x"))
        .agg(F.expr(f"sum({weight})").alias("w")).where("w > 0.5 + 1e-9").select(*keys, "z", "y", "x")
    )
    smaller = shapes.select(
        *keys, *[F.expr(f"if({big}, cast(bround({n} / {factor}D) as int), {n})").alias(n) for n in ("nz", "ny", "nx")],
        *[F.expr(f"if({big}, {v} * {factor}, {v})").alias(v) for v in ("vx_um", "vy_um", "vz_um")],
    )
    return kept, smaller


def placed_in_lines(rows: DataFrame, keys: Sequence[str], line: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The written rows with ``_place``, counted from 1 within each line (a row of cells or points)."""
    place = F.row_number().over(Window.partitionBy(*keys, *line).orderBy(*order))
    return materialize(rows.withColumn("_place", place))


def line_starts(placed: DataFrame, keys: Sequence[str], line: Sequence[str]) -> DataFrame:
    """(keys, line, _start): rows of the run before each line.

    Lines are added up within their slice, the first of the ``line`` columns, and slices within the run, so a task sees as many
    counts as a slice has lines or a run has slices.
    """
    keys, line = list(keys), list(line)
    outer, inner = line[:1], line[1:]
    counts = materialize(placed.groupBy(*keys, *line).agg(F.max("_place").cast("bigint").alias("_n")))

    def before(table: DataFrame, group: list[str], order: list[str], total: str, start: str) -> DataFrame:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return table.withColumn(start, F.sum(total).over(upto) - F.col(total)).drop(total)

    slices = before(counts.groupBy(*keys, *outer).agg(F.sum("_n").alias("_all")), keys, outer, "_all", "_slice")
    lines = before(counts, [*keys, *outer], inner, "_n", "_line").join(slices, [*keys, *outer])
    return lines.select(*keys, *line, (F.col("_slice") + F.col("_line")).alias("_start"))


def numbered(rows: DataFrame, keys: Sequence[str], line: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number rows 0, 1, 2... within each run without sorting or adding up a whole run in one task."""
    placed = placed_in_lines(rows, keys, line, order)
    return placed.join(line_starts(placed, keys, line), [*keys, *line]).withColumn(
        name, F.col("_start") + F.col("_place") - 1
    ).drop("_place", "_start")


def mesh_tables(triangles: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices (keys, vertex, x, y, z) and faces (keys, face, a, b, c), coordinates to six places.

    Triangles and vertices are written once. Corners meet their vertices by place, then again by line of cells, where the
    faces are counted.
    """
    keys = list(keys)
    line = [*keys, "cz", "cy"]
    placed = placed_in_lines(triangles, keys, ["cz", "cy"], ["cx", "tri"])
    corners = ", ".join(
        f"struct({i} as corner, " + ", ".join(f"round({a}{i}, 6) as {a}" for a in "xyz") + ")" for i in range(3)
    )
    points = placed.select(*line, "_place", F.explode(F.expr(f"array({corners})")).alias("p")).select(*line, "_place", "p.*")
    vertices = materialize(numbered(points.select(*keys, "x", "y", "z").distinct(), keys, ["z", "y"], ["x"], "vertex"))
    named = (
        points.join(vertices, [*keys, "x", "y", "z"]).select(*line, "_place", "corner", "vertex").repartition(*line)
        .groupBy(*line, "_place").agg(*[F.max(F.when(F.col("corner") == i, F.col("vertex"))).alias(n) for i, n in enumerate("abc")])
    )
    faces = named.join(line_starts(placed, keys, ["cz", "cy"]), line).select(
        *keys, (F.col("_start") + F.col("_place") - 1).alias("face"), *"abc"
    )
    return vertices.select(*keys, "vertex", "x", "y", "z"), faces


def decimate(triangles: DataFrame, keys: Sequence[str], max_faces: int = MAX_FACES) -> DataFrame:
    """Keep every n-th triangle so that at most ``max_faces`` remain, for display only."""
    keys = list(keys)
    stride = triangles.groupBy(*keys).agg(F.expr(f"greatest(1L, cast(ceil(count(*) / {max_faces}) as bigint))").alias("_stride"))
    return (
        numbered(triangles, keys, ["cz", "cy"], ["cx", "tri"], "face").join(stride, keys)
        .where("face % _stride = 0").drop("_stride", "face")
    )


def display_mesh(
    contours: DataFrame, mask_of, shapes: DataFrame, keys: Sequence[str], *, factor: int = 2, max_faces: int = MAX_FACES
) -> tuple[DataFrame, DataFrame]:
    """The displayed mesh (triangles, measures before decimation).

    ``mask_of`` turns contours into mask runs. Small outlier frames are dropped, slices aligned, the
    stack shrunk, then meshed.
    """
    keys = list(keys)
    aligned = align_slices(mask_of(drop_small_contours(contours, keys)), shapes, keys)
    small, sizes = downsample(aligned, shapes, keys, factor)
    runs = pixel_runs(small, keys).select(*keys, "z", "y", "x0", "x1")
    cells = surface.cell_stretches(runs, sizes, keys)
    triangles = surface.surface_triangles(cells, sizes, keys)
    return decimate(triangles, keys, max_faces), surface.measure_surface(cells, sizes, keys)
