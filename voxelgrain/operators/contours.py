"""Choosing one object per frame: largest outline, bounding rectangle, or the object at a seed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.functions.geometry import hull_area as hull_area_of_ends
from voxelgrain.operators.nearest import nearest_targets
from voxelgrain.operators.outline import block_counts, outline_measures
from voxelgrain.operators.runs import BAND_ROWS, filled_runs, hole_runs, label_runs, run_components

# fixed values: limits an outline must meet to count as an object
MIN_SIDE, MAX_ASPECT, MIN_CIRCULARITY, MIN_SEED_AREA = 8, 8, 0.05, 16

TOO_FEW_POINTS = "(ymin = ymax or xmin = xmax or (area = ymax - ymin + 1 and area = xmax - xmin + 1))"


@dataclass
class Objects:
    """Labelled mask of many frames: runs, enclosed holes, filled runs and measured components."""

    runs: DataFrame
    holes: DataFrame
    filled: DataFrame
    components: DataFrame


def describe_objects(
    labelled: DataFrame, keys: Sequence[str], *, holes: DataFrame | None = None,
    band_rows: int = BAND_ROWS,
) -> Objects:
    """Components with pixel statistics, outline measures of their filled shape, and ``nested``."""
    keys = list(keys)
    shape = [*keys, "z", "label"]
    if holes is None:
        holes = hole_runs(labelled, keys, band_rows=band_rows)
    filled = filled_runs(labelled, holes, keys)
    measured = outline_measures(block_counts(filled, keys, band_rows=band_rows))
    components = run_components(labelled, keys).join(measured, shape)
    inner = nested_components(components, holes, keys).distinct().withColumn("nested", F.lit(True))
    components = components.join(inner, shape, "left").withColumn("nested", F.coalesce("nested", F.lit(False)))
    return Objects(labelled, holes, filled, components)


def nested_components(components: DataFrame, holes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, z, label) of components that lie inside a hole of another one.

    In the row of a component's first pixel, holes open and close like brackets; the component is
    nested when one is open at its pixel.
    """
    keys = list(keys)
    line = [*keys, "z", "y"]
    brackets = holes.select(
        *line, F.explode(F.expr("array(struct(x0 as x, 0 as k, 1 as d), struct(x1 + 1 as x, 0 as k, -1 as d))")).alias("e"),
        F.lit(None).cast("bigint").alias("label"),
    )
    probes = components.select(
        *keys, "z", F.col("first_y").alias("y"), F.struct(F.col("first_x").alias("x"), F.lit(1).alias("k"), F.lit(0).alias("d")).alias("e"), "label"
    )
    events = brackets.unionByName(probes).select(*line, "label", "e.x", "e.k", "e.d")
    depth = F.sum("d").over(
        Window.partitionBy(*line).orderBy("x", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return events.withColumn("depth", depth).where("label is not null and depth > 0").select(*keys, "z", "label")


def is_candidate(nx: str = "nx", ny: str = "ny") -> str:
    """SQL for outlines large, compact and central enough to be an object."""
    w, h = "(xmax - xmin + 1)", "(ymax - ymin + 1)"
    border = f"(xmin <= 1 or ymin <= 1 or xmin + {w} >= {nx} - 1 or ymin + {h} >= {ny} - 1)"
    return (
        f"({w} >= {MIN_SIDE} and {h} >= {MIN_SIDE} and greatest({w} / {h}, {h} / {w}) <= {MAX_ASPECT} "
        f"and not {border} and perimeter_px > 0 and circularity_px >= {MIN_CIRCULARITY})"
    )


def largest_outline(objects: Objects, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best outer outline per frame: candidates before others, then polygon area, then first pixel."""
    keys = list(keys)
    frame = [*keys, "z"]
    ranked = objects.components.where("not nested").join(frames.select(*frame, "nx", "ny"), frame).withColumn("candidate", F.expr(is_candidate()))
    cols = [c for c in objects.components.columns if c not in frame]
    return (
        ranked.groupBy(*frame)
        .agg(F.max_by(F.struct(*cols), F.struct("candidate", "area_px2", -F.col("label"))).alias("c"))
        .select(*frame, "c.*")
        .where(f"not {TOO_FEW_POINTS}")
    )


def largest_rectangle(
    runs: DataFrame, keys: Sequence[str], *, band_rows: int = BAND_ROWS
) -> DataFrame:
    """Largest 4-connected component per frame, first found on a tie, as its bounds."""
    keys = list(keys)
    frame = [*keys, "z"]
    cols = [*frame, "band", "y", "x0", "x1"]
    found = run_components(label_runs(runs.select(*cols), keys, connectivity=4, band_rows=band_rows), keys)
    picked = [c for c in found.columns if c not in frame]
    return (
        found.groupBy(*frame)
        .agg(F.max_by(F.struct(*picked), F.struct("area", -F.col("label"))).alias("c"))
        .select(*frame, "c.*")
    )


def hull_area(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Convex hull area (pixels) per component, from the two end pixels of each of its rows.

    A component's rows meet in one array, so a group is bounded by the height of an image.
    """
    keys = list(keys)
    owner = [*keys, "z", "label"]
    rows = runs.groupBy(*owner, "y").agg(F.max("x1").alias("right"), F.min("x0").alias("left"))
    ends = {"_r": "right", "_l": "-left"}
    points = rows.groupBy(*owner).agg(
        *[F.collect_list(F.expr(f"named_struct('y', cast(y as double), 'x', cast({x} as double))")).alias(n) for n, x in ends.items()]
    )
    return points.select(*owner, hull_area_of_ends("_r", "_l").alias("hull_px2"))


def component_at_seed(
    components: DataFrame, runs: DataFrame, seeds: DataFrame, keys: Sequence[str], seed_keys: Sequence[str],
    *, min_area: int = MIN_SEED_AREA,
) -> DataFrame:
    """(seed_keys, z, label): component under a seed pixel, else the one with the nearest centroid.

    ``seeds`` holds (seed_keys, z, sx, sy, nx, ny), one row per frame to be searched; components
    smaller than ``min_area`` pixels do not count.
    """
    keys, seed_keys = list(keys), list(seed_keys)
    probe = [*seed_keys, "z"]
    placed = seeds.select(
        *probe, F.expr("greatest(0, least(nx - 1, sx))").alias("sx"), F.expr("greatest(0, least(ny - 1, sy))").alias("sy"),
        F.expr("cast(nx + ny as double)").alias("width"),
    )
    large = components.where(f"area >= {min_area}").select(*keys, "z", "label", "cx", "cy")
    touched = (
        placed.join(runs.select(*keys, "z", F.col("y").alias("sy"), "x0", "x1", "label"), [*keys, "z", "sy"])
        .where("sx between x0 and x1")
        .join(large.select(*keys, "z", "label"), [*keys, "z", "label"], "left_semi")
        .select(*probe, "label")
    )
    frame = [*keys, "z"]
    points = placed.join(touched, probe, "left_anti").select(
        *probe, F.col("sx").alias("px"), F.col("sy").alias("py"), "width", F.col("width").alias("reach")
    )
    widths = placed.select(*frame, "width").distinct()
    targets = large.join(widths, frame).select(*frame, F.col("label").alias("to_label"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), "width")
    nearest = nearest_targets(points, targets, frame, probe).select(*probe, F.col("to_label").alias("label"))
    return touched.unionByName(nearest)
