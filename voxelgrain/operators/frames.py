"""Frame rows: one contour per frame with its metrics, in the fixed column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.geometry import FRAME_METRICS, outline_metrics, rectangle_metrics
from voxelgrain.operators.contours import (
    TOO_FEW_POINTS, Objects, hull_area, largest_outline, largest_rectangle,
)
from voxelgrain.operators.runs import BAND_ROWS

MESH_COLUMNS = ("mesh_surface_area_um2", "mesh_volume_um3", "mesh_equivalent_sphere_diameter_um", "mesh_sphericity")
# fixed values: column order of the frame table
FRAME_COLUMNS = ("frame_index", "threshold", "profile", "method", "excluded", "has_contour", *FRAME_METRICS, *MESH_COLUMNS)


def outline_rows(picked: DataFrame, objects: Objects, voxels: DataFrame, keys: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """Metrics of picked components: (owner, z, label) with component measures already joined."""
    keys = list(keys)
    shape = [*keys, "z", "label"]
    chosen = objects.runs.join(picked.select(*shape).distinct(), shape, "left_semi")
    hulls = hull_area(chosen, keys)
    full = picked.join(hulls, shape).join(voxels, [*owner, "z"])
    return outline_metrics(full)


def unseeded_contours(
    objects: Objects, frames: DataFrame, keys: Sequence[str], *, contour: str = "boundary",
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(keys, z, method, label, bounds, metrics) for every frame that has a contour.

    The outline of the largest object comes first; frames whose pick is a point or a line fall back
    to the rectangle around the largest 4-connected component.
    """
    keys = list(keys)
    frame = [*keys, "z"]
    voxels = frames.select(*frame, "vx_um", "vy_um")
    keep = [*frame, "method", "label", "area", "ymin", "ymax", "xmin", "xmax", *FRAME_METRICS]
    if contour == "rectangle":
        rest, outlines = objects.runs, None
    elif contour == "boundary":
        best = largest_outline(objects, frames, keys)
        outlines = outline_rows(best, objects, voxels, keys, keys).withColumn("method", F.lit("opencv")).select(*keep)
        rest = objects.runs.join(best.select(*frame), frame, "left_anti")
    else:
        raise ValueError("contour must be boundary or rectangle")
    boxes = rectangle_metrics(
        largest_rectangle(rest, keys, band_rows=band_rows).join(voxels, frame)
    ).withColumn("method", F.lit("fallback")).select(*keep)
    return boxes if outlines is None else outlines.unionByName(boxes)


def seeded_contours(picked: DataFrame, objects: Objects, frames: DataFrame, keys: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """Contours of components picked per (owner, z); a point or a line gives none."""
    keys, owner = list(keys), list(owner)
    keep = [*owner, "z", "method", "label", "area", "ymin", "ymax", "xmin", "xmax", *FRAME_METRICS]
    found = picked.join(objects.components, [*keys, "z", "label"]).where(f"not {TOO_FEW_POINTS}")
    voxels = frames.select(*owner, "z", "vx_um", "vy_um")
    return outline_rows(found, objects, voxels, keys, owner).withColumn("method", F.lit("seed")).select(*keep)


def frame_rows(
    frames: DataFrame, contours: DataFrame, keys: Sequence[str], *, profile: str, mesh: DataFrame | None = None,
    missing_method: str = "'fallback'",
) -> DataFrame:
    """The frame table: every analysed frame, zeros where nothing was measured.

    Excluded frames keep their metric values but count as having no contour.
    """
    keys = list(keys)
    frame = [*keys, "z"]
    joined = frames.join(contours.select(*frame, "method", *FRAME_METRICS), frame, "left")
    if mesh is not None:
        joined = joined.join(mesh.select(*keys, *MESH_COLUMNS), keys, "left")
    else:
        joined = joined.withColumns({c: F.lit(0.0) for c in MESH_COLUMNS})
    out_keys = [k for k in keys if k not in FRAME_COLUMNS]
    return joined.select(
        *out_keys,
        F.col("z").alias("frame_index"), "threshold", F.lit(profile).alias("profile"),
        F.coalesce("method", F.expr(missing_method)).alias("method"), "excluded",
        F.expr("area_px2 is not null and not excluded").alias("has_contour"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*FRAME_METRICS, *MESH_COLUMNS)],
    )
