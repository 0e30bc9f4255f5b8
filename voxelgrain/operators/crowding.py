"""Comparing runs: several seeds in one stack, two methods on the same objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: limits of the checks
MIN_DISTINCT_RANGE, MIN_VOLUME_CHANGE, MIN_VOLUME_FRACTION = 1.0, 50.0, 0.05


def distinct_objects(summary: DataFrame) -> DataFrame:
    """Per stack: do its seeds measure different objects, judged by their mean areas?"""
    return summary.groupBy("stack_id").agg(
        F.count("*").alias("seeds"), F.min("area_um2_mean").alias("least_area"), F.max("area_um2_mean").alias("most_area")
    ).select(
        "stack_id", "seeds", "least_area", "most_area",
        F.expr(f"coalesce(most_area - least_area > {MIN_DISTINCT_RANGE}, false)").alias("distinct"),
        F.expr("most_area / greatest(least_area, 1e-9D)").alias("area_ratio"),
    )


def snapshot(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The few values by which methods are compared."""
    return summary.select(
        *keys, "valid_frame_count", "valid_fraction", F.col("area_um2_mean").alias("mean_area_um2"),
        *[F.when(F.col("mesh_present"), F.col(c)).alias(c) for c in ("mesh_volume_um3", "mesh_surface_area_um2", "mesh_sphericity")],
        "warning_codes",
    )


def percent_change(value: str, base: str) -> str:
    """SQL for the signed change in percent; null when unknown or the base is zero."""
    return f"if({base} = 0, null, ({value} - {base}) / {base} * 100)"


def compare_methods(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshots of two methods side by side with signed changes in percent."""
    keys = list(keys)
    values = ("mean_area_um2", "mesh_volume_um3", "mesh_surface_area_um2", "mesh_sphericity")
    both = base.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values]).join(
        other.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values]), keys
    )
    return both.select(
        *keys, "mean_area_um2_a", "mean_area_um2_b",
        *[F.expr(percent_change(f"{v}_b", f"{v}_a")).alias(f"{v}_change") for v in values],
    )


def merge_failures(threshold_only: DataFrame, seeded: DataFrame, tracking: DataFrame, bounds: DataFrame, x_limit: float) -> DataFrame:
    """Did a seed fail to separate touching objects? Any of three signs confirms it.

    The seed changed the volume too little, tracking saw a merge, or the contour on the seed's frame
    (``bounds``) reaches past ``x_limit``.
    """
    a = threshold_only.select("stack_id", F.col("mesh_volume_um3").alias("v_all"))
    b = seeded.select("stack_id", F.col("mesh_volume_um3").alias("v_seed"))
    merges = tracking.groupBy("stack_id").agg(F.bool_or("likely_neighbor_merge").alias("merge_flag"))
    past = bounds.groupBy("stack_id").agg((F.max("xmax") > x_limit).alias("bleeds"))
    joined = a.join(b, "stack_id").join(merges, "stack_id", "left").join(past, "stack_id", "left")
    return joined.select(
        "stack_id",
        F.expr(f"abs(v_all - v_seed) < greatest({MIN_VOLUME_CHANGE}D, {MIN_VOLUME_FRACTION}D * v_all)").alias("seed_ignored"),
        F.coalesce("merge_flag", F.lit(False)).alias("merge_flag"), F.coalesce("bleeds", F.lit(False)).alias("bleeds"),
    ).withColumn("confirmed", F.expr("seed_ignored or merge_flag or bleeds"))
