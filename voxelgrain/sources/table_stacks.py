"""Image stacks derived from ordinary tables.

Every adapter returns ``(stacks, pixels)``. The number of stacks grows with the table while each
stack keeps a fixed geometry, so a bigger table means more stacks of the same kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StackSet:
    """Stacks and their sparse pixels (absent = 0)."""

    stacks: DataFrame
    pixels: DataFrame


def _stacks(ids: DataFrame, shape: tuple[int, int, int], voxel: tuple[float, float, float], source: str) -> DataFrame:
    nz, ny, nx = shape
    vx, vy, vz = voxel
    return ids.select(
        "stack_id",
        F.concat(F.lit("table://"), "stack_id").alias("source_path"),
        F.lit(nz).alias("nz"), F.lit(ny).alias("ny"), F.lit(nx).alias("nx"),
        F.lit(vx).alias("vx_um"), F.lit(vy).alias("vy_um"), F.lit(vz).alias("vz_um"),
        F.lit(source).alias("voxel_source"),
    )


def lineitem_density(spark: SparkSession, folder: str) -> StackSet:
    """Order-line counts over (line number, discount, quantity), one stack per flag and 50 suppliers."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.expr("concat(l_returnflag, '-', cast(l_suppkey div 50 as string))").alias("stack_id"),
        F.expr("l_linenumber - 1").alias("z"),
        F.expr("cast(round(l_discount * 100) as int)").alias("y"),
        F.expr("cast(l_quantity as int) - 1").alias("x"),
    )
    pixels = rows.groupBy("stack_id", "z", "y", "x").agg(F.count("*").cast("double").alias("v"))
    stacks = _stacks(rows.select("stack_id").distinct(), (7, 11, 50), (0.5, 0.25, 1.0), "metadata")
    return StackSet(stacks, pixels)


def embedding_tiles(spark: SparkSession, folder: str) -> StackSet:
    """Each vector is one dense 8 by 8 frame of signed values; 20 consecutive vectors make a stack."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.expr("concat('emb-', cast(vec_id div 20 as string))").alias("stack_id"),
        F.expr("cast(vec_id % 20 as int)").alias("z"),
        "embedding",
    )
    pixels = rows.select("stack_id", "z", F.posexplode("embedding").alias("i", "e")).select(
        "stack_id", "z",
        F.expr("cast(i div 8 as int)").alias("y"),
        F.expr("cast(i % 8 as int)").alias("x"),
        F.col("e").cast("double").alias("v"),
    )
    stacks = _stacks(rows.select("stack_id").distinct(), (20, 8, 8), (1.0, 1.0, 1.0), "default")
    return StackSet(stacks, pixels)


def event_activity(spark: SparkSession, folder: str) -> StackSet:
    """Summed event value over (day, hour, user), one stack per event type and 32 users."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        F.expr("concat(event_type, '-', cast(user_id div 32 as string))").alias("stack_id"),
        F.expr("day(ts) - 1").alias("z"),
        F.expr("hour(ts)").alias("y"),
        F.expr("cast(user_id % 32 as int)").alias("x"),
        "value",
    )
    pixels = rows.groupBy("stack_id", "z", "y", "x").agg(F.round(F.sum("value"), 2).alias("v"))
    stacks = _stacks(rows.select("stack_id").distinct(), (31, 24, 32), (1.0, 1.0, 2.0), "default")
    return StackSet(stacks, pixels)


def user_profiles(spark: SparkSession, folder: str) -> StackSet:
    """Summed event value over (event type, hour, user), one stack per 32 users; large ragged objects."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        F.expr("concat('users-', cast(user_id div 32 as string))").alias("stack_id"),
        F.expr(
            "cast(coalesce(nullif(array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type), 0), "
            "raise_error('unknown event type')) - 1 as int)"
        ).alias("z"),
        F.expr("hour(ts)").alias("y"),
        F.expr("cast(user_id % 32 as int)").alias("x"),
        "value",
    )
    pixels = rows.groupBy("stack_id", "z", "y", "x").agg(F.round(F.sum("value"), 2).alias("v"))
    stacks = _stacks(rows.select("stack_id").distinct(), (5, 24, 32), (0.5, 0.5, 1.5), "override")
    return StackSet(stacks, pixels)


ADAPTERS = {
    "lineitem": lineitem_density, "embeddings": embedding_tiles, "events": event_activity, "profiles": user_profiles,
}


def unpack_frames(frames: DataFrame) -> DataFrame:
    """Packed frames (stack_id, z, ny, nx, data) to pixels; zero values stay absent."""
    return (
        frames.select("stack_id", "z", "nx", F.posexplode("data").alias("i", "v"))
        .where("v <> 0 or v is null")
        .select("stack_id", "z", F.expr("cast(i div nx as int)").alias("y"), F.expr("cast(i % nx as int)").alias("x"), "v")
    )
