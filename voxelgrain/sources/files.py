"""Finding, hashing and inspecting source files without decoding them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.functions.calibration import standard_shapes

# fixed values: suffixes of image stacks
STACK_SUFFIXES = ("czi", "lsm", "tif", "tiff")


def is_stack_path(path: str) -> str:
    """SQL: does a path end in a known suffix, whatever its case?"""
    return f"lower({path}) rlike '[^/][.]({'|'.join(STACK_SUFFIXES)})$'"


def discover_stacks(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """(source_path, length, modified) of stack files, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(is_stack_path("path")).select(
        F.col("path").alias("source_path"), "length", F.col("modificationTime").alias("modified")
    ).orderBy("source_path")


def file_hashes(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """(source_path, source_sha256) of stack files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(is_stack_path("path")).select(
        F.col("path").alias("source_path"), content_hash("content").alias("source_sha256")
    )


def content_hash(column: str):
    """SHA-256 of a binary or text column as lower-case hex."""
    return F.sha2(F.col(column).cast("binary"), 256)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels (stack_id, z, y, x, v); range filters on z, y and x reach the scan."""
    return spark.read.parquet(path).select("stack_id", "z", "y", "x", "v")


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixels partitioned by stack and sorted by slice, so that slice ranges skip row groups."""
    pixels.repartition("stack_id", "z").sortWithinPartitions("stack_id", "z", "y", "x").write.mode("overwrite").partitionBy(
        "stack_id"
    ).parquet(path)


def inspect_stacks(raw: DataFrame) -> DataFrame:
    """Shapes and spacing of stacks from their raw ``shape`` and voxel columns; no pixels are read."""
    gray, color = standard_shapes("shape")
    checked = raw.withColumn("grayscale_shape", F.expr(gray)).withColumn("color_shape", F.expr(color))
    return checked.withColumn(
        "grayscale_shape",
        F.when(
            F.col("grayscale_shape").isNull(),
            F.raise_error(F.concat(F.lit("Unsupported image stack shape: "), F.col("shape").cast("string"))),
        ).otherwise(F.col("grayscale_shape")),
    )
