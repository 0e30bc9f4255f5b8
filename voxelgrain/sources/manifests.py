"""Indexing run manifests and rolling up checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "profile string, threshold double, frame_count bigint, valid_frame_count bigint, "
    "mesh struct<surface_area_um2:double,volume_um3:double>, warnings array<struct<code:string>>, _bad string"
)


def read_manifest_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of manifest files, one row per file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("path", F.input_file_name())


def index_manifests(texts: DataFrame) -> DataFrame:
    """One row per manifest with its main values; unreadable ones have status error."""
    parsed = texts.withColumn("_m", F.from_json("value", MANIFEST_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.expr("_m is null or _m._bad is not null")
    return parsed.select(
        "path", F.when(broken, "error").otherwise("ok").alias("status"),
        *[F.when(~broken, F.col(f"_m.{c}")).alias(c) for c in ("profile", "threshold", "frame_count", "valid_frame_count")],
        F.when(~broken, F.col("_m.mesh.volume_um3")).alias("mesh_volume_um3"),
        F.when(~broken, F.array_join(F.expr("transform(_m.warnings, w -> w.code)"), ";")).alias("warning_codes"),
    )


def roll_up(checks: DataFrame, index: DataFrame) -> DataFrame:
    """Totals over named checks (name, passed) and indexed runs."""
    a = checks.agg(F.count("*").alias("checks"), F.expr("count_if(passed)").alias("checks_passed"))
    b = index.agg(
        F.count("*").alias("runs"), F.expr("count_if(status = 'error')").alias("runs_unreadable"),
        F.expr("count_if(status = 'ok' and valid_frame_count = frame_count)").alias("runs_complete"),
        F.expr("count_if(status = 'ok' and warning_codes <> '')").alias("runs_with_warnings"),
    )
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("passed", F.expr("checks = checks_passed and runs_unreadable = 0"))
