"""Project settings files: reading, checking, precedence, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.functions.checks import first_error

SETTINGS_VERSION = 1
SETTINGS_SCHEMA = (
    "version int, profile string, threshold double, voxel_size struct<x_um:double,y_um:double,z_um:double>, "
    "roi struct<xmin:int,xmax:int,ymin:int,ymax:int>, z_range struct<zmin:int,zmax:int>, "
    "include_mesh boolean, prefer_opencv boolean, sweep struct<start:double,stop:double,step:double>"
)
DEFAULTS = {"profile": "'vesicle'", "include_mesh": "false", "prefer_opencv": "true"}


# fixed values: JSON kinds of the fields; the parts of an object are all needed
NUMBERS = ("version", "threshold")
TRUTHS = ("include_mesh", "prefer_opencv")
OBJECTS = {
    "voxel_size": ("x_um", "y_um", "z_um"), "roi": ("xmin", "xmax", "ymin", "ymax"), "z_range": ("zmin", "zmax"),
    "sweep": ("start", "stop", "step"),
}


def _kind(path: str) -> str:
    """Kind of a JSON value: absent and null are VOID."""
    return f"coalesce(schema_of_variant(try_variant_get(_v, '{path}', 'variant')), 'VOID')"


def parse_error() -> F.Column:
    """Text of the first malformed part of the JSON value in column ``_v``, or null."""
    number = "rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL)'"
    checks = [("_v is null or schema_of_variant(_v) not like 'OBJECT%'", "'settings must be a JSON object'")]
    checks += [(f"{_kind('$.' + f)} <> 'VOID' and not {_kind('$.' + f)} {number}", f"'{f} must be a number'") for f in NUMBERS]
    checks += [(f"{_kind('$.' + f)} not in ('VOID', 'BOOLEAN')", f"'{f} must be true or false'") for f in TRUTHS]
    checks.append((f"{_kind('$.profile')} not in ('VOID', 'STRING')", "'profile must be text'"))
    for name, parts in OBJECTS.items():
        whole = " and ".join([f"{_kind('$.' + name)} like 'OBJECT%'", *[f"{_kind(f'$.{name}.{q}')} {number}" for q in parts]])
        checks.append((f"{_kind('$.' + name)} <> 'VOID' and not ({whole})", f"'{name} needs the numbers {', '.join(parts)}'"))
    return first_error(*checks)


def parse_settings(texts: DataFrame, column: str = "value") -> DataFrame:
    """Settings columns from JSON text, next to the other columns of ``texts``; ``parse_error`` names what is malformed."""
    parsed = texts.withColumn("_s", F.from_json(column, SETTINGS_SCHEMA, {"mode": "PERMISSIVE"})).withColumn(
        "_v", F.expr(f"try_parse_json({column})")
    )
    return parsed.select(*[c for c in texts.columns if c != column], "_s.*", parse_error().alias("parse_error")).withColumn(
        "version", F.coalesce("version", F.lit(SETTINGS_VERSION))
    )


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One settings row per file."""
    return parse_settings(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()))


def settings_error() -> F.Column:
    """Text of the first invalid setting of a row, or null."""
    profile = "replace(lower(trim(profile)), '-', '_')"
    return first_error(
        ("parse_error is not null", "parse_error"),
        (f"version <> {SETTINGS_VERSION}", "concat('unsupported project settings version: ', version)"),
        (f"profile is not null and {profile} not in ('vesicle', 'rbc', 'active_surfaces')", "concat('unknown analysis profile: ', profile)"),
        ("least(voxel_size.x_um, voxel_size.y_um, voxel_size.z_um) <= 0", "'voxel spacing must be greater than zero'"),
        ("z_range.zmin < 0", "'zmin must be greater than or equal to zero'"),
        ("z_range.zmax <= z_range.zmin", "'zmax must be greater than zmin'"),
        ("sweep.step <= 0", "'sweep.step must be greater than zero'"),
    )


def checked_settings(settings: DataFrame) -> DataFrame:
    """The settings, failing on the first invalid row."""
    error = settings_error()
    return settings.withColumn("version", F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.col("version")))


def resolve_settings(command: DataFrame, project: DataFrame, key: str) -> DataFrame:
    """Command values before project values before defaults, per ``key``.

    A command must give all three voxel axes (vx_um, vy_um, vz_um) or none; anything between is an
    error, as is a missing threshold on both sides.
    """
    fields = ("profile", "threshold", "voxel_size", "roi", "z_range", "include_mesh", "prefer_opencv", "sweep")
    axes = "array(vx_um, vy_um, vz_um)"
    given = command.withColumn("_given", F.expr(f"size(filter({axes}, v -> v is not null))")).withColumn(
        "voxel_size",
        F.when(F.col("_given").isin(1, 2), F.raise_error(F.lit("voxel override needs x, y and z")))
        .when(F.col("_given") == 3, F.struct(F.col("vx_um").alias("x_um"), F.col("vy_um").alias("y_um"), F.col("vz_um").alias("z_um"))),
    )
    have = [f for f in fields if f in given.columns]
    joined = given.select(key, *[F.col(f).alias(f"c_{f}") for f in have]).join(
        project.select(key, *[F.col(f).alias(f"p_{f}") for f in fields]), key, "left"
    )
    out = []
    for f in fields:
        parts = ([f"c_{f}"] if f in have else []) + [f"p_{f}"] + ([DEFAULTS[f]] if f in DEFAULTS else [])
        out.append(F.expr(f"coalesce({', '.join(parts)})").alias(f))
    return joined.select(key, *out)


def settings_text(settings: DataFrame) -> F.Column:
    """Settings as JSON text without absent values; the profile falls back to the default."""
    del settings
    return F.to_json(
        F.struct(
            "include_mesh", "prefer_opencv", F.expr("coalesce(profile, 'vesicle')").alias("profile"), "roi", "sweep", "threshold",
            F.lit(SETTINGS_VERSION).alias("version"), "voxel_size", "z_range",
        )
    )


def write_settings(settings: DataFrame, folder: str) -> None:
    settings.select(settings_text(settings).alias("value")).write.mode("overwrite").text(folder)
