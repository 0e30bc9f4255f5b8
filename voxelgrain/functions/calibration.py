"""Voxel spacing from image metadata text, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOXEL_UM = 1.0
METRE_LIMIT, UM_PER_METRE = 0.001, 1_000_000.0
NUMBER = "([0-9.eE+-]+)"


def resolution_um(numerator: str, denominator: str) -> str:
    """Pixel size from a resolution fraction (pixels per micrometre); zero or malformed gives null."""
    rate = f"try_divide(cast({numerator} as double), cast({denominator} as double))"
    return f"if({numerator} = 0, null, try_divide(1D, {rate}))"


def description_spacing(text: str) -> str:
    """Slice spacing written as ``spacing=...`` in a description."""
    return f"try_cast(nullif(regexp_extract({text}, 'spacing\\\\s*=\\\\s*{NUMBER}', 1), '') as double)"


def distance_from_xml(text: str, axis: str) -> str:
    """Value of the last Distance element of an axis, or of a Scaling element, whatever the namespaces."""
    name = "(?:[A-Za-z_][\\\\w.-]*:)?"
    block = (
        f"regexp_extract_all({text}, '(?s)<{name}Distance\\\\b[^>]*\\\\bId\\\\s*=\\\\s*[\"\\']{axis}[\"\\'][^>]*>(.*?)</{name}Distance>', 1)"
    )
    value = f"try_cast(trim(regexp_extract(try_element_at({block}, -1), '<{name}Value\\\\b[^>]*>([^<]*)<', 1)) as double)"
    scaling = (
        f"try_cast(trim(try_element_at(regexp_extract_all({text}, '<{name}Scaling{axis}\\\\b[^>]*>([^<]*)<', 1), -1)) as double)"
    )
    return f"coalesce({value}, {scaling})"


def distance_from_text(text: str, axis: str) -> str:
    """Fallbacks for damaged metadata: a Distance pattern, then the number after a Scaling key."""
    loose = (
        f"try_cast(nullif(regexp_extract({text}, '(?is)<Distance\\\\s+[^>]*Id\\\\s*=\\\\s*[\"\\']{axis}[\"\\'][^>]*>.*?<Value>\\\\s*{NUMBER}\\\\s*</Value>', 1), '') as double)"
    )
    key = f"try_cast(nullif(regexp_extract({text}, 'Scaling{axis}[^0-9+.eE-]+{NUMBER}', 1), '') as double)"
    return f"coalesce({loose}, {key})"


def metres_to_um(value: str) -> str:
    """Metadata spacing in micrometres: values below a thousandth are metres, none at or below zero."""
    return f"case when {value} <= 0 then null when {value} < {METRE_LIMIT} then {value} * {UM_PER_METRE}D else {value} end"


def _assembled(df: DataFrame) -> DataFrame:
    """``vx_um``.. from ``_x``..: all null stays null, single missing or zero axes become one."""
    known = "(_x is not null or _y is not null or _z is not null)"
    return df.withColumns(
        {f"v{a}_um": F.expr(f"if({known}, coalesce(nullif(_{a}, 0D), {DEFAULT_VOXEL_UM}D), null)") for a in "xyz"}
    ).drop("_x", "_y", "_z")


def tiff_voxels(metadata: DataFrame) -> DataFrame:
    """Spacing from resolution fractions (x_num, x_den, y_num, y_den) and ``description``."""
    return _assembled(
        metadata.withColumns(
            {
                "_x": F.expr(resolution_um("x_num", "x_den")),
                "_y": F.expr(resolution_um("y_num", "y_den")),
                "_z": F.expr(description_spacing("description")),
            }
        )
    )


def xml_voxels(metadata: DataFrame) -> DataFrame:
    """Spacing from metadata ``xml``; a lone X or Y stands for both."""
    raw = metadata.withColumns(
        {f"_r{a}": F.expr(f"coalesce({distance_from_xml('xml', a.upper())}, {distance_from_text('xml', a.upper())})") for a in "xyz"}
    )
    return _assembled(
        raw.withColumns(
            {
                "_x": F.expr(metres_to_um("coalesce(_rx, _ry)")),
                "_y": F.expr(metres_to_um("coalesce(_ry, _rx)")),
                "_z": F.expr(metres_to_um("_rz")),
            }
        ).drop("_rx", "_ry", "_rz")
    )


def voxel_precedence(detected: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Override before metadata before the default spacing, and where it came from.

    Spacing that is not positive is an error.
    """
    axes = ("vx_um", "vy_um", "vz_um")
    base = detected
    if overrides is not None:
        base = base.join(overrides.select("stack_id", *[F.col(a).alias(f"o_{a}") for a in axes]), "stack_id", "left")
    else:
        base = base.withColumns({f"o_{a}": F.lit(None).cast("double") for a in axes})
    chosen = base.withColumn(
        "voxel_source",
        F.expr("case when o_vx_um is not null then 'override' when vx_um is not null then 'metadata' else 'default' end"),
    ).withColumns({a: F.coalesce(f"o_{a}", a, F.lit(DEFAULT_VOXEL_UM)) for a in axes})
    bad = "least(vx_um, vy_um, vz_um) <= 0"
    return chosen.withColumn(
        "vx_um", F.when(F.expr(bad), F.raise_error(F.lit("voxel spacing must be greater than zero"))).otherwise(F.col("vx_um"))
    ).drop(*[f"o_{a}" for a in axes])


def standard_shapes(shape: str) -> tuple[str, str]:
    """SQL for the grayscale and colour shapes of a raw array shape; unsupported ranks give null.

    Axes of length one are dropped; a trailing (or second) axis of three or four is colour.
    """
    s = f"filter({shape}, d -> d <> 1)"
    rgb_last = "element_at(s, -1) in (3, 4)"

    def pick(two: str, one_color: str, plain: str, last: str, second: str) -> str:
        return (
            f"transform(array({s}), s -> case when size(s) = 2 then {two} "
            f"when size(s) = 3 and {rgb_last} then {one_color} when size(s) = 3 then {plain} "
            f"when size(s) = 4 and {rgb_last} then {last} when size(s) = 4 and s[1] in (3, 4) then {second} end)[0]"
        )

    gray = pick("concat(array(1), s)", "array(1, s[0], s[1])", "s", "slice(s, 1, 3)", "array(s[0], s[2], s[3])")
    color = pick(
        "concat(array(1), s, array(3))", "concat(array(1), s)", "concat(s, array(3))", "s", "array(s[0], s[2], s[3], s[1])"
    )
    return gray, color
