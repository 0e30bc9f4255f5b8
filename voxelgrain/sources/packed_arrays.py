"""Packed arrays of two to four axes as pixels: one row holds a whole array in row-major order together with its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.intensity import LUMINANCE

# how an array without its axes of length one is read, from its shape ``s``
KINDS = (
    "case when size(s) = 2 then 'yx' when size(s) = 3 and element_at(s, -1) in (3, 4) then 'yxc' when size(s) = 3 then 'zyx' "
    "when size(s) = 4 and element_at(s, -1) in (3, 4) then 'zyxc' when size(s) = 4 and s[1] in (3, 4) then 'zcyx' end"
)
SHAPE_ERROR = "Unsupported image stack shape: "
LENGTH_ERROR = "array data must have as many values as the shape"


def described_arrays(arrays: DataFrame) -> DataFrame:
    """(stack_id, data, nz, ny, nx, nc, sz, sy, sx, sc): length and step of every axis of the arrays (stack_id, shape, data).

    Axes of length one are dropped unless there are only two. A last axis of three or four is colour, else a second of four axes.
    Other shapes are errors, and so is data of another length; an axis that is missing has length one, so any step does.
    """
    squeezed = arrays.select("stack_id", "data", "shape", F.expr("if(size(shape) = 2, shape, filter(shape, d -> d <> 1))").alias("s"))
    kind = F.expr(f"coalesce({KINDS}, raise_error(concat('{SHAPE_ERROR}(', array_join(shape, ', '), ')')))")
    known = squeezed.withColumn("kind", kind)
    # the position of an axis is its place in the name of the kind
    axes = {}
    for axis in "zyxc":
        here = f"instr(kind, '{axis}')"
        axes[f"n{axis}"] = F.expr(f"if({here} = 0, 1, element_at(s, greatest({here}, 1)))")
        axes[f"s{axis}"] = F.expr(f"aggregate(slice(s, {here} + 1, size(s)), 1, (a, d) -> a * d)")
    right = F.expr(f"if(nz * ny * nx * nc = size(data), data, raise_error('{LENGTH_ERROR}'))")
    return known.withColumns(axes).select("stack_id", right.alias("data"), *axes)


def _place(y_x: str) -> str:
    """SQL for the place in ``data`` of number p of the pixels in z, y, x order."""
    return f"({y_x} div (ny * nx)) * sz + ({y_x} div nx % ny) * sy + ({y_x} % nx) * sx"


def gray_pixels(arrays: DataFrame) -> DataFrame:
    """(stack_id, z, y, x, v): arrays as grayscale pixels; zeros stay absent, nulls and NaN do not.

    Colours become their luminance in the type of the data, so whole numbers lose their fraction; a fourth channel is ignored.
    """
    shaped = described_arrays(arrays)
    kind = shaped.schema["data"].dataType.elementType.simpleString()
    at = _place("p")
    red, green, blue = (f"data[{at} + {c} * sc]" for c in range(3))
    r, g, b = LUMINANCE
    light = f"cast({red} * {r}D + {green} * {g}D + {blue} * {b}D as {kind})"
    gray = F.expr(f"transform(sequence(0, nz * ny * nx - 1), p -> if(nc = 1, data[{at}], {light}))")
    filled = shaped.where("size(data) > 0").select("stack_id", "ny", "nx", F.posexplode(gray).alias("p", "v"))
    return filled.where("v <> 0 or v is null").select(
        "stack_id", F.expr("cast(p div (ny * nx) as int)").alias("z"), F.expr("cast(p div nx % ny as int)").alias("y"), F.expr("cast(p % nx as int)").alias("x"), "v"
    )


def color_pixels(arrays: DataFrame) -> DataFrame:
    """(stack_id, z, y, x, c, v): arrays as channel rows, every value; grayscale is repeated in three channels."""
    shaped = described_arrays(arrays).withColumn("many", F.expr("if(nc = 1, 3, nc)"))
    at = _place("(q div many)")
    values = F.expr(f"transform(sequence(0, nz * ny * nx * many - 1), q -> data[{at} + if(nc = 1, 0, (q % many) * sc)])")
    filled = shaped.where("size(data) > 0").select("stack_id", "ny", "nx", "many", F.posexplode(values).alias("q", "v"))
    return filled.select(
        "stack_id", F.expr("cast(q div many div (ny * nx) as int)").alias("z"), F.expr("cast(q div many div nx % ny as int)").alias("y"),
        F.expr("cast(q div many % nx as int)").alias("x"), F.expr("cast(q % many as int)").alias("c"), "v",
    )


def array_stacks(arrays: DataFrame) -> DataFrame:
    """(stack_id, nz, ny, nx): the shapes of the grayscale stacks."""
    return described_arrays(arrays).select("stack_id", "nz", "ny", "nx")
