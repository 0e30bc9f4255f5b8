"""Shape metrics as column expressions, and polygons held as arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: column names of the output, in order
FRAME_METRICS = (
    "area_px2", "perimeter_px", "area_um2", "perimeter_um", "circularity", "bbox_width_um", "bbox_height_um",
    "aspect_ratio", "elongation", "deformation_index", "extent", "equivalent_diameter_um", "solidity",
)
SUMMARY_METRICS = FRAME_METRICS[2:]


def derived_metrics(df: DataFrame) -> DataFrame:
    """Ratios from area_um2, perimeter_um, bbox_width_um, bbox_height_um and hull_um2."""
    major, minor = "greatest(bbox_width_um, bbox_height_um)", "least(bbox_width_um, bbox_height_um)"
    box = "(bbox_width_um * bbox_height_um)"
    return df.withColumns(
        {
            "circularity": F.expr("if(perimeter_um > 0, 4 * pi() * area_um2 / pow(perimeter_um, 2), 0D)"),
            "aspect_ratio": F.expr(f"if({minor} > 0, {major} / {minor}, 0D)"),
            "elongation": F.expr(f"if({minor} > 0, 1 - {minor} / {major}, 0D)"),
            "deformation_index": F.expr(f"if({minor} > 0, ({major} - {minor}) / ({major} + {minor}), 0D)"),
            "extent": F.expr(f"if({box} > 0, area_um2 / {box}, 0D)"),
            "equivalent_diameter_um": F.expr("if(area_um2 > 0, sqrt(4 * area_um2 / pi()), 0D)"),
            "solidity": F.expr("if(hull_um2 > 0, area_um2 / hull_um2, 0D)"),
        }
    )


def outline_metrics(df: DataFrame) -> DataFrame:
    """All frame metrics of traced outlines: needs block measures, bounds, hull_px2 and voxel sizes."""
    return derived_metrics(
        df.withColumns(
            {
                "area_um2": F.expr("area_px2 * vx_um * vy_um"),
                "perimeter_um": F.expr("steps_h * vx_um + steps_v * vy_um + steps_d * sqrt(vx_um * vx_um + vy_um * vy_um)"),
                "bbox_width_um": F.expr("(xmax - xmin) * vx_um"),
                "bbox_height_um": F.expr("(ymax - ymin) * vy_um"),
                "hull_um2": F.expr("hull_px2 * vx_um * vy_um"),
            }
        )
    )


def rectangle_metrics(df: DataFrame) -> DataFrame:
    """All frame metrics of bounding rectangles, whose far sides lie one pixel beyond the bounds."""
    w, h = "cast(xmax - xmin + 1 as double)", "cast(ymax - ymin + 1 as double)"
    return derived_metrics(
        df.withColumns(
            {
                "area_px2": F.expr(f"{w} * {h}"),
                "perimeter_px": F.expr(f"2 * ({w} + {h})"),
                "area_um2": F.expr(f"{w} * vx_um * {h} * vy_um"),
                "perimeter_um": F.expr(f"2 * ({w} * vx_um + {h} * vy_um)"),
                "bbox_width_um": F.expr(f"{w} * vx_um"),
                "bbox_height_um": F.expr(f"{h} * vy_um"),
                "hull_um2": F.expr(f"{w} * vx_um * {h} * vy_um"),
            }
        )
    )


def polygon_area(points: str) -> str:
    """SQL for the shoelace area of ``array<struct<x,y>>``."""
    turned = f"concat(slice({points}, 2, size({points}) - 1), slice({points}, 1, 1))"
    pairs = f"zip_with({points}, {turned}, (p, q) -> p.x * q.y - p.y * q.x)"
    return f"(abs(aggregate({pairs}, 0D, (s, c) -> s + c)) / 2)"


def polygon_perimeter(points: str, vx: str = "1D", vy: str = "1D") -> str:
    """SQL for the closed edge length, scaled per axis."""
    turned = f"concat(slice({points}, 2, size({points}) - 1), slice({points}, 1, 1))"
    sides = f"zip_with({points}, {turned}, (p, q) -> sqrt(pow((q.x - p.x) * {vx}, 2) + pow((q.y - p.y) * {vy}, 2)))"
    return f"aggregate({sides}, 0D, (s, c) -> s + c)"


def _chain_area(points: str) -> str:
    """SQL for the area between the y axis and the hull's side of greatest x, over ``array<struct<y,x>>``.

    Points come in order of y, then x. Each is joined to the corner from which it lies steepest; corners after that one
    lie inside, as does a corner of the same y.
    """
    steepest = "array_min(transform(filter(side, v -> v.y < p.y), (v, i) -> struct((p.x - v.x) / (p.y - v.y) as slope, i as i)))"
    side = (
        f"aggregate(array_sort({points}), cast(array() as array<struct<y:double,x:double>>), "
        f"(side, p) -> concat(slice(side, 1, coalesce({steepest}.i + 1, 0)), array(p)))"
    )
    return (
        f"aggregate({side}, named_struct('area', 0D, 'y', cast(null as double), 'x', cast(null as double)), (t, p) -> "
        "named_struct('area', t.area + coalesce((p.y - t.y) * (p.x + t.x) / 2, 0D), 'y', p.y, 'x', p.x), t -> t.area)"
    )


def hull_area(right: str, left: str) -> Column:
    """Area of the convex hull of points given twice, as ``array<struct<y,x>>`` of doubles and with x negated.

    Of points with one y, only the rightmost has to be in the first array and the leftmost in the second.
    """
    return F.expr(f"{_chain_area(right)} + {_chain_area(left)}")


def hull_area_of_points(points: str) -> Column:
    """Area of the convex hull of ``array<struct<x,y>>``."""
    turned = "transform({0}, p -> named_struct('y', cast(p.y as double), 'x', cast({1}p.x as double)))"
    return hull_area(turned.format(points, ""), turned.format(points, "-"))


def contour_metrics(contours: DataFrame) -> DataFrame:
    """Frame metrics of stored contours (points, vx_um, vy_um); fewer than three points is an error."""
    checked = contours.withColumn(
        "points",
        F.when(F.size("points") < 3, F.raise_error(F.lit("At least three contour points are required"))).otherwise(F.col("points")),
    )
    scaled = checked.withColumn("_p", F.expr("transform(points, p -> struct(p.x * vx_um as x, p.y * vy_um as y))"))
    span = "array_max(transform(_p, p -> p.{0})) - array_min(transform(_p, p -> p.{0}))"
    based = scaled.withColumns(
        {
            "area_px2": F.expr(polygon_area("points")),
            "perimeter_px": F.expr(polygon_perimeter("points")),
            "area_um2": F.expr(polygon_area("_p")),
            "perimeter_um": F.expr(polygon_perimeter("_p")),
            "bbox_width_um": F.expr(span.format("x")),
            "bbox_height_um": F.expr(span.format("y")),
            "hull_um2": hull_area_of_points("_p"),
        }
    )
    return derived_metrics(based).drop("_p", "hull_um2")
