"""Following one seeded object through the slices of its stack.

Every component gets a pointer to its successor in the next and in the previous slice, once per stack;
the chain of a seed is then read off by repeated doubling of the pointers, in rounds logarithmic in the
number of slices rather than one job per slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.operators.contours import MIN_SEED_AREA
from voxelgrain.operators.nearest import nearest_targets
from voxelgrain.session import materialize

# fixed values: default search distance
DEFAULT_REACH_UM, DEFAULT_REACH_RADII, DEFAULT_RADIUS = 15.0, 3.0, 10.0
MERGE_GROWTH = 2.5

SEED_SCHEMA = (
    "stack_id string, seed_id string, x double, y double, frame_index int, radius double, "
    "max_tracking_dist_um double, type string, points array<struct<x:double,y:double>>"
)


def seed_errors(seeds: DataFrame, stacks: DataFrame, rect=None, slices=None) -> DataFrame:
    """Seeds with ``seed_error``: null when the seed lies in the image, region and slice range."""
    joined = seeds.join(stacks.select("stack_id", "nz", "ny", "nx"), "stack_id", "left")
    polygon = "coalesce(type, 'circle') = 'polygon'"
    checks = [
        ("nz is null", "concat('Unknown stack ', stack_id)"),
        (f"{polygon} and coalesce(size(points), 0) < 1", "'Polygon seed must have a non-empty list of points'"),
    ]
    for axis, size in (("x", "nx"), ("y", "ny")):
        checks.append((
            f"not {polygon} and ({axis} < 0 or {axis} >= {size})",
            f"concat('Seed {axis.upper()} coordinate ', {axis}, ' is outside full image bounds (0-', {size} - 1, ')')",
        ))
    checks.append((
        f"{polygon} and exists(points, p -> p.x < 0 or p.x >= nx or p.y < 0 or p.y >= ny)",
        "'Polygon vertex is outside full image bounds'",
    ))
    checks.append((
        "frame_index < 0 or frame_index >= nz",
        "concat('Seed frame index ', frame_index, ' is outside full image bounds (0-', nz - 1, ')')",
    ))
    if rect is not None:
        for axis, low, high in (("x", rect.xmin, rect.xmax), ("y", rect.ymin, rect.ymax)):
            checks.append((
                f"not {polygon} and ({axis} < {low} or {axis} >= {high})",
                f"concat('Seed {axis.upper()} coordinate ', {axis}, ' is outside ROI bounds [{low}, {high})')",
            ))
        checks.append((
            f"{polygon} and exists(points, p -> p.x < {rect.xmin} or p.x >= {rect.xmax} or p.y < {rect.ymin} or p.y >= {rect.ymax})",
            "'Polygon vertex is outside ROI bounds'",
        ))
    if slices is not None:
        checks.append((
            f"frame_index < {slices.zmin} or frame_index >= {slices.zmax}",
            f"concat('Seed frame index ', frame_index, ' is outside Z-range [{slices.zmin}, {slices.zmax})')",
        ))
    error = F.coalesce(*[F.when(F.expr(cond), F.expr(text)) for cond, text in checks])
    return joined.withColumn("seed_error", error)


def place_seeds(seeds: DataFrame, frames: DataFrame) -> DataFrame:
    """Seeds on their frame: centre pixel (half-even rounding, clamped), search distance in pixels.

    A polygon's centre is the mean of its corners; ``centre_x`` and ``centre_y`` keep it before rounding and clamping.
    Coordinates stay in the full image throughout.
    """
    polygon = "coalesce(type, 'circle') = 'polygon'"
    mean = "aggregate(points, 0D, (s, p) -> s + p.{0}) / size(points)"
    centred = seeds.withColumns(
        {
            "radius": F.coalesce("radius", F.lit(DEFAULT_RADIUS)),
            "_x": F.expr(f"if({polygon}, {mean.format('x')}, bround(x))"),
            "_y": F.expr(f"if({polygon}, {mean.format('y')}, bround(y))"),
            "polygon": F.expr(polygon),
        }
    )
    geometry = frames.select("stack_id", F.col("z").alias("frame_index"), "ny", "nx", "vx_um")
    return centred.join(geometry, ["stack_id", "frame_index"]).select(
        "stack_id", "seed_id", F.col("frame_index").alias("z"), "nx", "ny",
        F.expr("cast(greatest(0, least(nx - 1, bround(_x))) as int)").alias("sx"),
        F.expr("cast(greatest(0, least(ny - 1, bround(_y))) as int)").alias("sy"),
        F.col("_x").alias("centre_x"), F.col("_y").alias("centre_y"), "radius", "polygon", "points",
        F.expr(
            f"coalesce(max_tracking_dist_um / vx_um, greatest({DEFAULT_REACH_RADII}D * radius, {DEFAULT_REACH_UM}D / vx_um))"
        ).alias("reach_px"),
    )


def inside_polygon(points: str = "points", x: str = "x", y: str = "y") -> str:
    """SQL: is a pixel inside or on a polygon (even-odd rule, edges included)."""
    turned = f"concat(slice({points}, 2, size({points}) - 1), slice({points}, 1, 1))"
    crossing = (
        f"aggregate(zip_with({points}, {turned}, (p, q) -> if((p.y > {y}) <> (q.y > {y}) and "
        f"{x} < (q.x - p.x) * ({y} - p.y) / (q.y - p.y) + p.x, 1, 0)), 0, (s, c) -> s + c) % 2 = 1"
    )
    on_edge = (
        f"exists(zip_with({points}, {turned}, (p, q) -> (q.x - p.x) * ({y} - p.y) = (q.y - p.y) * ({x} - p.x) and "
        f"{x} between least(p.x, q.x) and greatest(p.x, q.x) and {y} between least(p.y, q.y) and greatest(p.y, q.y)), e -> e)"
    )
    return f"({crossing} or {on_edge})"


def seed_region(placed: DataFrame, *, far_edge: bool = False) -> DataFrame:
    """Pixels of each seed's region as (stack_id, seed_id, z, y, x): a disc or a filled polygon.

    Only the region's own bounding box is spelled out, clipped to the image. The box is half-open
    when objects are tracked; ``far_edge`` includes its last row and column.
    """
    last = 0 if far_edge else 1
    box = {
        "_y0": "if(polygon, floor(array_min(transform(points, p -> p.y))), floor(sy - radius))",
        "_y1": f"if(polygon, ceil(array_max(transform(points, p -> p.y))), ceil(sy + radius)) - {last}",
        "_x0": "if(polygon, floor(array_min(transform(points, p -> p.x))), floor(sx - radius))",
        "_x1": f"if(polygon, ceil(array_max(transform(points, p -> p.x))), ceil(sx + radius)) - {last}",
    }
    sized = placed.withColumns({k: F.expr(v) for k, v in box.items()}).withColumns(
        {
            "_y0": F.expr("cast(greatest(0, _y0) as int)"), "_y1": F.expr("cast(least(ny - 1, _y1) as int)"),
            "_x0": F.expr("cast(greatest(0, _x0) as int)"), "_x1": F.expr("cast(least(nx - 1, _x1) as int)"),
        }
    ).where("_y1 >= _y0 and _x1 >= _x0")
    pixels = sized.withColumn("y", F.explode(F.expr("sequence(_y0, _y1)"))).withColumn("x", F.explode(F.expr("sequence(_x0, _x1)")))
    return pixels.where(
        F.expr(f"if(polygon, {inside_polygon()}, pow(x - sx, 2) + pow(y - sy, 2) <= pow(radius, 2))")
    ).select("stack_id", "seed_id", "z", "y", "x")


def seed_component(placed: DataFrame, components: DataFrame, runs: DataFrame) -> DataFrame:
    """(stack_id, seed_id, z, label) on the seed's own frame.

    The component under the centre pixel, else the one sharing most pixels with the seed's region,
    else the nearest centroid within reach; ties go to the component met first in raster order.
    """
    key = ["stack_id", "seed_id", "z"]
    large = components.where(f"area >= {MIN_SEED_AREA}").select("stack_id", "z", "label", "cx", "cy")
    frame_runs = runs.join(large.select("stack_id", "z", "label"), ["stack_id", "z", "label"], "left_semi")
    hit = (
        placed.join(frame_runs.withColumnRenamed("y", "sy"), ["stack_id", "z", "sy"])
        .where("sx between x0 and x1").select(*key, "label")
    )
    # a disc's or polygon's row is compared with a run by its pixels, through their exact row
    overlap = (
        seed_region(placed.join(hit, key, "left_anti"))
        .join(frame_runs.select("stack_id", "z", "y", "x0", "x1", "label"), ["stack_id", "z", "y"])
        .where("x between x0 and x1")
        .groupBy(*key, "label").agg(F.count("*").alias("shared"))
        .groupBy(*key).agg(F.max_by("label", F.struct("shared", -F.col("label"))).alias("label"))
    )
    found = hit.unionByName(overlap)
    frame = ["stack_id", "z"]
    widths = placed.groupBy(*frame).agg(F.max("reach_px").alias("width"))
    lost = placed.join(found, key, "left_anti").join(widths, frame)
    points = lost.select(*key, F.col("sx").alias("px"), F.col("sy").alias("py"), "width", F.col("reach_px").alias("reach"))
    targets = large.join(widths, frame).select(*frame, F.col("label").alias("to_label"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), "width")
    nearest = nearest_targets(points, targets, frame, key).select(*key, F.col("to_label").alias("label"))
    return found.unionByName(nearest)


def shared_pixels(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, z, label, next_label, shared): pixels that components of slices z and z + 1 share.

    In each image row the runs of both slices are swept from left to right, so the work is linear
    in the number of runs and no two runs are compared.
    """
    keys = list(keys)
    line = [*keys, "z", "y"]
    none = -1
    # a run goes once to each of the two pairs of slices it belongs to; its ends are spelled out there
    laid_out = runs.select(
        *keys, "y", "x0", "x1", "label", F.explode(F.expr("array(struct(z as z, true as lower), struct(z - 1 as z, false as lower))")).alias("e")
    ).select(*keys, "e.z", "y", "x0", "x1", "label", "e.lower").repartition(*line)
    ends = laid_out.select(
        *line, "lower", F.explode(F.expr(f"array(struct(x0 as x, label as l), struct(x1 + 1 as x, {none}L as l))")).alias("e")
    ).select(*line, "e.x", F.expr("if(lower, e.l, null)").alias("a"), F.expr("if(lower, null, e.l)").alias("b"))
    # runs of one slice never touch, so at one x there is at most one event per slice
    steps = ends.groupBy(*line, "x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    order = Window.partitionBy(*line).orderBy("x")
    states = steps.select(
        *line,
        F.last("a", ignorenulls=True).over(order).alias("label"),
        F.last("b", ignorenulls=True).over(order).alias("next_label"),
        (F.lead("x").over(order) - F.col("x")).alias("len"),
    )
    return (
        states.where(f"label <> {none} and next_label <> {none} and len > 0")
        .groupBy(*keys, "z", "label", "next_label").agg(F.sum("len").alias("shared"))
    )


def successor_pointers(placed: DataFrame, components: DataFrame, runs: DataFrame) -> DataFrame:
    """(stack_id, dir, z, label, to_z, to_label, need) for components of seeded stacks, whatever the number of seeds.

    The successor shares most pixels; without any overlap it is the nearest centroid. ``need`` is the squared distance
    that a seed has to reach for the step, zero where pixels are shared. Nearest ones are found on grids
    of cells that halve from the longest reach of the stack's seeds.
    """
    large = components.where(f"area >= {MIN_SEED_AREA}").select("stack_id", "z", "label", "cx", "cy")
    seeded = placed.groupBy("stack_id").agg(F.max("reach_px").alias("reach_px"))
    big_runs = runs.join(large.select("stack_id", "z", "label"), ["stack_id", "z", "label"], "left_semi").join(
        seeded.select("stack_id"), "stack_id", "left_semi"
    )
    shared = shared_pixels(big_runs, ["stack_id"])
    both = shared.select(
        "stack_id", "shared",
        F.explode(
            F.expr(
                "array(struct(1 as dir, z as z, label as label, next_label as to_label), "
                "struct(-1 as dir, z + 1 as z, next_label as label, label as to_label))"
            )
        ).alias("p"),
    ).select("stack_id", "shared", "p.*")
    step = ["stack_id", "dir", "z", "label"]
    # written, because the components without overlap are asked for as well
    by_overlap = materialize(both.groupBy(*step).agg(F.max_by("to_label", F.struct("shared", -F.col("to_label"))).alias("to_label")))
    directed = large.join(seeded, "stack_id").select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("dir"))
    lonely = directed.join(by_overlap, step, "left_anti").select(
        *step, F.expr("z + dir").alias("to_z"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("reach_px").alias("width"), F.col("reach_px").alias("reach")
    )
    targets = large.join(seeded, "stack_id").select(
        "stack_id", F.col("z").alias("to_z"), F.col("label").alias("to_label"),
        F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("reach_px").alias("width"),
    )
    near = nearest_targets(lonely, targets, ["stack_id", "to_z"], step).select(*step, "to_label", F.col("d").alias("need"))
    return by_overlap.withColumn("need", F.lit(0.0)).unionByName(near).withColumn("to_z", F.expr("z + dir"))


def follow_chain(start: DataFrame, pointers: DataFrame, placed: DataFrame) -> DataFrame:
    """(stack_id, seed_id, z, label) of every component on a seed's chain, both directions.

    A chain ends at the first slice without a successor in the seed's reach and is never picked up again. Pointers of the
    stack double and carry the longest step they stand for; seeds follow those within their reach, until none gets farther.
    """
    step, to = ["stack_id", "dir", "z", "label"], ["to_z", "to_label", "need"]
    seeds = placed.select("stack_id", "seed_id", F.expr("reach_px * reach_px").alias("limit"))
    jumps = materialize(pointers.select(*step, *to))
    latest = start.select("stack_id", "seed_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("dir"), "z", "label")
    reached = materialize(latest.join(seeds, ["stack_id", "seed_id"]).select("seed_id", "limit", *step))
    parts = [reached]
    while True:
        held = reduce(DataFrame.unionByName, parts)
        ahead = materialize(
            held.join(jumps, step).where("need <= limit").select(
                "seed_id", "limit", "stack_id", "dir", F.col("to_z").alias("z"), F.col("to_label").alias("label")
            )
        )
        if ahead.isEmpty():
            return held.select("stack_id", "seed_id", "z", "label").distinct()
        parts.append(ahead)
        onward = jumps.select(
            "stack_id", "dir", F.col("z").alias("to_z"), F.col("label").alias("to_label"),
            F.col("to_z").alias("far_z"), F.col("to_label").alias("far_label"), F.col("need").alias("far_need"),
        )
        jumps = materialize(
            jumps.join(onward, ["stack_id", "dir", "to_z", "to_label"]).select(
                *step, F.col("far_z").alias("to_z"), F.col("far_label").alias("to_label"), F.greatest("need", "far_need").alias("need")
            )
        )


def tracking_records(chain: DataFrame, components: DataFrame, frames: DataFrame, placed: DataFrame, *, merge_reference: str = "first") -> DataFrame:
    """One row per seed and frame: tracked, centroid, area, edge contact, likely merge.

    The merge test compares with the first tracked frame in slice order (``merge_reference`` may be
    ``seed_frame`` instead). Edge contact means the image edge.
    """
    spine = frames.select("stack_id", "z", "nx", "ny").join(
        placed.select("stack_id", "seed_id", F.col("z").alias("seed_z")), "stack_id"
    )
    found = chain.join(
        components.select("stack_id", "z", "label", "area", "cx", "cy", "ymin", "ymax", "xmin", "xmax"), ["stack_id", "z", "label"]
    )
    if merge_reference == "first":
        reference = found.groupBy("stack_id", "seed_id").agg(F.min_by("area", "z").alias("reference_area"))
    elif merge_reference == "seed_frame":
        reference = found.join(placed.select("stack_id", "seed_id", "z"), ["stack_id", "seed_id", "z"]).select(
            "stack_id", "seed_id", F.col("area").alias("reference_area")
        )
    else:
        raise ValueError("merge_reference must be first or seed_frame")
    joined = spine.join(found, ["stack_id", "seed_id", "z"], "left").join(reference, ["stack_id", "seed_id"], "left")
    return joined.select(
        "stack_id", "seed_id", F.col("z").alias("frame_index"),
        F.col("label").isNotNull().alias("tracked"),
        F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"),
        F.coalesce("area", F.lit(0)).alias("area_px"),
        F.expr("coalesce(xmin <= 0 or ymin <= 0 or xmax + 1 >= nx or ymax + 1 >= ny, false)").alias("touches_roi_boundary"),
        F.expr(f"coalesce(area > reference_area * {MERGE_GROWTH}, false)").alias("likely_neighbor_merge"),
        "label",
    )


def tracking_summary(records: DataFrame) -> DataFrame:
    """Per seed: frames, lost frames and fraction, frames with edge contact or likely merges."""
    return records.groupBy("stack_id", "seed_id").agg(
        F.count("*").alias("track_frame_count"),
        F.expr("count_if(not tracked)").alias("lost_frame_count"),
        F.expr("count_if(not tracked) / count(*)").alias("lost_fraction"),
        F.expr("array_sort(collect_list(if(touches_roi_boundary, frame_index, null)))").alias("boundary_frames"),
        F.expr("array_sort(collect_list(if(likely_neighbor_merge, frame_index, null)))").alias("merge_frames"),
    )


def frame_seeds(records: DataFrame, frames: DataFrame) -> DataFrame:
    """Rounded centroid of the tracked component as the seed of each frame."""
    return (
        records.where("tracked")
        .select(
            "stack_id", "seed_id", F.col("frame_index").alias("z"), "label",
            F.expr("cast(bround(centroid_x) as int)").alias("sx"), F.expr("cast(bround(centroid_y) as int)").alias("sy"),
        )
        .join(frames.select("stack_id", "z", "nx", "ny"), ["stack_id", "z"])
    )


def largest_component_seed(components: DataFrame, frames: DataFrame) -> DataFrame:
    """First pixel of the largest component per frame, the image centre where there is none."""
    best = components.where(f"area >= {MIN_SEED_AREA}").groupBy("stack_id", "z").agg(
        F.max_by(F.struct("first_x", "first_y"), F.struct("area", -F.col("label"))).alias("b")
    )
    return frames.join(best, ["stack_id", "z"], "left").select(
        "stack_id", "z",
        F.expr("coalesce(cast(b.first_x as double), nx / 2)").alias("seed_x"),
        F.expr("coalesce(cast(b.first_y as double), ny / 2)").alias("seed_y"),
    )


def preview_seed(placed: DataFrame, components: DataFrame, runs: DataFrame) -> DataFrame:
    """Pixel that stands for a seed on one frame.

    First pixel of the component under the centre, for polygons else of the one sharing most pixels
    with it, otherwise the centre itself. A disc's radius plays no part.
    """
    key = ["stack_id", "seed_id", "z"]
    large = components.where(f"area >= {MIN_SEED_AREA}")
    frame_runs = runs.join(large.select("stack_id", "z", "label"), ["stack_id", "z", "label"], "left_semi")
    hit = (
        placed.join(frame_runs.withColumnRenamed("y", "sy"), ["stack_id", "z", "sy"])
        .where("sx between x0 and x1").select(*key, "label")
    )
    overlap = (
        seed_region(placed.where("polygon").join(hit, key, "left_anti"), far_edge=True)
        .join(frame_runs.select("stack_id", "z", "y", "x0", "x1", "label"), ["stack_id", "z", "y"])
        .where("x between x0 and x1")
        .groupBy(*key, "label").agg(F.count("*").alias("shared"))
        .groupBy(*key).agg(F.max_by("label", F.struct("shared", -F.col("label"))).alias("label"))
    )
    found = hit.unionByName(overlap).join(large.select("stack_id", "z", "label", "first_x", "first_y"), ["stack_id", "z", "label"])
    return placed.select(*key, "sx", "sy").join(found, key, "left").select(
        *key, F.coalesce("first_x", "sx").alias("seed_x"), F.coalesce("first_y", "sy").alias("seed_y")
    )
