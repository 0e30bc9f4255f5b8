"""Queries on pixels, thresholds, components and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from voxelgrain.functions.intensity import stretch_slices
from voxelgrain.operators import contours, masks, runs, threshold, tracking
from voxelgrain.sources.table_stacks import ADAPTERS

LI_T, EV_T = 4.0, 60.0  # thresholds of the component queries


def _r(*names: str, places: int = 6):
    return [F.round(F.col(n).cast("double"), places).alias(n) for n in names]


def labelled(spark, folder, table, t, *, connectivity=8, band_rows=runs.BAND_ROWS):
    s = ADAPTERS[table](spark, folder)
    mask = runs.pixel_runs(s.pixels.where(F.col("v") >= t), ["stack_id"], band_rows=band_rows)
    return s, runs.label_runs(
        mask, ["stack_id"], connectivity=connectivity, band_rows=band_rows, arranged=True
    )


def mask_counts(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    frames = masks.frame_thresholds(masks.stack_frames(s.stacks), LI_T)
    return masks.threshold_mask(s.pixels, frames, ["stack_id"]).groupBy("stack_id", "z").agg(
        F.count("*").alias("area"), *[F.round(F.avg(c), 6).alias(f"c{c}") for c in "xy"],
        *[fn(c).alias(f"{n}_{c}") for c in "xy" for n, fn in (("min", F.min), ("max", F.max))],
    )


def mask_per_frame_thresholds(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    given = s.stacks.select("stack_id", F.explode(F.expr("sequence(0, 6)")).alias("z")).withColumn(
        "threshold", F.expr("3D + z % 3")
    )
    frames = masks.frame_thresholds(masks.stack_frames(s.stacks), given)
    return masks.threshold_mask(s.pixels, frames, ["stack_id"]).groupBy("stack_id", "z").agg(F.count("*").alias("area"))


def region_totals(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    rect, slices = masks.Rect(10, 40, 2, 90), masks.Slices(1, 5)
    kept = masks.keep_rect(masks.trim_slices(s.pixels, slices), rect)
    frames = masks.stack_frames(masks.check_rect(s.stacks, rect), slices)
    return frames.select("stack_id", "z").join(
        kept.groupBy("stack_id", "z").agg(F.sum("v").alias("total"), F.count("*").alias("pixels")), ["stack_id", "z"], "left"
    ).fillna(0)


def region_zeroed_low_threshold(spark, folder):
    """Signed values with thresholds at or below zero: zeroed pixels belong to the mask."""
    s = ADAPTERS["embeddings"](spark, folder)
    rect = masks.Rect(1, 6, 2, 8)
    given = s.stacks.select("stack_id", F.expr("if(cast(substring(stack_id, 5) as int) % 2 = 0, -0.05D, 0.05D)").alias("threshold"))
    frames = masks.frame_thresholds(masks.stack_frames(masks.check_rect(s.stacks, rect)), given)
    found, _ = masks.mask_runs(masks.keep_rect(s.pixels, rect), frames, ["stack_id"])
    return found.groupBy("stack_id", "z").agg(F.expr("sum(x1 - x0 + 1)").alias("area"), F.count("*").alias("runs"))


def excluded_frames(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    text = s.stacks.select("stack_id", F.lit(" 1, 3;; 5 ,").alias("t"))
    excluded = text.select("stack_id", F.explode(F.expr(masks.parse_frame_list("t"))).alias("z"))
    frames = masks.mark_excluded(masks.stack_frames(s.stacks), excluded)
    have = s.pixels.where(f"v >= {LI_T}").select("stack_id", "z").distinct().withColumn("measured", F.lit(True))
    return frames.select("stack_id", "z", "excluded").join(have, ["stack_id", "z"], "left").select(
        "stack_id", "z", "excluded", F.expr("coalesce(measured, false) and not excluded").alias("valid")
    )


# region and slices of the suggestions within a part of each stack
PART_RECT, PART_SLICES = masks.Rect(5, 40, 2, 9), masks.Slices(1, 5)


def suggest(table, method, part=False):
    def run(spark, folder):
        s = ADAPTERS[table](spark, folder)
        limits = {"rect": PART_RECT, "slices": PART_SLICES} if part else {}
        return threshold.suggest_threshold(s.pixels, s.stacks, method, **limits).select("stack_id", *_r("threshold"), "method")

    return run


def stretch(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    frames = masks.stack_frames(s.stacks)
    return stretch_slices(s.pixels, frames).where("stretched > 0")


def components(connectivity, band_rows, table="lineitem", t=LI_T):
    def run(spark, folder):
        _, found = labelled(spark, folder, table, t, connectivity=connectivity, band_rows=band_rows)
        c = runs.run_components(found, ["stack_id"])
        return c.select("stack_id", "z", "label", "area", *_r("cx", "cy"), "ymin", "ymax", "xmin", "xmax")

    return run


def component_edges(spark, folder):
    _, found = labelled(spark, folder, "lineitem", LI_T)
    c = runs.run_components(found, ["stack_id"]).where("area >= 16")
    return c.groupBy("stack_id", "z").agg(
        F.count("*").alias("objects"),
        F.expr("count_if(xmin <= 0 or ymin <= 0 or xmax + 1 >= 50 or ymax + 1 >= 11)").alias("touching"),
    )


def enclosed(band_rows):
    def run(spark, folder):
        s, found = labelled(spark, folder, "lineitem", 3.0, band_rows=band_rows)
        holes = runs.hole_runs(found, ["stack_id"], band_rows=band_rows)
        return holes.groupBy("stack_id", "z", "label").agg(
            F.expr("sum(x1 - x0 + 1)").alias("pixels"), F.min("y").alias("ymin"), F.max("y").alias("ymax")
        )

    return run


def outlines(spark, folder):
    s, found = labelled(spark, folder, "lineitem", 3.0)
    o = contours.describe_objects(found, ["stack_id"])
    return o.components.select(
        "stack_id", "z", "label", "area", "area_px2", "steps_h", "steps_v", "steps_d", *_r("perimeter_px", "circularity_px")
    )


def nested(spark, folder):
    s, found = labelled(spark, folder, "lineitem", 3.0)
    o = contours.describe_objects(found, ["stack_id"])
    return o.components.where("nested").select("stack_id", "z", "label")


def candidates(spark, folder):
    s, found = labelled(spark, folder, "lineitem", 3.0)
    o = contours.describe_objects(found, ["stack_id"])
    return o.components.withColumn("nx", F.lit(50)).withColumn("ny", F.lit(11)).select(
        "stack_id", "z", "label", F.expr(contours.is_candidate()).alias("candidate")
    )


def largest_box(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    mask = runs.pixel_runs(s.pixels.where(f"v >= {LI_T}"), ["stack_id"])
    return contours.largest_rectangle(mask, ["stack_id"]).select(
        "stack_id", "z", "label", "area", "xmin", "ymin", (F.col("xmax") + 1).alias("xmax"), (F.col("ymax") + 1).alias("ymax")
    )


def auto_seed(spark, folder):
    s, found = labelled(spark, folder, "lineitem", LI_T)
    return tracking.largest_component_seed(runs.run_components(found, ["stack_id"]), masks.stack_frames(s.stacks))


def at_seed(connectivity):
    """The component at the image point (25, 5) of every frame, or the nearest."""

    def run(spark, folder):
        s, found = labelled(spark, folder, "lineitem", LI_T, connectivity=connectivity)
        c = runs.run_components(found, ["stack_id"])
        seeds = masks.stack_frames(s.stacks).select("stack_id", "z", F.lit(25).alias("sx"), F.lit(5).alias("sy"), "nx", "ny")
        picked = contours.component_at_seed(c, found, seeds, ["stack_id"], ["stack_id"])
        return picked.join(c, ["stack_id", "z", "label"]).select(
            "stack_id", "z", "label", "area", "xmin", "ymin", (F.col("xmax") + 1).alias("xmax"), (F.col("ymax") + 1).alias("ymax")
        )

    return run


QUERIES = {
    "mask_counts": mask_counts,
    "mask_per_frame_thresholds": mask_per_frame_thresholds,
    "region_totals": region_totals,
    "region_zeroed_low_threshold": region_zeroed_low_threshold,
    "excluded_frames": excluded_frames,
    "threshold_auto_lineitem": suggest("lineitem", "auto"),
    "threshold_auto_events": suggest("events", "auto"),
    "threshold_otsu_embeddings": suggest("embeddings", "otsu"),
    "threshold_percentile_lineitem": suggest("lineitem", "percentile"),
    "threshold_auto_part": suggest("lineitem", "auto", part=True),
    "threshold_percentile_part": suggest("lineitem", "percentile", part=True),
    "threshold_percentile_embeddings": suggest("embeddings", "percentile"),
    "slice_contrast_stretch": stretch,
    "components_eight": components(8, runs.BAND_ROWS),
    "components_four": components(4, runs.BAND_ROWS),
    "components_across_bands": components(8, 4),
    "components_events": components(8, runs.BAND_ROWS, "events", EV_T),
    "component_edge_contact": component_edges,
    "enclosed_holes": enclosed(runs.BAND_ROWS),
    "enclosed_holes_across_bands": enclosed(4),
    "outline_measures": outlines,
    "nested_components": nested,
    "candidate_objects": candidates,
    "largest_rectangle": largest_box,
    "largest_component_seed": auto_seed,
    "component_at_seed": at_seed(8),
    "component_at_seed_four": at_seed(4),
}


def _suggest_sql(table: str, method: str, part: bool = False) -> str:
    dense = sql.dense(table)
    if part:
        r, t = PART_RECT, PART_SLICES
        dense = dense.replace("dn AS", "whole AS") + (
            f", dn AS (SELECT stack_id, CASE WHEN x >= {r.xmin} AND x < {r.xmax} AND y >= {r.ymin} AND y < {r.ymax} THEN v ELSE 0 END AS v "
            f"FROM whole WHERE z >= {t.zmin} AND z < {t.zmax})"
        )

    def otsu(pop: str, where: str) -> str:
        return (
            f"{pop}_s AS (SELECT stack_id, min(v) AS lo, max(v) AS hi, count(*) AS c FROM dn WHERE {where} GROUP BY 1), "
            f"{pop}_g AS (SELECT d.stack_id, d.v, s.lo, s.hi, CAST(least(floor((d.v - s.lo) * (256 / (s.hi - s.lo))), 255) AS INTEGER) AS g "
            f"FROM dn d JOIN {pop}_s s USING (stack_id) WHERE s.hi > s.lo AND {where}), "
            f"{pop}_b AS (SELECT stack_id, lo, hi, g - CASE WHEN v < lo + g * ((hi - lo) / 256) THEN 1 ELSE 0 END "
            f"+ CASE WHEN g < 255 AND v >= lo + (g + 1) * ((hi - lo) / 256) THEN 1 ELSE 0 END AS bin FROM {pop}_g), "
            f"{pop}_h AS (SELECT stack_id, bin, ((lo + bin * ((hi - lo) / 256)) + (lo + (bin + 1) * ((hi - lo) / 256))) / 2 AS centre, count(*) AS n "
            f"FROM {pop}_b GROUP BY stack_id, bin, lo, hi), "
            f"{pop}_w AS (SELECT stack_id, bin, centre, sum(n) OVER u AS w1, sum(n * centre) OVER u AS m1, "
            f"sum(n) OVER d AS w2, sum(n * centre) OVER d AS m2 FROM {pop}_h "
            "WINDOW u AS (PARTITION BY stack_id ORDER BY bin ROWS UNBOUNDED PRECEDING), "
            "d AS (PARTITION BY stack_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), "
            f"{pop}_t AS (SELECT stack_id, arg_max(centre, struct_pack(a := w1 * w2 * (m1 / w1 - m2 / w2) ** 2, b := -bin)) AS t "
            f"FROM {pop}_w WHERE w2 IS NOT NULL GROUP BY 1)"
        )

    if method == "percentile":
        return (
            f"WITH {dense} SELECT stack_id, round(CASE WHEN min(v) = max(v) THEN min(v) ELSE quantile_cont(v, 0.75) END, 6) AS threshold, "
            "CASE WHEN min(v) = max(v) THEN 'constant' ELSE 'percentile' END AS method FROM dn GROUP BY 1"
        )
    full = otsu("f", "true")
    if method == "otsu":
        return (
            f"WITH {dense}, {full} SELECT s.stack_id, round(CASE WHEN lo = hi THEN lo ELSE t END, 6) AS threshold, "
            "CASE WHEN lo = hi THEN 'constant' ELSE 'otsu' END AS method FROM f_s s LEFT JOIN f_t USING (stack_id)"
        )
    robust = otsu("r", "v > 0 AND v < 250")
    return (
        f"WITH {dense}, {full}, {robust}, j AS (SELECT s.stack_id, s.lo, s.hi, f.t AS ft, "
        "CASE WHEN rs.c >= 16 AND rs.hi > rs.lo THEN r.t END AS rt FROM f_s s LEFT JOIN f_t f USING (stack_id) "
        "LEFT JOIN r_s rs USING (stack_id) LEFT JOIN r_t r USING (stack_id)) "
        "SELECT stack_id, round(CASE WHEN lo = hi THEN lo WHEN rt IS NULL THEN ft WHEN ft > rt * 2 AND rt > 0 THEN rt ELSE ft END, 6) AS threshold, "
        "CASE WHEN lo = hi THEN 'constant' WHEN rt IS NULL THEN 'otsu' ELSE 'robust_otsu' END AS method FROM j"
    )


def _fg(table: str, t: float) -> str:
    return f"{sql.px(table)}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {t})"


def _components_sql(table: str, t: float, connectivity: int) -> str:
    return (
        f"WITH RECURSIVE {_fg(table, t)}, {sql.labels(connectivity=connectivity)}, {sql.components()} "
        "SELECT stack_id, z, label, area, round(cx, 6) AS cx, round(cy, 6) AS cy, ymin, ymax, xmin, xmax FROM comp"
    )


def _at_seed_sql(connectivity: int) -> str:
    return (
        f"WITH RECURSIVE {sql.frames('lineitem')}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {LI_T}), "
        f"{sql.labels(connectivity=connectivity)}, {sql.components()}, big AS (SELECT * FROM comp WHERE area >= 16), "
        "hit AS (SELECT b.stack_id, b.z, b.label FROM big b JOIN lab l USING (stack_id, z, label) WHERE l.y = 5 AND l.x = 25), "
        "near AS (SELECT stack_id, z, arg_min(label, struct_pack(a := (cx - 25) ** 2 + (cy - 5) ** 2, b := label)) AS label "
        "FROM big GROUP BY 1, 2), pick AS (SELECT n.stack_id, n.z, coalesce(h.label, n.label) AS label FROM near n LEFT JOIN hit h USING (stack_id, z)) "
        "SELECT stack_id, z, label, area, xmin, ymin, xmax + 1 AS xmax, ymax + 1 AS ymax FROM pick JOIN comp USING (stack_id, z, label)"
    )


_SHAPE3 = f"{_fg('lineitem', 3.0)}, {sql.labels()}, {sql.components()}, {sql.holes()}"
CANDIDATE_SQL = (
    "xmax - xmin + 1 >= 8 AND ymax - ymin + 1 >= 8 AND greatest((xmax - xmin + 1) / (ymax - ymin + 1), (ymax - ymin + 1) / (xmax - xmin + 1)) <= 8 "
    "AND xmin > 1 AND ymin > 1 AND xmax + 1 < 49 AND ymax + 1 < 10 AND perimeter_px > 0 AND 4 * pi() * area_px2 / perimeter_px ** 2 >= 0.05"
)

ORACLES = {
    "mask_counts": (
        f"WITH {_fg('lineitem', LI_T)} SELECT stack_id, z, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, "
        "min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM fg GROUP BY 1, 2"
    ),
    "mask_per_frame_thresholds": (
        f"WITH {sql.px('lineitem')} SELECT stack_id, z, count(*) AS area FROM px WHERE v >= 3 + z % 3 GROUP BY 1, 2"
    ),
    "region_totals": (
        f"WITH {sql.frames('lineitem', 1, 5)} SELECT f.stack_id, f.z, coalesce(sum(p.v), 0) AS total, count(p.v) AS pixels FROM fr f "
        "LEFT JOIN px p ON p.stack_id = f.stack_id AND p.z = f.z AND p.x >= 10 AND p.x < 40 AND p.y >= 2 GROUP BY 1, 2"
    ),
    "region_zeroed_low_threshold": (
        f"WITH {sql.dense('embeddings')}, m AS (SELECT stack_id, z, y, x FROM dn "
        "WHERE (CASE WHEN x >= 1 AND x < 6 AND y >= 2 AND y < 8 THEN v ELSE 0 END) >= "
        "(CASE WHEN CAST(substr(stack_id, 5) AS INTEGER) % 2 = 0 THEN -0.05 ELSE 0.05 END)) "
        "SELECT a.stack_id, a.z, count(*) AS area, count(*) FILTER (WHERE b.x IS NULL) AS runs FROM m a "
        "LEFT JOIN m b ON a.stack_id = b.stack_id AND a.z = b.z AND a.y = b.y AND a.x = b.x + 1 GROUP BY 1, 2"
    ),
    "excluded_frames": (
        f"WITH {sql.frames('lineitem')} SELECT stack_id, z, z IN (1, 3, 5) AS excluded, "
        f"z NOT IN (1, 3, 5) AND (stack_id, z) IN (SELECT (stack_id, z) FROM px WHERE v >= {LI_T}) AS valid FROM fr"
    ),
    "threshold_auto_lineitem": _suggest_sql("lineitem", "auto"),
    "threshold_auto_events": _suggest_sql("events", "auto"),
    "threshold_otsu_embeddings": _suggest_sql("embeddings", "otsu"),
    "threshold_percentile_lineitem": _suggest_sql("lineitem", "percentile"),
    "threshold_auto_part": _suggest_sql("lineitem", "auto", part=True),
    "threshold_percentile_part": _suggest_sql("lineitem", "percentile", part=True),
    "threshold_percentile_embeddings": _suggest_sql("embeddings", "percentile"),
    "slice_contrast_stretch": (
        f"WITH {sql.dense('lineitem')}, s AS (SELECT *, min(v) OVER (PARTITION BY stack_id, z) AS lo, max(v) OVER (PARTITION BY stack_id, z) AS hi FROM dn) "
        "SELECT stack_id, z, y, x, CAST(floor((v - lo) / (hi - lo) * 255) AS INTEGER) AS stretched FROM s WHERE hi > lo AND floor((v - lo) / (hi - lo) * 255) > 0"
    ),
    "components_eight": _components_sql("lineitem", LI_T, 8),
    "components_four": _components_sql("lineitem", LI_T, 4),
    "components_across_bands": _components_sql("lineitem", LI_T, 8),
    "components_events": _components_sql("events", EV_T, 8),
    "component_edge_contact": (
        f"WITH RECURSIVE {_fg('lineitem', LI_T)}, {sql.labels()}, {sql.components()} SELECT stack_id, z, count(*) AS objects, "
        "count(*) FILTER (WHERE xmin <= 0 OR ymin <= 0 OR xmax + 1 >= 50 OR ymax + 1 >= 11) AS touching FROM comp WHERE area >= 16 GROUP BY 1, 2"
    ),
    "enclosed_holes": (
        f"WITH RECURSIVE {_SHAPE3} SELECT stack_id, z, label, count(*) AS pixels, min(y) AS ymin, max(y) AS ymax FROM hole GROUP BY 1, 2, 3"
    ),
    "outline_measures": (
        f"WITH RECURSIVE {_SHAPE3}, {sql.quads()} SELECT stack_id, z, label, area, area_px2, CAST(steps_h AS DOUBLE) AS steps_h, "
        "CAST(steps_v AS DOUBLE) AS steps_v, CAST(steps_d AS DOUBLE) AS steps_d, round(perimeter_px, 6) AS perimeter_px, "
        "round(CASE WHEN perimeter_px > 0 THEN 4 * pi() * area_px2 / perimeter_px ** 2 ELSE 0 END, 6) AS circularity_px "
        "FROM shape JOIN comp USING (stack_id, z, label)"
    ),
    "nested_components": (
        f"WITH RECURSIVE {_SHAPE3} SELECT DISTINCT l.stack_id, l.z, l.label FROM lab l JOIN hole h "
        "ON l.stack_id = h.stack_id AND l.z = h.z AND l.y = h.y AND l.x = h.x"
    ),
    "candidate_objects": (
        f"WITH RECURSIVE {_SHAPE3}, {sql.quads()} SELECT stack_id, z, label, {CANDIDATE_SQL} AS candidate "
        "FROM shape JOIN comp USING (stack_id, z, label)"
    ),
    "largest_rectangle": (
        f"WITH RECURSIVE {_fg('lineitem', LI_T)}, {sql.labels(connectivity=4)}, {sql.components()}, "
        "b AS (SELECT *, row_number() OVER (PARTITION BY stack_id, z ORDER BY area DESC, label) AS rn FROM comp) "
        "SELECT stack_id, z, label, area, xmin, ymin, xmax + 1 AS xmax, ymax + 1 AS ymax FROM b WHERE rn = 1"
    ),
    "largest_component_seed": (
        f"WITH RECURSIVE {sql.frames('lineitem')}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {LI_T}), {sql.labels()}, {sql.components()}, "
        "b AS (SELECT *, row_number() OVER (PARTITION BY stack_id, z ORDER BY area DESC, label) AS rn FROM comp WHERE area >= 16) "
        f"SELECT f.stack_id, f.z, coalesce(CAST(label % {sql.BASE} AS DOUBLE), 25) AS seed_x, coalesce(CAST(label // {sql.BASE} AS DOUBLE), 5.5) AS seed_y "
        "FROM fr f LEFT JOIN b ON b.stack_id = f.stack_id AND b.z = f.z AND rn = 1"
    ),
    "component_at_seed": _at_seed_sql(8),
    "component_at_seed_four": _at_seed_sql(4),
}
ORACLES["enclosed_holes_across_bands"] = ORACLES["enclosed_holes"]
