"""Queries on seeds, tracking through slices, and surfaces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import sql
from catalog.frames import T, metric_sql, HULL_EDGES, FRAME_METRICS
from voxelgrain.operators import contours, crowding, display_mesh, masks, runs, surface, tracking
from voxelgrain.plans.analyze import Settings, analyze, analyze_seeded
from voxelgrain.session import materialize
from voxelgrain.sources.table_stacks import ADAPTERS

LI_T = 4.0


def bright_seeds(s, radius=6.0, reach=None):
    """A seed at every stack's brightest pixel (first in raster order on a tie)."""
    top = s.pixels.groupBy("stack_id").agg(F.max_by(F.struct("z", "y", "x"), F.struct("v", -F.col("z"), -F.col("y"), -F.col("x"))).alias("p"))
    return top.select(
        "stack_id", F.lit("bright").alias("seed_id"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"),
        F.col("p.z").cast("int").alias("frame_index"), F.lit(radius).alias("radius"),
        F.lit(reach).cast("double").alias("max_tracking_dist_um"), F.lit("circle").alias("type"),
        F.expr("cast(null as array<struct<x:double,y:double>>)").alias("points"),
    )


def corner_seeds(s):
    """Triangular region in the image's lower left on the middle slice."""
    return s.stacks.select(
        "stack_id", F.lit("corner").alias("seed_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        F.expr("cast(nz div 2 as int)").alias("frame_index"), F.lit(5.0).alias("radius"), F.lit(None).cast("double").alias("max_tracking_dist_um"),
        F.lit("polygon").alias("type"),
        F.expr("array(named_struct('x', 2D, 'y', 2D), named_struct('x', 20D, 'y', 3D), named_struct('x', 4D, 'y', 9D))").alias("points"),
    )


def seeded(spark, folder, reach=None, seeds=None, **settings):
    s = ADAPTERS["lineitem"](spark, folder)
    points = seeds(s) if seeds else bright_seeds(s, reach=reach)
    return s, analyze_seeded(
        s.stacks, s.pixels, points, Settings(LI_T, only_positive=True, **settings)
    )


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def records(reach):
    def query(spark, folder):
        _, a = seeded(spark, folder, reach)
        return _rounded(a.tracking.drop("label"))

    return query


def track_summary(spark, folder):
    _, a = seeded(spark, folder, 3.0)
    t = tracking.tracking_summary(a.tracking)
    return _rounded(
        t.select(
            "stack_id", "track_frame_count", "lost_frame_count", "lost_fraction",
            *[F.array_join(c, ",").alias(c) for c in ("boundary_frames", "merge_frames")],
        )
    )


def track_warnings(spark, folder):
    _, a = seeded(spark, folder, 3.0)
    return a.summary.select("stack_id", F.explode("warnings").alias("w")).select(
        "stack_id", "w.code", "w.severity", "w.message", F.array_join("w.frame_indices", ",").alias("frame_indices"), "w.lost_frame_count"
    ).where("code not in ('partial_contours', 'no_valid_contours')")


def seeded_rows(**settings):
    def query(spark, folder):
        _, a = seeded(spark, folder, **settings)
        return _rounded(a.rows.drop(*(c for c in a.rows.columns if c.startswith("mesh_")), "excluded"))

    return query


def region_pixels(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    seeds = bright_seeds(s).unionByName(corner_seeds(s))
    placed = tracking.place_seeds(seeds, masks.stack_frames(s.stacks))
    return tracking.seed_region(placed, far_edge=True).groupBy("stack_id", "seed_id", "z").agg(
        F.count("*").alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")
    )


def seed_checks(spark, folder):
    """Seeds from order lines against image, region and slice bounds."""
    li = spark.read.parquet(f"{folder}/lineitem.parquet")
    s = ADAPTERS["lineitem"](spark, folder)
    seeds = li.select(
        F.expr("concat(l_returnflag, '-', cast(l_suppkey div 50 as string))").alias("stack_id"),
        F.expr("concat(l_orderkey, '/', l_linenumber)").alias("seed_id"),
        (F.col("l_quantity") + 5).alias("x"), F.expr("l_discount * 150 - 1").alias("y"), F.expr("cast(l_linenumber as int)").alias("frame_index"),
        F.lit(5.0).alias("radius"), F.lit(None).cast("double").alias("max_tracking_dist_um"), F.lit("circle").alias("type"),
        F.expr("cast(null as array<struct<x:double,y:double>>)").alias("points"),
    )
    checked = tracking.seed_errors(seeds, s.stacks, masks.Rect(8, 45, 1, 10), masks.Slices(2, 6))
    kind = F.expr(
        "case when seed_error is null then 'ok' when seed_error like '%X coordinate%full image%' then 'x image' "
        "when seed_error like '%Y coordinate%full image%' then 'y image' when seed_error like '%frame index%full image%' then 'z image' "
        "when seed_error like '%X coordinate%ROI%' then 'x region' when seed_error like '%Y coordinate%ROI%' then 'y region' "
        "when seed_error like '%Z-range%' then 'z range' end"
    )
    return checked.groupBy("stack_id", kind.alias("result")).agg(F.count("*").alias("seeds"))


def _labelled(spark, folder, t=LI_T):
    s = ADAPTERS["lineitem"](spark, folder)
    found = runs.label_runs(runs.pixel_runs(s.pixels.where(F.col("v") >= t), ["stack_id"]), ["stack_id"], arranged=True)
    return s, found


def shared(spark, folder):
    _, found = _labelled(spark, folder)
    return tracking.shared_pixels(found, ["stack_id"])


def seed_choice(spark, folder):
    s, found = _labelled(spark, folder)
    placed = tracking.place_seeds(bright_seeds(s).unionByName(corner_seeds(s)), masks.stack_frames(s.stacks))
    return tracking.seed_component(placed, runs.run_components(found, ["stack_id"]), found)


def preview_seeds(spark, folder):
    s, found = _labelled(spark, folder)
    placed = tracking.place_seeds(bright_seeds(s).unionByName(corner_seeds(s)), masks.stack_frames(s.stacks))
    return tracking.preview_seed(placed, runs.run_components(found, ["stack_id"]), found)


def _mask(spark, folder, t):
    s = ADAPTERS["profiles"](spark, folder)
    s = replace(s, stacks=materialize(s.stacks))
    return s, runs.pixel_runs(s.pixels.where(F.col("v") >= t), ["stack_id"])


def mask_surface(pad):
    def query(spark, folder):
        s, mask = _mask(spark, folder, T["profiles"])
        cells = surface.cell_stretches(mask, s.stacks, ["stack_id"], pad=pad)
        return _rounded(surface.measure_surface(cells, s.stacks, ["stack_id"]))

    return query


def mask_triangles(spark, folder):
    s, mask = _mask(spark, folder, T["profiles"])
    triangles = surface.surface_triangles(surface.cell_stretches(mask, s.stacks, ["stack_id"]), s.stacks, ["stack_id"])
    return _rounded(surface.measure_triangles(triangles, ["stack_id"]))


def mesh_summary(contour):
    def query(spark, folder):
        s = ADAPTERS["profiles"](spark, folder)
        a = analyze(s.stacks, s.pixels, Settings(T["profiles"], only_positive=True, include_mesh=True, contour=contour))
        return _rounded(a.mesh)

    return query


def mesh_tables(spark, folder):
    """Vertices and faces of the surfaces, as counts and coordinate sums."""
    s, mask = _mask(spark, folder, T["profiles"])
    triangles = surface.surface_triangles(surface.cell_stretches(mask, s.stacks, ["stack_id"]), s.stacks, ["stack_id"])
    vertices, faces = display_mesh.mesh_tables(triangles, ["stack_id"])
    v = vertices.groupBy("stack_id").agg(
        F.count("*").alias("vertices"), F.countDistinct("vertex").alias("numbers"), *[F.round(F.sum(c), 4).alias(f"sum_{c}") for c in "xyz"]
    )
    return v.join(faces.groupBy("stack_id").agg(F.count("*").alias("faces")), "stack_id")


def kept_faces(spark, folder):
    s, mask = _mask(spark, folder, T["profiles"])
    triangles = surface.surface_triangles(surface.cell_stretches(mask, s.stacks, ["stack_id"]), s.stacks, ["stack_id"])
    return display_mesh.decimate(triangles, ["stack_id"], max_faces=500).groupBy("stack_id").agg(F.count("*").alias("faces"))


def aligned_slices(spark, folder):
    s, mask = _mask(spark, folder, T["profiles"])
    moved = display_mesh.align_slices(mask, s.stacks, ["stack_id"])
    return moved.groupBy("stack_id", "z").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def slice_centroids(spark, folder):
    _, mask = _mask(spark, folder, T["profiles"])
    return _rounded(display_mesh.slice_centroids(mask, ["stack_id"]))


def halved_stack(spark, folder):
    s, mask = _mask(spark, folder, T["profiles"])
    small, shapes = display_mesh.downsample(display_mesh.run_pixels(mask, ["stack_id"]), s.stacks, ["stack_id"], factor=2)
    return small.groupBy("stack_id", "z").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")).join(
        shapes.select("stack_id", "nz", "ny", "nx", "vx_um"), "stack_id"
    )


def outlier_frames(spark, folder):
    s = ADAPTERS["lineitem"](spark, folder)
    a = analyze(s.stacks, s.pixels, Settings(5.0, only_positive=True))
    return display_mesh.drop_small_contours(a.contours, ["stack_id"]).select("stack_id", "z", "area_px2")


def crowd(spark, folder):
    """Two seeds per stack: the brightest pixel and a corner region."""
    s = ADAPTERS["lineitem"](spark, folder)
    points = bright_seeds(s).unionByName(corner_seeds(s))
    a = analyze_seeded(s.stacks, s.pixels, points, Settings(LI_T, only_positive=True, include_mesh=False))
    return _rounded(crowding.distinct_objects(a.summary))


def method_delta(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    snap = {}
    for contour in ("boundary", "rectangle"):
        a = analyze(s.stacks, s.pixels, Settings(T["profiles"], only_positive=True, contour=contour))
        snap[contour] = crowding.snapshot(a.summary, ["stack_id"])
    return _rounded(crowding.compare_methods(snap["boundary"], snap["rectangle"], ["stack_id"]))


QUERIES = {
    "seed_bounds_checks": seed_checks,
    "seed_region_pixels": region_pixels,
    "seed_component_choice": seed_choice,
    "preview_seed_pixels": preview_seeds,
    "slice_overlap": shared,
    "tracking_records": records(None),
    "tracking_records_short_reach": records(1.0),
    "tracking_summary": track_summary,
    "tracking_warnings": track_warnings,
    "seeded_frame_rows": seeded_rows(),
    "seeded_frame_rows_direct": seeded_rows(reselect=False),
    "crowded_seeds": crowd,
    "method_comparison": method_delta,
    "surface_of_mask": mask_surface(False),
    "surface_of_mask_closed": mask_surface(True),
    "surface_triangles": mask_triangles,
    "mesh_of_outlines": mesh_summary("boundary"),
    "mesh_of_rectangles": mesh_summary("rectangle"),
    "mesh_tables": mesh_tables,
    "mesh_decimation": kept_faces,
    "slice_centroids": slice_centroids,
    "slice_alignment": aligned_slices,
    "stack_downsampling": halved_stack,
    "outlier_contours": outlier_frames,
}


# ---- checking SQL ----

_COMP = (
    f"{sql.frames('lineitem')}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {LI_T}), {sql.labels()}, {sql.components()}, "
    "big AS (SELECT * FROM comp WHERE area >= 16), bl AS (SELECT l.* FROM lab l SEMI JOIN big USING (stack_id, z, label))"
)
_BRIGHT = (
    "bright AS (SELECT stack_id, CASE WHEN rn = 1 THEN 'bright' END AS seed_id, z, y AS sy, x AS sx FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY v DESC, z, y, x) AS rn FROM px) WHERE rn = 1)"
)


def _inside(x: str, y: str) -> str:
    """Pixel in or on the corner triangle (2,2), (20,3), (4,9), by signed areas."""
    sides = [((2, 2), (20, 3)), ((20, 3), (4, 9)), ((4, 9), (2, 2))]
    return " AND ".join(f"({b[0] - a[0]}) * ({y} - {a[1]}) - ({b[1] - a[1]}) * ({x} - {a[0]}) >= 0" for a, b in sides)


# centre of the triangle: (26/3, 14/3), rounded (9, 5)
def _placed(far: bool) -> str:
    hi = "" if far else " AND y < sy + 6 AND x < sx + 6"
    corner_hi = "" if far else " AND y < 9 AND x < 20"
    return (
        f"{_BRIGHT}, seeds AS (SELECT stack_id, seed_id, z, sy, sx FROM bright UNION ALL SELECT stack_id, CASE WHEN stack_id IS NOT NULL THEN 'corner' END, 3, 5, 9 FROM st), "
        "grid AS (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x FROM range(0, 11) AS a(y), range(0, 50) AS b(x)), "
        f"region AS (SELECT stack_id, seed_id, z, y, x FROM bright, grid WHERE (x - sx) ** 2 + (y - sy) ** 2 <= 36{hi} UNION ALL "
        f"SELECT stack_id, 'corner', 3, y, x FROM st, grid WHERE {_inside('x', 'y')}{corner_hi})"
    )


def _choice(far: bool = False, nearest: bool = True, disc: bool = True, reach: str = "greatest(18.0, 30.0)") -> str:
    """CTE ``start`` (stack_id, seed_id, z, label)."""
    only = "" if disc else " WHERE r.seed_id = 'corner'"
    near = (
        f"SELECT s.stack_id, s.seed_id, s.z, 3 AS k, c.label, -((c.cx - s.sx) ** 2 + (c.cy - s.sy) ** 2) AS score FROM seeds s JOIN big c USING (stack_id, z) "
        f"WHERE (c.cx - s.sx) ** 2 + (c.cy - s.sy) ** 2 <= ({reach}) ** 2"
    )
    return (
        f"{_placed(far)}, opt AS (SELECT s.stack_id, s.seed_id, s.z, 1 AS k, l.label, CAST(0 AS DOUBLE) AS score FROM seeds s JOIN bl l ON l.stack_id = s.stack_id AND l.z = s.z AND l.y = s.sy AND l.x = s.sx "
        f"UNION ALL SELECT r.stack_id, r.seed_id, r.z, 2, l.label, count(*) FROM region r JOIN bl l USING (stack_id, z, y, x){only} GROUP BY ALL"
        + (f" UNION ALL {near}" if nearest else "")
        + "), start AS MATERIALIZED (SELECT stack_id, seed_id, z, label FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, seed_id ORDER BY k, score DESC, label) AS rn FROM opt) WHERE rn = 1)"
    )


def _track(reach: str, seeds: str = "all") -> str:
    """CTEs up to ``rec`` (tracking records) for the bright seeds (or both)."""
    keep = "" if seeds == "all" else " WHERE seed_id = 'bright'"
    return (
        f"{_COMP}, {_choice(reach=reach)}, "
        "ov AS (SELECT a.stack_id, a.z, a.label, b.label AS nlabel, count(*) AS shared FROM bl a JOIN bl b ON a.stack_id = b.stack_id AND b.z = a.z + 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL), "
        "cand AS (SELECT stack_id, z, 1 AS dir, label, nlabel AS tl, 1 AS k, shared AS score FROM ov UNION ALL SELECT stack_id, z + 1, -1, nlabel, label, 1, shared FROM ov UNION ALL "
        "SELECT a.stack_id, a.z, d.dir, a.label, b.label, 2, -((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) FROM big a CROSS JOIN (VALUES (1), (-1)) AS d(dir) JOIN big b ON a.stack_id = b.stack_id AND b.z = a.z + d.dir "
        f"WHERE (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= ({reach}) ** 2), "
        "ptr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, z, dir, label ORDER BY k, score DESC, tl) AS rn FROM cand) WHERE rn = 1), "
        f"chain AS (SELECT stack_id, seed_id, d.dir, z, label FROM start, (VALUES (1), (-1)) AS d(dir){keep} UNION "
        "SELECT c.stack_id, c.seed_id, c.dir, p.z + p.dir, p.tl FROM chain c JOIN ptr p ON p.stack_id = c.stack_id AND p.z = c.z AND p.dir = c.dir AND p.label = c.label), "
        "onchain AS (SELECT DISTINCT c.stack_id, c.seed_id, c.z, c.label, b.area, b.cx, b.cy, b.xmin, b.xmax, b.ymin, b.ymax FROM chain c JOIN big b USING (stack_id, z, label)), "
        "ref AS (SELECT stack_id, seed_id, arg_min(area, z) AS ra FROM onchain GROUP BY ALL), "
        f"rec AS MATERIALIZED (SELECT f.stack_id, s.seed_id, f.z AS frame_index, o.label IS NOT NULL AS tracked, o.cx AS centroid_x, o.cy AS centroid_y, coalesce(o.area, 0) AS area_px, "
        "coalesce(xmin <= 0 OR ymin <= 0 OR xmax + 1 >= 50 OR ymax + 1 >= 11, false) AS touches_roi_boundary, coalesce(o.area > ra * 2.5, false) AS likely_neighbor_merge, o.label "
        f"FROM fr f JOIN (SELECT stack_id, seed_id FROM seeds{keep}) s USING (stack_id) LEFT JOIN onchain o ON o.stack_id = f.stack_id AND o.seed_id = s.seed_id AND o.z = f.z LEFT JOIN ref ON ref.stack_id = f.stack_id AND ref.seed_id = s.seed_id)"
    )


_REC = (
    "SELECT stack_id, seed_id, frame_index, tracked, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, area_px, "
    "touches_roi_boundary, likely_neighbor_merge FROM rec"
)
FAR = "greatest(18.0, 30.0)"
_TSUM = (
    "ts AS (SELECT stack_id, count(*) AS n, count(*) FILTER (WHERE NOT tracked) AS lost, count(*) FILTER (WHERE NOT tracked) / count(*) AS frac, "
    "coalesce(list_sort(list(frame_index) FILTER (WHERE touches_roi_boundary)), []) AS edge, coalesce(list_sort(list(frame_index) FILTER (WHERE likely_neighbor_merge)), []) AS mrg FROM rec GROUP BY 1)"
)


def _seeded_rows(reselect: bool, seeds: str = "bright") -> str:
    """CTEs up to ``srw``: frame rows of the seeded analysis."""
    pick = (
        "fs AS (SELECT stack_id, seed_id, frame_index AS z, label AS tl, greatest(0, least(49, CAST(round_even(centroid_x, 0) AS INTEGER))) AS sx, greatest(0, least(10, CAST(round_even(centroid_y, 0) AS INTEGER))) AS sy FROM rec WHERE tracked), "
    )
    if reselect:
        pick += (
            "ph AS (SELECT f.stack_id, f.seed_id, f.z, l.label FROM fs f JOIN bl l ON l.stack_id = f.stack_id AND l.z = f.z AND l.y = f.sy AND l.x = f.sx), "
            "pn AS (SELECT f.stack_id, f.seed_id, f.z, arg_min(b.label, struct_pack(a := (b.cx - f.sx) ** 2 + (b.cy - f.sy) ** 2, b := b.label)) AS label FROM fs f JOIN big b USING (stack_id, z) GROUP BY ALL), "
            "pk AS (SELECT n.stack_id, n.seed_id, n.z, coalesce(h.label, n.label) AS label FROM pn n LEFT JOIN ph h USING (stack_id, seed_id, z)), "
        )
    else:
        pick += "pk AS (SELECT stack_id, seed_id, z, tl AS label FROM fs), "
    hull = HULL_EDGES.format(
        k="p.stack_id, p.z, p.label", pts="pts", pq="p.stack_id = q.stack_id AND p.z = q.z AND p.label = q.label",
        pr="p.stack_id = r.stack_id AND p.z = r.z AND p.label = r.label",
    )
    vx, vy, _ = sql.VOXELS["lineitem"]
    return (
        f"{pick}cl AS (SELECT l.* FROM lab l SEMI JOIN pk USING (stack_id, z, label)), {sql.holes('cl')}, {sql.quads()}, "
        "ext AS (SELECT stack_id, z, label, y, min(x) AS a, max(x) AS b FROM cl GROUP BY ALL), "
        f"pts AS (SELECT stack_id, z, label, y, a AS x FROM ext UNION SELECT stack_id, z, label, y, b FROM ext), {hull}, "
        f"scon AS (SELECT stack_id, seed_id, z, 'seed' AS method, {metric_sql(f'CAST({vx} AS DOUBLE)', f'CAST({vy} AS DOUBLE)')} FROM (SELECT p.seed_id, s.*, h.hull_px2, c.xmax - c.xmin AS box_w, c.ymax - c.ymin AS box_h "
        "FROM pk p JOIN shape s USING (stack_id, z, label) JOIN hull h USING (stack_id, z, label) JOIN comp c USING (stack_id, z, label) "
        "WHERE NOT (ymin = ymax OR xmin = xmax OR (area = ymax - ymin + 1 AND area = xmax - xmin + 1)))), "
        f"srw AS (SELECT r.stack_id, r.seed_id, r.frame_index, CAST({LI_T} AS DOUBLE) AS threshold, 'vesicle' AS profile, coalesce(method, CASE WHEN tracked THEN 'fallback' ELSE 'seed_lost' END) AS method, "
        "area_px2 IS NOT NULL AS has_contour, " + ", ".join(f"round(coalesce({m}, 0), 6) AS {m}" for m in FRAME_METRICS)
        + ", area_um2 IS NOT NULL AS ok, area_um2 AS raw_area FROM rec r LEFT JOIN scon c ON c.stack_id = r.stack_id AND c.seed_id = r.seed_id AND c.z = r.frame_index)"
    )


_SROW = "SELECT stack_id, seed_id, frame_index, threshold, profile, method, has_contour, " + ", ".join(FRAME_METRICS) + " FROM srw"


def _triangles(mask: str, pad: bool = False, shape=sql.SHAPES["profiles"], voxels=sql.VOXELS["profiles"]) -> str:
    """CTE ``tri``: triangles of mask cells from the case table; ``mask`` is a CTE (stack_id, z, y, x)."""
    nz, ny, nx = shape
    vx, vy, vz = voxels
    table = ", ".join(
        f"({case}, {n}, {', '.join(str(float(c)) for p in t for c in p)})" for case, n, t in surface.case_triangles()
    )
    names = ", ".join(f"{a}{i}" for i in range(3) for a in "xyz")
    low = -1 if pad else 0
    scaled = ", ".join(f"(c{a} + {a}{i}) * CAST({v} AS DOUBLE) AS {a}{i}" for i in range(3) for a, v in zip("xyz", (vx, vy, vz)))
    return (
        f"cell AS (SELECT stack_id, z - d.dz AS cz, y - d.dy AS cy, x - d.dx AS cx, sum(1 << (4 * d.dz + 2 * d.dy + d.dx)) AS cell_case "
        f"FROM {mask}, (VALUES (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) AS d(dz, dy, dx) GROUP BY ALL), "
        f"ct(cell_case, tri, {names}) AS (VALUES {table}), "
        f"tri AS (SELECT stack_id, cz, cy, cx, tri, {scaled} FROM cell JOIN ct USING (cell_case) "
        f"WHERE cz >= {low} AND cy >= {low} AND cx >= {low} AND cz < {nz - 1 - low} AND cy < {ny - 1 - low} AND cx < {nx - 1 - low}), "
        "cr AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS c FROM tri), "
        "ms AS (SELECT stack_id, sum(sqrt(a * a + b * b + c * c)) / 2 AS s, abs(sum(x0 * a + y0 * b + z0 * c)) / 6 AS v FROM cr GROUP BY 1)"
    )


_MEASURE = (
    "SELECT stack_id, round(s, 6) AS mesh_surface_area_um2, round(v, 6) AS mesh_volume_um3, round(CASE WHEN v <= 0 THEN 0 ELSE (6 * v / pi()) ** (1.0 / 3) END, 6) AS mesh_equivalent_sphere_diameter_um, "
    "round(CASE WHEN v <= 0 OR s <= 0 THEN 0 ELSE least(1, pi() ** (1.0 / 3) * (6 * v) ** (2.0 / 3) / s) END, 6) AS mesh_sphericity FROM ms"
)
_PFG = f"{sql.px('profiles')}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {T['profiles']})"


def _profile_contours(boundary: bool) -> str:
    from catalog.frames import contours_sql

    return contours_sql("profiles", _PFG, boundary=boundary)


_BOX_MASK = (
    "SELECT b.stack_id, b.z, CAST(g.y AS INTEGER) AS y, CAST(h.x AS INTEGER) AS x FROM (SELECT stack_id, z, ymin, ymax, xmin, xmax FROM boxed{anti} WHERE rn = 1) b, "
    "LATERAL (SELECT unnest(range(b.ymin, least(b.ymax + 2, 24))) AS y) g, LATERAL (SELECT unnest(range(b.xmin, least(b.xmax + 2, 32))) AS x) h"
)
_CENT = "cen AS (SELECT stack_id, z, avg(x) AS cx, avg(y) AS cy FROM fg GROUP BY ALL)"

ORACLES = {
    "seed_bounds_checks": (
        "WITH s AS (SELECT l_returnflag || '-' || CAST(l_suppkey // 50 AS VARCHAR) AS stack_id, l_quantity + 5 AS x, l_discount * 150 - 1 AS y, l_linenumber AS z FROM lineitem) "
        "SELECT stack_id, CASE WHEN x < 0 OR x >= 50 THEN 'x image' WHEN y < 0 OR y >= 11 THEN 'y image' WHEN z < 0 OR z >= 7 THEN 'z image' "
        "WHEN x < 8 OR x >= 45 THEN 'x region' WHEN y < 1 OR y >= 10 THEN 'y region' WHEN z < 2 OR z >= 6 THEN 'z range' ELSE 'ok' END AS result, count(*) AS seeds FROM s GROUP BY 1, 2"
    ),
    "seed_region_pixels": (
        f"WITH {sql.stacks('lineitem')}, {_placed(True)} SELECT stack_id, seed_id, z, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM region GROUP BY ALL"
    ),
    "seed_component_choice": f"WITH RECURSIVE {_COMP}, {_choice()} SELECT stack_id, seed_id, z, label FROM start",
    "preview_seed_pixels": (
        f"WITH RECURSIVE {_COMP}, {_choice(far=True, nearest=False, disc=False)} SELECT s.stack_id, s.seed_id, s.z, "
        f"CAST(coalesce(t.label % {sql.BASE}, s.sx) AS INTEGER) AS seed_x, CAST(coalesce(t.label // {sql.BASE}, s.sy) AS INTEGER) AS seed_y FROM seeds s LEFT JOIN start t USING (stack_id, seed_id, z)"
    ),
    "slice_overlap": (
        f"WITH RECURSIVE {sql.px('lineitem')}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {LI_T}), {sql.labels()} "
        "SELECT a.stack_id, a.z, a.label, b.label AS next_label, count(*) AS shared FROM lab a JOIN lab b ON a.stack_id = b.stack_id AND b.z = a.z + 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL"
    ),
    "tracking_records": f"WITH RECURSIVE {_track(FAR, 'bright')} {_REC}",
    "tracking_records_short_reach": f"WITH RECURSIVE {_track('1.0 / 0.5', 'bright')} {_REC}",
    "tracking_summary": (
        f"WITH RECURSIVE {_track('3.0 / 0.5', 'bright')}, {_TSUM} SELECT stack_id, n AS track_frame_count, lost AS lost_frame_count, round(frac, 6) AS lost_fraction, "
        "array_to_string(edge, ',') AS boundary_frames, array_to_string(mrg, ',') AS merge_frames FROM ts"
    ),
    "tracking_warnings": (
        f"WITH RECURSIVE {_track('3.0 / 0.5', 'bright')}, {_TSUM} SELECT stack_id, CASE WHEN frac >= 0.25 THEN 'tracking_lost_many_frames' ELSE 'tracking_lost_some_frames' END AS code, "
        "CASE WHEN frac >= 0.25 THEN 'warning' ELSE 'info' END AS severity, 'Object tracking was lost on ' || lost || ' of ' || n || ' frames' || "
        "CASE WHEN frac >= 0.25 THEN ' (' || CAST(round_even(frac * 100, 0) AS INTEGER) || '%). Metrics may mix frames or omit slices.' ELSE '.' END AS message, NULL AS frame_indices, lost AS lost_frame_count FROM ts WHERE lost > 0 UNION ALL "
        "SELECT stack_id, 'roi_boundary_touch', 'warning', 'Selected component touches the ROI or crop boundary on ' || len(edge) || ' frame(s); area may be clipped.', array_to_string(edge, ','), NULL FROM ts WHERE len(edge) > 0 UNION ALL "
        "SELECT stack_id, 'likely_neighbor_merge', 'warning', 'Tracked component area grew sharply on ' || len(mrg) || ' frame(s); neighbors may have merged.', array_to_string(mrg, ','), NULL FROM ts WHERE len(mrg) > 0"
    ),
    "seeded_frame_rows": f"WITH RECURSIVE {_track(FAR, 'bright')}, {_seeded_rows(True)} {_SROW}",
    "seeded_frame_rows_direct": f"WITH RECURSIVE {_track(FAR, 'bright')}, {_seeded_rows(False)} {_SROW}",
    # seeds as numbers: the checking engine stumbles over grouping by constant strings that it keeps as dictionaries
    "crowded_seeds": (
        f"WITH RECURSIVE {_track(FAR)}, {_seeded_rows(True)}, mean AS MATERIALIZED (SELECT concat(stack_id, '') AS stack_id, seed_id, avg(raw_area) FILTER (WHERE ok) AS m FROM srw GROUP BY 1, 2) "
        "SELECT stack_id, count(*) AS seeds, round(min(m), 6) AS least_area, round(max(m), 6) AS most_area, coalesce(max(m) - min(m) > 1, false) AS \"distinct\", round(max(m) / greatest(min(m), 1e-9), 6) AS area_ratio FROM mean GROUP BY 1"
    ).replace("'bright'", "1").replace("'corner'", "2"),
    "surface_of_mask": f"WITH {_PFG}, {_triangles('fg')} {_MEASURE}",
    "surface_of_mask_closed": f"WITH {_PFG}, {_triangles('fg', True)} {_MEASURE}",
    "surface_triangles": f"WITH {_PFG}, {_triangles('fg')} {_MEASURE}",
    "mesh_of_outlines": (
        f"WITH RECURSIVE {_profile_contours(True)}, mk AS (SELECT DISTINCT f.stack_id, f.z, f.y, f.x FROM fill f SEMI JOIN pick USING (stack_id, z, label) UNION {_BOX_MASK.format(anti=' ANTI JOIN pick USING (stack_id, z)')}), "
        f"{_triangles('mk')} {_MEASURE}"
    ),
    "mesh_of_rectangles": f"WITH RECURSIVE {_profile_contours(False)}, mk AS ({_BOX_MASK.format(anti='')}), {_triangles('mk')} {_MEASURE}",
    "mesh_tables": (
        f"WITH {_PFG}, {_triangles('fg')}, pt AS (SELECT DISTINCT stack_id, x, y, z FROM (SELECT stack_id, round(x0, 6) AS x, round(y0, 6) AS y, round(z0, 6) AS z FROM tri UNION ALL "
        "SELECT stack_id, round(x1, 6), round(y1, 6), round(z1, 6) FROM tri UNION ALL SELECT stack_id, round(x2, 6), round(y2, 6), round(z2, 6) FROM tri)) "
        "SELECT p.stack_id, p.n AS vertices, p.n AS numbers, p.sum_x, p.sum_y, p.sum_z, t.faces FROM (SELECT stack_id, count(*) AS n, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y, round(sum(z), 4) AS sum_z FROM pt GROUP BY 1) p "
        "JOIN (SELECT stack_id, count(*) AS faces FROM tri GROUP BY 1) t USING (stack_id)"
    ),
    "mesh_decimation": (
        f"WITH {_PFG}, {_triangles('fg')} SELECT stack_id, CAST(ceil(count(*) / ceil(count(*) / 500)) AS BIGINT) AS faces FROM tri GROUP BY 1"
    ),
    "slice_centroids": f"WITH {_PFG}, {_CENT} SELECT stack_id, z, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cen",
    "slice_alignment": (
        f"WITH {_PFG}, {_CENT}, sh AS (SELECT c.stack_id, c.z, floor((round_even((c.cx - f.cx) * 1024, 0) + 16) / 32) / 32 AS sx, floor((round_even((c.cy - f.cy) * 1024, 0) + 16) / 32) / 32 AS sy "
        "FROM cen c JOIN (SELECT stack_id, arg_min(cx, z) AS cx, arg_min(cy, z) AS cy FROM cen GROUP BY 1) f USING (stack_id)), "
        "grid AS (SELECT s.*, a.y, b.x FROM sh s, range(0, 24) AS a(y), range(0, 32) AS b(x)), "
        "smp AS (SELECT g.stack_id, g.z, g.y, g.x, sum((1 - abs(p.x - (g.x + g.sx))) * (1 - abs(p.y - (g.y + g.sy)))) AS w FROM grid g JOIN fg p ON p.stack_id = g.stack_id AND p.z = g.z "
        "AND p.x BETWEEN floor(g.x + g.sx) AND floor(g.x + g.sx) + 1 AND p.y BETWEEN floor(g.y + g.sy) AND floor(g.y + g.sy) + 1 GROUP BY ALL) "
        "SELECT stack_id, z, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM smp WHERE w >= 0.5 GROUP BY 1, 2"
    ),
    "stack_downsampling": (
        f"WITH {_PFG}, o AS (SELECT st.stack_id, a.z, b.y, c.x, a.z * 4.0 AS fz, b.y * 23.0 / 11 AS fy, c.x * 31.0 / 15 AS fx FROM (SELECT DISTINCT stack_id FROM px) st, range(0, 2) AS a(z), range(0, 12) AS b(y), range(0, 16) AS c(x)), "
        "smp AS (SELECT o.stack_id, o.z, o.y, o.x, sum((1 - abs(p.x - fx)) * (1 - abs(p.y - fy)) * (1 - abs(p.z - fz))) AS w FROM o JOIN fg p ON p.stack_id = o.stack_id AND abs(p.x - fx) < 1 AND abs(p.y - fy) < 1 AND abs(p.z - fz) < 1 GROUP BY ALL) "
        "SELECT stack_id, CAST(z AS INTEGER) AS z, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, 2 AS nz, 12 AS ny, 16 AS nx, CAST(1 AS DOUBLE) AS vx_um FROM smp WHERE w > 0.5 + 1e-9 GROUP BY 1, 2"
    ),
}


def _late() -> None:
    from catalog.frames import contours_sql, rows_sql, SUM_SQL

    ORACLES["outlier_contours"] = (
        "WITH RECURSIVE " + contours_sql("lineitem", f"{sql.px('lineitem')}, fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= 5)")
        + ", md AS (SELECT stack_id, median(area_px2) AS m FROM con GROUP BY 1) SELECT stack_id, z, area_px2 FROM con JOIN md USING (stack_id) WHERE m <= 0 OR area_px2 >= m * 0.1"
    )
    ORACLES["method_comparison"] = (
        f"WITH RECURSIVE {rows_sql('profiles')}, a AS (SELECT stack_id, avg(area_um2) FILTER (WHERE has_contour) AS m FROM rw GROUP BY 1), "
        "bx AS (SELECT stack_id, avg((xmax - xmin + 1) * 0.5 * (ymax - ymin + 1) * 0.5) AS m FROM boxed WHERE rn = 1 GROUP BY 1) "
        "SELECT stack_id, round(a.m, 6) AS mean_area_um2_a, round(bx.m, 6) AS mean_area_um2_b, round((bx.m - a.m) / a.m * 100, 6) AS mean_area_um2_change, "
        "CAST(NULL AS DOUBLE) AS mesh_volume_um3_change, CAST(NULL AS DOUBLE) AS mesh_surface_area_um2_change, CAST(NULL AS DOUBLE) AS mesh_sphericity_change FROM a JOIN bx USING (stack_id)"
    )


_late()
