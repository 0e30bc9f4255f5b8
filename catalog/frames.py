"""Queries on frame metrics, run summaries, warnings, manifests, reports and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql
from catalog.objects import CANDIDATE_SQL
from voxelgrain.functions.geometry import FRAME_METRICS, SUMMARY_METRICS, contour_metrics, hull_area_of_points
from voxelgrain.operators import masks, report, summary
from voxelgrain.operators.summary import STATS, SWEEP_COLUMNS
from voxelgrain.operators.threshold import sweep_values
from voxelgrain.plans.analyze import Settings, analyze, best_threshold, sweep
from voxelgrain.plans.analyze import batch as analyze_batch
from voxelgrain.sources.table_stacks import ADAPTERS

T = {"profiles": 20.0, "lineitem": 3.0}
SWEEP = (20.0, 60.0, 20.0)


def _rounded(df, skip=()):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes]
    )


def run(spark, folder, table, *, excluded=None, **settings):
    s = ADAPTERS[table](spark, folder)
    out = None
    if excluded:
        out = s.stacks.where(excluded).select("stack_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("z"))
    options = Settings(T[table], only_positive=True, **settings)
    return s, analyze(s.stacks, s.pixels, options, excluded=out)


MESH = ("mesh_surface_area_um2", "mesh_volume_um3", "mesh_equivalent_sphere_diameter_um", "mesh_sphericity")
EXCLUDED = "stack_id >= 'users-3'"


def frame_metrics(table, **settings):
    def query(spark, folder):
        _, a = run(spark, folder, table, **settings)
        return _rounded(a.rows.drop(*MESH))

    return query


def frame_rows_excluded(spark, folder):
    _, a = run(spark, folder, "profiles", excluded=EXCLUDED)
    return _rounded(a.rows.drop(*MESH))


def frame_metrics_region(spark, folder):
    _, a = run(spark, folder, "profiles", rect=masks.Rect(4, 28, 2, 22), slices=masks.Slices(1, 4))
    return _rounded(a.rows.drop(*MESH))


def run_summary(spark, folder):
    _, a = run(spark, folder, "profiles", excluded=EXCLUDED)
    return _rounded(
        a.summary.select(
            "stack_id", "frame_count", "valid_frame_count", "valid_fraction", "warning_codes",
            *[f"{m}_{s}" for m in SUMMARY_METRICS for s in STATS],
        )
    )


def metric_summary(spark, folder):
    _, a = run(spark, folder, "lineitem")
    return _rounded(summary.metric_summary(a.summary, ["stack_id"]))


def metric_map(spark, folder):
    """The nested summary read back by metric name."""
    _, a = run(spark, folder, "lineitem")
    nested = summary.metric_map(summary.metric_summary(a.summary, ["stack_id"]), ["stack_id"])
    return _rounded(
        nested.select(
            "stack_id", F.expr("metrics['area_um2'].mean").alias("area_mean"), F.expr("metrics['solidity'].min").alias("solidity_min"),
            F.size(F.map_keys("metrics")).alias("metrics"),
        )
    )


def run_warnings(spark, folder):
    _, a = run(spark, folder, "profiles", excluded=EXCLUDED)
    w = a.summary.select("stack_id", F.posexplode("warnings").alias("place", "w"))
    return w.select(
        "stack_id", "place", "w.code", "w.severity", "w.message",
        F.array_join("w.frame_indices", ",").alias("frame_indices"), "w.invalid_frame_count", "w.frame_count",
    )


NUMBER = "cast(substring(stack_id, 7) as int)"


def batch(spark, folder):
    """Stacks without a spacing or without a threshold of their own fail alone; the others are analysed."""
    s = ADAPTERS["profiles"](spark, folder)
    stacks = s.stacks.withColumn("vz_um", F.expr(f"if({NUMBER} % 4 = 3, 0D, vz_um)"))
    limits = s.stacks.where(f"{NUMBER} % 4 <> 1").select("stack_id", F.lit(T["profiles"]).cast("double").alias("threshold"))
    return analyze_batch(stacks, s.pixels, Settings(limits, only_positive=True))


def batch_part(spark, folder):
    """Stacks too short for the slices or too narrow for the region fail alone."""
    s = ADAPTERS["profiles"](spark, folder)
    stacks = s.stacks.withColumns({"nz": F.expr(f"if({NUMBER} % 3 = 1, 2, nz)"), "nx": F.expr(f"if({NUMBER} % 5 = 2, 4, nx)")})
    settings = Settings(T["profiles"], rect=masks.Rect(4, 28, 2, 22), slices=masks.Slices(2, 5), only_positive=True)
    rows = analyze_batch(stacks, s.pixels, settings)
    return _rounded(rows.select("source_path", "status", "error_message", "frame_count", "valid_frame_count", "area_um2_mean"))


def frameless_warnings(spark, folder):
    """Every second stack has no frames."""
    s = ADAPTERS["profiles"](spark, folder)
    stacks = s.stacks.withColumn("nz", F.expr(f"if({NUMBER} % 2 = 1, 0, nz)"))
    a = analyze(stacks, s.pixels, Settings(T["profiles"], only_positive=True))
    return _rounded(a.summary.select("stack_id", "profile", "frame_count", "valid_frame_count", "valid_fraction", "warning_codes", "area_um2_mean"))


def batch_summary(spark, folder):
    return _rounded(batch(spark, folder).drop(*MESH))


def batch_totals(spark, folder):
    return summary.batch_totals(batch(spark, folder))


def manifest_fields(spark, folder):
    _, a = run(spark, folder, "profiles", excluded=EXCLUDED)
    m = report.manifests(a.summary, ["stack_id"])
    path = lambda p: F.get_json_object("manifest", p)
    return m.select(
        "stack_id", path("$.profile").alias("profile"), path("$.frame_count").cast("bigint").alias("frame_count"),
        path("$.summary.valid_frame_count").cast("bigint").alias("valid_frame_count"),
        path("$.excluded_frames").alias("excluded_frames"), path("$.warnings[0].code").alias("first_warning"),
        path("$.voxel_size.z_um").cast("double").alias("z_um"),
        F.round(path("$.summary.metrics.area_um2.mean").cast("double"), 6).alias("area_mean"),
        F.expr("size(json_object_keys(manifest))").alias("fields"),
    )


def report_tables(spark, folder):
    a = run(spark, folder, "profiles", excluded=EXCLUDED)[1].save()
    lines = report.report_lines(a.summary, a.rows, ["stack_id"], row_limit=3)
    return lines.where("section <> 7 and line <> ''").select("stack_id", "section", "line")


def first_frames(spark, folder):
    _, a = run(spark, folder, "lineitem")
    return _rounded(summary.first_rows(a.rows, ["stack_id"], 3).select("stack_id", "frame_index", "has_contour", "area_um2"))


def sweep_table(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    a = sweep(s.stacks, s.pixels, sweep_values(*SWEEP), Settings(0.0, only_positive=True))
    return a.summary


def sweep_rows(spark, folder):
    return _rounded(sweep_table(spark, folder).select("stack_id", *[c for c in SWEEP_COLUMNS if c not in MESH]))


def sweep_best(spark, folder):
    return _rounded(best_threshold(sweep_table(spark, folder)))


def _polygons(spark, folder):
    """Each vector as 32 corner points; a spread of shapes, most of them crossing themselves."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return rows.select(
        "vec_id",
        F.expr(
            "transform(sequence(0, 31), i -> struct(cast(embedding[2 * i] as double) * 10 as x, cast(embedding[2 * i + 1] as double) * 10 as y))"
        ).alias("points"),
        F.lit(0.5).alias("vx_um"), F.lit(2.0).alias("vy_um"),
    )


def polygon_metrics(spark, folder):
    return _rounded(contour_metrics(_polygons(spark, folder)).drop("points", "vx_um", "vy_um"))


def polygon_hulls(spark, folder):
    p = _polygons(spark, folder)
    return p.select("vec_id", F.round(hull_area_of_points("points"), 6).alias("hull_px2"))


QUERIES = {
    "frame_metrics": frame_metrics("profiles"),
    "frame_metrics_anisotropic": frame_metrics("lineitem"),
    "frame_metrics_rectangle": frame_metrics("profiles", contour="rectangle"),
    "frame_metrics_region": frame_metrics_region,
    "frame_rows_excluded": frame_rows_excluded,
    "run_summary": run_summary,
    "metric_summary_long": metric_summary,
    "metric_summary_nested": metric_map,
    "run_warnings": run_warnings,
    "batch_summary": batch_summary,
    "batch_totals": batch_totals,
    "batch_part": batch_part,
    "frameless_warnings": frameless_warnings,
    "manifest_fields": manifest_fields,
    "report_tables": report_tables,
    "first_frame_rows": first_frames,
    "threshold_sweep": sweep_rows,
    "threshold_sweep_best": sweep_best,
    "polygon_metrics": polygon_metrics,
    "polygon_hulls": polygon_hulls,
}


def metric_sql(vx: str, vy: str) -> str:
    """Frame metrics from area_px2, perimeter_px, steps, box_w, box_h (pixels) and hull_px2."""
    w, h = f"(box_w * {vx})", f"(box_h * {vy})"
    a, p = f"(area_px2 * {vx} * {vy})", f"(steps_h * {vx} + steps_v * {vy} + steps_d * sqrt({vx} * {vx} + {vy} * {vy}))"
    major, minor = f"greatest({w}, {h})", f"least({w}, {h})"
    return (
        f"CAST(area_px2 AS DOUBLE) AS area_px2, perimeter_px, {a} AS area_um2, {p} AS perimeter_um, "
        f"CASE WHEN {p} > 0 THEN 4 * pi() * {a} / {p} ** 2 ELSE 0 END AS circularity, {w} AS bbox_width_um, {h} AS bbox_height_um, "
        f"CASE WHEN {minor} > 0 THEN {major} / {minor} ELSE 0 END AS aspect_ratio, "
        f"CASE WHEN {minor} > 0 THEN 1 - {minor} / {major} ELSE 0 END AS elongation, "
        f"CASE WHEN {minor} > 0 THEN ({major} - {minor}) / ({major} + {minor}) ELSE 0 END AS deformation_index, "
        f"CASE WHEN {w} * {h} > 0 THEN {a} / ({w} * {h}) ELSE 0 END AS extent, "
        f"CASE WHEN {a} > 0 THEN sqrt(4 * {a} / pi()) ELSE 0 END AS equivalent_diameter_um, "
        f"CASE WHEN hull_px2 > 0 THEN area_px2 / hull_px2 ELSE 0 END AS solidity"
    )


HULL_EDGES = (
    # sides of the hull: every other point lies left of the side, or on it between its ends
    "hull AS (SELECT {k}, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS hull_px2 FROM {pts} p JOIN {pts} q ON {pq} AND (p.x, p.y) <> (q.x, q.y) "
    "WHERE NOT EXISTS (SELECT 1 FROM {pts} r WHERE {pr} AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR "
    "((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND NOT (r.x BETWEEN least(p.x, q.x) AND greatest(p.x, q.x) "
    "AND r.y BETWEEN least(p.y, q.y) AND greatest(p.y, q.y))))) GROUP BY {k})"
)


def contours_sql(table: str, fg: str, keys: str = "stack_id, z", boundary: bool = True, nx=None, ny=None) -> str:
    """CTEs from ``fg`` to ``con`` (keys, method, label, metrics)."""
    ks = [k.strip() for k in keys.split(",")]
    nz_, ny_, nx_ = sql.SHAPES[table]
    vx, vy = (f"CAST({v} AS DOUBLE)" for v in sql.VOXELS[table][:2])
    boxes = (
        f"{sql.labels(name='lab4', reach='reach4', connectivity=4, keys=keys)}, {sql.components('lab4', 'comp4', keys)}, "
        f"boxed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY area DESC, label) AS rn FROM comp4), "
        f"box AS (SELECT {keys}, 'fallback' AS method, label, (xmax - xmin + 1) * (ymax - ymin + 1) AS area_px2, "
        "2 * (xmax - xmin + 1) AS steps_h, 2 * (ymax - ymin + 1) AS steps_v, 0 AS steps_d, "
        "CAST(2 * (xmax - xmin + 1) + 2 * (ymax - ymin + 1) AS DOUBLE) AS perimeter_px, xmax - xmin + 1 AS box_w, ymax - ymin + 1 AS box_h, "
        "(xmax - xmin + 1) * (ymax - ymin + 1) AS hull_px2 FROM boxed WHERE rn = 1)"
    )
    if not boundary:
        return f"{fg}, {boxes}, con AS (SELECT {keys}, method, label, {metric_sql(vx, vy)} FROM box)"
    candidate = CANDIDATE_SQL.replace("< 49", f"< {nx_ - 1}").replace("< 10 ", f"< {ny_ - 1} ")
    same = " AND ".join(f"l.{k} = h.{k}" for k in ks)
    pts_keys = ", ".join(f"p.{k}" for k in ks)
    hull = HULL_EDGES.format(
        k=pts_keys, pts="pts", pq=" AND ".join(f"p.{k} = q.{k}" for k in ks), pr=" AND ".join(f"p.{k} = r.{k}" for k in ks)
    )
    return (
        f"{fg}, {sql.labels(keys=keys)}, {sql.components(keys=keys)}, {sql.holes(keys=keys)}, {sql.quads(keys)}, "
        f"inner_ AS (SELECT DISTINCT {', '.join('l.' + k for k in ks)}, l.label FROM lab l JOIN hole h ON {same} AND l.y = h.y AND l.x = h.x), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN {candidate} THEN 1 ELSE 0 END DESC, area_px2 DESC, label) AS rn "
        f"FROM (SELECT s.*, c.area, c.xmin, c.xmax, c.ymin, c.ymax FROM shape s JOIN comp c USING ({keys}, label) ANTI JOIN inner_ i USING ({keys}, label))), "
        f"pick AS (SELECT * FROM ranked WHERE rn = 1 AND NOT (ymin = ymax OR xmin = xmax OR (area = ymax - ymin + 1 AND area = xmax - xmin + 1))), "
        f"ext AS (SELECT {keys}, y, min(x) AS a, max(x) AS b FROM lab JOIN pick USING ({keys}, label) GROUP BY {keys}, y), "
        f"pts AS (SELECT {keys}, y, a AS x FROM ext UNION SELECT {keys}, y, b FROM ext), {hull}, {boxes}, "
        f"con AS (SELECT {keys}, 'opencv' AS method, label, {metric_sql(vx, vy)} FROM (SELECT *, xmax - xmin AS box_w, ymax - ymin AS box_h FROM pick JOIN hull USING ({keys})) "
        f"UNION ALL SELECT {keys}, method, label, {metric_sql(vx, vy)} FROM box ANTI JOIN pick USING ({keys}))"
    )


def rows_sql(table: str, t: float | None = None, *, boundary=True, where="true", zmin=0, zmax=None, excluded="false") -> str:
    """CTEs up to ``rw``: the frame table without its mesh columns."""
    t = T[table] if t is None else t
    metrics = ", ".join(f"coalesce({m}, 0) AS {m}" for m in FRAME_METRICS)
    return (
        f"{sql.frames(table, zmin, zmax)}, "
        + contours_sql(table, f"fg AS (SELECT stack_id, z, y, x FROM px WHERE v >= {t} AND {where})", boundary=boundary)
        + f", rw AS (SELECT f.stack_id, f.z AS frame_index, CAST({t} AS DOUBLE) AS threshold, 'vesicle' AS profile, coalesce(method, 'fallback') AS method, "
        f"{excluded} AS excluded, area_px2 IS NOT NULL AND NOT ({excluded}) AS has_contour, {metrics} "
        "FROM fr f LEFT JOIN con c ON c.stack_id = f.stack_id AND c.z = f.z)"
    )


ROUND_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in FRAME_METRICS)
ROW_COLUMNS = f"stack_id, frame_index, threshold, profile, method, excluded, has_contour, {ROUND_METRICS}"
OUT = "(f.stack_id >= 'users-3' AND f.z IN (1, 3))"
STAT_SQL = ", ".join(
    f"round({fn}({m}) FILTER (WHERE has_contour), 6) AS {m}_{s}"
    for m in SUMMARY_METRICS
    for s, fn in zip(STATS, ("avg", "min", "max", "stddev_pop"))
)
RAW_STAT_SQL = ", ".join(
    f"{fn}({m}) FILTER (WHERE has_contour) AS {m}_{s}"
    for m in SUMMARY_METRICS
    for s, fn in zip(STATS, ("avg", "min", "max", "stddev_pop"))
)
SUM_SQL = (
    "sm AS (SELECT stack_id, count(*) AS frame_count, count(*) FILTER (WHERE has_contour) AS valid_frame_count, "
    "count(*) FILTER (WHERE has_contour) / count(*) AS valid_fraction, "
    "coalesce(list_sort(list(frame_index) FILTER (WHERE excluded)), []) AS excluded_frames, any_value(profile) AS profile, "
    f"any_value(threshold) AS threshold, {STAT_SQL} FROM rw GROUP BY 1)"
)
CODES = (
    "concat_ws(';', CASE WHEN len(excluded_frames) > 0 THEN 'excluded_frames' END, CASE WHEN valid_frame_count = 0 THEN 'no_valid_contours' END, "
    "CASE WHEN valid_frame_count > 0 AND valid_frame_count < frame_count THEN 'partial_contours' END)"
)
STAT_NAMES = [f"{m}_{s}" for m in SUMMARY_METRICS for s in STATS]


def _long(select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT stack_id, '{m}' AS metric, {', '.join(f'{m}_{s} AS {s}' for s in STATS)} FROM sm WHERE {m}_mean IS NOT NULL" for m in SUMMARY_METRICS
    )


_EXCLUDED_SM = f"WITH RECURSIVE {rows_sql('profiles', excluded=OUT)}, {SUM_SQL}"
_SWEEP_FR = "(20.0), (40.0), (60.0)"
_SWEEP_CON = (
    f"{sql.frames('profiles')}, th AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {_SWEEP_FR}) AS v(t)), "
    + contours_sql(
        "profiles", "fg AS (SELECT stack_id, threshold, z, y, x FROM px, th WHERE v >= threshold)", keys="stack_id, threshold, z"
    )
    + ", rw AS (SELECT f.stack_id, th.threshold, f.z AS frame_index, 'vesicle' AS profile, false AS excluded, area_px2 IS NOT NULL AS has_contour, "
    + ", ".join(f"coalesce({m}, 0) AS {m}" for m in FRAME_METRICS)
    + " FROM fr f CROSS JOIN th LEFT JOIN con c ON c.stack_id = f.stack_id AND c.z = f.z AND c.threshold = th.threshold), "
    + SUM_SQL.replace("SELECT stack_id, count(*)", "SELECT stack_id, threshold, count(*)").replace(
        "any_value(threshold) AS threshold, ", ""
    ).replace("GROUP BY 1)", "GROUP BY 1, 2)")
)
_POLY = (
    "p0 AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) * 10 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 10 AS y FROM embeddings, range(0, 32) AS r(i)), "
    "e AS (SELECT a.vec_id, a.x, a.y, b.x AS x2, b.y AS y2 FROM p0 a JOIN p0 b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 32), "
    + HULL_EDGES.format(k="p.vec_id", pts="p0", pq="p.vec_id = q.vec_id", pr="p.vec_id = r.vec_id")
)
_NUM = lambda c: f"printf('%.6g', {c})"

ORACLES = {
    "frame_metrics": f"WITH RECURSIVE {rows_sql('profiles')} SELECT {ROW_COLUMNS} FROM rw",
    "frame_metrics_anisotropic": f"WITH RECURSIVE {rows_sql('lineitem')} SELECT {ROW_COLUMNS} FROM rw",
    "frame_metrics_rectangle": f"WITH RECURSIVE {rows_sql('profiles', boundary=False)} SELECT {ROW_COLUMNS} FROM rw",
    "frame_metrics_region": (
        f"WITH RECURSIVE {rows_sql('profiles', where='x >= 4 AND x < 28 AND y >= 2 AND y < 22 AND z >= 1 AND z < 4', zmin=1, zmax=4)} "
        f"SELECT {ROW_COLUMNS} FROM rw"
    ),
    "frame_rows_excluded": f"WITH RECURSIVE {rows_sql('profiles', excluded=OUT)} SELECT {ROW_COLUMNS} FROM rw",
    "run_summary": (
        f"{_EXCLUDED_SM} SELECT stack_id, frame_count, valid_frame_count, round(valid_fraction, 6) AS valid_fraction, {CODES} AS warning_codes, "
        f"{', '.join(STAT_NAMES)} FROM sm"
    ),
    "metric_summary_long": f"WITH RECURSIVE {rows_sql('lineitem')}, {SUM_SQL} {_long('')}",
    "metric_summary_nested": (
        f"WITH RECURSIVE {rows_sql('lineitem')}, {SUM_SQL} SELECT stack_id, area_um2_mean AS area_mean, solidity_min, "
        "CAST(11 AS INTEGER) AS metrics FROM sm WHERE valid_frame_count > 0"
    ),
    "run_warnings": (
        f"{_EXCLUDED_SM}, w AS (SELECT stack_id, 0 AS k, 'excluded_frames' AS code, 'info' AS severity, "
        "len(excluded_frames) || ' frame(s) excluded from metrics summary and 3D mesh.' AS message, array_to_string(excluded_frames, ',') AS frame_indices, "
        "NULL::BIGINT AS invalid_frame_count, NULL::BIGINT AS frame_count FROM sm WHERE len(excluded_frames) > 0 UNION ALL "
        "SELECT stack_id, 1, 'no_valid_contours', 'error', 'No frames produced a valid contour. Check threshold, ROI, and image contrast.', NULL, NULL, NULL "
        "FROM sm WHERE valid_frame_count = 0 UNION ALL "
        "SELECT stack_id, 2, 'partial_contours', 'warning', (frame_count - valid_frame_count) || ' of ' || frame_count || ' frames did not produce a valid contour.', "
        "NULL, frame_count - valid_frame_count, frame_count FROM sm WHERE valid_frame_count > 0 AND valid_frame_count < frame_count) "
        "SELECT stack_id, CAST(row_number() OVER (PARTITION BY stack_id ORDER BY k) - 1 AS INTEGER) AS place, code, severity, message, frame_indices, "
        "invalid_frame_count, frame_count FROM w"
    ),
    "batch_summary": (
        f"WITH RECURSIVE {rows_sql('profiles')}, {SUM_SQL} SELECT 'table://' || stack_id AS source_path, '' AS source_sha256, "
        "CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE k WHEN 3 THEN 'voxel spacing must be greater than zero' WHEN 1 THEN 'threshold table must name every stack once' ELSE '' END AS error_message, "
        "CASE WHEN NOT bad THEN profile END AS profile, CASE WHEN NOT bad THEN threshold END AS threshold, CASE WHEN NOT bad THEN 'override' END AS voxel_source, "
        "CASE WHEN NOT bad THEN frame_count END AS frame_count, CASE WHEN NOT bad THEN valid_frame_count END AS valid_frame_count, "
        f"CASE WHEN NOT bad THEN round(valid_fraction, 6) END AS valid_fraction, CASE WHEN NOT bad THEN {CODES} END AS warning_codes, "
        f"{', '.join(f'CASE WHEN NOT bad THEN {c} END AS {c}' for c in STAT_NAMES)} "
        "FROM (SELECT *, CAST(substr(stack_id, 7) AS INTEGER) % 4 AS k, k % 2 = 1 AS bad FROM sm)"
    ),
    "batch_totals": (
        "SELECT count(*) AS found, count(*) FILTER (WHERE k % 2 = 0) AS succeeded, count(*) FILTER (WHERE k % 2 = 1) AS failed "
        "FROM (SELECT DISTINCT user_id // 32 AS k FROM events)"
    ),
    "batch_part": (
        f"WITH RECURSIVE {rows_sql('profiles', where='x >= 4 AND x < 28 AND y >= 2 AND y < 22 AND z >= 2 AND z < 5', zmin=2, zmax=5)}, {SUM_SQL}, "
        "j AS (SELECT *, CAST(substr(stack_id, 7) AS INTEGER) AS k, CASE WHEN k % 3 = 1 THEN 'Z range bounds must define at least one frame' "
        "WHEN k % 5 = 2 THEN 'ROI bounds must define a non-empty rectangle' ELSE '' END AS error_message FROM sm) "
        "SELECT 'table://' || stack_id AS source_path, CASE WHEN error_message = '' THEN 'ok' ELSE 'error' END AS status, error_message, "
        "CASE WHEN error_message = '' THEN frame_count END AS frame_count, CASE WHEN error_message = '' THEN valid_frame_count END AS valid_frame_count, "
        "CASE WHEN error_message = '' THEN area_um2_mean END AS area_um2_mean FROM j"
    ),
    "frameless_warnings": (
        f"WITH RECURSIVE {rows_sql('profiles')}, {SUM_SQL}, j AS (SELECT *, CAST(substr(stack_id, 7) AS INTEGER) % 2 = 0 AS has FROM sm) "
        "SELECT stack_id, 'vesicle' AS profile, CASE WHEN has THEN frame_count ELSE 0 END AS frame_count, CASE WHEN has THEN valid_frame_count ELSE 0 END AS valid_frame_count, "
        f"CASE WHEN has THEN round(valid_fraction, 6) ELSE 0 END AS valid_fraction, CASE WHEN has THEN {CODES} ELSE 'no_frames' END AS warning_codes, "
        "CASE WHEN has THEN area_um2_mean END AS area_um2_mean FROM j"
    ),
    "manifest_fields": (
        f"{_EXCLUDED_SM} SELECT stack_id, profile, frame_count, valid_frame_count, '[' || array_to_string(excluded_frames, ',') || ']' AS excluded_frames, "
        f"nullif(split_part({CODES}, ';', 1), '') AS first_warning, CAST(1.5 AS DOUBLE) AS z_um, area_um2_mean AS area_mean, CAST(22 AS INTEGER) AS fields FROM sm"
    ),
    "first_frame_rows": (
        f"WITH RECURSIVE {rows_sql('lineitem')} SELECT stack_id, frame_index, has_contour, round(area_um2, 6) AS area_um2 FROM rw WHERE frame_index < 3"
    ),
    "report_tables": (
        f"{_EXCLUDED_SM.replace(STAT_SQL, RAW_STAT_SQL)}, lg AS ({_long('')}), tx AS ("
        "SELECT stack_id, 0 AS section, unnest(['# Analysis Report', '## Run Settings', '- Source: `table://' || stack_id || '`', '- Profile: `' || profile || '`', "
        "'- Threshold: `20.0`', '- ROI: `full stack`', '- Z range: `full stack`', '- Include mesh: `false`', '- Voxel source: `override`', "
        "'- Voxel size: x=0.5 um, y=0.5 um, z=1.5 um']) AS line FROM sm UNION ALL "
        "SELECT stack_id, 3, unnest(['## Frame Summary', '- Frames: ' || frame_count, '- Valid frames: ' || valid_frame_count, "
        f"'- Valid fraction: ' || {_NUM('valid_fraction')}, '- Excluded frames: ' || CASE WHEN len(excluded_frames) > 0 THEN '[' || array_to_string(excluded_frames, ', ') || ']' ELSE 'none' END]) FROM sm UNION ALL "
        "SELECT stack_id, 4, unnest(['## Warnings', '- `excluded_frames` (info): ' || len(excluded_frames) || ' frame(s) excluded from metrics summary and 3D mesh.', "
        "'- `partial_contours` (warning): ' || (frame_count - valid_frame_count) || ' of ' || frame_count || ' frames did not produce a valid contour.']) FROM sm WHERE len(excluded_frames) > 0 UNION ALL "
        "SELECT stack_id, 5, unnest(['## Metric Summary', '| Metric | Mean | Min | Max | Std |', '| --- | ---: | ---: | ---: | ---: |']) FROM sm UNION ALL "
        f"SELECT stack_id, 6, '| ' || metric || ' | ' || {_NUM('mean')} || ' | ' || {_NUM('min')} || ' | ' || {_NUM('max')} || ' | ' || {_NUM('std')} || ' |' FROM lg UNION ALL "
        "SELECT stack_id, 8, unnest(['## First 3 Frame Rows', '| Frame | Contour | Area (um^2) | Perimeter (um) | Circularity | Deformation index |', '| ---: | :---: | ---: | ---: | ---: | ---: |']) FROM sm UNION ALL "
        f"SELECT stack_id, 9, '| ' || frame_index || ' | ' || CASE WHEN has_contour THEN 'yes' ELSE 'no' END || ' | ' || {_NUM('area_um2')} || ' | ' || {_NUM('perimeter_um')} || ' | ' || "
        f"{_NUM('circularity')} || ' | ' || {_NUM('deformation_index')} || ' |' FROM rw WHERE frame_index < 3) SELECT stack_id, CAST(section AS INTEGER) AS section, line FROM tx"
    ),
    "threshold_sweep": (
        f"WITH RECURSIVE {_SWEEP_CON} SELECT stack_id, threshold, profile, frame_count, valid_frame_count, round(valid_fraction, 6) AS valid_fraction, "
        f"{CODES} AS warning_codes, {', '.join(STAT_NAMES)} FROM sm"
    ),
    "threshold_sweep_best": (
        f"WITH RECURSIVE {_SWEEP_CON}, b AS (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY valid_fraction DESC, abs(threshold), threshold) AS rn FROM sm) "
        "SELECT stack_id, threshold, valid_frame_count, round(valid_fraction, 6) AS valid_fraction FROM b WHERE rn = 1"
    ),
    "polygon_metrics": (
        f"WITH {_POLY}, m AS (SELECT vec_id, abs(sum(x * y2 - y * x2)) / 2 AS a, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS p, "
        "sum(sqrt(((x2 - x) * 0.5) ** 2 + ((y2 - y) * 2.0) ** 2)) AS q, (max(x) - min(x)) * 0.5 AS w, (max(y) - min(y)) * 2.0 AS h FROM e GROUP BY 1) "
        "SELECT vec_id, round(a, 6) AS area_px2, round(p, 6) AS perimeter_px, round(a, 6) AS area_um2, round(q, 6) AS perimeter_um, "
        "round(4 * pi() * a / q ** 2, 6) AS circularity, round(w, 6) AS bbox_width_um, round(h, 6) AS bbox_height_um, "
        "round(greatest(w, h) / least(w, h), 6) AS aspect_ratio, round(1 - least(w, h) / greatest(w, h), 6) AS elongation, "
        "round((greatest(w, h) - least(w, h)) / (w + h), 6) AS deformation_index, round(a / (w * h), 6) AS extent, "
        "round(sqrt(4 * a / pi()), 6) AS equivalent_diameter_um, round(a / hull_px2, 6) AS solidity FROM m JOIN hull USING (vec_id)"
    ),
    "polygon_hulls": f"WITH {_POLY} SELECT vec_id, round(hull_px2, 6) AS hull_px2 FROM hull",
}
