"""Queries on results that carry surface measures: frame rows, comparisons, sweeps; and stacks without a spacing of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import CODES, EXCLUDED, MESH, OUT, ROW_COLUMNS, SUM_SQL, T, _rounded, rows_sql, run
from catalog.tracks import _BOX_MASK, _MEASURE, _PFG, _profile_contours, _triangles
from voxelgrain.functions import calibration
from voxelgrain.operators import crowding
from voxelgrain.plans.analyze import Settings, analyze, sweep
from voxelgrain.sources.table_stacks import ADAPTERS

LIMITS = (T["profiles"], 35.0)


def mesh_rows(spark, folder):
    """Frame rows with the surface of their stack; excluded frames are no part of it."""
    _, a = run(spark, folder, "profiles", excluded=EXCLUDED, include_mesh=True)
    return _rounded(a.rows)


def mesh_sweep(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    a = sweep(s.stacks, s.pixels, LIMITS, Settings(0.0, only_positive=True, include_mesh=True))
    return _rounded(a.summary.select("stack_id", "threshold", "valid_frame_count", "warning_codes", *MESH))


def mesh_comparison(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    snap, objects = {}, None
    for contour in ("boundary", "rectangle"):
        a = analyze(s.stacks, s.pixels, Settings(T["profiles"], only_positive=True, contour=contour, include_mesh=True), objects=objects)
        objects = a.objects
        snap[contour] = crowding.snapshot(a.summary, ["stack_id"])
    compared = crowding.compare_methods(snap["boundary"], snap["rectangle"], ["stack_id"])
    return compared.select("stack_id", *[F.round(c, 6).alias(c) for c in compared.columns if c.startswith("mesh_")])


def default_spacing(spark, folder):
    """Stacks whose files name no spacing: one micrometre, and a warning."""
    s = ADAPTERS["profiles"](spark, folder)
    axes = ("vx_um", "vy_um", "vz_um")
    unknown = s.stacks.select("stack_id", *[F.lit(None).cast("double").alias(c) for c in axes])
    stacks = s.stacks.drop("voxel_source", *axes).join(calibration.voxel_precedence(unknown), "stack_id")
    a = analyze(stacks, s.pixels, Settings(T["profiles"], only_positive=True))
    return _rounded(a.rows.select("stack_id", "frame_index", "area_px2", "area_um2").join(a.summary.select("stack_id", "warning_codes"), "stack_id"))


QUERIES = {
    "mesh_frame_rows": mesh_rows, "mesh_sweep": mesh_sweep, "method_comparison_mesh": mesh_comparison, "default_spacing_rows": default_spacing,
}


def _outline_mesh(kept: str = "true", limit: float = LIMITS[0], measure: str = _MEASURE) -> str:
    """The surface of the chosen outlines, of the slices that are ``kept``."""
    boxes = _BOX_MASK.format(anti=" ANTI JOIN pick USING (stack_id, z)")
    text = (
        f"WITH RECURSIVE {_profile_contours(True)}, al AS (SELECT DISTINCT f.stack_id, f.z, f.y, f.x FROM fill f SEMI JOIN pick USING (stack_id, z, label) UNION {boxes}), "
        f"mk AS (SELECT * FROM al f WHERE {kept}), {_triangles('mk')} {measure}"
    )
    return text.replace(_PFG, _PFG.replace(f"v >= {T['profiles']}", f"v >= {limit}"))


# changes are computed from measures that are not rounded yet
_EXACT = _MEASURE.replace("round(", "(").replace(", 6)", ")")
_MESH_OR_ZERO = ", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in MESH)
_CHANGE = ", ".join(
    f"round(CASE WHEN a.{c} <> 0 THEN (b.{c} - a.{c}) / a.{c} * 100 END, 6) AS {c}_change" for c in ("mesh_volume_um3", "mesh_surface_area_um2", "mesh_sphericity")
)


def _swept(limit: float) -> str:
    flat = "CASE WHEN m.stack_id IS NOT NULL AND (coalesce(m.mesh_surface_area_um2, 0) <= 0 OR coalesce(m.mesh_volume_um3, 0) <= 0) THEN 'zero_mesh_measurement' END"
    return (
        f"SELECT s.stack_id, CAST({limit} AS DOUBLE) AS threshold, s.valid_frame_count, concat_ws(';', nullif(s.codes, ''), {flat}) AS warning_codes, {_MESH_OR_ZERO} "
        f"FROM (WITH RECURSIVE {rows_sql('profiles', limit)}, {SUM_SQL} SELECT stack_id, valid_frame_count, {CODES} AS codes FROM sm) s LEFT JOIN ({_outline_mesh(limit=limit)}) m USING (stack_id)"
    )


_SHIFT = "floor((round_even((c.{0} - f.{0}) * 1024, 0) + 16) / 32) / 32"
_DISPLAYED = (
    f"{_profile_contours(True)}, md AS (SELECT stack_id, median(area_px2) AS m FROM con GROUP BY 1), "
    "keep AS (SELECT stack_id, z FROM con JOIN md USING (stack_id) WHERE m <= 0 OR area_px2 >= m * 0.1), "
    f"al AS (SELECT DISTINCT f.stack_id, f.z, f.y, f.x FROM fill f SEMI JOIN pick USING (stack_id, z, label) UNION {_BOX_MASK.format(anti=' ANTI JOIN pick USING (stack_id, z)')}), "
    "mk0 AS (SELECT a.* FROM al a SEMI JOIN keep USING (stack_id, z)), cen AS (SELECT stack_id, z, avg(x) AS cx, avg(y) AS cy FROM mk0 GROUP BY ALL), "
    f"sh AS (SELECT c.stack_id, c.z, {_SHIFT.format('cx')} AS sx, {_SHIFT.format('cy')} AS sy FROM cen c JOIN (SELECT stack_id, arg_min(cx, z) AS cx, arg_min(cy, z) AS cy FROM cen GROUP BY 1) f USING (stack_id)), "
    "dg AS (SELECT s.*, a.y, b.x FROM sh s, range(0, 24) AS a(y), range(0, 32) AS b(x)), "
    "al2 AS (SELECT g.stack_id, g.z, g.y, g.x, sum((1 - abs(p.x - (g.x + g.sx))) * (1 - abs(p.y - (g.y + g.sy)))) AS w FROM dg g JOIN mk0 p ON p.stack_id = g.stack_id AND p.z = g.z "
    "AND p.x BETWEEN floor(g.x + g.sx) AND floor(g.x + g.sx) + 1 AND p.y BETWEEN floor(g.y + g.sy) AND floor(g.y + g.sy) + 1 GROUP BY ALL), "
    "o AS (SELECT t.stack_id, a.z, b.y, c.x, a.z * 4.0 AS fz, b.y * 23.0 / 11 AS fy, c.x * 31.0 / 15 AS fx FROM (SELECT DISTINCT stack_id FROM px) t, range(0, 2) AS a(z), range(0, 12) AS b(y), range(0, 16) AS c(x)), "
    "dn2 AS (SELECT o.stack_id, o.z, o.y, o.x, sum((1 - abs(p.x - fx)) * (1 - abs(p.y - fy)) * (1 - abs(p.z - fz))) AS w FROM o JOIN al2 p ON p.w >= 0.5 AND p.stack_id = o.stack_id "
    "AND abs(p.x - fx) < 1 AND abs(p.y - fy) < 1 AND abs(p.z - fz) < 1 GROUP BY ALL), mk AS (SELECT stack_id, z, y, x FROM dn2 WHERE w > 0.5 + 1e-9), "
    f"{_triangles('mk', shape=(2, 12, 16), voxels=(1.0, 1.0, 3.0))}, fc AS (SELECT stack_id, count(*) AS n FROM tri GROUP BY 1)"
)

ORACLES = {
    "displayed_mesh": f"WITH RECURSIVE {_DISPLAYED} SELECT m.*, CAST(ceil(n / ceil(n / 100)) AS BIGINT) AS faces FROM ({_MEASURE}) m JOIN fc USING (stack_id)",
    "mesh_frame_rows": (
        f"SELECT r.*, {_MESH_OR_ZERO} FROM (WITH RECURSIVE {rows_sql('profiles', excluded=OUT)} SELECT {ROW_COLUMNS} FROM rw) r "
        f"LEFT JOIN ({_outline_mesh(f'NOT {OUT}')}) m USING (stack_id)"
    ),
    "mesh_sweep": " UNION ALL ".join(_swept(t) for t in LIMITS),
    "method_comparison_mesh": (
        f"SELECT a.stack_id, {_CHANGE} FROM ({_outline_mesh(measure=_EXACT)}) a JOIN (WITH RECURSIVE {_profile_contours(False)}, mk AS ({_BOX_MASK.format(anti='')}), {_triangles('mk')} {_EXACT}) b USING (stack_id)"
    ),
    "default_spacing_rows": (
        f"WITH RECURSIVE {rows_sql('profiles')}, {SUM_SQL} SELECT r.stack_id, r.frame_index, round(r.area_px2, 6) AS area_px2, round(r.area_px2, 6) AS area_um2, "
        f"concat_ws(';', nullif(s.codes, ''), 'default_voxel_size') AS warning_codes FROM rw r JOIN (SELECT stack_id, {CODES} AS codes FROM sm) s USING (stack_id)"
    ),
}
