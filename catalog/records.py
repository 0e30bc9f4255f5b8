"""Queries on metadata, settings, comparisons, manifests, distance maps, splits and edge probes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import sql
from catalog.frames import T
from catalog.tracks import bright_seeds
from voxelgrain.functions import calibration, text
from voxelgrain.functions.intensity import gray_to_color, luminance
from voxelgrain.operators import compare, crowding, display_mesh, edges, masks, runs, split, tracking
from voxelgrain.plans.analyze import Settings, analyze, analyze_seeded, split_analysis, stack_mask
from voxelgrain.session import materialize
from voxelgrain.sources import files, manifests, settings
from voxelgrain.sources.table_stacks import ADAPTERS, unpack_frames


SCALES = tuple(f"1e{k}" for k in range(-7, 7))


def _read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tiff_metadata(spark, folder):
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("stack_id"),
        F.expr("p_partkey % 5 * 1000").alias("x_num"), F.expr("p_size * 100L").alias("x_den"),
        F.expr("p_partkey % 7 + 1").alias("y_num"), F.expr("p_partkey % 3").alias("y_den"),
        F.expr(
            "case p_partkey % 4 when 0 then concat('images=9 spacing = ', p_size, '.25 unit=um') when 1 then 'spacing=e' "
            "when 2 then 'spacing=0' else 'plain' end"
        ).alias("description"),
    )


def tiff_calibration(spark, folder):
    return _rounded(calibration.tiff_voxels(tiff_metadata(spark, folder)).select("stack_id", "vx_um", "vy_um", "vz_um"))


def xml_calibration(spark, folder):
    rows = _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("stack_id"),
        F.expr(
            """case c_custkey % 6
            when 0 then concat('<M><Distance Id="X"><Value>', c_nationkey + 1, 'e-7</Value></Distance><Distance Id="Z"><Value>5e-7</Value></Distance></M>')
            when 1 then '<c:M xmlns:c="u"><c:Distance Id="Y"><c:Value> 2.5e-7 </c:Value></c:Distance></c:M>'
            when 2 then '<M><ScalingX>1.5e-7</ScalingX><ScalingY>-1</ScalingY></M>'
            when 3 then '<distance Id="X"><Value>3e-7</Value>'
            when 4 then 'ScalingX = 0.25, ScalingZ = 1.5'
            else 'nothing here' end"""
        ).alias("xml"),
    )
    return _rounded(calibration.xml_voxels(rows).select("stack_id", "vx_um", "vy_um", "vz_um"))


def voxel_sources(spark, folder):
    detected = calibration.tiff_voxels(tiff_metadata(spark, folder)).select(
        "stack_id", *[F.expr(f"if(stack_id % 10 = 9, null, {a})").alias(a) for a in ("vx_um", "vy_um", "vz_um")]
    )
    overrides = _read(spark, folder, "part").where("p_partkey % 8 = 3").select(
        F.col("p_partkey").alias("stack_id"), F.lit(0.5).alias("vx_um"), F.lit(0.5).alias("vy_um"), F.lit(2.0).alias("vz_um")
    )
    return _rounded(calibration.voxel_precedence(detected, overrides))


def inspected_shapes(spark, folder):
    raw = _read(spark, folder, "part").select(
        F.col("p_partkey").alias("stack_id"),
        F.expr(
            "case p_partkey % 7 when 0 then array(p_size + 9, 64) when 1 then array(1, p_size + 9, 64, 1) when 2 then array(p_size + 9, 64, 3) "
            "when 3 then array(p_size + 9, 64, 32) when 4 then array(5, p_size + 9, 64, 4) when 5 then array(5, 3, p_size + 9, 64) else array(1, 1, 7, p_size + 9, 64) end"
        ).alias("shape"),
    )
    return files.inspect_stacks(raw).select(
        "stack_id", *[F.array_join(c, "x").alias(c) for c in ("grayscale_shape", "color_shape")]
    )


def _channels(spark, folder):
    return _read(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select(
        F.concat(F.lit("rgb-"), F.expr("cast(vec_id div 20 as string)")).alias("stack_id"),
        F.expr("cast(vec_id % 20 as int)").alias("z"), F.expr("cast(i div 16 as int)").alias("y"), F.expr("cast(i div 4 % 4 as int)").alias("x"),
        F.expr("i % 4").alias("c"), F.expr("cast(floor(abs(cast(e as double)) * 400) as int)").alias("v"),
    )


def luminance_pixels(spark, folder):
    return luminance(_channels(spark, folder))


def color_channels(spark, folder):
    gray = luminance(_channels(spark, folder))
    return gray_to_color(gray).groupBy("stack_id", "c").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


def content_hashes(spark, folder):
    return _read(spark, folder, "documents").select("doc_id", files.content_hash("text").alias("sha256"))


def _paths(spark, folder):
    return _read(spark, folder, "pages").select(
        "page_id",
        F.expr(
            "concat('set ', page_id % 5, '/Run#', page_id, elt(cast(page_id % 6 + 1 as int), '.tif', '.TIFF', '.Lsm', '.czi', '.png', '.tif.txt'))"
        ).alias("path"),
    )


def stack_paths(spark, folder):
    return _paths(spark, folder).select("page_id", F.expr(files.is_stack_path("path")).alias("is_stack"))


def output_folders(spark, folder):
    return _paths(spark, folder).select(
        "page_id", F.expr(text.safe_stem("path")).alias("stem"), F.expr(text.bundle_folder("path")).alias("folder")
    )


def short_numbers(spark, folder):
    return _read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        "l_extendedprice", "l_discount", F.element_at(F.array(*[F.lit(float(p)) for p in SCALES]), F.expr("cast(l_quantity as int) % 14 + 1")).alias("scale"),
    ).select("l_orderkey", "l_linenumber", F.expr("l_extendedprice * l_discount / 3 * scale").alias("value")).transform(
        lambda df: text.short_numbers(df, ["value"], prefix="shown_")
    ).select("l_orderkey", "l_linenumber", F.col("shown_value").alias("shown"))


def _settings_texts(spark, folder):
    return _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("owner"),
        F.expr(
            """concat('{"version": ', if(c_custkey % 11 = 0, 2, 1), ', "profile": "', elt(cast(c_custkey % 4 + 1 as int), 'vesicle', 'RBC', 'active-surfaces', 'odd'), '"',
            if(c_custkey % 3 = 0, concat(', "threshold": ', c_nationkey, '.5'), ''),
            if(c_custkey % 5 = 0, ', "z_range": {"zmin": 4, "zmax": 2}', ', "z_range": {"zmin": 1, "zmax": 5}'), ', "include_mesh": true}')"""
        ).alias("value"),
    )


def settings_checks(spark, folder):
    parsed = settings.parse_settings(_settings_texts(spark, folder))
    return parsed.select("owner", F.coalesce(settings.settings_error(), F.lit("ok")).alias("result"))


def settings_precedence(spark, folder):
    project = settings.parse_settings(_settings_texts(spark, folder))
    good = project.where(settings.settings_error().isNull())
    command = _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("owner"), F.expr("if(c_custkey % 2 = 0, 99.5D, null)").alias("threshold"),
        F.lit(None).cast("string").alias("profile"),
        *[F.expr(f"if(c_custkey % 7 = 0, {v}, null)").alias(n) for n, v in (("vx_um", "0.5D"), ("vy_um", "0.25D"), ("vz_um", "1D"))],
    )
    r = settings.resolve_settings(command, good, "owner")
    return r.select("owner", "profile", "threshold", F.col("voxel_size.y_um").alias("y_um"), F.col("z_range.zmax").alias("zmax"), "include_mesh", "prefer_opencv")


def settings_written(spark, folder):
    """Settings written as text and read back."""
    project = settings.parse_settings(_settings_texts(spark, folder))
    good = project.where(settings.settings_error().isNull())
    back = settings.parse_settings(good.select("owner", settings.settings_text(good).alias("value")))
    return back.select("owner", "version", "profile", "threshold", F.col("z_range.zmin").alias("zmin"), "include_mesh")


def _sides(spark, folder):
    """All orders as two metric tables; each side lacks some rows and some cells differ."""
    orders = _read(spark, folder, "orders")
    price = "cast(cast(o_totalprice as decimal(14, 2)) as string)"
    expected = orders.where("o_orderkey % 97 <> 1").select(
        F.col("o_orderkey").cast("string").alias("frame_index"), F.expr(price).alias("price"), F.col("o_custkey").cast("string").alias("cust"),
        F.col("o_orderstatus").alias("status"), F.lit("x").alias("only_expected"), F.monotonically_increasing_id().alias("_line"),
    )
    actual = orders.where("o_orderkey % 89 <> 2").select(
        F.col("o_orderkey").cast("string").alias("frame_index"),
        F.expr(f"if(o_orderkey % 10 = 3, cast(cast(o_totalprice as decimal(14, 2)) + 0.5 as string), {price})").alias("price"),
        F.expr("if(o_orderkey % 13 = 0, concat(o_custkey, '.0'), cast(o_custkey as string))").alias("cust"),
        F.expr("if(o_orderkey % 31 = 5, 'Z', o_orderstatus)").alias("status"), F.monotonically_increasing_id().alias("_line"),
    )
    return expected, actual


def compare_numeric(spark, folder):
    found, _ = compare.compare_tables(*_sides(spark, folder), tolerance=0.01)
    return _rounded(found)


def compare_all(spark, folder):
    found, _ = compare.compare_tables(*_sides(spark, folder), tolerance=1.0, all_columns=True)
    return _rounded(found)


def compare_named(spark, folder):
    found, _ = compare.compare_tables(*_sides(spark, folder), tolerance=0.01, columns=["cust", "only_expected"])
    return found.groupBy("column", "expected", "actual").agg(F.count("*").alias("cells")).where("column <> '__row__'")


def compare_report(spark, folder):
    _, report = compare.compare_tables(*_sides(spark, folder), tolerance=0.01)
    return report


def compare_first(spark, folder):
    found, _ = compare.compare_tables(*_sides(spark, folder), tolerance=0.01)
    return compare.first_differences(found.where("column <> '__row__'")).select("row_id", "column", "expected", "actual")


def _manifest_texts(spark, folder):
    return _read(spark, folder, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("path"),
        F.expr(
            """if(o_orderkey % 17 = 0, '{"profile": "vesicle", "frame_count": ',
            concat('{"profile": "vesicle", "threshold": 4.5, "frame_count": ', o_custkey % 9 + 1, ', "valid_frame_count": ', o_custkey % 9 + o_orderkey % 2,
            ', "mesh": null, "warnings": [', if(o_orderkey % 3 = 0, '{"code": "partial_contours"}, {"code": "default_voxel_size"}', ''), ']}'))"""
        ).alias("value"),
    )


def manifest_index(spark, folder):
    return manifests.index_manifests(_manifest_texts(spark, folder)).drop("mesh_volume_um3")


def manifest_roll_up(spark, folder):
    index = manifests.index_manifests(_manifest_texts(spark, folder))
    checks = _read(spark, folder, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") < 9).alias("passed"))
    return manifests.roll_up(checks, index)


def _profile_runs(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    mask = runs.pixel_runs(s.pixels.where(F.col("v") >= T["profiles"]), ["stack_id"])
    return s, runs.label_runs(mask, ["stack_id"], arranged=True)


def distances(spark, folder):
    s, found = _profile_runs(spark, folder)
    d = split.distance_map(found, masks.stack_frames(s.stacks), ["stack_id"])
    return d.select("stack_id", "z", "y", "x", "d2")


def seed_markers(spark, folder):
    s, found = _profile_runs(spark, folder)
    frames = masks.stack_frames(s.stacks)
    placed = tracking.place_seeds(bright_seeds(s), frames)
    d = split.distance_map(found, frames, ["stack_id"])
    return split.markers(d, placed, frames).select("stack_id", "z", "y", "x", "d2", "mine")


def split_pixels(spark, folder):
    s, found = _profile_runs(spark, folder)
    frames = masks.stack_frames(s.stacks)
    return split.split_mask(found, frames, tracking.place_seeds(bright_seeds(s), frames)).groupBy("stack_id", "z").agg(
        F.count("*").alias("pixels"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("x").alias("xmin"), F.max("x").alias("xmax")
    )


def split_rows(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    a = split_analysis(s.stacks, s.pixels, bright_seeds(s), Settings(T["profiles"], only_positive=True))
    return _rounded(a.rows.drop(*(c for c in a.rows.columns if c.startswith("mesh_"))))


def masked(spark, folder):
    s = ADAPTERS["profiles"](spark, folder)
    mask = s.pixels.where("(x + y + z) % 3 = 0").select("stack_id", "z", "y", "x")
    return _rounded(split.masked_intensity(s.pixels, mask, ["stack_id"]).groupBy("stack_id", "z").agg(F.sum("v").alias("total"), F.count("*").alias("pixels")), 4)


def _probes(spark, folder):
    """A probe from every pixel of the event stacks, slanted in the plane of its slice."""
    s = ADAPTERS["profiles"](spark, folder)
    probes = s.pixels.select(
        F.concat_ws("/", "stack_id", "z", "y", "x").alias("probe_id"), "stack_id", F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"), (F.col("z") * 3.0).alias("z"),
        F.lit(0.8).alias("dx"), F.lit(0.6).alias("dy"), F.lit(0.0).alias("dz"), F.lit(3.0).alias("z_scale"),
    )
    return edges.intensity_profiles(probes, s.pixels, search=4.0, step=0.5)


def probe_profiles(spark, folder):
    return _probes(spark, folder).select("probe_id", F.explode("samples").alias("e")).select("probe_id", "e.s", "e.v")


def probe_peaks(spark, folder):
    return _rounded(
        edges.edge_peaks(_probes(spark, folder)).select("probe_id", F.explode("peaks").alias("p")).select("probe_id", "p.s", "p.slope", "p.strength")
    )


def probe_edges(spark, folder):
    return edges.nearest_edges(_probes(spark, folder), step=0.5, relaxed_within=1.0).drop("stack_id")


def packed_frames(spark, folder):
    """Vectors as packed 8 by 8 frames, unpacked to pixels."""
    frames = _read(spark, folder, "embeddings").select(
        F.expr("concat('emb-', cast(vec_id div 20 as string))").alias("stack_id"), F.expr("cast(vec_id % 20 as int)").alias("z"),
        F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.expr("transform(embedding, e -> cast(e as double))").alias("data"),
    )
    return unpack_frames(frames)


def displayed_mesh(spark, folder):
    """Measures of the displayed mesh: outliers dropped, slices aligned, halved, meshed, thinned."""
    s = ADAPTERS["profiles"](spark, folder)
    a = analyze(s.stacks, s.pixels, Settings(T["profiles"], only_positive=True, include_mesh=True))

    def mask_of(contours):
        return stack_mask(contours, a.objects, a.frames, ["stack_id"], ["stack_id"])

    triangles, measured = display_mesh.display_mesh(a.contours, mask_of, a.shapes, ["stack_id"], max_faces=100)
    kept = triangles.groupBy("stack_id").agg(F.count("*").alias("faces"))
    return _rounded(measured.join(kept, "stack_id"))


def merge_checks(spark, folder):
    """Did the brightest pixel's seed separate its object from what the plain analysis measures?"""
    s = ADAPTERS["profiles"](spark, folder)
    s = replace(s, pixels=materialize(s.pixels))
    seeds = materialize(bright_seeds(s))
    options = Settings(T["profiles"], only_positive=True, include_mesh=True)
    plain = analyze(s.stacks, s.pixels, options)
    seeded = analyze_seeded(s.stacks, s.pixels, seeds, options, objects=plain.objects)
    on_seed = seeded.contours.join(seeds.select("stack_id", F.col("frame_index").alias("z")), ["stack_id", "z"])
    return crowding.merge_failures(plain.mesh, seeded.mesh, seeded.tracking, on_seed, 24.0)


QUERIES = {
    "packed_frames": packed_frames,
    "displayed_mesh": displayed_mesh,
    "merge_failure_checks": merge_checks,
    "tiff_calibration": tiff_calibration,
    "xml_calibration": xml_calibration,
    "voxel_sources": voxel_sources,
    "inspected_shapes": inspected_shapes,
    "luminance_pixels": luminance_pixels,
    "color_channels": color_channels,
    "content_hashes": content_hashes,
    "stack_paths": stack_paths,
    "output_folders": output_folders,
    "short_numbers": short_numbers,
    "settings_checks": settings_checks,
    "settings_precedence": settings_precedence,
    "settings_written": settings_written,
    "compare_numeric": compare_numeric,
    "compare_all_columns": compare_all,
    "compare_named_columns": compare_named,
    "compare_report": compare_report,
    "compare_first_differences": compare_first,
    "manifest_index": manifest_index,
    "manifest_roll_up": manifest_roll_up,
    "distance_map": distances,
    "seed_markers": seed_markers,
    "split_pixels": split_pixels,
    "split_frame_rows": split_rows,
    "masked_intensity": masked,
    "probe_profiles": probe_profiles,
    "probe_edge_peaks": probe_peaks,
    "probe_nearest_edges": probe_edges,
}

_TIFF = (
    "m AS (SELECT p_partkey AS stack_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1.0 / ((p_partkey % 5) * 1000.0 / (p_size * 100.0)) END AS x, "
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS DOUBLE) / (p_partkey % 7 + 1) END AS y, "
    "CASE p_partkey % 4 WHEN 0 THEN p_size + 0.25 WHEN 2 THEN 0 END AS z FROM part), "
    "t AS (SELECT stack_id, x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL AS known, coalesce(x, 1) AS vx, coalesce(y, 1) AS vy, coalesce(nullif(z, 0), 1) AS vz FROM m)"
)
_PAIR = (
    "e AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(14, 2)) AS price, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey % 97 <> 1), "
    "a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN CAST(CAST(o_totalprice AS DECIMAL(14, 2)) + 0.5 AS DECIMAL(14, 2)) ELSE CAST(o_totalprice AS DECIMAL(14, 2)) END AS price, "
    "CASE WHEN o_orderkey % 13 = 0 THEN o_custkey || '.0' ELSE CAST(o_custkey AS VARCHAR) END AS cust, CASE WHEN o_orderkey % 31 = 5 THEN 'Z' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 89 <> 2), "
    "lone AS (SELECT CAST(coalesce(e.k, a.k) AS VARCHAR) AS row_id, '__row__' AS \"column\", CASE WHEN e.k IS NULL THEN 'missing' ELSE 'present' END AS expected, "
    "CASE WHEN a.k IS NULL THEN 'missing' ELSE 'present' END AS actual, CAST(NULL AS DOUBLE) AS delta FROM e FULL JOIN a ON e.k = a.k WHERE e.k IS NULL OR a.k IS NULL), "
    "b AS (SELECT CAST(e.k AS VARCHAR) AS row_id, e.k, e.price AS ep, a.price AS ap, e.cust AS ec, a.cust AS ac, e.status AS es, a.status AS as_ FROM e JOIN a ON e.k = a.k)"
)
_PRICE = "SELECT row_id, 'price' AS \"column\", CAST(ep AS VARCHAR) AS expected, CAST(ap AS VARCHAR) AS actual, round(CAST(abs(ep - ap) AS DOUBLE), 6) AS delta FROM b WHERE abs(ep - ap) > {t}"
_MANIFEST = (
    "i AS (SELECT 'run-' || o_orderkey AS path, CASE WHEN o_orderkey % 17 = 0 THEN 'error' ELSE 'ok' END AS status, "
    "CASE WHEN o_orderkey % 17 <> 0 THEN 'vesicle' END AS profile, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(4.5 AS DOUBLE) END AS threshold, "
    "CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 9 + 1 END AS frame_count, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 9 + o_orderkey % 2 END AS valid_frame_count, "
    "CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'partial_contours;default_voxel_size' ELSE '' END END AS warning_codes FROM orders)"
)
_CHAN = (
    "ch AS (SELECT 'rgb-' || CAST(vec_id // 20 AS VARCHAR) AS stack_id, CAST(vec_id % 20 AS INTEGER) AS z, CAST((i - 1) // 16 AS INTEGER) AS y, CAST((i - 1) // 4 % 4 AS INTEGER) AS x, "
    "(i - 1) % 4 AS c, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 400) AS INTEGER) AS v FROM embeddings, range(1, 65) AS r(i)), "
    "lu AS (SELECT stack_id, z, y, x, CAST(trunc(CAST(0.299 AS DOUBLE) * max(v) FILTER (WHERE c = 0) + CAST(0.587 AS DOUBLE) * max(v) FILTER (WHERE c = 1) + CAST(0.114 AS DOUBLE) * max(v) FILTER (WHERE c = 2)) AS INTEGER) AS v FROM ch GROUP BY 1, 2, 3, 4)"
)
_SET = (
    "c AS (SELECT c_custkey AS owner, c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 11 = 0 THEN 'unsupported project settings version: 2' "
    "WHEN c_custkey % 4 = 3 THEN 'unknown analysis profile: odd' WHEN c_custkey % 5 = 0 THEN 'zmax must be greater than zmin' ELSE 'ok' END AS result FROM customer)"
)
_PROBE = (
    f"{sql.px('profiles')}, pr AS (SELECT stack_id || '/' || z || '/' || y || '/' || x AS probe_id, stack_id, z, y, x FROM px), "
    "sm AS (SELECT p.probe_id, p.stack_id, CAST(i AS DOUBLE) * 0.5 AS s, CAST(round_even(p.x + (0.0 + CAST(i AS DOUBLE) * 0.5) * CAST(0.8 AS DOUBLE), 0) AS INTEGER) AS sx, "
    "CAST(round_even(p.y + (0.0 + CAST(i AS DOUBLE) * 0.5) * CAST(0.6 AS DOUBLE), 0) AS INTEGER) AS sy, p.z AS sz FROM pr p, range(-8, 9) AS r(i)), "
    "pf AS (SELECT s.probe_id, s.s, coalesce(q.v, 0) AS v FROM sm s LEFT JOIN px q ON q.stack_id = s.stack_id AND q.z = s.sz AND q.y = s.sy AND q.x = s.sx), "
    "ed AS (SELECT probe_id, (s + ps) / 2 AS s, (v - pv) / (s - ps) AS slope, abs((v - pv) / (s - ps)) AS strength FROM (SELECT *, lag(s) OVER w AS ps, lag(v) OVER w AS pv FROM pf WINDOW w AS (PARTITION BY probe_id ORDER BY s)) WHERE ps IS NOT NULL), "
    "pk AS (SELECT probe_id, s, slope, strength FROM (SELECT *, lag(strength, 1, 0) OVER w AS l, lead(strength, 1, 0) OVER w AS r FROM ed WINDOW w AS (PARTITION BY probe_id ORDER BY s)) WHERE strength >= l AND strength >= r)"
)
_DFG = f"{sql.dense('profiles')}, fg AS (SELECT * FROM dn WHERE v >= {T['profiles']}), gb AS (SELECT * FROM dn WHERE v < {T['profiles']})"

ORACLES = {
    "packed_frames": f"WITH {sql.px('embeddings')} SELECT stack_id, z, y, x, v FROM px WHERE v <> 0",
    "tiff_calibration": (
        f"WITH {_TIFF} SELECT stack_id, CASE WHEN known THEN round(CAST(vx AS DOUBLE), 6) END AS vx_um, CASE WHEN known THEN round(CAST(vy AS DOUBLE), 6) END AS vy_um, "
        "CASE WHEN known THEN round(CAST(vz AS DOUBLE), 6) END AS vz_um FROM t"
    ),
    "xml_calibration": (
        "WITH k AS (SELECT c_custkey AS stack_id, c_custkey % 6 AS m, CAST(c_nationkey + 1 AS DOUBLE) / 10 AS u FROM customer) "
        "SELECT stack_id, round(CASE m WHEN 0 THEN u WHEN 1 THEN 0.25 WHEN 2 THEN 0.15 WHEN 3 THEN 0.3 WHEN 4 THEN 0.25 END, 6) AS vx_um, "
        "round(CASE m WHEN 0 THEN u WHEN 1 THEN 0.25 WHEN 2 THEN 1 WHEN 3 THEN 0.3 WHEN 4 THEN 0.25 END, 6) AS vy_um, "
        "round(CAST(CASE m WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1.5 END AS DOUBLE), 6) AS vz_um FROM k"
    ),
    "voxel_sources": (
        f"WITH {_TIFF}, u AS (SELECT stack_id, known AND stack_id % 10 <> 9 AS known, stack_id % 8 = 3 AS over_, vx, vy, vz FROM t) "
        "SELECT stack_id, CASE WHEN over_ THEN 'override' WHEN known THEN 'metadata' ELSE 'default' END AS voxel_source, "
        "round(CAST(CASE WHEN over_ THEN 0.5 WHEN known THEN vx ELSE 1 END AS DOUBLE), 6) AS vx_um, round(CAST(CASE WHEN over_ THEN 0.5 WHEN known THEN vy ELSE 1 END AS DOUBLE), 6) AS vy_um, "
        "round(CAST(CASE WHEN over_ THEN 2 WHEN known THEN vz ELSE 1 END AS DOUBLE), 6) AS vz_um FROM u"
    ),
    "inspected_shapes": (
        "WITH p AS (SELECT p_partkey AS stack_id, p_partkey % 7 AS m, p_size + 9 AS s FROM part) "
        "SELECT stack_id, CASE m WHEN 3 THEN s || 'x64x32' WHEN 4 THEN '5x' || s || 'x64' WHEN 5 THEN '5x' || s || 'x64' WHEN 6 THEN '7x' || s || 'x64' ELSE '1x' || s || 'x64' END AS grayscale_shape, "
        "CASE m WHEN 3 THEN s || 'x64x32x3' WHEN 4 THEN '5x' || s || 'x64x4' WHEN 5 THEN '5x' || s || 'x64x3' WHEN 6 THEN '7x' || s || 'x64x3' ELSE '1x' || s || 'x64x3' END AS color_shape FROM p"
    ),
    "luminance_pixels": f"WITH {_CHAN} SELECT * FROM lu",
    "color_channels": (
        f"WITH {_CHAN} SELECT stack_id, CAST(k AS INTEGER) AS c, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total FROM lu, range(0, 3) AS r(k) GROUP BY 1, 2"
    ),
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "stack_paths": "SELECT page_id, page_id % 6 < 4 AS is_stack FROM pages",
    "output_folders": (
        "SELECT page_id, 'Run_' || page_id || CASE WHEN page_id % 6 = 5 THEN '.tif' ELSE '' END AS stem, "
        "'set_' || (page_id % 5) || '/Run_' || page_id AS folder FROM pages"
    ),
    "short_numbers": (
        "SELECT l_orderkey, l_linenumber, printf('%.6g', l_extendedprice * l_discount / 3 * "
        f"([{', '.join(f'CAST({p} AS DOUBLE)' for p in SCALES)}])[CAST(l_quantity AS INTEGER) % 14 + 1]) AS shown FROM lineitem"
    ),
    "settings_checks": f"WITH {_SET} SELECT owner, result FROM c",
    "settings_precedence": (
        f"WITH {_SET} SELECT owner, CASE WHEN result = 'ok' THEN CASE k % 4 WHEN 0 THEN 'vesicle' WHEN 1 THEN 'RBC' WHEN 2 THEN 'active-surfaces' END ELSE 'vesicle' END AS profile, "
        "CASE WHEN k % 2 = 0 THEN 99.5 WHEN result = 'ok' AND k % 3 = 0 THEN CAST(n AS DOUBLE) + 0.5 END AS threshold, CASE WHEN k % 7 = 0 THEN CAST(0.25 AS DOUBLE) END AS y_um, "
        "CASE WHEN result = 'ok' THEN 5 END AS zmax, result = 'ok' AS include_mesh, true AS prefer_opencv FROM c"
    ),
    "settings_written": (
        f"WITH {_SET} SELECT owner, 1 AS version, CASE k % 4 WHEN 0 THEN 'vesicle' WHEN 1 THEN 'RBC' WHEN 2 THEN 'active-surfaces' END AS profile, "
        "CASE WHEN k % 3 = 0 THEN CAST(n AS DOUBLE) + 0.5 END AS threshold, 1 AS zmin, true AS include_mesh FROM c WHERE result = 'ok'"
    ),
    "compare_numeric": f"WITH {_PAIR} SELECT * FROM lone UNION ALL {_PRICE.format(t='0.01')}",
    "compare_all_columns": (
        f"WITH {_PAIR} SELECT * FROM lone UNION ALL SELECT row_id, 'status', es, as_, NULL FROM b WHERE es <> as_"
    ),
    "compare_named_columns": (
        f"WITH {_PAIR} SELECT 'only_expected' AS \"column\", 'x' AS expected, '<missing>' AS actual, count(*) AS cells FROM b"
    ),
    "compare_report": (
        f"WITH {_PAIR} SELECT (SELECT count(*) FROM b) AS compared_rows, (SELECT 2 * count(*) FROM b) AS compared_cells, "
        f"(SELECT count(*) FROM (SELECT * FROM lone UNION ALL {_PRICE.format(t='0.01')})) AS difference_count, "
        f"(SELECT count(*) FROM (SELECT * FROM lone UNION ALL {_PRICE.format(t='0.01')})) = 0 AS passed"
    ),
    "compare_first_differences": (
        f"WITH {_PAIR} SELECT row_id, \"column\", expected, actual FROM ({_PRICE.format(t='0.01').replace('FROM b', ', k FROM b')} ORDER BY k LIMIT 20)"
    ),
    "manifest_index": f"WITH {_MANIFEST} SELECT * FROM i",
    "manifest_roll_up": (
        f"WITH {_MANIFEST} SELECT (SELECT count(*) FROM nation) AS checks, (SELECT count(*) FROM nation) AS checks_passed, count(*) AS runs, "
        "count(*) FILTER (WHERE status = 'error') AS runs_unreadable, count(*) FILTER (WHERE status = 'ok' AND valid_frame_count = frame_count) AS runs_complete, "
        "count(*) FILTER (WHERE status = 'ok' AND warning_codes <> '') AS runs_with_warnings, count(*) FILTER (WHERE status = 'error') = 0 AS passed FROM i"
    ),
    "distance_map": (
        f"WITH {_DFG} SELECT f.stack_id, f.z, f.y, f.x, CAST(min((f.x - b.x) ** 2 + (f.y - b.y) ** 2) AS BIGINT) AS d2 FROM fg f JOIN gb b ON f.stack_id = b.stack_id AND f.z = b.z GROUP BY 1, 2, 3, 4"
    ),
    "masked_intensity": (
        f"WITH {sql.px('profiles')} SELECT stack_id, z, round(sum(CASE WHEN (x + y + z) % 3 = 0 THEN v ELSE 0 END), 4) AS total, count(*) AS pixels FROM px GROUP BY 1, 2"
    ),
    "probe_profiles": f"WITH {_PROBE} SELECT probe_id, s, v FROM pf",
    "probe_edge_peaks": f"WITH {_PROBE} SELECT probe_id, round(s, 6) AS s, round(slope, 6) AS slope, round(strength, 6) AS strength FROM pk",
    "probe_nearest_edges": (
        f"WITH {_PROBE}, mx AS (SELECT probe_id, greatest(1.0, 0.2 * max(strength)) AS lim FROM pk GROUP BY 1), "
        "sg AS (SELECT p.* , strength >= lim AS strong, bool_or(strength >= lim) OVER (PARTITION BY probe_id) AS any_ FROM pk p JOIN mx USING (probe_id)), "
        "ok AS (SELECT * FROM sg WHERE strong OR NOT any_), "
        "n AS (SELECT probe_id, coalesce(min(s) FILTER (WHERE s > 0.125), arg_min(s, struct_pack(a := abs(s), b := s))) AS edge_s FROM ok GROUP BY 1) "
        "SELECT probe_id, edge_s, CASE WHEN abs(edge_s) <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS relaxed FROM n"
    ),
}
