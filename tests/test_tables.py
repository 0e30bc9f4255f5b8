"""Thresholds, contours, comparisons, metadata, settings and sinks on literal input."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import sphere
from voxelgrain.functions import calibration
from voxelgrain.functions.geometry import contour_metrics
from voxelgrain.operators import compare, edges, masks, report, summary, threshold
from voxelgrain.plans.analyze import Settings, analyze
from voxelgrain.sources import files, manifests, settings

POINTS = "contour_id string, points array<struct<x:double,y:double>>, vx_um double, vy_um double"


def test_rectangle_contour(spark):
    pts = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    m = contour_metrics(spark.createDataFrame([("r", pts, 0.5, 2.0)], POINTS)).first()
    assert (m.area_px2, m.area_um2, m.perimeter_px, m.perimeter_um) == (8, 8, 12, 12)
    assert (m.bbox_width_um, m.bbox_height_um, m.aspect_ratio, m.elongation) == (2, 4, 2, 0.5)
    assert m.deformation_index == pytest.approx(1 / 3)
    assert (m.extent, m.solidity) == (1, 1)
    assert m.equivalent_diameter_um == pytest.approx(3.191538243)


def test_concave_contour_and_short_contour(spark):
    pts = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    m = contour_metrics(spark.createDataFrame([("c", pts, 2.0, 1.0)], POINTS)).first()
    assert (m.area_um2, m.extent, m.solidity) == (24, 0.75, 0.75)
    with pytest.raises(Exception, match="At least three"):
        contour_metrics(spark.createDataFrame([("c", pts[:2], 1.0, 1.0)], POINTS)).collect()


def test_threshold_suggestions(spark, make):
    s, p = make({"seven": [[[7, 7], [7, 7]]], "q": [[[0, 0], [10, 20]]], "zero": [[[0, 0], [0, 1]]]})
    got = {r.stack_id: (r.threshold, r.method) for r in threshold.suggest_threshold(p, s, "percentile").collect()}
    assert got["seven"] == (7.0, "constant") and got["q"] == (12.5, "percentile")
    auto = {r.stack_id: r.method for r in threshold.suggest_threshold(p, s, "auto").collect()}
    assert auto == {"seven": "constant", "q": "otsu", "zero": "otsu"}
    with pytest.raises(ValueError):
        threshold.suggest_threshold(p, s, "magic")


def test_percentile_beside_an_outlier(spark, make):
    rng = np.random.default_rng(5)
    far, huge = rng.random((4, 20, 30)) + 0.5, rng.normal(size=(3, 20, 30))
    far[1, 2, 3], huge[0, 0, 0], huge[2, 1, 1] = 1e12, 1.7e308, -1.7e308
    s, p = make({"far": far, "huge": huge})
    got = {r.stack_id: r.threshold for r in threshold.suggest_threshold(p, s, "percentile").collect()}
    assert got == pytest.approx({"far": np.quantile(far, 0.75), "huge": np.quantile(huge, 0.75)}, abs=1e-12)


def test_suggestion_sees_region_and_slices_only(spark, make):
    a = np.zeros((4, 6, 6))
    a[1:3, 1:3, 1:3], a[0], a[:, 5] = 8, 99, 77
    s, p = make({"a": a})
    rect, slices = masks.Rect(0, 3, 0, 3), masks.Slices(1, 3)
    cut = np.zeros((2, 6, 6))
    cut[:, 1:3, 1:3] = 8
    s2, p2 = make({"a": cut})
    for method in ("auto", "otsu", "percentile"):
        part = threshold.suggest_threshold(p, s, method, rect=rect, slices=slices).first()
        assert tuple(part) == tuple(threshold.suggest_threshold(p2, s2, method).first())
    with pytest.raises(Exception, match="at least one frame"):
        threshold.suggest_threshold(p, s, slices=masks.Slices(9, 12)).collect()


def test_sweep_values():
    assert threshold.sweep_values(50, 100, 25) == [50, 75, 100]
    assert threshold.sweep_values(0, 1, 0.1)[-1] == 1.0 and len(threshold.sweep_values(0, 1, 0.1)) == 11
    for bad in ((0, 1, 0), (2, 1, 1)):
        with pytest.raises(ValueError):
            threshold.sweep_values(*bad)


def _csv(spark, tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return compare.read_metric_csv(spark, str(path))


def test_compare_by_key(spark, tmp_path):
    e = _csv(spark, tmp_path, "e.csv", "frame_index,area,note\n0,9.000000,a\n1,4,b\n")
    a = _csv(spark, tmp_path, "a.csv", "frame_index,area,note\n0,9.000001,z\n")
    found, total = compare.compare_tables(e, a, tolerance=1e-5)
    assert [(r.row_id, r.column, r.expected, r.actual) for r in found.collect()] == [("1", "__row__", "present", "missing")]
    assert total.first().asDict() == {"compared_rows": 1, "compared_cells": 1, "difference_count": 1, "passed": False}
    found, total = compare.compare_tables(e, a, tolerance=1e-5, all_columns=True)
    assert total.first().compared_cells == 2
    assert {r.column for r in found.collect()} == {"__row__", "note"}
    found, _ = compare.compare_tables(e, a, columns=["area", "gone"])
    assert {(r.column, r.expected) for r in found.where("column <> '__row__'").collect()} == {("gone", "<missing>")}
    lines = compare.report_text(total, found, expected="e", actual="a", tolerance=1e-5).orderBy("line_no").collect()
    assert "Result: FAIL" in [r.line for r in lines]


def test_compare_by_position_and_last_key_wins(spark, tmp_path):
    e = _csv(spark, tmp_path, "e.csv", "area\n1\n2\n3\n")
    a = _csv(spark, tmp_path, "a.csv", "area\n1\n2.5\n")
    found, total = compare.compare_tables(e, a)
    assert {(r.row_id, r.column, r.delta) for r in found.collect()} == {("*", "__row_count__", None), ("1", "area", 0.5)}
    assert total.first().compared_rows == 2
    e = _csv(spark, tmp_path, "k.csv", "frame_index,area\n0,1\n0,7\n")
    a = _csv(spark, tmp_path, "l.csv", "frame_index,area\n0,7\n")
    assert compare.compare_tables(e, a)[1].first().passed
    nan = _csv(spark, tmp_path, "n.csv", "frame_index,area\n0,nan\n")
    assert compare.compare_tables(nan, a)[1].first().passed
    assert not compare.compare_tables(nan, a, nan_equal=False)[1].first().passed


def test_metadata(spark):
    t = spark.createDataFrame([(2, 1, 4, 1, "ImageJ\nspacing=0.5"), (0, 1, 0, 1, ""), (0, 1, 5, 1, "x")], "x_num int, x_den int, y_num int, y_den int, description string")
    got = [(r.vx_um, r.vy_um, r.vz_um) for r in calibration.tiff_voxels(t).collect()]
    assert got == [(0.5, 0.25, 0.5), (None, None, None), (1.0, 0.2, 1.0)]
    xml = '<Metadata><Items><Distance Id="X"><Value>2e-7</Value></Distance><Distance Id="Z"><Value>1e-6</Value></Distance></Items></Metadata>'
    x = calibration.xml_voxels(spark.createDataFrame([(xml,), ("",)], "xml string")).collect()
    assert x[0].vx_um == pytest.approx(0.2) and x[0].vy_um == pytest.approx(0.2) and x[0].vz_um == pytest.approx(1.0)
    assert x[1].vx_um is None


def test_shapes(spark):
    bad = spark.createDataFrame([([2, 3, 4, 5, 6],)], "shape array<int>")
    with pytest.raises(Exception, match="Unsupported image stack shape"):
        files.inspect_stacks(bad).collect()


def test_settings_round_trip_and_errors(spark, tmp_path):
    text = json.dumps({"version": 1, "profile": "rbc", "threshold": 5.5, "roi": {"xmin": 1, "xmax": 2, "ymin": 3, "ymax": 4}, "sweep": {"step": 2.0}})
    parsed = settings.parse_settings(spark.createDataFrame([("a", text)], "owner string, value string"))
    settings.write_settings(settings.checked_settings(parsed), str(tmp_path / "s"))
    back = settings.read_settings(spark, str(tmp_path / "s")).first()
    assert (back.profile, back.threshold, back.roi.ymax, back.sweep.step, back.voxel_size) == ("rbc", 5.5, 4, 2.0, None)
    two = settings.parse_settings(spark.createDataFrame([("a", '{"version": 2}')], "owner string, value string"))
    with pytest.raises(Exception, match="unsupported project settings version: 2"):
        settings.checked_settings(two).collect()
    part = spark.createDataFrame([("a", 1.0, None, None)], "owner string, vx_um double, vy_um double, vz_um double")
    with pytest.raises(Exception, match="needs x, y and z"):
        settings.resolve_settings(part, parsed, "owner").collect()


def test_discovery_and_hashes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.TIF", "a.czi", "c.png", "deep/d.lsm"):
        (tmp_path / name).write_bytes(b"abc")
    flat = [r.source_path.rsplit("/", 1)[1] for r in files.discover_stacks(spark, str(tmp_path)).collect()]
    assert flat == ["a.czi", "b.TIF"]
    assert files.discover_stacks(spark, str(tmp_path), recursive=True).count() == 3
    digests = {r.source_sha256 for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert digests == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}


def test_sinks(spark, make, tmp_path):
    s, p = make({"a": sphere(), "b": sphere(radius=4)}, source="default")
    a = analyze(s, p, Settings(100.0, include_mesh=True)).save()
    report.write_rows(a.rows, ["stack_id"], str(tmp_path / "rows"))
    back = spark.read.option("header", True).csv(str(tmp_path / "rows"))
    assert back.count() == 20 and back.columns[:2] == ["frame_index", "threshold"]
    batch = summary.batch_rows(a.summary)
    report.write_table(batch, str(tmp_path / "batch"), summary.BATCH_COLUMNS)
    head = spark.read.option("header", True).csv(str(tmp_path / "batch"))
    assert tuple(head.columns) == summary.BATCH_COLUMNS and "default_voxel_size" in head.first().warning_codes
    m = report.manifests(a.summary, ["stack_id"], include_mesh=True)
    report.write_manifests(m, ["stack_id"], str(tmp_path / "m"))
    index = manifests.index_manifests(manifests.read_manifest_texts(spark, str(tmp_path / "m")))
    assert [r.status for r in index.collect()] == ["ok", "ok"]
    loaded = json.loads(m.where("stack_id = 'a'").first().manifest)
    assert list(loaded) == sorted(loaded) and loaded["mesh"]["volume_um3"] == pytest.approx(622.1667, abs=1e-3)
    lines = report.report_lines(a.summary, a.rows, ["stack_id"], include_mesh=True)
    report.write_reports(lines, ["stack_id"], str(tmp_path / "r"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "## Mesh Summary" in text and "| area_um2 | 71.2 | 28 | 92 |" in text


def test_pixel_store_prunes_slices(spark, make, tmp_path):
    s, p = make({"a": sphere()})
    files.write_pixels(p, str(tmp_path / "px"))
    part = masks.trim_slices(files.read_pixels(spark, str(tmp_path / "px")), masks.Slices(2, 4))
    assert part.count() == 89 + 97
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(z,2)" in plan


def test_nearest_edge_on_a_ray(spark, make):
    import numpy as np

    a = np.zeros((1, 1, 40))
    a[0, 0, 8:18], a[0, 0, 18:22], a[0, 0, 22:32] = 180, 20, 255
    _, p = make({"a": a})
    probe = spark.createDataFrame([("p", "a", 13.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)], "probe_id string, stack_id string, x double, y double, z double, dx double, dy double, dz double, z_scale double")
    got = edges.nearest_edges(edges.intensity_profiles(probe, p, search=12.0, step=0.5), step=0.5, relaxed_within=7.0).first()
    assert 3 <= got.edge_s <= 7 and got.relaxed == 1.0


def test_excluded_text(spark):
    got = spark.sql(f"select {masks.parse_frame_list(repr('3, 7; 9,,'))} as f").first().f
    assert got == [3, 7, 9]
    with pytest.raises(Exception):
        spark.createDataFrame([("3, x",)], "t string").select(F.expr(masks.parse_frame_list("t"))).collect()


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("{not json", "JSON object"), ("[1,2]", "JSON object"), ('{"threshold": "abc"}', "threshold must be a number"),
        ('{"include_mesh": "yes"}', "include_mesh must be true or false"), ('{"roi": {"xmin": 1}}', "roi needs the numbers"),
        ('{"profile": 3}', "profile must be text"), ('{"z_range": [1, 2]}', "z_range needs the numbers"),
        ('{"threshold": 5, "roi": null, "include_mesh": true}', None),
    ],
)
def test_malformed_settings_are_named(spark, text, message):
    parsed = settings.parse_settings(spark.createDataFrame([("a", text)], "owner string, value string"))
    found = parsed.select(settings.settings_error().alias("e")).first()["e"]
    assert (found is None) if message is None else (message in found)


def test_profiles_over_tiles_and_image_edges(spark, make):
    """Samples of probes that cross tiles, slices and the image edge, against a plain look-up."""
    rng = np.random.default_rng(21)
    a = rng.integers(0, 9, (3, 140, 300)) * (rng.random((3, 140, 300)) < 0.6)
    _, p = make({"a": a})
    rows = [
        (f"p{i}", "a", *(float(v) for v in (rng.uniform(0, 299), rng.uniform(0, 139), rng.uniform(0, 4))), *(float(v) for v in rng.uniform(-1, 1, 3)), 2.0)
        for i in range(60)
    ] + [("corner", "a", 0.0, 139.0, 0.0, 0.8, 0.6, 0.0, 2.0), ("seam", "a", 127.0, 127.0, 2.0, 1.0, 1.0, 0.0, 2.0)]
    probes = spark.createDataFrame(rows, "probe_id string, stack_id string, x double, y double, z double, dx double, dy double, dz double, z_scale double")
    got = edges.intensity_profiles(probes, p, search=6.0, step=0.5, offset=0.25)
    found = {r.probe_id: [(e.s, e.v) for e in r.samples] for r in got.collect()}
    assert len(found) == len(rows) == got.count()
    for name, _, x, y, z, dx, dy, dz, scale in rows:
        wanted = []
        for s in np.arange(-12, 13) * 0.5:
            at = [int(np.rint(v)) for v in ((z + (0.25 + s) * dz) / scale, y + (0.25 + s) * dy, x + (0.25 + s) * dx)]
            inside = all(0 <= n < size for n, size in zip(at, a.shape))
            wanted.append((s, float(a[tuple(at)]) if inside else 0.0))
        assert found[name] == wanted
    # a probe is shuffled with its tile, not once for each sample
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
