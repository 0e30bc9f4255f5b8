"""Published values and small stacks with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import seed, sphere, touching
from voxelgrain.operators.masks import Rect, Slices
from voxelgrain.operators.tracking import SEED_SCHEMA
from voxelgrain.plans.analyze import Settings, analyze, analyze_seeded, batch, best_threshold, split_analysis, sweep


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_sphere_seeded_with_mesh(spark, make):
    s, p = make({"a": sphere()})
    seeds = spark.createDataFrame([seed("a", 20, 20, 5, 6)], SEED_SCHEMA)
    a = analyze_seeded(s, p, seeds, Settings(100.0, include_mesh=True, only_positive=True))
    got = rows(a.summary, "stack_id")[0]
    assert got["area_um2_mean"] == pytest.approx(71.2)
    assert got["mesh_volume_um3"] == pytest.approx(622.1667, abs=1e-3)
    assert got["mesh_surface_area_um2"] == pytest.approx(357.6520, abs=1e-3)
    assert got["mesh_sphericity"] == pytest.approx(0.98543, abs=1e-4)
    assert got["warning_codes"] == "likely_neighbor_merge"


def test_touching_pair_rectangle_and_outline(spark, make):
    s, p = make({"t": touching()})
    box = analyze(s, p, Settings(100.0, include_mesh=True, contour="rectangle"))
    first = rows(box.rows, "frame_index")[0]
    assert (first["area_px2"], first["perimeter_px"], first["method"]) == (851.0, 120.0, "fallback")
    assert first["mesh_volume_um3"] == pytest.approx(2430.6667, abs=1e-3)
    assert first["mesh_surface_area_um2"] == pytest.approx(491.3137, abs=1e-3)
    seeds = spark.createDataFrame([seed("t", 30, 40, 2, 9)], SEED_SCHEMA)
    a = analyze_seeded(s, p, seeds, Settings(100.0, include_mesh=True))
    first = rows(a.rows, "frame_index")[0]
    assert first["area_px2"] == 576.0
    assert first["perimeter_px"] == pytest.approx(106.91168824543)
    assert first["solidity"] == pytest.approx(0.8958009, abs=1e-6)
    assert (first["bbox_width_um"], first["bbox_height_um"]) == (36.0, 22.0)
    assert first["mesh_volume_um3"] == pytest.approx(1660.0)
    assert first["mesh_surface_area_um2"] == pytest.approx(438.9605, abs=1e-3)


def test_tall_images_are_joined_across_bands(spark, make):
    """One object over many bands, with a hole and a nested object, equals the single-band result."""
    a = np.zeros((1, 90, 40))
    a[0, 5:85, 5:35] = 1
    a[0, 30:60, 12:28] = 0
    a[0, 40:50, 16:24] = 1
    s, p = make({"a": a})
    got = []
    for band in (128, 64, 7):
        r = analyze(s, p, Settings(0.5), band_rows=band)
        got.append(rows(r.objects.components, "label"))
    assert got[0] == got[1] == got[2]
    outer, inner = got[0]
    assert outer["area_px2"] == 79 * 29 and not outer["nested"]
    assert inner["nested"] and inner["area"] == 80


def test_two_circles_by_seed(spark, make):
    _, y, x = np.indices((2, 40, 80))
    a = np.where((np.hypot(x - 20, y - 20) <= 10) | (np.hypot(x - 60, y - 20) <= 5), 200, 0)
    s, p = make({"a": a})
    seeds = spark.createDataFrame([seed("a", 20, 20, 0, seed_id="left"), seed("a", 60, 20, 0, seed_id="right")], SEED_SCHEMA)
    r = analyze_seeded(s, p, seeds, Settings(100.0))
    areas = {d["seed_id"]: d["area_px2"] for d in rows(r.rows, "frame_index")}
    assert areas["left"] > 3 * areas["right"] > 0
    free = rows(analyze(s, p, Settings(100.0)).rows, "frame_index")
    assert free[0]["area_px2"] == areas["left"]


def test_moving_square_reach(spark, make):
    a = np.zeros((3, 20, 20))
    for z, c in enumerate((10, 11, 16)):
        a[z, c - 2 : c + 3, c - 2 : c + 3] = 200
    s, p = make({"a": a})
    seeds = spark.createDataFrame([seed("a", 10, 10, 0, 5, 3.0, "short"), seed("a", 10, 10, 0, 5, None, "free")], SEED_SCHEMA)
    r = analyze_seeded(s, p, seeds, Settings(100.0))
    lost = {(d["seed_id"], d["frame_index"]): d["method"] for d in rows(r.rows, "seed_id", "frame_index")}
    assert lost[("short", 2)] == "seed_lost" and lost[("free", 2)] == "seed"
    codes = {d["seed_id"]: d["warning_codes"] for d in rows(r.summary, "seed_id")}
    assert "tracking_lost_many_frames" in codes["short"] and "tracking" not in codes["free"]


def test_excluded_frame_drops_from_mesh_and_summary(spark, make):
    a = np.zeros((3, 20, 20))
    a[:, 6:14, 6:14] = 220
    s, p = make({"a": a})
    out = spark.createDataFrame([("a", 1)], "stack_id string, z int")
    full = analyze(s, p, Settings(100.0, include_mesh=True))
    less = analyze(s, p, Settings(100.0, include_mesh=True), excluded=out)
    f, g = rows(full.summary, "stack_id")[0], rows(less.summary, "stack_id")[0]
    assert (f["valid_frame_count"], g["valid_frame_count"]) == (3, 2)
    assert g["mesh_volume_um3"] < f["mesh_volume_um3"]
    row = rows(less.rows, "frame_index")[1]
    assert row["excluded"] and not row["has_contour"] and row["area_px2"] > 0
    assert g["warning_codes"] == "excluded_frames;partial_contours"
    with pytest.raises(Exception, match="not in analyzed stack"):
        bad = spark.createDataFrame([("a", 7)], "stack_id string, z int")
        analyze(s, p, Settings(100.0), excluded=bad).rows.collect()


def test_block_sweep_and_best(spark, make):
    a = np.zeros((2, 8, 8))
    a[:, 2:5, 1:4] = 200
    s, p = make({"a": a})
    t = [50.0, 250.0]
    r = sweep(s, p, t, Settings(0.0, contour="rectangle"))
    low, high = rows(r.summary, "threshold")
    assert low["area_um2_mean"] == 9.0 and low["valid_fraction"] == 1.0
    assert high["warning_codes"] == "no_valid_contours"
    assert rows(best_threshold(r.summary), "stack_id")[0]["threshold"] == 50.0
    b = rows(sweep(s, p, t, Settings(0.0)).rows, "threshold", "frame_index")
    assert b[0]["area_px2"] == 4.0 and b[0]["method"] == "opencv"


def test_per_frame_thresholds_and_trim(spark, make):
    a = np.zeros((4, 8, 8))
    a[1, 2:5, 2:5], a[2, 2:5, 2:5] = 50, 200
    s, p = make({"a": a})
    t = spark.createDataFrame([("a", z, 100.0) for z in (1, 2)], "stack_id string, z int, threshold double")
    got = rows(analyze(s, p, Settings(t, slices=Slices(1, 3))).rows, "frame_index")
    assert [d["frame_index"] for d in got] == [1, 2]
    assert [d["has_contour"] for d in got] == [False, True]
    with pytest.raises(Exception, match="match number of frames"):
        analyze(s, p, Settings(t)).rows.collect()


def test_region_keeps_only_its_object(spark, make):
    a = np.zeros((1, 8, 8))
    a[0, 1:3, 1:3], a[0, 5:7, 5:7] = 200, 200
    s, p = make({"a": a})
    got = rows(analyze(s, p, Settings(100.0, rect=Rect(0, 4, 0, 4))).rows, "frame_index")[0]
    assert got["area_px2"] == 1.0
    with pytest.raises(Exception, match="non-empty rectangle"):
        analyze(s, p, Settings(100.0, rect=Rect(9, 12, 0, 4))).rows.collect()


def test_line_objects_fall_back_to_rectangle(spark, make):
    a = np.zeros((2, 12, 12))
    a[0, 3, 2:9] = 9
    for i in range(4):
        a[1, 2 + i, 3 + i] = 9
    s, p = make({"a": a})
    got = rows(analyze(s, p, Settings(5.0)).rows, "frame_index")
    assert [d["method"] for d in got] == ["fallback", "fallback"]
    assert [d["area_px2"] for d in got] == [7.0, 1.0]


def test_edge_contact_is_reported(spark, make):
    a = np.zeros((1, 20, 20))
    a[0, 0:6, 0:6] = 255
    s, p = make({"a": a})
    seeds = spark.createDataFrame([seed("a", 2, 2, 0, 3)], SEED_SCHEMA)
    r = analyze_seeded(s, p, seeds, Settings(100.0))
    assert "roi_boundary_touch" in rows(r.summary, "stack_id")[0]["warning_codes"]


def test_seed_outside_fails(spark, make):
    s, p = make({"a": sphere()})
    seeds = spark.createDataFrame([seed("a", 45, 20, 5)], SEED_SCHEMA)
    with pytest.raises(Exception, match="outside full image bounds"):
        analyze_seeded(s, p, seeds, Settings(100.0)).rows.collect()


def test_profile_needing_a_seed(spark, make):
    s, p = make({"a": sphere()})
    with pytest.raises(ValueError, match="requires an object seed"):
        analyze(s, p, Settings(100.0, profile="active_surfaces"))
    with pytest.raises(ValueError, match="unknown analysis profile"):
        analyze(s, p, Settings(100.0, profile="odd"))


def test_touching_objects_are_split(spark, make):
    s, p = make({"t": touching()})
    seeds = spark.createDataFrame([seed("t", 30, 40, 2, 14)], SEED_SCHEMA)
    r = split_analysis(s, p, seeds, Settings(100.0, include_mesh=True))
    got = rows(r.rows, "frame_index")
    assert all(d["method"] == "active_surfaces" for d in got)
    reach = r.contours.agg(F.max("xmax")).first()[0]
    assert reach <= 42
    assert 350 < got[2]["area_px2"] < 450


def test_tall_and_deep_stacks_stay_whole(spark, make):
    tall = np.zeros((1, 130, 8))
    tall[0, 5:125, 3:5] = 200
    deep = np.zeros((12, 20, 20))
    for z in range(12):
        deep[z, 5:12, 2 + z // 2 : 9 + z // 2] = 200
    s, p = make({"tall": tall, "deep": deep})
    found = analyze(s, p, Settings(100.0)).objects.components.where("stack_id = 'tall'").collect()
    assert [c["area"] for c in found] == [240]
    seeds = spark.createDataFrame([seed("deep", 5, 8, 0)], SEED_SCHEMA)
    only = s.where("stack_id = 'deep'"), p.where("stack_id = 'deep'")
    tracked = analyze_seeded(*only, seeds, Settings(100.0)).rows.where("has_contour").count()
    assert tracked == 12


def test_threshold_table_names_every_stack_once(spark, make):
    s, p = make({"a": np.full((1, 20, 20), 200), "b": np.full((1, 20, 20), 200)})
    for given in ([("a", 100.0)], [("a", 100.0), ("b", 100.0), ("b", 50.0)]):
        t = spark.createDataFrame(given, "stack_id string, threshold double")
        with pytest.raises(Exception, match="every stack once"):
            analyze(s, p, Settings(t)).rows.collect()


def test_batch_isolates_failing_stacks(spark, make):
    s, p = make({n: sphere(shape=shape, centre=(shape[0] // 2, 10, 10), radius=4) for n, shape in (
        ("good", (6, 20, 20)), ("flat", (2, 20, 20)), ("narrow", (6, 20, 5)), ("unscaled", (6, 20, 20)), ("bare", (6, 20, 20)), ("off", (6, 20, 20)),
    )})
    s = s.withColumn("vy_um", F.expr("if(stack_id = 'unscaled', 0D, vy_um)"))
    limits = s.where("stack_id <> 'bare'").select("stack_id", F.lit(100.0).alias("threshold"))
    excluded = spark.createDataFrame([("off", 0), ("good", 3)], "stack_id string, z int")
    options = Settings(limits, rect=Rect(5, 20, 0, 20), slices=Slices(2, 6))
    got = {r.source_path[:-4]: (r.status, r.error_message) for r in batch(s, p, options, excluded=excluded).collect()}
    assert got == {
        "good": ("ok", ""),
        "flat": ("error", "Z range bounds must define at least one frame"),
        "narrow": ("error", "ROI bounds must define a non-empty rectangle"),
        "unscaled": ("error", "voxel spacing must be greater than zero"),
        "bare": ("error", "threshold table must name every stack once"),
        "off": ("error", "excluded frame index(es) not in analyzed stack: 0"),
    }


def test_stacks_are_read_once(spark, make):
    """A table of stacks may be as dear as a scan of all pixels, so every later step reads the written one."""
    s, p = make({"a": sphere(), "b": sphere()})
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    seeds = spark.createDataFrame([seed(n, 20, 20, 5, 6) for n in "ab"], SEED_SCHEMA)
    a = analyze_seeded(s.mapInArrow(pass_on, s.schema), p, seeds, Settings(100.0, include_mesh=True, only_positive=True))
    assert [r["mesh_volume_um3"] for r in rows(a.summary, "stack_id")] == pytest.approx([622.1667] * 2, abs=1e-3)
    assert seen.value == 2


def test_mask_of_a_mesh_is_written(make):
    s, p = make({"t": touching()})
    mask = analyze(s, p, Settings(100.0, include_mesh=True)).mask
    assert "Join" not in mask._jdf.queryExecution().optimizedPlan().toString()
    assert mask.count() > 0
