"""Operators without checking SQL, against direct computation on small random images."""

import heapq
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import seed
from voxelgrain.operators import display_mesh, masks, nearest, outline, runs, split, surface, tracking
from voxelgrain.operators.tracking import SEED_SCHEMA
from voxelgrain.plans.analyze import Settings, analyze, split_analysis, sweep


def direct_split(mask, sx, sy, radius):
    """Distance, peaks, spacing, flooding and seed region by plain loops."""
    ny, nx = mask.shape
    bg = np.argwhere(~mask)
    d2 = np.zeros(mask.shape, dtype=int)
    for y, x in np.argwhere(mask):
        d2[y, x] = ((bg - (y, x)) ** 2).sum(axis=1).min()
    r = max(3, int(round(max(1.0, np.sqrt(d2[sy, sx])) * 0.75)))
    peaks = [
        (y, x) for y, x in np.argwhere(mask)
        if d2[y, x] == d2[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max()
    ]
    peaks.sort(key=lambda p: (-d2[p], p[0], p[1]))
    kept = []
    for p in peaks:
        if all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) >= r for q in kept):
            kept.append(p)
    mine = min(range(len(kept)), key=lambda i: (kept[i][1] - sx) ** 2 + (kept[i][0] - sy) ** 2)
    label = np.zeros(mask.shape, dtype=int)
    queue = []
    for i, p in sorted(enumerate(kept), key=lambda e: e[1]):
        label[p] = i + 1
        queue.append((-d2[p], 0, p[0] * nx + p[1]))
    heapq.heapify(queue)
    age = 0
    while queue:
        _, _, at = heapq.heappop(queue)
        y, x = divmod(at, nx)
        for b, a in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= b < ny and 0 <= a < nx and mask[b, a] and label[b, a] == 0:
                age += 1
                label[b, a] = label[y, x]
                heapq.heappush(queue, (-d2[b, a], age, b * nx + a))
    yy, xx = np.indices(mask.shape)
    return (label == mine + 1) & ((xx - sx) ** 2 + (yy - sy) ** 2 <= radius**2)


def test_polygon_seed_keeps_its_unrounded_centre(spark, make):
    """Two equal discs; the corners' mean (15.25, 10) is nearer to the right one, its rounded form to neither."""
    _, y, x = np.indices((1, 20, 32))
    stack = np.where((np.hypot(x - 10, y - 10) < 4) | (np.hypot(x - 20, y - 10) < 4), 9, 0)
    stacks, pixels = make({"a": stack})
    corners = [(5.0, 5.0), (25.5, 5.0), (25.5, 15.0), (5.0, 15.0)]
    seeds = spark.createDataFrame([seed("a", 0, 0, 0, points=corners), seed("a", 10, 10, 0, seed_id="t")], SEED_SCHEMA)
    parts = split_analysis(stacks, pixels, seeds, Settings(5.0)).mask
    ends = {r.seed_id: (r.a, r.b) for r in parts.groupBy("seed_id").agg(F.min("x0").alias("a"), F.max("x1").alias("b")).collect()}
    assert ends["s"][0] > 15 and ends["t"][1] < 15


def test_split_matches_direct_computation(spark, make):
    rng = np.random.default_rng(3)
    stack = np.zeros((6, 40, 50))
    y, x = np.indices((40, 50))
    for z in range(6):
        for _ in range(9):
            cy, cx, r = rng.integers(5, 35), rng.integers(5, 45), rng.integers(3, 9)
            stack[z][np.hypot(y - cy, x - cx) < r] = 1
    sx, sy, radius = 24, 20, 15.0
    s, p = make({"a": stack})
    frames = masks.stack_frames(s)
    found = runs.label_runs(runs.pixel_runs(p, ["stack_id"]), ["stack_id"], arranged=True)
    placed = tracking.place_seeds(spark.createDataFrame([seed("a", sx, sy, 2, radius)], SEED_SCHEMA), frames)
    got = {(r.z, r.y, r.x) for r in split.split_mask(found, frames, placed).collect()}
    want = {(z, b, a) for z in range(6) for b, a in np.argwhere(direct_split(stack[z] > 0, sx, sy, radius))}
    assert got == want and len(want) > 300


def test_split_of_scattered_pixels_matches_direct_computation(spark, make):
    rng = np.random.default_rng(16)
    stack = (rng.random((8, 30, 34)) < rng.choice([0.3, 0.6, 0.9], 8)[:, None, None]).astype(float)
    s, p = make({"a": stack})
    frames = masks.stack_frames(s)
    found = runs.label_runs(runs.pixel_runs(p, ["stack_id"]), ["stack_id"], arranged=True)
    placed = tracking.place_seeds(spark.createDataFrame([seed("a", 17, 15, 2, 9.0)], SEED_SCHEMA), frames)
    want = {(z, b, a) for z in range(8) for b, a in np.argwhere(direct_split(stack[z] > 0, 17, 15, 9.0))}
    assert {(r.z, r.y, r.x) for r in split.split_mask(found, frames, placed).collect()} == want


def test_nearest_of_many_against_all_pairs(spark):
    rng = np.random.default_rng(17)
    points = [(g, i, float(x), float(y), 64.0, float(r)) for g in range(3) for i, (x, y, r) in enumerate(zip(*rng.integers(0, 64, (2, 60)), rng.integers(1, 65, 60)))]
    # dense on one side only, with places that repeat
    targets = [(g, i, float(x) / 2, float(y) / 2, 64.0) for g in range(2) for i, (x, y) in enumerate(zip(rng.integers(0, 40, 150), rng.integers(0, 128, 150)))]
    p = spark.createDataFrame(points, "g int, i int, px double, py double, width double, reach double")
    t = spark.createDataFrame(targets, "g int, to_label int, tx double, ty double, width double")
    got = {(r.g, r.i): (r.to_label, r.d) for r in nearest.nearest_targets(p, t, ["g"], ["i"]).collect()}
    want = {}
    for g, i, px, py, _, reach in points:
        near = min(((tx - px) ** 2 + (ty - py) ** 2, label) for h, label, tx, ty, _ in targets if h == g) if g < 2 else (1e9, 0)
        if near[0] <= reach**2:
            want[g, i] = (near[1], near[0])
    assert got == want and 20 < len(want) < 120


def test_nearest_joins_few_rows_with_a_wide_reach(spark):
    """A reach as wide as the image: a point still meets only the targets in the cells around it."""
    targets = [(1, 100 * y + x, x * 10.0, y * 10.0, 1000.0) for y in range(100) for x in range(100)]
    points = [(1, i, 37.0 * i + 3, 991.0 - 29 * i, 1000.0, 1000.0) for i in range(25)]
    t = spark.createDataFrame(targets, "g int, to_label int, tx double, ty double, width double")
    p = spark.createDataFrame(points, "g int, i int, px double, py double, width double, reach double")
    met = []
    around = nearest._around

    def counted(table):
        found = around(table)
        met.append(found)
        return found

    nearest._around = counted
    try:
        assert nearest.nearest_targets(p, t, ["g"], ["i"]).count() == 25
    finally:
        nearest._around = around
    cells = t.selectExpr("g", "tx", "ty", "width", f"explode(sequence(0, {nearest.LEVELS})) as level").selectExpr(
        "g", "level", f"{nearest._cell('tx')} as gx", f"{nearest._cell('ty')} as gy"
    )
    assert met[1].join(cells, ["g", "level", "gx", "gy"]).count() <= 25 * 36


def test_labels_with_small_bands_match_flood_fill(spark, make):
    rng = np.random.default_rng(11)
    stack = (rng.random((3, 70, 60)) < 0.45).astype(float)
    s, p = make({"a": stack})
    for connectivity in (4, 8):
        want = {}
        for z in range(3):
            seen = np.zeros((70, 60), dtype=bool)
            for y, x in np.argwhere(stack[z] > 0):
                if seen[y, x]:
                    continue
                todo, members = [(y, x)], []
                seen[y, x] = True
                while todo:
                    b, a = todo.pop()
                    members.append((b, a))
                    for db in (-1, 0, 1):
                        for da in (-1, 0, 1):
                            if connectivity == 4 and db and da:
                                continue
                            n = (b + db, a + da)
                            if 0 <= n[0] < 70 and 0 <= n[1] < 60 and stack[z][n] and not seen[n]:
                                seen[n] = True
                                todo.append(n)
                want[(z, int(y), int(x))] = len(members)
        for band in (64, 9):
            found = runs.label_runs(
                runs.pixel_runs(p, ["stack_id"], band_rows=band), ["stack_id"], connectivity=connectivity,
                band_rows=band, arranged=True,
            )
            got = {(r.z, r.first_y, r.first_x): r.area for r in runs.run_components(found, ["stack_id"]).collect()}
            assert got == want


def test_component_tree_matches_single_thresholds(spark, make):
    rng = np.random.default_rng(12)
    s, p = make({"a": rng.integers(0, 6, (3, 40, 30)), "b": rng.integers(0, 3, (1, 9, 50))})
    twice = p.unionByName(p.withColumn("v", F.col("v") - 1))
    limits = [1.0, 2.5, 3.0, 4.0, 9.0]
    for connectivity, band in ((8, 64), (8, 7), (4, 7)):
        levels = runs.level_runs(twice, limits, band_rows=band)
        found = runs.label_levels(levels, limits, connectivity=connectivity, band_rows=band)
        for limit in limits:
            mask = p.where(F.col("v") >= limit).select("stack_id", "z", "y", "x")
            one = runs.label_runs(runs.pixel_runs(mask, ["stack_id"], band_rows=band), ["stack_id"], connectivity=connectivity, band_rows=band, arranged=True)
            got = found.where(F.col("threshold") == limit).select(*one.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))


def test_sweep_of_thresholds_on_both_sides_of_zero(spark, make):
    rng = np.random.default_rng(13)
    y, x = np.indices((30, 30))
    stack = np.where(np.hypot(y - 15, x - 15) < 9, 5, -2) * (rng.random((2, 30, 30)) < 0.98)
    s, p = make({"a": stack})
    limits = [-1.0, 0.0, 2.0, 5.0]
    swept = sweep(s, p, limits, Settings(0.0)).rows
    for limit in limits:
        want = analyze(s, p, Settings(limit)).rows
        got = swept.where(F.col("threshold") == limit).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="positive"):
        sweep(s, p, limits, Settings(0.0, only_positive=True))


def test_lowest_parabolas_and_window_maxima():
    rng = np.random.default_rng(14)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        height = np.where(rng.random(n) < 0.3, split.FAR, rng.integers(0, 300, n))
        cuts = np.unique(np.append(rng.integers(0, n, 3), [0, n]))
        got = split._lowest_parabolas(height, cuts)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            assert all(got[i] == min(height[j] + (i - j) ** 2 for j in range(a, b)) for i in range(a, b))
        group = np.sort(rng.integers(0, 4, n))
        place = np.concatenate([np.sort(rng.choice(500, (group == k).sum(), replace=False)) for k in range(4)])
        reach, value = rng.integers(1, 90, 4)[group], rng.integers(0, 50, n)
        got = split._window_maximum(group, place, value, reach, group, place, reach)
        for i in range(n):
            assert got[i] == max(value[(group == group[i]) & (abs(place - place[i]) <= reach[i])])


def test_closed_surface_of_random_masks_is_consistent(spark, make):
    """Closed surfaces: volume equals the sum of cell shares and every edge has two triangles."""
    rng = np.random.default_rng(5)
    stack = (rng.random((6, 7, 8)) < 0.5).astype(float)
    s, p = make({"a": stack}, voxel=(0.5, 2.0, 1.5))
    mask = runs.pixel_runs(p, ["stack_id"])
    cells = surface.cell_stretches(mask, s, ["stack_id"], pad=True)
    triangles = surface.surface_triangles(cells, s, ["stack_id"])
    edges = {}
    for t in triangles.collect():
        corners = [(t.x0, t.y0, t.z0), (t.x1, t.y1, t.z1), (t.x2, t.y2, t.z2)]
        for i in range(3):
            a, b = corners[i], corners[(i + 1) % 3]
            edges[(a, b)] = edges.get((a, b), 0) + 1
    assert all(edges.get((b, a), 0) == n for (a, b), n in edges.items())
    one = surface.measure_surface(cells, s, ["stack_id"]).first()
    two = surface.measure_triangles(triangles, ["stack_id"]).first()
    assert one.mesh_volume_um3 == pytest.approx(two.mesh_volume_um3)
    assert one.mesh_surface_area_um2 == pytest.approx(two.mesh_surface_area_um2)


def test_tetrahedron(spark):
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], dtype=float)
    faces = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    names = ["run"] + [f"{a}{i}" for i in range(3) for a in "xyz"]
    table = spark.createDataFrame([("t", *[float(c) for i in f for c in v[i]]) for f in faces], names)
    m = surface.measure_triangles(table, ["run"]).first()
    assert m.mesh_surface_area_um2 == pytest.approx(1.5 + np.sqrt(3) / 2)
    assert m.mesh_volume_um3 == pytest.approx(1 / 6)


def test_numbering_is_dense(spark):
    table = spark.range(500).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("cz"), (F.col("id") % 3).alias("cy"), F.col("id").alias("cx"))
    got = sorted(r.n for r in display_mesh.numbered(table, ["k"], ["cz", "cy"], ["cx"], "n").collect())
    assert got == list(range(500))


def test_sweep_of_rings_over_many_tasks(spark, make):
    """Surroundings of a shape stay in one task although the threshold among their keys is a fraction."""
    _, y, x = np.indices((3, 24, 24))
    ring = np.where((np.hypot(x - 11, y - 11) < 9) & (np.hypot(x - 11, y - 11) > 4), 50, 0)
    s, p = make({f"r{i}": ring for i in range(4)})
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        swept = sweep(s, p, [20.0, 40.5], Settings(0.0, only_positive=True)).rows.toPandas()
        single = analyze(s, p, Settings(40.5, only_positive=True)).rows.toPandas()
    finally:
        spark.conf.set(conf, before)
    order = ["stack_id", "frame_index"]
    wanted = single.sort_values(order)[["area_px2", "perimeter_px", "solidity"]].to_numpy()
    for limit in (20.0, 40.5):
        got = swept[swept.threshold == limit].sort_values(order)[["area_px2", "perimeter_px", "solidity"]].to_numpy()
        assert np.allclose(got, wanted)
    assert wanted[:, 0].max() < 24 * 24


def test_split_measures_distances_once(spark, make):
    stacks, pixels = make({"a": np.ones((1, 6, 6))})
    frames = masks.stack_frames(stacks)
    found = runs.label_runs(runs.pixel_runs(pixels, ["stack_id"]), ["stack_id"], arranged=True)
    placed = tracking.place_seeds(spark.createDataFrame([seed("a", 2, 2, 0, 3.0)], SEED_SCHEMA), frames)
    plan = split.split_mask(found, frames, placed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_split_broadcasts_no_pixels(spark, make, monkeypatch):
    """Distances, markers and regions never go through the driver, however small the files are that hold them."""
    stacks, pixels = make({"a": np.ones((2, 9, 9)), "b": np.eye(9)[None]})
    frames = masks.stack_frames(stacks)
    found = runs.label_runs(runs.pixel_runs(pixels, ["stack_id"]), ["stack_id"], arranged=True)
    placed = tracking.place_seeds(spark.createDataFrame([seed("a", 2, 2, 0, 3.0), seed("b", 2, 2, 0, 3.0)], SEED_SCHEMA), frames)
    plans, keep = [], split.materialize

    def seen(table):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return keep(table)

    monkeypatch.setattr(split, "materialize", seen)
    seen(split.split_mask(found, frames, placed))
    assert len(plans) == 3 and plans[1].count("Join") > 4 and plans[2].count("Join") > 4
    for plan in plans[1:]:
        lines = plan.splitlines()
        depth = [re.search(r"\w", line).start() if re.search(r"\w", line) else 0 for line in lines]
        for i in (i for i, line in enumerate(lines) if "BroadcastExchange" in line):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not re.search(r"\b(d2|label|mine)#|sequence\(_x0", "\n".join(lines[i:end]))


def counted(table):
    """The same table, and how many of its rows were made so far."""
    seen = table.sparkSession.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return table.mapInArrow(pass_on, table.schema), seen


def test_mesh_tables_make_triangles_once(spark, make):
    s, p = make({n: np.random.default_rng(i).random((4, 7, 6)) < 0.5 for i, n in enumerate("ab")}, voxel=(0.5, 0.25, 1.5))
    cells = surface.cell_stretches(runs.pixel_runs(p, ["stack_id"]), s, ["stack_id"])
    made = surface.surface_triangles(cells, s, ["stack_id"])
    triangles, seen = counted(made)
    vertices, faces = display_mesh.mesh_tables(triangles, ["stack_id"])
    rows, places = faces.collect(), {(v.stack_id, v.vertex): (v.x, v.y, v.z) for v in vertices.collect()}
    wanted = made.collect()
    assert seen.value == len(wanted)
    for name in "ab":
        order = sorted((t for t in wanted if t.stack_id == name), key=lambda t: (t.cz, t.cy, t.cx, t.tri))
        got = {f.face: [places[name, n] for n in (f.a, f.b, f.c)] for f in rows if f.stack_id == name}
        assert got == {i: [(t.x0, t.y0, t.z0), (t.x1, t.y1, t.z1), (t.x2, t.y2, t.z2)] for i, t in enumerate(order)}
        points = [places[name, n] for n in range(sum(stack == name for stack, _ in places))]
        assert points == sorted(set(points), key=lambda q: (q[2], q[1], q[0]))


@pytest.mark.parametrize("rows", [17, 70])
def test_few_seams_need_no_rounds(spark, make, monkeypatch, rows):
    """A winding line over bands of one row is one object; only more seams than one task joins are linked in rounds."""
    a = np.zeros((2, rows, 9))
    a[:, ::2] = 1
    a[:, 1::4, 8] = 1
    a[:, 3::4, 0] = 1
    s, p = make({"a": a, "b": a})
    rounds, connect = [], runs.connect
    monkeypatch.setattr(runs, "connect", lambda *given, **named: rounds.append(1) or connect(*given, **named))
    found = runs.label_runs(runs.pixel_runs(p, ["stack_id"], band_rows=1), ["stack_id"], connectivity=4, band_rows=1, arranged=True)
    got = runs.run_components(found, ["stack_id"]).collect()
    assert sorted((c.stack_id, c.z, c.label, c.area) for c in got) == [(n, z, 0, int(a[z].sum())) for n in "ab" for z in range(2)]
    assert {r.bottom for r in found.collect()} == {rows - 1}
    assert bool(rounds) == (rows > 17)


def test_runs_are_shuffled_rather_than_their_ends(make):
    s, p = make({"a": np.ones((3, 6, 6))})
    mask = runs.pixel_runs(p, ["stack_id"])
    for table in (
        surface.cell_stretches(mask, s, ["stack_id"]),
        outline.block_counts(mask.withColumn("label", F.lit(0)), ["stack_id"], band_rows=4),
    ):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("RepartitionByExpression")[0]
        assert any("Generate" in step and "x0#" in step for step in above.split("\n"))
