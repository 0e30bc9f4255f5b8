"""SQL that checks splitting: distance peaks, their greedy spacing, and the flood from markers, one pixel of each slice a step."""

from __future__ import annotations

from catalog import sql
from catalog.frames import ROUND_METRICS, T, _rounded, rows_sql
from catalog.tracks import bright_seeds
from voxelgrain.plans.analyze import Settings, split_analysis
from voxelgrain.sources.table_stacks import ADAPTERS


def split_by_slice(spark, folder):
    """A list of two thresholds for five slices: the last one counts for the rest."""
    s = ADAPTERS["profiles"](spark, folder)
    a = split_analysis(s.stacks, s.pixels, bright_seeds(s), Settings((T["profiles"], 35.0), only_positive=True))
    return _rounded(a.rows.select("stack_id", "frame_index", "threshold", "method", "area_px2", "perimeter_px"))


QUERIES = {"split_thresholds_by_slice": split_by_slice}

_T = T["profiles"]
_FAR = sql.SHAPES["profiles"][2]

# distances, components, the seed of every stack and its spacing on every slice
_DISTANCES = (
    f"{sql.dense('profiles')}, fg AS (SELECT stack_id, z, y, x FROM dn WHERE v >= {_T}), gb AS (SELECT stack_id, z, y, x FROM dn WHERE v < {_T}), {sql.labels()}, "
    "dm AS MATERIALIZED (SELECT f.stack_id, f.z, f.y, f.x, f.label, CAST(min((f.x - b.x) ** 2 + (f.y - b.y) ** 2) AS BIGINT) AS d2 "
    "FROM lab f JOIN gb b ON f.stack_id = b.stack_id AND f.z = b.z GROUP BY ALL), "
    "sd AS (SELECT stack_id, y AS sy, x AS sx FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY v DESC, z, y, x) AS rn FROM px) WHERE rn = 1), "
    "rr AS (SELECT f.stack_id, f.z, s.sy, s.sx, CAST(greatest(3, round_even(greatest(1, coalesce(sqrt(d.d2), 0)) * 0.75, 0)) AS INTEGER) AS r FROM fr f JOIN sd s USING (stack_id) "
    "LEFT JOIN dm d ON d.stack_id = f.stack_id AND d.z = f.z AND d.y = s.sy AND d.x = s.sx)"
)
_MARKERS = (
    f"{_DISTANCES}, flat AS (SELECT stack_id, z FROM dm GROUP BY ALL HAVING count(*) = (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AND min(d2) = max(d2)), "
    "tall AS (SELECT d.stack_id, d.z, d.y, d.x, d.label, d.d2, r.r FROM dm d JOIN rr r USING (stack_id, z) ANTI JOIN flat USING (stack_id, z)), "
    "peak AS (SELECT a.stack_id, a.z, a.y, a.x, any_value(a.label) AS label, any_value(a.d2) AS d2, any_value(a.r) AS r FROM tall a JOIN tall b "
    "ON a.stack_id = b.stack_id AND a.z = b.z AND abs(a.y - b.y) <= a.r AND abs(a.x - b.x) <= a.r GROUP BY a.stack_id, a.z, a.y, a.x HAVING max(b.d2) = any_value(a.d2)), "
    "turn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stack_id, z ORDER BY d2 DESC, y, x) AS n FROM peak), "
    "grd AS (SELECT stack_id, z, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(y INTEGER, x INTEGER)[]) AS kept FROM fr UNION ALL "
    "SELECT g.stack_id, g.z, t.n, CASE WHEN len(list_filter(g.kept, lambda k: greatest(abs(k.y - t.y), abs(k.x - t.x)) < t.r)) = 0 "
    "THEN list_append(g.kept, struct_pack(y := t.y, x := t.x)) ELSE g.kept END FROM grd g JOIN turn t ON t.stack_id = g.stack_id AND t.z = g.z AND t.n = g.n + 1), "
    "spaced AS (SELECT stack_id, z, unnest(ks) AS k FROM (SELECT stack_id, z, arg_max(kept, n) AS ks FROM grd GROUP BY stack_id, z)), "
    "mk AS MATERIALIZED (SELECT stack_id, z, y, x, label, d2, row_number() OVER (PARTITION BY stack_id, z ORDER BY (x - sx) ** 2 + (y - sy) ** 2, d2 DESC, y, x) = 1 AS mine "
    "FROM (SELECT p.*, r.sy, r.sx FROM peak p JOIN spaced s ON s.stack_id = p.stack_id AND s.z = p.z AND s.k.y = p.y AND s.k.x = p.x JOIN rr r ON r.stack_id = p.stack_id AND r.z = p.z))"
)
_SAME = "{0}.stack_id = {1}.stack_id AND {0}.z = {1}.z"
_SPLIT = (
    f"{_MARKERS}, whole AS (SELECT d.stack_id, d.z, d.y, d.x, d.d2 FROM dm d JOIN mk m ON {_SAME.format('d', 'm')} AND d.label = m.label WHERE m.mine), "
    "fld(stack_id, z, p, y, x, height, mark, age, done) USING KEY (stack_id, z, p) AS ("
    f"SELECT w.stack_id, w.z, w.y * {_FAR} + w.x, w.y, w.x, -w.d2, CASE WHEN m.mine THEN 2 WHEN NOT m.mine THEN 1 ELSE 0 END, CAST(0 AS BIGINT), false "
    f"FROM whole w LEFT JOIN mk m ON {_SAME.format('w', 'm')} AND w.y = m.y AND w.x = m.x UNION "
    "(WITH top AS (SELECT stack_id, z, arg_min(struct_pack(p := p, y := y, x := x, height := height, mark := mark, age := age), struct_pack(h := height, a := age, p := p)) AS t "
    "FROM recurring.fld WHERE mark > 0 AND NOT done GROUP BY stack_id, z), last AS (SELECT stack_id, z, max(age) AS age FROM recurring.fld GROUP BY stack_id, z) "
    "SELECT stack_id, z, t.p, t.y, t.x, t.height, t.mark, t.age, true FROM top UNION ALL "
    f"SELECT n.stack_id, n.z, n.p, n.y, n.x, n.height, q.t.mark, l.age + o.k, false FROM top q JOIN last l ON {_SAME.format('q', 'l')}, (VALUES (-1, 0, 1), (0, -1, 2), (0, 1, 3), (1, 0, 4)) AS o(dy, dx, k), recurring.fld n "
    f"WHERE {_SAME.format('n', 'q')} AND n.y = q.t.y + o.dy AND n.x = q.t.x + o.dx AND n.mark = 0)), "
    "part AS (SELECT stack_id, z, y, x FROM fld WHERE mark = 2 UNION ALL SELECT d.stack_id, d.z, d.y, d.x FROM dm d JOIN dm s ON "
    f"{_SAME.format('d', 's')} AND d.label = s.label JOIN sd ON sd.stack_id = s.stack_id AND sd.sy = s.y AND sd.sx = s.x WHERE NOT EXISTS (SELECT 1 FROM mk m WHERE {_SAME.format('m', 'd')})), "
    "cut AS (SELECT p.* FROM part p JOIN sd USING (stack_id) WHERE (p.x - sx) ** 2 + (p.y - sy) ** 2 <= 36)"
)

_LISTED = "CASE WHEN {z} = 0 THEN 20.0 ELSE 35.0 END"
_BY_SLICE = _SPLIT.replace(f"v >= {_T}", f"v >= {_LISTED.format(z='z')}").replace(f"v < {_T}", f"v < {_LISTED.format(z='z')}")

ORACLES = {
    "split_thresholds_by_slice": (
        f"WITH RECURSIVE own AS MATERIALIZED (WITH RECURSIVE {_BY_SLICE} SELECT * FROM cut), "
        + rows_sql("profiles", where="EXISTS (SELECT 1 FROM own WHERE own.stack_id = px.stack_id AND own.z = px.z AND own.y = px.y AND own.x = px.x)")
        + f" SELECT stack_id, frame_index, CAST({_LISTED.format(z='frame_index')} AS DOUBLE) AS threshold, CASE WHEN has_contour THEN 'active_surfaces' ELSE 'active_surfaces_empty' END AS method, "
        "round(area_px2, 6) AS area_px2, round(perimeter_px, 6) AS perimeter_px FROM rw"
    ),
    "seed_markers": f"WITH RECURSIVE {_MARKERS} SELECT stack_id, z, y, x, d2, mine FROM mk",
    "split_pixels": (
        f"WITH RECURSIVE {_SPLIT} SELECT stack_id, z, count(*) AS pixels, min(y) AS ymin, max(y) AS ymax, min(x) AS xmin, max(x) AS xmax FROM cut GROUP BY 1, 2"
    ),
    "split_frame_rows": (
        f"WITH RECURSIVE own AS MATERIALIZED (WITH RECURSIVE {_SPLIT} SELECT * FROM cut), "
        + rows_sql("profiles", where="EXISTS (SELECT 1 FROM own WHERE own.stack_id = px.stack_id AND own.z = px.z AND own.y = px.y AND own.x = px.x)")
        + f" SELECT stack_id, 'bright' AS seed_id, frame_index, threshold, 'active_surfaces' AS profile, CASE WHEN has_contour THEN 'active_surfaces' ELSE 'active_surfaces_empty' END AS method, "
        f"excluded, has_contour, {ROUND_METRICS} FROM rw"
    ),
}
