"""SQL fragments that describe the table-derived stacks to the checking engine."""

from __future__ import annotations

PIXELS = {
    "lineitem": (
        "SELECT l_returnflag || '-' || CAST(l_suppkey // 50 AS VARCHAR) AS stack_id, l_linenumber - 1 AS z, "
        "CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(l_quantity AS INTEGER) - 1 AS x, "
        "CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3, 4"
    ),
    "events": (
        "SELECT event_type || '-' || CAST(user_id // 32 AS VARCHAR) AS stack_id, CAST(day(ts) - 1 AS INTEGER) AS z, "
        "CAST(hour(ts) AS INTEGER) AS y, CAST(user_id % 32 AS INTEGER) AS x, round(sum(value), 2) AS v "
        "FROM events GROUP BY 1, 2, 3, 4"
    ),
    "embeddings": (
        "SELECT 'emb-' || CAST(vec_id // 20 AS VARCHAR) AS stack_id, CAST(vec_id % 20 AS INTEGER) AS z, "
        "CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v "
        "FROM embeddings, range(1, 65) AS r(i)"
    ),
    "profiles": (
        "SELECT 'users-' || CAST(user_id // 32 AS VARCHAR) AS stack_id, "
        "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS z, "
        "CAST(hour(ts) AS INTEGER) AS y, CAST(user_id % 32 AS INTEGER) AS x, round(sum(value), 2) AS v FROM events "
        "WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1, 2, 3, 4"
    ),
}
SHAPES = {"profiles": (5, 24, 32), "lineitem": (7, 11, 50), "events": (31, 24, 32), "embeddings": (20, 8, 8)}
VOXELS = {"profiles": (0.5, 0.5, 1.5), "lineitem": (0.5, 0.25, 1.0), "events": (1.0, 1.0, 2.0), "embeddings": (1.0, 1.0, 1.0)}
BASE = 4294967296


def px(table: str) -> str:
    """CTE ``px`` (stack_id, z, y, x, v)."""
    return f"px AS (SELECT * FROM ({PIXELS[table]}))"


def stacks(table: str) -> str:
    """CTEs ``px`` and ``st`` (stack_id)."""
    return f"{px(table)}, st AS (SELECT DISTINCT stack_id FROM px)"


def frames(table: str, zmin: int = 0, zmax: int | None = None) -> str:
    """CTEs ``px``, ``st`` and ``fr`` (stack_id, z)."""
    nz = SHAPES[table][0]
    return f"{stacks(table)}, fr AS (SELECT stack_id, CAST(z AS INTEGER) AS z FROM st, range({zmin}, {nz if zmax is None else zmax}) AS r(z))"


def dense(table: str) -> str:
    """CTEs up to ``dn`` (stack_id, z, y, x, v) with absent pixels as zero."""
    nz, ny, nx = SHAPES[table]
    return (
        f"{frames(table)}, dn AS (SELECT f.stack_id, f.z, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, coalesce(p.v, 0) AS v "
        f"FROM fr f, range(0, {ny}) AS a(y), range(0, {nx}) AS b(x) "
        "LEFT JOIN px p ON p.stack_id = f.stack_id AND p.z = f.z AND p.y = a.y AND p.x = b.x)"
    )


def labels(source: str = "fg", name: str = "lab", reach: str = "reach", connectivity: int = 8, keys: str = "stack_id, z") -> str:
    """CTEs labelling the pixels of ``source`` (keys, y, x) with the first pixel of their component."""
    key_list = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"f.{k} = r.{k}" for k in key_list)
    near = (
        "abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1" if connectivity == 8 else "abs(f.y - r.y) + abs(f.x - r.x) = 1"
    )
    offsets = "(-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)" if connectivity == 8 else "(-1,0),(0,-1),(0,1),(1,0)"
    return (
        f"{reach} AS (SELECT {keys}, y, x, CAST(y AS BIGINT) * {BASE} + x AS label FROM {source} UNION "
        f"SELECT {', '.join('f.' + k for k in key_list)}, f.y, f.x, r.label FROM {reach} r, (VALUES {offsets}) AS o(dy, dx), {source} f "
        f"WHERE {on} AND f.y = r.y + o.dy AND f.x = r.x + o.dx AND r.label < CAST(f.y AS BIGINT) * {BASE} + f.x), "
        f"{name} AS (SELECT {keys}, y, x, min(label) AS label FROM {reach} GROUP BY {keys}, y, x)"
    )


def components(source: str = "lab", name: str = "comp", keys: str = "stack_id, z") -> str:
    return (
        f"{name} AS (SELECT {keys}, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(y) AS ymin, max(y) AS ymax, "
        f"min(x) AS xmin, max(x) AS xmax FROM {source} GROUP BY {keys}, label)"
    )


def holes(source: str = "lab", keys: str = "stack_id, z") -> str:
    """CTEs ``fill`` (keys, label, y, x): pixels of components together with what they enclose.

    Each component's complement within its bounds, grown by one pixel, is searched from the corner.
    """
    key_list = [k.strip() for k in keys.split(",")]

    def same(a: str, b: str) -> str:
        return " AND ".join([f"{a}.{k} = {b}.{k}" for k in key_list] + [f"{a}.label = {b}.label"])

    return (
        f"bnd AS (SELECT {keys}, label, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM {source} GROUP BY {keys}, label), "
        f"cells AS (SELECT {keys}, label, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x FROM bnd, "
        "LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) a, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) b), "
        f"bg AS (SELECT c.* FROM cells c ANTI JOIN {source} l ON {same('c', 'l')} AND c.y = l.y AND c.x = l.x), "
        f"outside AS (SELECT {keys}, label, y0 AS y, x0 AS x FROM bnd UNION "
        f"SELECT {', '.join('g.' + k for k in key_list)}, g.label, g.y, g.x FROM outside o, (VALUES (-1,0),(1,0),(0,-1),(0,1)) AS d(dy, dx), bg g "
        f"WHERE {same('g', 'o')} AND g.y = o.y + d.dy AND g.x = o.x + d.dx), "
        f"hole AS (SELECT g.* FROM bg g ANTI JOIN outside o ON {same('g', 'o')} AND g.y = o.y AND g.x = o.x), "
        f"fill AS (SELECT {keys}, label, y, x FROM {source} UNION ALL SELECT {keys}, label, y, x FROM hole)"
    )


def quads(keys: str = "stack_id, z") -> str:
    """CTE ``quad`` (keys, label, n4, n3, nh, nv, nd) and ``shape`` with area and steps, from ``fill``."""
    return (
        f"corner AS (SELECT {keys}, label, y - d.dy AS by, x - d.dx AS bx, sum(1 << (2 * d.dy + d.dx)) AS k "
        f"FROM fill, (VALUES (0,0),(0,1),(1,0),(1,1)) AS d(dy, dx) GROUP BY ALL), "
        f"quad AS (SELECT {keys}, label, count(*) FILTER (WHERE k = 15) AS n4, count(*) FILTER (WHERE k IN (7, 11, 13, 14)) AS n3, "
        f"count(*) FILTER (WHERE k IN (3, 12)) AS nh, count(*) FILTER (WHERE k IN (5, 10)) AS nv, "
        f"count(*) FILTER (WHERE k IN (6, 9)) AS nd FROM corner GROUP BY {keys}, label), "
        f"shape AS (SELECT {keys}, label, n4 + n3 / 2.0 AS area_px2, nh AS steps_h, nv AS steps_v, n3 + 2 * nd AS steps_d, "
        f"nh + nv + sqrt(2) * (n3 + 2 * nd) AS perimeter_px FROM quad)"
    )
