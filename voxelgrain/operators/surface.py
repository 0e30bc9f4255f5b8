"""Three-dimensional surface of a mask stack by marching cubes over runs.

A cell's case depends on eight voxels. Along x it changes only where one of the four bounding runs
starts or stops, so cells are counted from run ends; the surface and the volume of a whole stack
then follow from how often each of the 256 cases occurs and where.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# corner number = 4 * dz + 2 * dy + dx


def _corner(n: int) -> tuple[int, int, int]:
    return (n & 1, n >> 1 & 1, n >> 2 & 1)


def _faces() -> list[list[int]]:
    """Corner cycles of the six cell faces, each seen counter-clockwise from outside."""
    faces = []
    for axis in range(3):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        faces.append([0, v, u | v, u])
        far = 1 << axis
        faces.append([far, far | u, far | u | v, far | v])
    return faces


def _loops(case: int) -> list[list[tuple[float, float, float]]]:
    """Closed polygons of edge midpoints that bound the set corners of one case."""
    follow: dict[tuple[int, int], tuple[int, int]] = {}
    for cycle in _faces():
        inside = [bool(case >> c & 1) for c in cycle]
        for i in range(4):
            if inside[i] or not inside[(i + 1) % 4]:
                continue
            # the boundary enters the set corners after i and leaves after the last of them
            j = (i + 1) % 4
            while inside[(j + 1) % 4]:
                j = (j + 1) % 4
            enter = tuple(sorted((cycle[i], cycle[(i + 1) % 4])))
            leave = tuple(sorted((cycle[j], cycle[(j + 1) % 4])))
            follow[leave] = enter
    loops = []
    while follow:
        start = min(follow)
        loop, edge = [], start
        while edge in follow:
            a, b = _corner(edge[0]), _corner(edge[1])
            loop.append(tuple((p + q) / 2 for p, q in zip(a, b)))
            edge = follow.pop(edge)
        loops.append(loop)
    return loops


def _cross(a, b, c) -> tuple[float, float, float]:
    p = [b[i] - a[i] for i in range(3)]
    q = [c[i] - a[i] for i in range(3)]
    return (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])


def _fan(loop: list) -> list[tuple]:
    """Triangles of a loop, fanned from the start vertex that gives the largest area."""
    best, best_area = [], -1.0
    for s in range(len(loop)):
        turned = loop[s:] + loop[:s]
        triangles = [(turned[0], turned[i], turned[i + 1]) for i in range(1, len(turned) - 1)]
        area = sum(math.dist((0, 0, 0), _cross(*t)) / 2 for t in triangles)
        if area > best_area + 1e-12:
            best, best_area = triangles, area
    return best


@lru_cache(maxsize=1)
def case_triangles() -> list[tuple[int, int, tuple]]:
    """(case, number, three points) for all 256 cases, generated from the face rule above."""
    table = []
    for case in range(256):
        number = 0
        for loop in _loops(case):
            for triangle in _fan(loop):
                table.append((case, number, triangle))
                number += 1
    return table


def triangle_table(spark: SparkSession) -> DataFrame:
    """The case table as rows: corner points within the cell (x, y, z). At most 256 small groups."""
    rows = [(case, n, *[float(c) for point in t for c in point]) for case, n, t in case_triangles()]
    kinds = {"cell_case": pa.int32(), "tri": pa.int32(), **{f"{axis}{i}": pa.float64() for i in range(3) for axis in "xyz"}}
    # a local relation, which costs no job of its own
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), zip(*rows))}))


def cell_stretches(mask: DataFrame, shapes: DataFrame, keys: Sequence[str], *, pad: bool = False) -> DataFrame:
    """Stretches of equal cells: (keys, cz, cy, cx, len, cell_case) for cells that hold some voxel.

    ``mask`` has (keys, z, y, x0, x1) with z counted from the first analysed slice, runs of one row
    disjoint; ``shapes`` has (keys, nz, ny, nx). Cells lie between voxel centres; ``pad`` adds a
    layer around the stack so that surfaces close.
    """
    keys = list(keys)
    line = [*keys, "cz", "cy"]
    # a run goes once to each of the four lines of cells around it; its ends are spelled out there
    corners = ", ".join(f"struct(z - {dz} as cz, y - {dy} as cy, {1 << (2 * dz + dy)} as d)" for dz in (0, 1) for dy in (0, 1))
    laid_out = mask.select(*keys, "x0", "x1", F.explode(F.expr(f"array({corners})")).alias("e")).select(
        *keys, "e.cz", "e.cy", "e.d", "x0", "x1"
    ).repartition(*line)
    ends = laid_out.select(*line, F.explode(F.expr("array(struct(x0 as x, d as d), struct(x1 + 1 as x, -d as d))")).alias("e"))
    steps = ends.select(*line, "e.x", "e.d").groupBy(*line, "x").agg(F.sum("d").cast("int").alias("d"))
    order = Window.partitionBy(*line).orderBy("x")
    states = steps.withColumn("now", F.sum("d").over(order).cast("int")).withColumn("next_x", F.lead("x").over(order))
    # bits of a column: 1 = (z, y), 2 = (z, y+1), 4 = (z+1, y), 8 = (z+1, y+1)
    spread = "({0} & 1) + ({0} & 2) * 2 + ({0} & 4) * 4 + ({0} & 8) * 8"
    left, right = spread.format("(now - d)"), spread.format("now")
    both = states.select(
        *line,
        F.explode(
            F.expr(
                f"array(struct(x - 1 as cx, 1 as len, {left} + 2 * ({right}) as cell_case), "
                f"struct(x as cx, coalesce(next_x - x - 1, 0) as len, 3 * ({right}) as cell_case))"
            )
        ).alias("s"),
    ).select(*line, "s.cx", "s.len", F.col("s.cell_case").cast("int").alias("cell_case"))
    both = both.where("len > 0 and cell_case > 0 and cell_case < 255").join(shapes.select(*keys, "nz", "ny", "nx"), keys)
    low = -1 if pad else 0
    inner = both.where(f"cz >= {low} and cy >= {low} and cz < nz - 1 - ({low}) and cy < ny - 1 - ({low})")
    return (
        inner.withColumn("first", F.greatest("cx", F.lit(low)))
        .withColumn("last", F.least(F.expr("cx + len - 1"), F.expr(f"nx - 2 - ({low})")))
        .where("last >= first")
        .select(*line, F.col("first").alias("cx"), F.expr("last - first + 1").alias("len"), "cell_case")
    )


def measure_surface(stretches: DataFrame, voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surface area, volume, equivalent sphere diameter and sphericity per run.

    Only the counts and coordinate sums of each case are needed, at most 254 rows per run.
    """
    keys = list(keys)
    spark = stretches.sparkSession
    tally = stretches.groupBy(*keys, "cell_case").agg(
        F.expr("sum(cast(len as double))").alias("n"),
        F.expr("sum(len * (cx + (len - 1) / 2D))").alias("sx"),
        F.expr("sum(cast(len as double) * cy)").alias("sy"),
        F.expr("sum(cast(len as double) * cz)").alias("sz"),
    )
    normals = triangle_table(spark).select(
        "cell_case", "x0", "y0", "z0",
        F.expr("(y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)").alias("nx_"),
        F.expr("(z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)").alias("ny_"),
        F.expr("(x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)").alias("nz_"),
    )
    joined = tally.join(F.broadcast(normals), "cell_case").join(voxels.select(*keys, "vx_um", "vy_um", "vz_um"), keys)
    area = "n * sqrt(pow(nx_ * vy_um * vz_um, 2) + pow(ny_ * vx_um * vz_um, 2) + pow(nz_ * vx_um * vy_um, 2)) / 2"
    volume = "((sx + n * x0) * nx_ + (sy + n * y0) * ny_ + (sz + n * z0) * nz_) * vx_um * vy_um * vz_um / 6"
    return mesh_shape(
        joined.groupBy(*keys).agg(
            F.expr(f"sum({area})").alias("mesh_surface_area_um2"), F.expr(f"abs(sum({volume}))").alias("mesh_volume_um3")
        )
    )


def mesh_shape(measured: DataFrame) -> DataFrame:
    """Add the diameter of the sphere of equal volume, and sphericity (at most one)."""
    return measured.withColumns(
        {
            "mesh_equivalent_sphere_diameter_um": F.expr(
                "if(mesh_volume_um3 <= 0, 0D, pow(6 * mesh_volume_um3 / pi(), 1D / 3))"
            ),
            "mesh_sphericity": F.expr(
                "if(mesh_volume_um3 <= 0 or mesh_surface_area_um2 <= 0, 0D, "
                "least(1D, pow(pi(), 1D / 3) * pow(6 * mesh_volume_um3, 2D / 3) / mesh_surface_area_um2))"
            ),
        }
    )


def surface_triangles(stretches: DataFrame, voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per triangle with scaled corner points x0..z2."""
    keys = list(keys)
    cells = stretches.select(*keys, "cz", "cy", F.explode(F.expr("sequence(cx, cx + len - 1)")).alias("cx"), "cell_case")
    placed = cells.join(F.broadcast(triangle_table(stretches.sparkSession)), "cell_case").join(
        voxels.select(*keys, "vx_um", "vy_um", "vz_um"), keys
    )
    return placed.select(
        *keys, "cz", "cy", "cx", "tri",
        *[F.expr(f"(c{a} + {a}{i}) * v{a}_um").alias(f"{a}{i}") for i in range(3) for a in "xyz"],
    )


def measure_triangles(triangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surface area and volume of a triangle table (any closed or open mesh)."""
    area, volume = (
        "sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) "
        "+ pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2",
        "(x0 * ((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)) + y0 * ((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)) "
        "+ z0 * ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))) / 6",
    )
    return mesh_shape(
        triangles.groupBy(*keys).agg(
            F.expr(f"sum({area})").alias("mesh_surface_area_um2"), F.expr(f"abs(sum({volume}))").alias("mesh_volume_um3")
        )
    )
