"""Intensity along straight probes, and the nearest significant edge on each of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.grouping import expand_sorted_groups

#: side of a tile in pixels, and probes sampled at a time
TILE, CHUNK = 128, 20000

# fixed values: an edge counts from this strength and this share of the strongest one
MIN_STRENGTH, STRENGTH_SHARE, OUTWARD_SHARE = 1.0, 0.2, 0.25


def intensity_profiles(probes: DataFrame, pixels: DataFrame, *, search: float, step: float, offset: float = 0.0) -> DataFrame:
    """(probe_id, stack_id, samples): intensities at ``s`` from -search to search along each probe's direction.

    ``probes`` has (probe_id, stack_id, x, y, z, dx, dy, dz, z_scale); samples are ordered and their number depends only on search
    and step. A sample takes the voxel nearest to it, half-even rounding; outside the stack is zero, and voxels are counted from
    zero. Probes go to the tiles of a slice that their samples touch, pixels to their own tile, so both are shuffled once; only
    probes cut by tiles are put together from their parts.
    """
    count = max(1, round(search / step))
    s = np.arange(-count, count + 1, dtype=np.float64) * step
    ends = [offset + float(s[0]), offset + float(s[-1])]
    place = {"x": "x + ({0}D) * dx", "y": "y + ({0}D) * dy", "z": "(z + ({0}D) * dz) / z_scale"}
    reach = {}
    for axis, text in place.items():
        first, last = (f"cast(bround({text.format(e)}) as int)" for e in ends)
        reach |= {f"_{axis}0": F.expr(f"greatest(0, least({first}, {last}))"), f"_{axis}1": F.expr(f"greatest(0, {first}, {last})")}

    def over(axis: str, size: int) -> Column:
        return F.explode(F.expr(f"sequence(cast(floor(_{axis}0 / {size}) as int), cast(floor(_{axis}1 / {size}) as int))"))

    numbers = ["x", "y", "z", "dx", "dy", "dz", "z_scale"]
    spread = (
        probes.select("probe_id", "stack_id", *[F.col(c).cast("double").alias(c) for c in numbers]).withColumns(reach)
        .withColumn("tz", over("z", 1)).withColumn("ty", over("y", TILE)).withColumn("tx", over("x", TILE))
    )
    group = ["stack_id", "tz", "ty", "tx"]
    one_tile = "_z0 = _z1 and floor(_y0 / {0}) = floor(_y1 / {0}) and floor(_x0 / {0}) = floor(_x1 / {0})".format(TILE)
    asked = spread.select(*group, "probe_id", F.expr(one_tile).alias("whole"), *numbers, F.lit(None).cast("double").alias("v"))
    given = pixels.select(
        "stack_id", F.col("z").cast("int").alias("tz"), F.expr(f"cast(floor(y / {TILE}) as int)").alias("ty"), F.expr(f"cast(floor(x / {TILE}) as int)").alias("tx"),
        F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.lit(False).alias("whole"),
        *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.lit(None).cast("double").alias(c) for c in numbers[3:]], F.col("v").cast("double").alias("v"),
    )
    sample = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("v", T.DoubleType())])
    schema = T.StructType([
        probes.schema["probe_id"], probes.schema["stack_id"], T.StructField("samples", T.ArrayType(sample)),
    ])
    shift = offset + s

    def sampled(table: pa.Table, number: np.ndarray, whole: bool) -> Iterator[pa.Table]:
        column = {c: table.column(c).to_numpy() for c in (*numbers, "ty", "tx", "tz", "v")}
        is_probe = table.column("dx").is_valid().to_numpy()
        low = {a: column[f"t{a}"].astype(np.int64) * TILE for a in "yx"}

        def cell(at: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
            return (number[at] * TILE + y - low["y"][at]) * TILE + x - low["x"][at]

        px = np.flatnonzero(~is_probe & table.column("v").is_valid().to_numpy())
        keys = cell(px, column["y"][px].astype(np.int64), column["x"][px].astype(np.int64))
        order = np.argsort(keys, kind="stable")
        # one more than any key, for samples beyond the last pixel
        keys, values = np.append(keys[order], np.iinfo(np.int64).max), np.append(column["v"][px][order], 0.0)
        chosen = np.flatnonzero(is_probe & (np.asarray(table.column("whole")) == whole))
        for begin in range(0, len(chosen), CHUNK):
            at = chosen[begin : begin + CHUNK, None]
            y, x = (np.rint(column[a][at] + shift * column[f"d{a}"][at]).astype(np.int64) for a in "yx")
            z = np.rint((column["z"][at] + shift * column["dz"][at]) / column["z_scale"][at]).astype(np.int64)
            # samples before the first row or column belong to the first tile, where they find no pixel
            in_tile = np.maximum(z, 0) == column["tz"][at]
            for a, n in (("y", y), ("x", x)):
                in_tile &= np.maximum(n, 0) // TILE == column[f"t{a}"][at]
            wanted = cell(at, y, x)
            found = np.searchsorted(keys, wanted)
            hit = in_tile & (z == column["tz"][at]) & (y >= 0) & (x >= 0) & (keys[found] == wanted)
            v = np.where(hit, values[found], 0.0)
            starts = np.append(0, np.cumsum(in_tile.sum(axis=1))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.broadcast_to(s, v.shape)[in_tile]), pa.array(v[in_tile])], ["s", "v"])
            rows = table.take(pa.array(at[:, 0])).select(["probe_id", "stack_id"])
            yield rows.append_column("samples", pa.ListArray.from_arrays(pa.array(starts), pairs))

    laid_out = asked.unionByName(given).repartition(*group)
    whole, cut = (
        expand_sorted_groups(laid_out, group, [], partial(sampled, whole=w), schema) for w in (True, False)
    )
    joined = cut.groupBy("probe_id", "stack_id").agg(F.array_sort(F.flatten(F.collect_list("samples"))).alias("samples"))
    return whole.unionByName(joined)


def edge_peaks(profiles: DataFrame) -> DataFrame:
    """Add ``peaks``: local maxima of the slope's magnitude at midpoints; the ends count as zero."""
    slope = "(samples[i + 1].v - samples[i].v) / (samples[i + 1].s - samples[i].s)"
    with_edges = profiles.withColumn(
        "_edges",
        F.expr(
            "transform(sequence(0, size(samples) - 2), i -> named_struct('s', (samples[i].s + samples[i + 1].s) / 2, "
            f"'slope', {slope}, 'strength', abs({slope})))"
        ),
    )
    peaks = (
        "filter(_edges, (e, j) -> e.strength >= if(j > 0, get(_edges, j - 1).strength, 0D) "
        "and e.strength >= if(j < size(_edges) - 1, get(_edges, j + 1).strength, 0D))"
    )
    return with_edges.withColumn("peaks", F.expr(peaks)).drop("_edges")


def nearest_edges(profiles: DataFrame, *, step: float, relaxed_within: float) -> DataFrame:
    """(probe_id, edge_s, relaxed): nearest outward significant edge, else the nearest of any side."""
    found = edge_peaks(profiles).withColumn(
        "_limit", F.expr(f"greatest({MIN_STRENGTH}D, {STRENGTH_SHARE}D * array_max(transform(peaks, p -> p.strength)))")
    ).withColumn("_strong", F.expr("filter(peaks, p -> p.strength >= _limit)")).withColumn(
        "_strong", F.expr("if(size(_strong) > 0, _strong, peaks)")
    )
    outward = f"array_min(transform(filter(_strong, p -> p.s > {step * OUTWARD_SHARE}D), p -> p.s))"
    nearest = "array_min(transform(_strong, p -> named_struct('m', abs(p.s), 's', p.s))).s"
    return found.select(
        "probe_id", "stack_id", F.expr(f"coalesce({outward}, {nearest})").alias("edge_s")
    ).withColumn("relaxed", F.expr(f"if(abs(edge_s) <= {relaxed_within}D, 1D, 0D)"))
