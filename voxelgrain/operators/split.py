"""Splitting touching objects: distance maps, peaks, and flooding from markers.

Distances are built from runs along x and finished column by column; peaks by two sliding maxima. Both take time
in proportion to the pixels, whatever the distances and spacings.
Only the flooding itself is sequential, and it is confined to the one component that holds the
seed's marker on one slice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.grouping import expand_sorted_groups, map_sorted_groups
from voxelgrain.operators.tracking import seed_region
from voxelgrain.session import materialize, never_broadcast

FAR = 1 << 60


def _column_distance(y, row, group, size):
    """Squared distance to the background within one column, given squared distances along rows."""
    breaks = np.ones(len(y), dtype=bool)
    breaks[1:] = (group[1:] != group[:-1]) | (y[1:] != y[:-1] + 1)
    piece = np.cumsum(breaks) - 1
    first = np.flatnonzero(breaks)
    top = y[first][piece]
    bottom = y[np.append(first[1:], len(y)) - 1][piece]
    best = _lowest_parabolas(row, np.append(np.flatnonzero(breaks), len(y)))
    for edge, gap in ((top > 0, y - top + 1), (bottom < size - 1, bottom - y + 1)):
        best = np.where(edge, np.minimum(best, gap * gap), best)
    return best


def _lowest_parabolas(height: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every place of a piece the least height[j] + (place - j)^2 over all places j of the piece.

    Which j is least never moves back as the place moves on. So the middle place of a stretch is decided first, and both halves
    search only to its side of the j found there: each halving looks at every place about once, whatever the distances are.
    """
    best = np.empty(len(height), np.int64)
    begin, end = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    low, high = begin, end - 1
    while len(begin):
        middle = (begin + end) // 2
        many = high - low + 1
        start = np.cumsum(many) - many
        stretch = np.repeat(np.arange(len(middle)), many)
        other = np.arange(many.sum()) - start[stretch] + low[stretch]
        value = height[other] + (middle[stretch] - other) ** 2
        least = np.minimum.reduceat(value, start)
        best[middle] = least
        hits = np.flatnonzero(value == least[stretch])
        chosen = other[hits[np.searchsorted(stretch[hits], np.arange(len(middle)))]]
        begin, end = np.concatenate([begin, middle + 1]), np.concatenate([middle, end])
        low, high = np.concatenate([low, chosen]), np.concatenate([chosen, high])
        some = end > begin
        begin, end, low, high = begin[some], end[some], low[some], high[some]
    return best


def distance_map(runs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, z, label, y, x, d2): squared distance of every mask pixel to the nearest background.

    Outside the image is not background. Without any background in reach ``d2`` is null.
    """
    keys = list(keys)
    sized = runs.join(frames.select(*keys, "z", "ny", "nx"), [*keys, "z"])
    pixels = sized.select(
        *keys, "z", "label", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "x0", "x1", "nx", "ny"
    ).select(
        *keys, "z", "label", "y", "x", "ny",
        F.expr(
            f"least(if(x0 > 0, pow(x - x0 + 1, 2), {FAR}), if(x1 < nx - 1, pow(x1 - x + 1, 2), {FAR}))"
        ).cast("bigint").alias("row2"),
    )

    def work(table: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
        y = table.column("y").to_numpy().astype(np.int64)
        row = table.column("row2").to_numpy().astype(np.int64)
        return {"d2": _column_distance(y, row, group, table.column("ny").to_numpy().astype(np.int64))}

    done = map_sorted_groups(pixels, [*keys, "z", "x"], ["y"], work, [("d2", T.LongType())])
    return done.select(*keys, "z", "label", "y", "x", F.expr(f"if(d2 >= {FAR}, null, d2)").alias("d2"))


def box_maximum(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``peak``: is a pixel's ``d2`` the largest within ``r`` pixels along both axes?

    The first maximum goes along the rows, also for the places outside the mask that lie within ``r`` of it, because a column
    has to see past pixels that are not in it.
    """
    keys = list(keys)
    schema = T.StructType([*values.schema.fields, T.StructField("mx", T.LongType()), T.StructField("real", T.BooleanType())])

    def rows(table: pa.Table, group: np.ndarray) -> Iterator[pa.Table]:
        place, value, reach = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "d2", "r"))
        count = len(place)
        before = np.append(True, group[1:] != group[:-1])
        free = np.where(before, place, place - np.append(0, place[:-1]) - 1)
        free_after = np.where(np.append(before[1:], True), reach, np.append(free[1:], 0))
        right = np.minimum(reach, free_after)
        # to the left only what the pixel before does not reach
        left = np.where(before, np.minimum(reach, place), np.clip(free - reach, 0, reach))
        source, step = _stretches(right)
        source2, step2 = _stretches(left)
        source = np.concatenate([np.arange(count), source, source2])
        where = place[source] + np.concatenate([np.zeros(count, np.int64), step, -step2])
        most = _window_maximum(group, place, value, reach, group[source], where, reach[source])
        made = table.take(pa.array(source))
        at = made.schema.get_field_index("x")
        made = made.set_column(at, "x", pa.array(where).cast(table.schema.field("x").type))
        yield made.append_column("mx", pa.array(most)).append_column("real", pa.array(np.arange(len(source)) < count))

    def columns(table: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
        place, value, reach = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "mx", "r"))
        return {"my": _window_maximum(group, place, value, reach, group, place, reach)}

    line = [*keys, "z", "y"]
    along_x = expand_sorted_groups(values.repartition(*line), line, ["x"], rows, schema)
    along_y = map_sorted_groups(along_x, [*keys, "z", "x"], ["y"], columns, [("my", T.LongType())])
    return along_y.where("real").withColumn("peak", F.expr("d2 = my")).drop("mx", "my", "real")


def _stretches(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, 1), (i, 2), ... (i, many[i]) for every i."""
    source = np.repeat(np.arange(len(many)), many)
    return source, np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + 1


def _window_maximum(
    group: np.ndarray, place: np.ndarray, value: np.ndarray, reach: np.ndarray,
    at_group: np.ndarray, at_place: np.ndarray, at_reach: np.ndarray,
) -> np.ndarray:
    """Largest value within ``reach`` of every asked place; the reach is the same for a whole group.

    Values are sorted by (group, place) and every asked place has one in reach. Places are cut into blocks as wide as the window,
    which then meets two blocks at most: the end of one and the start of the next. With running maxima from both ends of every
    block each window costs two look-ups, however wide it is.
    """
    if not len(place):
        return value
    block = place // (2 * reach + 1)
    levels, rank = np.unique(value, return_inverse=True)
    number = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (block[1:] != block[:-1])))
    size = len(levels) + 1
    onward = np.maximum.accumulate(rank + number * size) - number * size
    behind = (number[-1] + 1 - number) * size
    back = np.maximum.accumulate((rank + behind)[::-1])[::-1] - behind
    margin = int(at_reach.max()) + 1
    span = int(max(place.max(), at_place.max())) + 3 * margin
    key, at = group * span + place + margin, at_group * span + at_place + margin
    first = np.minimum(np.searchsorted(key, at - at_reach, side="left"), len(key) - 1)
    last = np.maximum(np.searchsorted(key, at + at_reach, side="right") - 1, 0)
    wide = 2 * at_reach + 1
    ends = (group[first] == at_group) & (block[first] == (at_place - at_reach) // wide)
    starts = (group[last] == at_group) & (block[last] == (at_place + at_reach) // wide)
    return levels[np.maximum(np.where(ends, back[first], -1), np.where(starts, onward[last], -1))]


def _spaced(y, x, group, reach):
    """Greedy choice in the given order: a point is kept unless a kept one is nearer than its reach."""
    keep = np.zeros(len(y), dtype=bool)
    cells: dict[tuple[int, int], list[int]] = {}
    current = -1
    for i in range(len(y)):
        if group[i] != current:
            current, cells = group[i], {}
        r = int(reach[i])
        cy, cx = int(y[i]) // r, int(x[i]) // r
        near = (
            j for a in (cy - 1, cy, cy + 1) for b in (cx - 1, cx, cx + 1) for j in cells.get((a, b), ())
        )
        if any(max(abs(int(y[j]) - int(y[i])), abs(int(x[j]) - int(x[i]))) < r for j in near):
            continue
        keep[i] = True
        cells.setdefault((cy, cx), []).append(i)
    return keep


def _flood(y, x, height, marker):
    """Grow numbered markers over 4-connected pixels, lowest height first, oldest first on ties."""
    index = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(y, x))}
    label = np.zeros(len(y), dtype=np.int64)
    queue, age = [], 0
    for i in np.flatnonzero(marker > 0):
        label[i] = marker[i]
        heapq.heappush(queue, (int(height[i]), 0, int(i)))
    while queue:
        _, _, i = heapq.heappop(queue)
        for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            j = index.get((int(y[i]) + dy, int(x[i]) + dx))
            if j is not None and label[j] == 0:
                age += 1
                label[j] = label[i]
                heapq.heappush(queue, (int(height[j]), age, j))
    return label


def markers(distances: DataFrame, placed: DataFrame, frames: DataFrame) -> DataFrame:
    """(stack_id, seed_id, z, label, y, x, d2, r, mine): spaced distance peaks; ``mine`` is nearest the seed.

    The spacing is three quarters of the distance at the seed, at least three pixels. Slices whose
    mask is a full box of equal distances have no peak.
    """
    key = ["stack_id", "seed_id", "z"]
    distances = never_broadcast(distances)
    seeds = placed.select("stack_id", "seed_id", "sx", "sy", "centre_x", "centre_y")
    per_slice = frames.select("stack_id", "z").join(seeds, "stack_id")
    here = distances.select("stack_id", "z", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("d2").alias("_s2"))
    spacing = per_slice.join(here, ["stack_id", "z", "sx", "sy"], "left").select(
        *key, "centre_x", "centre_y",
        F.expr("cast(greatest(3, bround(greatest(1D, coalesce(sqrt(_s2), 0D)) * 0.75)) as int)").alias("r"),
    )
    shape = distances.groupBy("stack_id", "z").agg(
        F.expr("count(*) = (max(y) - min(y) + 1L) * (max(x) - min(x) + 1L) and min(d2) = max(d2)").alias("flat")
    )
    # peaks depend on the spacing only, so seeds that ask for the same one share them
    per_spacing = ["stack_id", "z", "r"]
    tall = never_broadcast(distances.join(shape.where("not flat").select("stack_id", "z"), ["stack_id", "z"]))
    values = tall.join(spacing.select(*per_spacing).distinct(), ["stack_id", "z"])
    peaks = box_maximum(values.where("d2 is not null"), ["stack_id", "r"]).where("peak").withColumn("_order", -F.col("d2"))

    def work(table: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
        y, x, r = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "r"))
        return {"kept": _spaced(y, x, group, r)}

    spaced = map_sorted_groups(peaks, per_spacing, ["_order", "y", "x"], work, [("kept", T.BooleanType())]).where("kept")
    offered = spaced.join(spacing, per_spacing)
    near = F.expr("pow(x - centre_x, 2) + pow(y - centre_y, 2)")
    best = offered.groupBy(*key).agg(F.min_by(F.struct("y", "x"), F.struct(near, "_order", "y", "x")).alias("_m"))
    return offered.join(best, key).select(
        *key, "label", "y", "x", "d2", "r", F.expr("y = _m.y and x = _m.x").alias("mine")
    )


def split_mask(runs: DataFrame, frames: DataFrame, placed: DataFrame) -> DataFrame:
    """(stack_id, seed_id, z, y, x): the seeded part of the mask on every slice.

    Slices without peaks keep the component under the seed.
    """
    key = ["stack_id", "seed_id", "z"]
    # both are read by several joins, each of which would measure distances and space peaks again
    distances = never_broadcast(materialize(distance_map(runs, frames, ["stack_id"])))
    found = never_broadcast(materialize(markers(distances, placed, frames)))
    held = found.where("mine").select(*key, "label")
    inside = distances.join(held, ["stack_id", "z", "label"]).join(
        found.select(*key, "y", "x", F.when(F.col("mine"), 2).otherwise(1).alias("_m")), [*key, "y", "x"], "left"
    )
    # several markers must stay apart: number them by place, the seed's is the largest
    numbered = inside.select(
        *key, "label", "y", "x", (-F.col("d2")).alias("height"),
        F.expr("case _m when 2 then 9223372036854775807L when 1 then cast(y as bigint) * 2147483648L + x + 1 else 0L end").alias("marker"),
    )

    def work(table: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
        y, x, height, marker = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "height", "marker"))
        label = np.zeros(len(y), dtype=np.int64)
        edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(y))
        for a, b in zip(edges[:-1], edges[1:]):
            # markers enter the queue in raster order of the slice
            label[a:b] = _flood(y[a:b], x[a:b], height[a:b], marker[a:b])
        return {"basin": label}

    flooded = map_sorted_groups(numbered, [*key, "label"], ["y", "x"], work, [("basin", T.LongType())])
    basin = flooded.where("basin = 9223372036854775807L").select(*key, "y", "x")
    # slices without peaks: the whole component at the seed
    seeds = frames.select("stack_id", "z").join(placed.select("stack_id", "seed_id", "sx", "sy"), "stack_id")
    lacking = seeds.join(held.select(*key), key, "left_anti")
    at_seed = lacking.join(
        distances.select("stack_id", "z", F.col("y").alias("sy"), F.col("x").alias("sx"), "label"), ["stack_id", "z", "sy", "sx"]
    ).select(*key, "label")
    whole = distances.select("stack_id", "z", "label", "y", "x").join(at_seed, ["stack_id", "z", "label"]).select(*key, "y", "x")
    region = never_broadcast(seed_region(placed, far_edge=True).select("stack_id", "seed_id", "y", "x"))
    return basin.unionByName(whole).join(region, ["stack_id", "seed_id", "y", "x"], "left_semi").select(*key, "y", "x")


def masked_intensity(pixels: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels with values kept inside a pixel mask and zero elsewhere (absent pixels stay zero)."""
    keys = list(keys)
    marked = mask.select(*keys, "z", "y", "x", F.lit(True).alias("_in"))
    return pixels.join(marked, [*keys, "z", "y", "x"], "left").withColumn("v", F.expr("if(_in, v, 0D)")).drop("_in")
