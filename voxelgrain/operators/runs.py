"""Masks as runs: maximal horizontal stretches of foreground, and their connected labels.

A label is the first pixel of its component in raster order, packed as ``y * 2^32 + x``, so labels
are stable, comparable and independent of partitioning. Rows are cut into bands; a band of one
frame is the largest piece a single task holds, and labels that meet across bands are joined by an
iterative graph step that never looks at whole frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.grouping import expand_sorted_groups, kept_together, map_sorted_groups
from voxelgrain.session import ensure_checkpoint_dir, materialize

BAND_ROWS = 64
SEAMS_TOGETHER = 16  # neighbouring seams of a frame that one task joins
LABEL_BASE = 4294967296  # 2^32
LABEL_NONE = -9223372036854775807
FAR_RIGHT = 1073741824  # beyond any image
LABEL_FIELDS = [("label", T.LongType()), ("bottom", T.IntegerType()), ("gapped", T.BooleanType())]


def pack_label(y: str, x: str) -> Column:
    """First pixel of a component as one sortable number."""
    return F.expr(f"cast({y} as bigint) * {LABEL_BASE}L + {x}")


def pixel_runs(mask: DataFrame, keys: Sequence[str], *, band_rows: int = BAND_ROWS) -> DataFrame:
    """Foreground pixels (keys, z, y, x) to runs (keys, z, band, y, x0, x1), laid out by band.

    A pixel given twice counts once.
    """
    keys = list(keys)
    row = [*keys, "z", "band", "y"]
    laid_out = mask.select(*keys, "z", F.expr(f"y div {band_rows}").cast("int").alias("band"), "y", "x")
    if kept_together(laid_out, keys):
        laid_out = laid_out.repartition(*keys, "z", "band")
    order = Window.partitionBy(*row).orderBy("x")
    return (
        laid_out.withColumn("island", F.col("x") - F.dense_rank().over(order))
        .groupBy(*row, "island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("island")
    )


def complement_runs(runs: DataFrame, rows: DataFrame, keys: Sequence[str], *, band_rows: int = BAND_ROWS) -> DataFrame:
    """Runs of the complement over every image row given by ``rows`` (keys, z, y, nx)."""
    keys = list(keys)
    row = [*keys, "z", "y"]
    order = Window.partitionBy(*row).orderBy("x0")
    marked = rows.select(*row, "nx").join(runs.select(*row, "x0", "x1"), row, "left")
    after = marked.select(
        *row,
        F.coalesce(F.col("x1") + 1, F.lit(0)).alias("x0"),
        F.coalesce(F.lead("x0").over(order), F.col("nx")).alias("stop"),
    )
    before = marked.groupBy(*row).agg(F.min("x0").alias("stop")).where("stop > 0").select(
        *row, F.lit(0).alias("x0"), "stop"
    )
    return (
        after.unionByName(before)
        .where("stop > x0")
        .select(*keys, "z", F.expr(f"cast(y div {band_rows} as int)").alias("band"), "y", "x0", (F.col("stop") - 1).alias("x1"))
    )


def _links(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of touching runs of neighbouring rows; runs are sorted by (group, y, x0)."""
    count = len(y)
    span = int(y.max()) - int(y.min()) + 3
    width = int(x1.max()) + 4
    row = group * span + (y - y.min())
    start, stop = row * width + x0 + 1, row * width + x1 + 1
    low = np.searchsorted(stop, (row - 1) * width + x0 + 1 - reach, side="left")
    high = np.searchsorted(start, (row - 1) * width + x1 + 1 + reach, side="right")
    links = np.maximum(high - low, 0)
    below = np.repeat(np.arange(count), links)
    offset = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    return below, np.repeat(low, links) + offset


def _settled(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least run each run can reach, once the linked runs are one component."""
    while True:
        a, b = root[one], root[two]
        if np.array_equal(a, b):
            return root
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        hop = root[root]
        while not np.array_equal(hop, root):
            root, hop = hop, hop[hop]


def _roots(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """Index of the first run of each run's component; runs are sorted by (group, y, x0)."""
    return _settled(np.arange(len(y)), *_links(group, y, x0, x1, reach))


def _described(root: np.ndarray, y: np.ndarray, x0: np.ndarray) -> dict[str, np.ndarray]:
    """Label, last row and gap mark of every run from the first run of its component."""
    bottom = y.copy()
    np.maximum.at(bottom, root, y)
    by_root = np.argsort(root, kind="stable")
    again = (np.diff(root[by_root]) == 0) & (np.diff(y[by_root]) == 0)
    gapped = np.zeros(len(y), dtype=bool)
    gapped[root[by_root[1:][again]]] = True
    return {"label": y[root] * LABEL_BASE + x0[root], "bottom": bottom[root].astype(np.int32), "gapped": gapped[root]}


def connect(edges: DataFrame, keys: Sequence[str], *, max_rounds: int = 60) -> DataFrame:
    """Connected components of (keys, a, b): every node with the least node it can reach.

    Alternates between linking larger and smaller neighbours to the least one (Kiveris et al. 2014),
    which needs rounds in the logarithm of the graph's size. Each round is checkpointed.
    """
    keys = list(keys)
    ensure_checkpoint_dir(edges.sparkSession)
    current = edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = current.checkpoint()
    signature = None
    if current.isEmpty():
        max_rounds = 0
    for _ in range(max_rounds):
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        hop = large.join(least, [*keys, "u"])
        small = hop.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(*keys, "u", F.col("m").alias("v"))
        )
        current = small.where("u <> v").distinct().checkpoint()
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first()
        if seen == signature:
            return current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        signature = seen
    if max_rounds:
        raise RuntimeError("component linking did not settle")
    return current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))


def touching_labels(lower: DataFrame, upper: DataFrame, line: Sequence[str], reach: int) -> DataFrame:
    """(line, a, b): labels of runs of two neighbouring rows that touch.

    Both rows are swept from left to right, once per sideways shift, so the work is linear in the
    number of runs. Runs of one row never overlap.
    """
    line = list(line)
    shifts = F.array(*[F.lit(s) for s in range(-reach, reach + 1)])
    none = LABEL_NONE

    def ends(rows: DataFrame, mine: str, other: str, moved: str) -> DataFrame:
        pair = f"array(struct(x0 + {moved} as x, label as l), struct(x1 + 1 + {moved} as x, {none}L as l))"
        return rows.withColumn("shift", F.explode(shifts)).select(*line, "shift", F.explode(F.expr(pair)).alias("e")).select(
            *line, "shift", "e.x", F.col("e.l").alias(mine), F.lit(None).cast("bigint").alias(other)
        )

    events = ends(lower, "a", "b", "0").unionByName(ends(upper, "b", "a", "shift"))
    # where one run stops and the next begins at the same place, the beginning counts
    steps = events.groupBy(*line, "shift", "x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    order = Window.partitionBy(*line, "shift").orderBy("x")
    states = steps.select(
        *line, F.last("a", ignorenulls=True).over(order).alias("a"), F.last("b", ignorenulls=True).over(order).alias("b")
    )
    return states.where(f"a <> {none}L and b <> {none}L")


def joined_seams(seams: DataFrame, keys: Sequence[str], tallest: int, *, band_rows: int = BAND_ROWS) -> DataFrame:
    """(keys, z, node, root): labels that meet at seams (keys, z, y, a, b), each with the least label of its component.

    A few neighbouring seams of a frame are joined in one task, as many as make a piece of the size of a few rows. Only images
    with more seams need rounds over the pieces. The result is a written table.
    """
    frame = [*keys, "z"]
    piece = [*frame, "piece"]
    cut = f"cast(greatest(0, (y div {band_rows} - 1) div {SEAMS_TOGETHER}) as int) as piece"
    laid_out = seams.where("a <> b").selectExpr(*frame, cut, "a", "b").distinct().repartition(*piece)
    kinds = {f.name: f for f in laid_out.schema.fields}
    schema = T.StructType([*[kinds[c] for c in frame], *[T.StructField(n, T.LongType()) for n in ("node", "root")]])

    def work(table: pa.Table, group: np.ndarray) -> Iterator[pa.Table]:
        pairs = np.column_stack([np.tile(group, 2), np.concatenate([table.column(c).to_numpy() for c in "ab"])])
        nodes, first, number = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        one, two = np.split(number.reshape(-1), 2)
        label, root = nodes[:, 1], _settled(np.arange(len(nodes)), one, two)
        made = table.take(pa.array(first % len(group))).select(frame)
        made = made.append_column("node", pa.array(label)).append_column("root", pa.array(label[root]))
        yield made.filter(pa.array(root != np.arange(len(nodes))))

    linked = materialize(expand_sorted_groups(laid_out, piece, ["a", "b"], work, schema))
    if tallest < band_rows * (SEAMS_TOGETHER + 1):
        return linked
    return connect(linked.withColumnsRenamed({"node": "a", "root": "b"}), frame)


def label_runs(
    runs: DataFrame,
    keys: Sequence[str],
    *,
    connectivity: int = 8,
    band_rows: int = BAND_ROWS,
    arranged: bool = False,
) -> DataFrame:
    """Add ``label``, ``bottom`` (the component's last row) and ``gapped`` (does any row hold two runs?).

    The result is a written table. Images no taller than a band have no seams; whether there are taller ones is read from the labelled runs.
    """
    keys = list(keys)
    reach = 1 if connectivity == 8 else 0

    def work(table: pa.Table, group: np.ndarray) -> dict[str, np.ndarray]:
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        return _described(_roots(group, y, x0, x1, reach), y, x0)

    local = map_sorted_groups(runs, [*keys, "z", "band"], ["y", "x0"], work, LABEL_FIELDS, arranged=arranged)
    return _across_bands(materialize(local), keys, reach, band_rows)


def _across_bands(local: DataFrame, keys: list[str], reach: int, band_rows: int) -> DataFrame:
    """Labels of bands joined where components meet at the seams."""
    tallest = local.agg(F.max("y")).first()[0]
    if tallest is None or tallest < band_rows:
        return local
    frame = [*keys, "z"]
    lower = local.where(f"pmod(y, {band_rows}) = {band_rows - 1}").select(*frame, (F.col("y") + 1).alias("y"), "x0", "x1", "label")
    upper = local.where(f"pmod(y, {band_rows}) = 0").select(*frame, "y", "x0", "x1", "label")
    linked = joined_seams(touching_labels(lower, upper, [*frame, "y"], reach), keys, tallest, band_rows=band_rows)
    named = linked.select(*frame, F.col("node").alias("label"), "root").unionByName(
        linked.select(*frame, F.col("root").alias("label"), "root").distinct()
    )
    whole = local.select(*frame, "label", "bottom", "gapped").distinct().join(named, [*frame, "label"])
    lowest = whole.groupBy(*frame, "root").agg(F.max("bottom").alias("lowest"), F.bool_or("gapped").alias("any_gap"))
    merged = named.join(lowest, [*frame, "root"])
    return materialize(
        local.join(merged, [*frame, "label"], "left")
        .withColumn("label", F.coalesce("root", "label")).withColumn("bottom", F.coalesce("lowest", "bottom"))
        .withColumn("gapped", F.coalesce("any_gap", "gapped"))
        .select(*local.columns)
    )


def level_runs(pixels: DataFrame, thresholds: Sequence[float], *, band_rows: int = BAND_ROWS) -> DataFrame:
    """(stack_id, z, band, y, x0, x1, level): stretches of pixels that pass the same number of the ascending ``thresholds``.

    Pixels that pass none are left out; of a pixel given twice the larger value counts.
    """
    row = ["stack_id", "z", "band", "y"]
    level = sum(((F.col("v") >= float(t)).cast("int") for t in thresholds), F.lit(0))
    passed = pixels.where((F.col("v") >= float(thresholds[0])) & ~F.isnan("v"))
    laid_out = passed.select("stack_id", "z", F.expr(f"y div {band_rows}").cast("int").alias("band"), "y", "x", level.alias("level"))
    single = laid_out.repartition("stack_id", "z", "band").groupBy(*row, "x").agg(F.max("level").alias("level"))
    order = Window.partitionBy(*row, "level").orderBy("x")
    return (
        single.withColumn("island", F.col("x") - F.row_number().over(order)).groupBy(*row, "level", "island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(*row, "x0", "x1", "level")
    )


def level_cuts(
    group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, level: np.ndarray, reach: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The component tree of level runs, cut at one level after another from the highest down: (level, runs, first run of each).

    A link joins two runs from the lower of their levels on. Every level adds its own links to the components of the level
    above, which so become their children; no link is looked at twice.
    """
    below, above = _links(group, y, x0, x1, reach)
    beside = np.flatnonzero((group[1:] == group[:-1]) & (y[1:] == y[:-1]) & (x0[1:] == x1[:-1] + 1))
    below, above = np.append(below, beside + 1), np.append(above, beside)
    strength = np.minimum(level[below], level[above])
    order = np.argsort(-strength, kind="stable")
    below, above, strength = below[order], above[order], strength[order]
    root = np.arange(len(y))
    for cut in range(int(level.max()), 0, -1):
        own = slice(np.searchsorted(-strength, -cut, side="left"), np.searchsorted(-strength, -cut, side="right"))
        root = _settled(root, below[own], above[own])
        yield cut, np.flatnonzero(level >= cut), root


def label_levels(
    runs: DataFrame, thresholds: Sequence[float], *, connectivity: int = 8, band_rows: int = BAND_ROWS
) -> DataFrame:
    """Labelled runs of every threshold, keyed by (stack_id, threshold), from one component tree for each band of a slice.

    ``runs`` come from ``level_runs`` with the same ascending ``thresholds``. The result is a written table like that of
    ``label_runs``, whose labels it equals; where bands meet, the trees are joined level by level.
    """
    keys = ["stack_id", "threshold"]
    reach = 1 if connectivity == 8 else 0
    values = np.array([float(t) for t in thresholds])
    kinds = {f.name: f for f in runs.schema.fields}
    schema = T.StructType([
        kinds["stack_id"], T.StructField("threshold", T.DoubleType()), *[kinds[c] for c in ("z", "band", "y", "x0", "x1")],
        *[T.StructField(n, t) for n, t in LABEL_FIELDS],
    ])

    def work(table: pa.Table, group: np.ndarray) -> Iterator[pa.Table]:
        y, x0, x1, level = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "level"))
        for cut, chosen, root in level_cuts(group, y, x0, x1, level, reach):
            # stretches of different levels side by side are one run of the cut
            joined = np.append(False, (group[chosen[1:]] == group[chosen[:-1]]) & (y[chosen[1:]] == y[chosen[:-1]]) & (x0[chosen[1:]] == x1[chosen[:-1]] + 1))
            heads = chosen[~joined]
            ends = x1[chosen[np.append(np.flatnonzero(~joined)[1:], len(chosen)) - 1]]
            place = np.cumsum(~joined) - 1
            number = np.zeros(len(y), np.int64)
            number[chosen] = place
            first = number[root[heads]]
            made = table.take(pa.array(heads)).select(["stack_id", "z", "band", "y", "x0"])
            made = made.add_column(1, "threshold", pa.array(np.full(len(heads), values[cut - 1])))
            made = made.append_column("x1", pa.array(ends.astype(np.int32)).cast(table.schema.field("x1").type))
            for name, column in _described(first, y[heads], x0[heads]).items():
                made = made.append_column(name, pa.array(column))
            yield made

    local = expand_sorted_groups(runs, ["stack_id", "z", "band"], ["y", "x0"], work, schema)
    return _across_bands(materialize(local), keys, reach, band_rows)


def run_components(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per component: pixel count, centroid, bounds (inclusive) and first pixel."""
    keys = list(keys)
    length = "(x1 - x0 + 1)"
    return (
        labelled.groupBy(*keys, "z", "label")
        .agg(
            F.expr(f"sum(cast({length} as bigint))").alias("area"),
            F.expr(f"sum(cast({length} as double) * (x0 + x1) / 2)").alias("_sx"),
            F.expr(f"sum(cast({length} as double) * y)").alias("_sy"),
            F.min("y").alias("ymin"), F.max("y").alias("ymax"),
            F.min("x0").alias("xmin"), F.max("x1").alias("xmax"),
        )
        .select(
            *keys, "z", "label", "area",
            (F.col("_sx") / F.col("area")).alias("cx"), (F.col("_sy") / F.col("area")).alias("cy"),
            "ymin", "ymax", "xmin", "xmax",
            F.expr(f"cast(label div {LABEL_BASE}L as int)").alias("first_y"),
            F.expr(f"cast(label % {LABEL_BASE}L as int)").alias("first_x"),
        )
    )


def surrounding_runs(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Background of each component on its own: (keys, z, label, band, y, x0, x1).

    Components whose rows are all single runs enclose nothing and are left out.
    Every row of a component gives the gaps between its runs and one stretch to either side; rows
    above and below the component join both sides. The outside therefore is one region, and its
    first pixel is known from the component's label.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys, "z", "label", "band", "y").orderBy("x0")
    top = f"y = label div {LABEL_BASE}L"
    parts = (
        f"array(struct(y as y, x1 + 1 as x0, coalesce(ahead - 1, {FAR_RIGHT}) as x1), "
        "if(behind is null, struct(y as y, -1 as x0, x0 - 1 as x1), null), "
        f"if(behind is null and {top}, struct(y - 1 as y, -1 as x0, {FAR_RIGHT} as x1), null), "
        f"if(behind is null and y = bottom, struct(y + 1 as y, -1 as x0, {FAR_RIGHT} as x1), null))"
    )
    laid_out = labelled.where("gapped").select(*keys, "z", "label", "bottom", "band", "y", "x0", "x1")
    if kept_together(laid_out, keys):
        laid_out = laid_out.repartition(*keys, "z", "label", "band")
    return (
        laid_out
        .withColumn("ahead", F.lead("x0").over(order)).withColumn("behind", F.lag("x1").over(order))
        .select(*keys, "z", "label", "band", F.explode(F.expr(f"filter({parts}, p -> p is not null)")).alias("p"))
        .select(*keys, "z", "label", "band", "p.y", "p.x0", "p.x1")
    )


def hole_runs(
    labelled: DataFrame, keys: Sequence[str], *, band_rows: int = BAND_ROWS
) -> DataFrame:
    """Runs of background (and anything nested in it) that a component encloses.

    Background is 4-connected within the component's own complement, so the result does not depend
    on other components.
    """
    keys = list(keys)
    around = surrounding_runs(labelled, keys).withColumnRenamed("label", "owner")
    named = label_runs(around, [*keys, "owner"], connectivity=4, band_rows=band_rows, arranged=True)
    outside = f"(owner div {LABEL_BASE}L - 1) * {LABEL_BASE}L - 1"
    return named.where(f"label <> {outside}").select(*keys, "z", F.col("owner").alias("label"), "y", "x0", "x1")


def filled_runs(labelled: DataFrame, holes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component runs together with the holes they enclose."""
    cols = [*keys, "z", "label", "y", "x0", "x1"]
    return labelled.select(*cols).unionByName(holes.select(*cols))
