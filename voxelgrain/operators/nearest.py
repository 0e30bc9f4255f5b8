"""The nearest of many places, on grids whose cells double from level to level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 8


def _cell(place: str) -> str:
    return f"cast(floor({place} * shiftleft(1L, level) / greatest(width, 1D)) as bigint)"


def _around(points: DataFrame) -> DataFrame:
    """The cell of each point on its level and the eight next to it."""
    near = "transform(sequence(-1L, 1L), s -> {0} + s)"
    return points.withColumn("gx", F.explode(F.expr(near.format(_cell("px"))))).withColumn("gy", F.explode(F.expr(near.format(_cell("py")))))


def nearest_targets(points: DataFrame, targets: DataFrame, group: Sequence[str], step: Sequence[str], *, levels: int = LEVELS) -> DataFrame:
    """(group, step, to_label, d): the target nearest to each point within its reach, the smaller label on a tie; d is squared.

    ``points`` holds (group, step, px, py, width, reach), ``targets`` (group, to_label, tx, ty, width). ``width``, one value for a
    group, is at least every reach in it; level 0 has cells so wide, and every level halves them. Each cell with targets knows one
    of them. What the cells around a point know on any level bounds how far the nearest one can be, so only the cells around it on
    the finest level wider than that bound are joined with all their targets. A point beyond the reach of all has no row.
    """
    group, step = list(group), list(step)
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    spread = targets.select(*group, "to_label", "tx", "ty", "width", every).withColumns({"gx": F.expr(_cell("tx")), "gy": F.expr(_cell("ty"))})
    cell = [*group, "level", "gx", "gy"]
    known = spread.groupBy(*cell).agg(F.min_by(F.struct("tx", "ty"), "to_label").alias("one"))
    own = dict.fromkeys([*group, *step])
    probes = _around(points.select(*own, "px", "py", "width", every))
    bound = probes.join(known, cell).groupBy(*own).agg(F.min(F.expr("pow(one.tx - px, 2) + pow(one.ty - py, 2)")).alias("most"))
    fits = f"cast(greatest(0, least({levels}, floor(log2(greatest(width, 1D) / sqrt(greatest(most, 1e-6D) * (1 + 1e-9D)))))) as int)"
    chosen = points.select(*own, "px", "py", "width", "reach").join(bound, list(own)).withColumn("level", F.expr(fits))
    met = _around(chosen).join(spread.drop("width"), cell).withColumn("d", F.expr("pow(tx - px, 2) + pow(ty - py, 2)"))
    best = met.where("d <= reach * reach").groupBy(*own).agg(F.min(F.struct("d", "to_label")).alias("best"))
    return best.select(*own, "best.to_label", "best.d")
