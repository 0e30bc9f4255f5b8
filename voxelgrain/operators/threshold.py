"""Intensity threshold suggestion per stack, on sparse pixels whose absent values are zero."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.functions.checks import require
from voxelgrain.operators.masks import Rect, Slices, check_rect, keep_rect, slice_counts, trim_slices
from voxelgrain.session import materialize

OTSU_BINS = 256
RANK_BINS = 1024
# fixed values: open interval and least count of the outlier-resistant population
ROBUST_LOW, ROBUST_HIGH, ROBUST_MIN_COUNT = 0.0, 250.0, 16


FINITE = "v is not null and not isnan(v) and abs(v) < double('infinity')"


def value_ranges(pixels: DataFrame, stacks: DataFrame) -> DataFrame:
    """(stack_id, n, absent, vmin, vmax, rn, rmin, rmax): size and range of each stack's finite values.

    Absent pixels count as zeros. The ``r`` columns describe the outlier-resistant part. One row per
    stack, combined before the shuffle and written, since histograms and ranks start from it.
    """
    robust = f"v > {ROBUST_LOW} and v < {ROBUST_HIGH}"
    present = pixels.withColumn("v", F.col("v").cast("double")).groupBy("stack_id").agg(
        F.count("*").alias("present"), F.expr(f"count_if({FINITE})").alias("finite"),
        F.expr(f"min(v) filter (where {FINITE})").alias("vmin"), F.expr(f"max(v) filter (where {FINITE})").alias("vmax"),
        F.expr(f"count_if({robust})").alias("rn"),
        F.expr(f"min(v) filter (where {robust})").alias("rmin"), F.expr(f"max(v) filter (where {robust})").alias("rmax"),
    )
    dense = stacks.select("stack_id", F.expr("cast(nz as bigint) * ny * nx").alias("dense"))
    joined = dense.join(present, "stack_id", "left").withColumn("absent", F.expr("greatest(dense - coalesce(present, 0), 0)"))
    return materialize(
        joined.select(
            "stack_id", F.expr("coalesce(finite, 0) + absent").alias("n"), "absent",
            F.expr("if(absent > 0, least(vmin, 0D), vmin)").alias("vmin"), F.expr("if(absent > 0, greatest(vmax, 0D), vmax)").alias("vmax"),
            F.expr("coalesce(rn, 0)").alias("rn"), "rmin", "rmax",
        )
    )


def weighted_values(pixels: DataFrame, ranges: DataFrame) -> DataFrame:
    """(stack_id, v, n): every finite pixel, and the absent ones of a stack as one row; nothing is shuffled."""
    present = pixels.select("stack_id", F.col("v").cast("double").alias("v"), F.lit(1).cast("bigint").alias("n")).where(FINITE)
    return present.unionByName(ranges.where("absent > 0").select("stack_id", F.lit(0.0).alias("v"), F.col("absent").alias("n")))


def histogram(values: DataFrame, stats: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """(stack_id, population, bin, centre, n) over equal bins of each population's own range.

    Pixels are counted by bin before the shuffle, at most ``bins`` rows per task, stack and population.
    """
    pops = stats.select(
        "stack_id",
        F.explode(
            F.expr(
                "filter(array(struct('full' as population, n as size, vmin as lo, vmax as hi), "
                "struct('robust' as population, rn as size, rmin as lo, rmax as hi)), p -> p.hi > p.lo)"
            )
        ).alias("p"),
    ).select("stack_id", "p.*").where(f"population = 'full' or size >= {ROBUST_MIN_COUNT}")
    guess = f"cast(least(floor((v - lo) * ({bins} / (hi - lo))), {bins - 1}) as int)"
    edge = f"(lo + {{}} * ((hi - lo) / {bins}))"
    binned = (
        values.join(pops, "stack_id")
        .where("v >= lo and v <= hi")
        .withColumn("g", F.expr(guess))
        .withColumn(
            "bin",
            F.expr(f"g - if(v < {edge.format('g')}, 1, 0) + if(g < {bins - 1} and v >= {edge.format('(g + 1)')}, 1, 0)"),
        )
    )
    centre = f"({edge.format('bin')} + {edge.format('(bin + 1)')}) / 2"
    return (
        binned.groupBy("stack_id", "population", "lo", "hi", "bin")
        .agg(F.sum("n").alias("n"))
        .select("stack_id", "population", "bin", F.expr(centre).alias("centre"), "n")
    )


def otsu(values: DataFrame, stats: DataFrame) -> DataFrame:
    """(stack_id, full, robust): bin centre of greatest between-class variance, first bin on a tie.

    Empty bins repeat the variance of the occupied bin before them, so occupied bins suffice.
    """
    hist = histogram(values, stats)
    part = Window.partitionBy("stack_id", "population")
    up = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = part.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hist.withColumn("m", F.col("n") * F.col("centre")).select(
        "stack_id", "population", "bin", "centre",
        F.sum("n").over(up).cast("double").alias("w1"), F.sum("m").over(up).alias("m1"),
        F.sum("n").over(down).cast("double").alias("w2"), F.sum("m").over(down).alias("m2"),
    )
    following = part.orderBy("bin")
    split = sums.withColumn("w2", F.lead("w2").over(following)).withColumn("m2", F.lead("m2").over(following))
    best = split.where("w2 is not null").withColumn("variance", F.expr("w1 * w2 * pow(m1 / w1 - m2 / w2, 2)"))
    return (
        best.groupBy("stack_id")
        .agg(
            F.expr("max_by(centre, struct(variance, -bin)) filter (where population = 'full')").alias("full"),
            F.expr("max_by(centre, struct(variance, -bin)) filter (where population = 'robust')").alias("robust"),
        )
    )


def percentile(values: DataFrame, stats: DataFrame, q: float = 0.75) -> DataFrame:
    """(stack_id, percentile): exact quantile with linear interpolation.

    Both neighbouring ranks are narrowed to the bin they fall in, whose own least and greatest value bound the
    next round, until one value is left. No task sorts values, and the least and the greatest value never share a
    bin, so an outlier costs one more round at most.
    """
    rank = f"cast(floor((n - 1) * {q}D) as bigint)"
    targets = stats.where("n > 0").select(
        "stack_id", F.col("vmin").alias("lo"), F.col("vmax").alias("hi"), F.lit(0).cast("bigint").alias("before"),
        F.explode(F.expr(f"array(struct('lower' as side, {rank} as rank), struct('upper' as side, least({rank} + 1, n - 1) as rank))")).alias("t"),
    ).select("stack_id", "t.side", "t.rank", "lo", "hi", "before")
    share = "if(hi - lo < double('infinity'), (v - lo) / (hi - lo), (v / 2 - lo / 2) / (hi / 2 - lo / 2))"
    target = ["stack_id", "side", "rank", "before"]
    upto = F.col("before") + F.sum("n").over(
        Window.partitionBy("stack_id", "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    while not targets.where("lo < hi").isEmpty():
        binned = values.join(targets.where("lo < hi"), "stack_id").where("v between lo and hi").withColumn(
            "bin", F.expr(f"cast(least(floor({share} * {RANK_BINS}), {RANK_BINS - 1}) as int)")
        )
        cells = binned.groupBy(*target, "bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        hit = cells.withColumn("upto", upto).where("upto - n <= rank and rank < upto").select(
            "stack_id", "side", "rank", "lo", "hi", F.expr("upto - n").alias("before")
        )
        targets = materialize(targets.where("lo = hi").unionByName(hit))
    found = targets.groupBy("stack_id").agg(
        F.expr("max(lo) filter (where side = 'lower')").alias("lower"), F.expr("max(lo) filter (where side = 'upper')").alias("upper")
    )
    part = f"((n - 1) * {q}D - floor((n - 1) * {q}D))"
    return found.join(stats.select("stack_id", "n"), "stack_id").select(
        "stack_id", F.expr(f"lower + (upper - lower) * {part}").alias("percentile")
    )


def suggest_threshold(
    pixels: DataFrame, stacks: DataFrame, method: str = "auto", *, rect: Rect | None = None, slices: Slices | None = None
) -> DataFrame:
    """(stack_id, threshold, method): suggested threshold of every stack and how it was found.

    Only ``slices`` count; pixels outside ``rect`` count as zeros.
    """
    wanted = method.strip().lower()
    if wanted not in ("auto", "otsu", "percentile"):
        raise ValueError("threshold method must be auto, otsu, or percentile")
    kept = keep_rect(trim_slices(pixels, slices), rect)
    stats = value_ranges(kept, slice_counts(check_rect(stacks, rect), slices))
    values = weighted_values(kept, stats)
    # constant stacks keep their value; stacks without finite values are an error
    base = require(stats, "n = 0", "Cannot suggest a threshold for non-finite image data")
    if wanted == "percentile":
        found = base.join(percentile(values, stats), "stack_id", "left").select(
            "stack_id", "vmin", "vmax", F.col("percentile").alias("t"), F.lit("percentile").alias("m")
        )
    else:
        found = base.join(otsu(values, stats), "stack_id", "left")
        if wanted == "auto":
            t = "if(robust is null, full, if(full > robust * 2 and robust > 0, robust, full))"
            label = "if(robust is null, 'otsu', 'robust_otsu')"
        else:
            t, label = "full", "'otsu'"
        found = found.select("stack_id", "vmin", "vmax", F.expr(t).alias("t"), F.expr(label).alias("m"))
    return found.select(
        "stack_id",
        F.expr("if(vmin = vmax, vmin, t)").alias("threshold"),
        F.expr("if(vmin = vmax, 'constant', m)").alias("method"),
    )


def sweep_values(start: float, stop: float, step: float) -> list[float]:
    """Start to stop by step, inclusive with a small slack, rounded to 10 places, never past stop."""
    if step <= 0:
        raise ValueError("threshold sweep step must be greater than zero")
    if stop < start:
        raise ValueError("threshold sweep stop must be greater than or equal to start")
    count = math.floor((stop - start) / step + 1e-9) + 1
    return [min(round(start + i * step, 10), float(stop)) for i in range(count)]
