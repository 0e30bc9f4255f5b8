"""Run summaries, batch and sweep rows, warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.geometry import SUMMARY_METRICS
from voxelgrain.operators.frames import MESH_COLUMNS

STATS = ("mean", "min", "max", "std")
STAT_COLUMNS = tuple(f"{m}_{s}" for m in SUMMARY_METRICS for s in STATS)
# fixed values: column orders of the batch and sweep tables
BATCH_COLUMNS = (
    "source_path", "source_sha256", "status", "error_message", "profile", "threshold", "voxel_source",
    "frame_count", "valid_frame_count", "valid_fraction", *MESH_COLUMNS, "warning_codes", *STAT_COLUMNS,
)
SWEEP_COLUMNS = (
    "threshold", "profile", "frame_count", "valid_frame_count", "valid_fraction", *MESH_COLUMNS, "warning_codes", *STAT_COLUMNS,
)
WARNING_TYPE = (
    "struct<code:string,severity:string,message:string,frame_indices:array<int>,"
    "invalid_frame_count:bigint,lost_frame_count:bigint,frame_count:bigint>"
)
LOST_MANY_FRACTION = 0.25


def run_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run: frame counts and mean, min, max, population deviation over valid frames."""
    keys = list(keys)
    valid = "filter (where has_contour)"
    stats = []
    for m in SUMMARY_METRICS:
        for name, fn in zip(STATS, ("avg", "min", "max", "stddev_pop")):
            stats.append(F.expr(f"{fn}({m}) {valid}").alias(f"{m}_{name}"))
    first = [c for c in ("threshold", "profile") if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(
            F.count("*").alias("frame_count"),
            F.expr("count_if(has_contour)").alias("valid_frame_count"),
            F.expr("array_sort(collect_list(if(excluded, frame_index, null)))").alias("excluded_frames"),
            *[F.max(c).alias(c) for c in (*first, *MESH_COLUMNS)],
            *stats,
        )
        .withColumn("valid_fraction", F.expr("valid_frame_count / frame_count"))
    )


def frameless_runs(runs: DataFrame, summary: DataFrame, profile: str) -> DataFrame:
    """Summary rows of runs without any frame: counts are zero, measures are missing."""
    given = {
        "frame_count": F.lit(0), "valid_frame_count": F.lit(0), "valid_fraction": F.lit(0.0), "excluded_frames": F.array(), "profile": F.lit(profile),
        **{c: F.col(c) for c in runs.columns},
    }
    return runs.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in summary.schema.fields])


def metric_summary(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The run summary in long form: (keys, metric, mean, min, max, std)."""
    pairs = ", ".join(f"'{m}', {', '.join(f'{m}_{s}' for s in STATS)}" for m in SUMMARY_METRICS)
    return summary.select(*keys, F.expr(f"stack({len(SUMMARY_METRICS)}, {pairs}) as (metric, mean, min, max, std)")).where(
        "mean is not null"
    )


def metric_map(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested form: one map from metric name to its four statistics per run."""
    return long.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "min", "max", "std"))))).alias("metrics")
    )


def _warning(code: str, severity: str, message: str, **extra: str) -> str:
    cast = {
        "frame_indices": "array<int>", "invalid_frame_count": "bigint", "lost_frame_count": "bigint", "frame_count": "bigint",
    }
    fields = [f"'code', '{code}'", f"'severity', '{severity}'", f"'message', {message}"]
    fields += [f"'{name}', cast({extra.get(name, 'null')} as {kind})" for name, kind in cast.items()]
    return f"named_struct({', '.join(fields)})"


def analysis_warnings() -> str:
    """SQL for warnings of a run summary row, in their fixed order; an empty run has only no_frames."""
    excluded = _warning(
        "excluded_frames", "info",
        "concat(size(excluded_frames), ' frame(s) excluded from metrics summary and 3D mesh.')",
        frame_indices="excluded_frames",
    )
    no_frames = _warning("no_frames", "error", "'The analysis did not contain any frames.'")
    none = _warning(
        "no_valid_contours", "error",
        "'No frames produced a valid contour. Check threshold, ROI, and image contrast.'",
    )
    some = _warning(
        "partial_contours", "warning",
        "concat(frame_count - valid_frame_count, ' of ', frame_count, ' frames did not produce a valid contour.')",
        invalid_frame_count="frame_count - valid_frame_count", frame_count="frame_count",
    )
    mesh = _warning(
        "zero_mesh_measurement", "warning", "'3D mesh measurement returned zero surface area or volume.'"
    )
    flat = "mesh_present and (mesh_surface_area_um2 <= 0 or mesh_volume_um3 <= 0)"
    return (
        "filter(array("
        f"if(size(excluded_frames) > 0, {excluded}, null), "
        f"if(frame_count = 0, {no_frames}, null), "
        f"if(frame_count > 0 and valid_frame_count = 0, {none}, null), "
        f"if(valid_frame_count > 0 and valid_frame_count < frame_count, {some}, null), "
        f"if(frame_count > 0 and {flat}, {mesh}, null)), w -> w is not null)"
    )


def tracking_warnings() -> str:
    """SQL for warnings of a tracking summary (tracked_frames, lost_frame_count, lost_fraction, ...)."""
    many = _warning(
        "tracking_lost_many_frames", "warning",
        "concat('Object tracking was lost on ', lost_frame_count, ' of ', track_frame_count, ' frames (', "
        "cast(bround(lost_fraction * 100) as int), '%). Metrics may mix frames or omit slices.')",
        lost_frame_count="lost_frame_count", frame_count="track_frame_count",
    )
    some = _warning(
        "tracking_lost_some_frames", "info",
        "concat('Object tracking was lost on ', lost_frame_count, ' of ', track_frame_count, ' frames.')",
        lost_frame_count="lost_frame_count", frame_count="track_frame_count",
    )
    edge = _warning(
        "roi_boundary_touch", "warning",
        "concat('Selected component touches the ROI or crop boundary on ', size(boundary_frames), ' frame(s); area may be clipped.')",
        frame_indices="boundary_frames",
    )
    merge = _warning(
        "likely_neighbor_merge", "warning",
        "concat('Tracked component area grew sharply on ', size(merge_frames), ' frame(s); neighbors may have merged.')",
        frame_indices="merge_frames",
    )
    lost = f"if(lost_fraction >= {LOST_MANY_FRACTION}, {many}, {some})"
    return (
        "filter(array("
        f"if(track_frame_count > 0 and lost_frame_count > 0, {lost}, null), "
        f"if(size(boundary_frames) > 0, {edge}, null), "
        f"if(size(merge_frames) > 0, {merge}, null)), w -> w is not null)"
    )


def voxel_warnings() -> str:
    """SQL for the warning about uncalibrated spacing."""
    default = _warning(
        "default_voxel_size", "warning",
        "'Voxel spacing came from defaults. Physical units should be treated as uncalibrated.'",
    )
    return f"filter(array(if(voxel_source = 'default', {default}, null)), w -> w is not null)"


def with_warnings(
    summary: DataFrame, keys: Sequence[str], *, stacks: DataFrame, tracking: DataFrame | None = None, mesh_given: bool = False,
) -> DataFrame:
    """Add ``warnings`` (analysis, then tracking, then voxel) and ``warning_codes`` to run summaries."""
    base = summary.join(
        stacks.select("stack_id", "source_path", "voxel_source", "vx_um", "vy_um", "vz_um"), "stack_id"
    )
    if "mesh_present" not in base.columns:
        base = base.withColumn("mesh_present", F.lit(False) if not mesh_given else F.expr("mesh_surface_area_um2 is not null"))
    parts = [F.expr(analysis_warnings())]
    if tracking is not None:
        base = base.join(tracking, list(keys), "left")
        parts.append(F.coalesce(F.expr(tracking_warnings()), F.expr(f"cast(array() as array<{WARNING_TYPE}>)")))
    parts.append(F.expr(voxel_warnings()))
    return base.withColumn("warnings", F.concat(*parts)).withColumn(
        "warning_codes", F.expr("array_join(transform(warnings, w -> w.code), ';')")
    )


def _with_hashes(rows: DataFrame, hashes: DataFrame | None) -> DataFrame:
    if hashes is not None:
        rows = rows.join(hashes.select("source_path", "source_sha256"), "source_path", "left")
    else:
        rows = rows.withColumn("source_sha256", F.lit(None).cast("string"))
    return rows.withColumn("source_sha256", F.coalesce("source_sha256", F.lit("")))


def batch_rows(summary: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Summary rows of successful runs in the batch column order."""
    done = summary.withColumns({"status": F.lit("ok"), "error_message": F.lit("")})
    return _with_hashes(done, hashes).select(*BATCH_COLUMNS)


def failed_rows(failures: DataFrame, template: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(source_path, error_message) as batch rows whose other columns are empty."""
    failed = _with_hashes(failures.withColumn("status", F.lit("error")), hashes)
    given = ("source_path", "source_sha256", "status", "error_message")
    return failed.select(
        *[(F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name) for f in template.schema.fields]
    )


def batch_totals(batch: DataFrame) -> DataFrame:
    """Stacks found, succeeded and failed."""
    return batch.agg(
        F.count("*").alias("found"),
        F.expr("count_if(status = 'ok')").alias("succeeded"),
        F.expr("count_if(status <> 'ok')").alias("failed"),
    )


def first_rows(rows: DataFrame, keys: Sequence[str], limit: int = 10) -> DataFrame:
    """First frame rows of every run, by the frame's place within the run.

    Frames are numbered from the run's first frame without gaps, so the place is a subtraction and
    no run has to be sorted in one task.
    """
    keys = list(keys)
    start = rows.groupBy(*keys).agg(F.min("frame_index").alias("_start"))
    return rows.join(start, keys).where(F.col("frame_index") - F.col("_start") < max(limit, 0)).drop("_start")
