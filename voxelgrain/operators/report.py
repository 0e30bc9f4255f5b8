"""Manifests, reports and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.geometry import SUMMARY_METRICS
from voxelgrain.functions.text import short_numbers
from voxelgrain.operators.frames import FRAME_COLUMNS
from voxelgrain.operators.summary import STATS, first_rows, metric_summary

VERSION = "1"
MESH_FIELDS = ("surface_area_um2", "volume_um3", "equivalent_sphere_diameter_um", "sphericity")


def seed_payload() -> Column:
    """A seed row as the nested value manifests hold."""
    return F.struct("x", "y", "frame_index", "radius", "type", "max_tracking_dist_um", "points")


def tracking_payload(records: DataFrame) -> DataFrame:
    """Tracking records of each seed as one ordered array, bounded by the frames of a stack."""
    fields = (
        "frame_index", "tracked", "centroid_x", "centroid_y", "area_px", "touches_roi_boundary", "likely_neighbor_merge",
    )
    return records.groupBy("stack_id", "seed_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tracking"))


def manifests(
    summary: DataFrame, keys: Sequence[str], *, rect=None, slices=None, include_mesh: bool = False,
    prefer_outline: bool = True, hashes: DataFrame | None = None, seeds: DataFrame | None = None,
    records: DataFrame | None = None,
) -> DataFrame:
    """(keys, manifest): one nested JSON document per run, keys in alphabetical order."""
    keys = list(keys)
    base = summary
    base = base.join(hashes.select("source_path", "source_sha256"), "source_path", "left") if hashes is not None else base.withColumn(
        "source_sha256", F.lit(None).cast("string")
    )
    if seeds is not None:
        base = base.join(seeds.select("stack_id", "seed_id", seed_payload().alias("object_seed")), keys, "left")
    else:
        base = base.withColumn("object_seed", F.lit(None).cast("string"))
    if records is not None:
        base = base.join(tracking_payload(records), keys, "left")
    else:
        base = base.withColumn("tracking", F.lit(None).cast("string"))
    region = F.struct(*[F.lit(getattr(rect, c)).alias(c) for c in ("xmax", "xmin", "ymax", "ymin")]) if rect else F.lit(None).cast("string")
    z_range = F.struct(F.lit(slices.zmax).alias("zmax"), F.lit(slices.zmin).alias("zmin")) if slices else F.lit(None).cast("string")
    metrics = F.struct(
        *[
            F.when(F.col(f"{m}_mean").isNotNull(), F.struct(*[F.col(f"{m}_{s}").alias(s) for s in ("max", "mean", "min", "std")])).alias(m)
            for m in sorted(SUMMARY_METRICS)
        ]
    )
    mesh = F.when(F.col("mesh_present"), F.struct(*[F.col(f"mesh_{f}").alias(f) for f in sorted(MESH_FIELDS)]))
    fields = {
        "version": F.lit(VERSION),
        "created_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        "source_path": F.col("source_path"), "source_sha256": F.col("source_sha256"),
        "profile": F.col("profile"), "threshold": F.col("threshold"), "roi": region, "z_range": z_range,
        "include_mesh": F.lit(include_mesh), "prefer_outline": F.lit(prefer_outline),
        "voxel_size": F.struct(F.col("vx_um").alias("x_um"), F.col("vy_um").alias("y_um"), F.col("vz_um").alias("z_um")),
        "voxel_source": F.col("voxel_source"),
        "frame_count": F.col("frame_count"), "valid_frame_count": F.col("valid_frame_count"),
        "excluded_frames": F.col("excluded_frames"), "excluded_frame_count": F.size("excluded_frames"),
        "mesh": mesh,
        "summary": F.struct(F.col("frame_count"), metrics.alias("metrics"), F.col("valid_fraction"), F.col("valid_frame_count")),
        "warnings": F.col("warnings"), "object_seed": F.col("object_seed"), "tracking": F.col("tracking"),
        "columns": F.array(*[F.lit(c) for c in FRAME_COLUMNS]),
    }
    document = F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})
    return base.select(*keys, document.alias("manifest"))


def _lines(*texts: str) -> str:
    return f"filter(array({', '.join(texts)}), s -> s is not null)"


def report_lines(
    summary: DataFrame, rows: DataFrame, keys: Sequence[str], *, rect=None, slices=None, include_mesh: bool = False,
    seeds: DataFrame | None = None, row_limit: int = 10,
) -> DataFrame:
    """(keys, section, line_no, line): a Markdown report per run, ordered by section and line.

    Blank lines between blocks close the section before them, so a table may follow its heading.
    """
    keys = list(keys)
    region = f"xmin={rect.xmin}, xmax={rect.xmax}, ymin={rect.ymin}, ymax={rect.ymax}" if rect else "full stack"
    z_range = f"zmin={slices.zmin}, zmax={slices.zmax}" if slices else "full stack"
    settings = _lines(
        "'# Analysis Report'", "''", "'## Run Settings'", "''", "concat('- Source: `', source_path, '`')",
        "concat('- Profile: `', profile, '`')", "concat('- Threshold: `', threshold, '`')",
        f"'- ROI: `{region}`'", f"'- Z range: `{z_range}`'", f"'- Include mesh: `{str(include_mesh).lower()}`'",
        "concat('- Voxel source: `', voxel_source, '`')",
        "concat('- Voxel size: x=', t_vx_um, ' um, y=', t_vy_um, ' um, z=', t_vz_um, ' um')", "''",
    )
    frames = _lines(
        "'## Frame Summary'", "''", "concat('- Frames: ', frame_count)", "concat('- Valid frames: ', valid_frame_count)",
        "concat('- Valid fraction: ', t_valid_fraction)",
        "concat('- Excluded frames: ', if(size(excluded_frames) > 0, concat('[', array_join(excluded_frames, ', '), ']'), 'none'))", "''",
    )
    warned = (
        "if(size(warnings) = 0, array(), concat(array('## Warnings', ''), "
        "transform(warnings, w -> concat('- `', w.code, '` (', w.severity, '): ', w.message)), array('')))"
    )
    metrics = (
        "if(valid_frame_count = 0, array(), array('## Metric Summary', '', '| Metric | Mean | Min | Max | Std |', "
        "'| --- | ---: | ---: | ---: | ---: |'))"
    )
    mesh = (
        "if(not mesh_present, array(), array('## Mesh Summary', '', "
        "concat('- Surface area: ', t_mesh_surface_area_um2, ' um^2'), concat('- Volume: ', t_mesh_volume_um3, ' um^3'), "
        "concat('- Equivalent sphere diameter: ', t_mesh_equivalent_sphere_diameter_um, ' um'), "
        "concat('- Sphericity: ', t_mesh_sphericity), ''))"
    )
    sections = {0: settings, 3: frames, 4: warned, 5: metrics, 7: mesh}
    base = short_numbers(summary, ["vx_um", "vy_um", "vz_um", "valid_fraction", *[f"mesh_{f}" for f in MESH_FIELDS]])
    if seeds is not None:
        base = base.join(
            seeds.select(
                "stack_id", "seed_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("frame_index").alias("_f"),
                F.coalesce("radius", F.lit(10.0)).alias("_r"), F.coalesce("type", F.lit("circle")).alias("_t"),
            ),
            keys,
        )
        base = short_numbers(base, ["_x", "_y", "_r"])
        sections[1] = _lines(
            "'## Object Selection'", "''", "concat('- Seed frame: `', _f, '`')",
            "concat('- Seed center: `(', t__x, ', ', t__y, ')`')",
            "concat('- Seed radius: `', t__r, '` px')", "concat('- Seed type: `', _t, '`')", "''",
        )
        if "track_frame_count" in summary.columns:
            sections[2] = _lines(
                "'## Tracking Diagnostics'", "''",
                "concat('- Tracked frames: ', lost_frame_count, ' lost of ', track_frame_count, ' total')", "''",
            )
    texts = [f"transform({sql}, s -> struct({no} as section, s as line))" for no, sql in sorted(sections.items())]
    head = base.select(*keys, F.posexplode(F.expr(f"concat({', '.join(texts)})")).alias("line_no", "l")).select(
        *keys, "l.section", F.col("line_no").cast("int").alias("line_no"), "l.line"
    )
    table = short_numbers(metric_summary(summary, keys), STATS).select(
        *keys, F.lit(6).alias("section"),
        F.array_position(F.array(*[F.lit(m) for m in SUMMARY_METRICS]), F.col("metric")).cast("int").alias("line_no"),
        F.expr("concat('| ', metric, ' | ', concat_ws(' | ', t_mean, t_min, t_max, t_std), ' |')").alias("line"),
    )
    shown = first_rows(rows, keys, row_limit)
    cells = ("area_um2", "perimeter_um", "circularity", "deformation_index")
    body = short_numbers(shown, cells).select(
        *keys, F.lit(9).alias("section"), F.col("frame_index").cast("int").alias("line_no"),
        F.expr(
            f"concat('| ', frame_index, ' | ', if(has_contour, 'yes', 'no'), ' | ', concat_ws(' | ', {', '.join('t_' + c for c in cells)}), ' |')"
        ).alias("line"),
    )
    count = shown.groupBy(*keys).agg(F.count("*").alias("n"))
    title = count.select(
        *keys, F.lit(8).alias("section"),
        F.posexplode(
            F.expr(
                "array(concat('## First ', n, ' Frame Rows'), '', '| Frame | Contour | Area (um^2) | Perimeter (um) | Circularity | Deformation index |', "
                "'| ---: | :---: | ---: | ---: | ---: | ---: |')"
            )
        ).alias("line_no", "line"),
    )
    return head.unionByName(table).unionByName(title).unionByName(body)


def write_reports(lines: DataFrame, keys: Sequence[str], folder: str) -> None:
    """One text file per run, in line order; a report is at most a few dozen lines."""
    text = lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "line_no", "line"))), lambda s: s["line"]), "\n").alias("value")
    )
    text.write.mode("overwrite").partitionBy(*keys).text(folder)


def write_rows(rows: DataFrame, keys: Sequence[str], folder: str, columns: Sequence[str] = FRAME_COLUMNS) -> None:
    """Frame rows as CSV with a header, one folder per run, frames in order."""
    keys = list(keys)
    out = rows.repartition(*keys).sortWithinPartitions(*keys, "frame_index").select(*keys, *[c for c in columns if c not in keys])
    out.write.mode("overwrite").option("header", True).partitionBy(*keys).csv(folder)


def write_table(table: DataFrame, folder: str, columns: Sequence[str]) -> None:
    """Batch or sweep rows as CSV with a header, in the fixed column order."""
    table.select(*columns).write.mode("overwrite").option("header", True).csv(folder)


def write_manifests(documents: DataFrame, keys: Sequence[str], folder: str) -> None:
    """One JSON document per run."""
    documents.select(*keys, F.col("manifest").alias("value")).write.mode("overwrite").partitionBy(*keys).text(folder)
