"""Whole analyses over many stacks at once, with or without seeds, thresholds or exclusions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cache, cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.checks import first_error
from voxelgrain.operators import masks, split, summary, surface, tracking
from voxelgrain.operators.contours import Objects, component_at_seed, describe_objects
from voxelgrain.operators.frames import MESH_COLUMNS, frame_rows, seeded_contours, unseeded_contours
from voxelgrain.operators.runs import BAND_ROWS, label_levels, label_runs, level_runs, pixel_runs, run_components
from voxelgrain.session import materialize

# fixed values: profiles; rbc measures exactly like vesicle
PROFILES = ("vesicle", "rbc", "active_surfaces")


@dataclass(frozen=True)
class Settings:
    """What to analyse and how. ``thresholds`` is a number or a table, see ``frame_thresholds``, or for a split a list by slice."""

    thresholds: float | DataFrame | tuple[float, ...]
    rect: masks.Rect | None = None
    slices: masks.Slices | None = None
    profile: str = "vesicle"
    contour: str = "boundary"
    include_mesh: bool = False
    pad_mesh: bool = False
    reselect: bool = True
    merge_reference: str = "first"
    only_positive: bool = False


@dataclass
class Analysis:
    """Result tables of one job, built when they are asked for.

    ``mask`` holds (keys, z, y, x0, x1) of the measured objects, ``tracking`` one row per seed and frame, ``frameless`` the
    keys of runs on stacks without frames, which have no rows but a summary.
    """

    stacks: DataFrame
    frames: DataFrame
    find_contours: Callable[[], DataFrame]
    describe: Callable[[], Objects]
    mask_keys: list[str]
    keys: list[str]
    settings: Settings
    tracking: DataFrame | None = None
    missing_method: str = "'fallback'"
    found_method: str | None = None
    frameless: DataFrame | None = None

    @cached_property
    def objects(self) -> Objects:
        return self.describe()

    @cached_property
    def contours(self) -> DataFrame:
        """One measured object per run and frame; written once where several results need it."""
        found = self.find_contours()
        return materialize(found) if self.settings.include_mesh else found

    @cached_property
    def mask(self) -> DataFrame:
        """The measured objects as runs; written once where a surface reads them several times."""
        found = stack_mask(self.contours, self.objects, self.frames, self.mask_keys, self.keys)
        return materialize(found) if self.settings.include_mesh else found

    @cached_property
    def shapes(self) -> DataFrame:
        return mesh_shapes(self.frames, self.keys)

    @cached_property
    def mesh(self) -> DataFrame | None:
        """Surface measures per run; a run without any mask has no row."""
        if not self.settings.include_mesh:
            return None
        cells = surface.cell_stretches(self.mask, self.shapes, self.keys, pad=self.settings.pad_mesh)
        # a mask without any surface cell still has a mesh, of zero size
        present = self.mask.select(*self.keys).distinct()
        measured = present.join(surface.measure_surface(cells, self.shapes, self.keys), self.keys, "left")
        return materialize(measured.fillna(0.0, list(MESH_COLUMNS)))

    @cached_property
    def rows(self) -> DataFrame:
        contours = self.contours
        if self.found_method is not None:
            contours = contours.withColumn("method", F.lit(self.found_method))
        return frame_rows(
            self.frames, contours, self.keys, profile=check_profile(self.settings.profile), mesh=self.mesh,
            missing_method=self.missing_method,
        )

    def save(self) -> "Analysis":
        """Write the frame rows and the run summary once, for uses that read them several times."""
        self.__dict__["rows"] = materialize(self.rows)
        self.__dict__["summary"] = materialize(self.summary)
        return self

    @cached_property
    def summary(self) -> DataFrame:
        totals = summary.run_summary(self.rows, self.keys)
        if self.frameless is not None:
            totals = totals.unionByName(summary.frameless_runs(self.frameless, totals, check_profile(self.settings.profile)))
        if self.mesh is not None:
            totals = totals.join(self.mesh.select(*self.keys, F.lit(True).alias("mesh_present")), self.keys, "left")
            totals = totals.withColumn("mesh_present", F.coalesce("mesh_present", F.lit(False)))
        diagnostics = tracking.tracking_summary(self.tracking) if self.tracking is not None else None
        return summary.with_warnings(totals, self.keys, stacks=self.stacks, tracking=diagnostics)


def check_profile(profile: str | None) -> str:
    """Normalise a profile name; unknown names are an error."""
    name = (profile or PROFILES[0]).strip().lower().replace("-", "_")
    if name not in PROFILES:
        raise ValueError(f"unknown analysis profile: {profile}")
    return name


def analysed_frames(stacks: DataFrame, settings: Settings, excluded: DataFrame | None = None) -> DataFrame:
    """Frames of the selected slices with their threshold and exclusion mark."""
    checked = masks.check_rect(stacks, settings.rect)
    frames = masks.stack_frames(checked, settings.slices)
    if isinstance(settings.thresholds, tuple | list):
        if settings.profile != "active_surfaces":
            raise ValueError("a list of thresholds needs the active surfaces profile")
        frames = masks.listed_thresholds(frames, settings.thresholds)
    else:
        frames = masks.frame_thresholds(frames, settings.thresholds)
    return masks.mark_excluded(frames, excluded)


def selected_pixels(pixels: DataFrame, settings: Settings) -> DataFrame:
    return masks.keep_rect(masks.trim_slices(pixels, settings.slices), settings.rect)


def labelled_mask(
    pixels: DataFrame, frames: DataFrame, keys: Sequence[str], settings: Settings, *,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """The written labelled runs of the thresholded pixels."""
    runs, arranged = masks.mask_runs(
        selected_pixels(pixels, settings), frames, keys,
        only_positive=settings.only_positive, band_rows=band_rows,
    )
    return label_runs(runs, keys, band_rows=band_rows, arranged=arranged)


def find_objects(
    pixels: DataFrame, frames: DataFrame, keys: Sequence[str], settings: Settings, *,
    band_rows: int = BAND_ROWS,
) -> Objects:
    """Threshold, label and describe all components.

    Labelled runs and components are read by many later steps, so both are written once; holes are
    found again only where a surface is asked for.
    """
    objects = describe_objects(labelled_mask(pixels, frames, keys, settings, band_rows=band_rows), keys, band_rows=band_rows)
    objects.components = materialize(objects.components)
    return objects


def checked_seeds(seeds: DataFrame, stacks: DataFrame, settings: Settings) -> DataFrame:
    """The seeds; one outside its stack, the region or the slices is an error."""
    bad = tracking.seed_errors(seeds, stacks, settings.rect, settings.slices)
    return bad.withColumn(
        "seed_id", F.when(F.col("seed_error").isNotNull(), F.raise_error(F.col("seed_error"))).otherwise(F.col("seed_id"))
    ).select(*seeds.columns)


def split_analysis(
    stacks: DataFrame, pixels: DataFrame, seeds: DataFrame, settings: Settings, *,
    excluded: DataFrame | None = None, band_rows: int = BAND_ROWS,
) -> Analysis:
    """Touching objects split per slice by flooding, and the seeded part measured.

    Every slice is split on its own with the seed's region as a hard limit. Needs a seed. Thresholds may be a list by slice; if it
    is shorter than a stack, the last one counts for the rest.
    """
    keys, owner = ["stack_id"], ["stack_id", "seed_id"]
    settings = replace(settings, profile="active_surfaces")
    stacks = materialize(stacks)
    frames = analysed_frames(stacks, settings, excluded)
    placed = materialize(tracking.place_seeds(checked_seeds(seeds, stacks, settings), frames))
    kept = selected_pixels(pixels, settings)
    mask, arranged = masks.mask_runs(kept, frames, keys, only_positive=settings.only_positive, band_rows=band_rows)
    labelled = label_runs(mask, keys, band_rows=band_rows, arranged=arranged)
    parts = split.split_mask(labelled, frames, placed)
    per_seed = frames.join(placed.select(*owner), "stack_id")
    found = materialize(
        label_runs(pixel_runs(parts, owner, band_rows=band_rows), owner, band_rows=band_rows, arranged=True)
    )
    objects = describe_objects(found, owner, band_rows=band_rows)
    objects.components = materialize(objects.components)

    def find() -> DataFrame:
        return unseeded_contours(objects, per_seed, owner, band_rows=band_rows)

    return Analysis(
        stacks, per_seed, find, lambda: objects, owner, owner, settings,
        missing_method="'active_surfaces_empty'", found_method="active_surfaces",
    )


def contour_mask(contours: DataFrame, objects: Objects, keys: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """Contours as filled runs (owner, z, y, x0, x1).

    A traced outline fills its component and the holes in it; a rectangle fills its far sides too.
    """
    shape = [*keys, "z", "label"]
    traced = contours.where("method <> 'fallback'").select(*dict.fromkeys([*owner, *shape]))
    filled = objects.filled.join(traced, shape).select(*owner, "z", "y", "x0", "x1")
    return filled.unionByName(rectangle_mask(contours.where("method = 'fallback'"), owner))


def rectangle_mask(boxes: DataFrame, owner: Sequence[str]) -> DataFrame:
    return boxes.select(
        *owner, "z", F.explode(F.expr("sequence(ymin, ymax + 1)")).alias("y"),
        F.col("xmin").alias("x0"), (F.col("xmax") + 1).alias("x1"),
    )


def stack_mask(
    contours: DataFrame, objects: Objects, frames: DataFrame, keys: Sequence[str], owner: Sequence[str]
) -> DataFrame:
    """Mask stack for meshing: excluded frames empty, clipped to the image, z counted from zero."""
    placed = contour_mask(contours, objects, keys, owner).join(
        frames.where("not excluded").select(*owner, "z", "z_first", "nx", "ny"), [*owner, "z"]
    )
    clipped = placed.withColumn("x1", F.least("x1", F.col("nx") - 1)).where("x1 >= x0 and y >= 0 and y < ny")
    return clipped.select(*owner, F.expr("z - z_first").alias("z"), "y", "x0", "x1")


def mesh_shapes(frames: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Shape of the analysed part and voxel spacing per run."""
    return frames.groupBy(*owner).agg(
        F.expr("cast(max(z) - max(z_first) + 1 as int)").alias("nz"),
        *[F.max(c).alias(c) for c in ("ny", "nx", "vx_um", "vy_um", "vz_um")],
    )


def analyze(
    stacks: DataFrame, pixels: DataFrame, settings: Settings, *, excluded: DataFrame | None = None,
    band_rows: int = BAND_ROWS, objects: Objects | None = None,
) -> Analysis:
    """Largest object of every frame of every stack.

    ``objects`` are those of another analysis of the same pixels, frames and thresholds, which then are not looked for again.
    """
    if check_profile(settings.profile) == "active_surfaces":
        raise ValueError("Active surfaces profile requires an object seed")
    keys = ["stack_id"]
    # every step asks for the frames, and a table of stacks may be as dear as a scan of all pixels
    stacks = materialize(stacks)
    frames = analysed_frames(stacks, settings, excluded)
    if objects is None:
        objects = find_objects(pixels, frames, keys, settings, band_rows=band_rows)

    def find() -> DataFrame:
        return unseeded_contours(objects, frames, keys, contour=settings.contour, band_rows=band_rows)

    return Analysis(stacks, frames, find, lambda: objects, keys, keys, settings, frameless=stacks.where("nz <= 0").select(*keys))


def stack_failures(stacks: DataFrame, settings: Settings, excluded: DataFrame | None = None) -> DataFrame:
    """(stack_id, source_path, error_message) of stacks that cannot be analysed so, each with its first failing check."""
    placed = masks.place_slices(stacks, settings.slices)
    checks = [("not coalesce(vx_um > 0 and vy_um > 0 and vz_um > 0, false)", "voxel spacing must be greater than zero"), masks.NO_SLICES]
    if settings.rect is not None:
        checks.append((masks.is_empty_rect(settings.rect), masks.EMPTY_RECT))
    if isinstance(settings.thresholds, DataFrame):
        per_frame = "z" in settings.thresholds.columns
        counts = [F.count("*").alias("_given")]
        if per_frame:
            counts += [F.countDistinct("z").alias("_frames"), F.min("z").alias("_low"), F.max("z").alias("_high")]
            whole = "_given = z_stop - z_first and _frames = _given and _low = z_first and _high = z_stop - 1"
            checks.append((f"nz > 0 and not coalesce({whole}, false)", masks.FRAME_THRESHOLDS))
        else:
            checks.append(("nz > 0 and coalesce(_given, 0) <> 1", masks.STACK_THRESHOLDS))
        placed = placed.join(settings.thresholds.groupBy("stack_id").agg(*counts), "stack_id", "left")
    texts = [(condition, f"'{message}'") for condition, message in checks]
    if excluded is not None:
        outside = excluded.join(placed.select("stack_id", "z_first", "z_stop"), "stack_id").where("z < z_first or z >= z_stop")
        placed = placed.join(outside.groupBy("stack_id").agg(F.min("z").alias("_outside")), "stack_id", "left")
        texts.append(("_outside is not null", f"concat('{masks.UNKNOWN_FRAME}', _outside)"))
    return placed.select("stack_id", "source_path", first_error(*texts).alias("error_message")).where("error_message is not null")


def batch(
    stacks: DataFrame, pixels: DataFrame, settings: Settings, *, hashes: DataFrame | None = None,
    excluded: DataFrame | None = None, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per stack in the batch columns; a stack that fails a check gets its message, and the others are analysed."""
    failed = materialize(stack_failures(stacks, settings, excluded))

    def sound(table: DataFrame) -> DataFrame:
        return table.join(failed.select("stack_id"), "stack_id", "left_anti")

    limits = settings.thresholds
    # ``analyze`` writes them, or a raising check would be moved before the join that takes the failed stacks out
    found = analyze(
        sound(stacks), pixels, replace(settings, thresholds=sound(limits) if isinstance(limits, DataFrame) else limits),
        excluded=None if excluded is None else sound(excluded), band_rows=band_rows,
    )
    rows = summary.batch_rows(found.summary, hashes)
    return rows.unionByName(summary.failed_rows(failed, rows, hashes))


def analyze_seeded(
    stacks: DataFrame, pixels: DataFrame, seeds: DataFrame, settings: Settings, *,
    excluded: DataFrame | None = None, band_rows: int = BAND_ROWS, objects: Objects | None = None,
) -> Analysis:
    """One tracked object per seed, any number of seeds per stack.

    Frames where the object was lost have method ``seed_lost`` and no contour. With ``reselect`` the
    rounded centroid of the tracked component picks the measured component again, otherwise the
    tracked component itself is measured. ``objects`` are those of an unseeded analysis of the same pixels, frames and thresholds.
    """
    keys, owner = ["stack_id"], ["stack_id", "seed_id"]
    stacks = materialize(stacks)
    frames = analysed_frames(stacks, settings, excluded)
    placed = materialize(tracking.place_seeds(checked_seeds(seeds, stacks, settings), frames))
    if objects is None:
        labelled = labelled_mask(pixels, frames, keys, settings, band_rows=band_rows)
        components = materialize(run_components(labelled, keys))
    else:
        labelled = objects.runs
        components = objects.components.select(*run_components(labelled, keys).columns)
    start = tracking.seed_component(placed, components, labelled)
    pointers = tracking.successor_pointers(placed, components, labelled)
    chain = materialize(tracking.follow_chain(start, pointers, placed))
    records = materialize(tracking.tracking_records(chain, components, frames, placed, merge_reference=settings.merge_reference))
    per_seed = frames.join(placed.select(*owner), "stack_id")

    @cache
    def picked() -> DataFrame:
        if not settings.reselect:
            return chain
        return materialize(component_at_seed(components, labelled, tracking.frame_seeds(records, frames), keys, owner))

    @cache
    def describe() -> Objects:
        """Holes, outlines and hulls of the measured components only."""
        if objects is not None:
            return objects
        shape = [*keys, "z", "label"]
        found = describe_objects(labelled.join(picked().select(*shape).distinct(), shape, "left_semi"), keys, band_rows=band_rows)
        found.components = materialize(found.components)
        return found

    def find() -> DataFrame:
        return seeded_contours(picked(), describe(), per_seed, keys, owner)

    seeded_frames = per_seed.join(
        records.select(*owner, F.col("frame_index").alias("z"), "tracked"), [*owner, "z"]
    )
    return Analysis(
        stacks, seeded_frames, find, describe, keys, owner, settings, tracking=records,
        missing_method="if(tracked, 'fallback', 'seed_lost')",
    )


def sweep(
    stacks: DataFrame, pixels: DataFrame, thresholds: Sequence[float], settings: Settings, *,
    band_rows: int = BAND_ROWS,
) -> Analysis:
    """The unseeded analysis for every stack and threshold in one job.

    The pixels are read and laid out once whatever the number of thresholds above zero: a component tree of each slice is cut
    at every threshold. Thresholds of zero and less, where absent pixels belong to the mask, are labelled one by one.
    """
    keys = ["stack_id", "threshold"]
    if not thresholds:
        raise ValueError("threshold sweep requires at least one threshold")
    stacks = materialize(stacks)
    checked = masks.check_rect(stacks, settings.rect)
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    frames = masks.stack_frames(checked, settings.slices).select("*", each, F.lit(False).alias("excluded"))
    chosen = selected_pixels(pixels, settings)
    high = sorted({float(t) for t in thresholds if t > 0})
    parts = []
    if high:
        inside = chosen.join(frames.select("stack_id", "z").distinct(), ["stack_id", "z"], "left_semi")
        parts.append(label_levels(level_runs(inside, high, band_rows=band_rows), high, band_rows=band_rows))
    if any(t <= 0 for t in thresholds):
        if settings.only_positive:
            raise ValueError("thresholds must be positive here")
        mask = masks.mask_runs(chosen, frames.where("threshold <= 0"), keys, band_rows=band_rows)
        parts.append(label_runs(mask[0], keys, band_rows=band_rows, arranged=mask[1]))
    objects = describe_objects(reduce(DataFrame.unionByName, parts), keys, band_rows=band_rows)
    objects.components = materialize(objects.components)

    def find() -> DataFrame:
        return unseeded_contours(objects, frames, keys, contour=settings.contour, band_rows=band_rows)

    frameless = stacks.where("nz <= 0").select("stack_id", each)
    return Analysis(stacks, frames, find, lambda: objects, keys, keys, settings, frameless=frameless)


def best_threshold(sweep_summary: DataFrame) -> DataFrame:
    """Per stack: most valid frames, then the smallest magnitude, then the smaller threshold."""
    return sweep_summary.groupBy("stack_id").agg(
        F.max_by(
            F.struct("threshold", "valid_frame_count", "valid_fraction"),
            F.struct("valid_fraction", -F.abs("threshold"), -F.col("threshold")),
        ).alias("b")
    ).select("stack_id", "b.*")
