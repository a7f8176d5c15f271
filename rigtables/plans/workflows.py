"""Whole jobs over many recordings at once: post-processing and calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtables.durable import kept, packed
from rigtables.functions import geometry as g
from rigtables.operators import calibration as cal
from rigtables.operators import pixels, pose, quality, stage, sync


IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def pair_cameras(muscle: DataFrame, behavior: DataFrame, log: DataFrame, ratios: DataFrame) -> DataFrame:
    """Each muscle frame with its slot, behavior frame and stage position, on the line between the samples around."""
    groups = sync.sync_group_frames(behavior, ratios).select("recording_id", "slot", F.col("frame_id").alias("behavior_frame_id"), F.col("received_time_us").alias("group_received_us"))
    paired = sync.muscle_slot_join(sync.detect_dropped_frames(muscle), groups)
    return stage.interp_stage_linear(paired, log, "group_received_us")


@dataclass
class Processed:
    behavior: DataFrame
    alignment: DataFrame | None
    muscle: DataFrame | None
    errors: DataFrame
    warped: DataFrame | None = None


def refuse(errors: DataFrame) -> None:
    """Raises with the first few of the rules that recordings broke."""
    some = errors.orderBy("recording_id", "rule").limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r.recording_id}: {r.rule}" for r in some))


def postprocess_recordings(
    behavior: DataFrame,
    log: DataFrame,
    predictions: DataFrame | None = None,
    muscle: DataFrame | None = None,
    params: DataFrame | None = None,
    muscle_pixels: DataFrame | None = None,
    orphans: DataFrame | None = None,
    align_fly: bool = True,
    with_muscle: bool = True,
    crop: int = 900,
    tolerance: int = 3,
    earlier: tuple[DataFrame, DataFrame | None] | None = None,
    homography: list[float] | None = None,
    strict: bool = False,
    full_size: tuple[int, int] | None = None,
) -> Processed:
    """All recordings at once. One that breaks a rule is named in `errors` (recording_id, rule) and left out; the rest go on.

    behavior: (recording_id, behavior_frame_id, acquired_time_us, received_time_us); log: the stage log;
    predictions: keypoints; muscle: (recording_id, raw_frame_id, acquired_time_us, received_time_us); params:
    (recording_id, ratio); orphans: (recording_id, n_orphans), counted from muscle_pixels where absent. Raw muscle
    ids are judged as they come from disk: a hole in them, among the orphans too, ends a recording's part in the job. With `strict` the
    first broken rule is raised instead. `homography` (9 numbers, muscle to behavior pixels) is put before each
    frame's alignment. With muscle_pixels (frame_id the raw id) they are resampled smoothly: into the aligned crop, or without alignment
    by the homography alone into frames of `full_size` (height, width), that of behavior frames. A muscle frame whose behavior frame has
    no alignment is black. `earlier` hands in behavior and alignment tables of an earlier run instead of making them.
    """
    unsteady = quality.check_monotonic(behavior, order="behavior_frame_id").where("NOT monotonic").select("recording_id", F.lit("acquisition times do not increase").alias("rule"))
    unlogged = behavior.select("recording_id").distinct().join(log, "recording_id", "left_anti").select("recording_id", F.lit("no stage samples").alias("rule"))
    bad = unsteady.unionByName(stage.bad_stage_logs(log)).unionByName(unlogged)
    posed = None
    if align_fly and predictions is not None:
        posed = kept(pose.pivot_pose(predictions))
        bad = bad.unionByName(posed.where("n_instances > 1").select("recording_id", F.lit("several instances in a frame").alias("rule")).distinct())
    if with_muscle and params is not None:
        bad = bad.unionByName(behavior.select("recording_id").distinct().join(params, "recording_id", "left_anti").select("recording_id", F.lit("no sync ratio").alias("rule")))
    bad = kept(bad)
    good = lambda df: df.join(bad.select("recording_id").distinct(), "recording_id", "left_anti")

    if earlier is not None:
        placed, alignment = earlier
    else:
        placed = kept(stage.interp_stage_cubic(good(behavior), log))
        alignment = pose.alignment_transform(pose.fill_pose_gaps(good(posed).drop("n_instances")), crop) if posed is not None else None
    if not with_muscle or muscle is None or params is None:
        if strict:
            refuse(bad)
        return Processed(placed, alignment, None, bad)

    if orphans is None:
        orphans = pixels.count_leading_orphans(muscle_pixels) if muscle_pixels is not None else params.select("recording_id", F.lit(0).alias("n_orphans"))
    orphans = kept(orphans)
    groups = kept(sync.sync_group_frames(placed, params.select("recording_id", "ratio"), frame="behavior_frame_id"))
    n_groups = groups.groupBy("recording_id").agg(F.count("*").alias("n_groups"))
    wanted = n_groups.join(orphans, "recording_id", "left").select("recording_id", "n_groups", F.coalesce("n_orphans", F.lit(0)).alias("first"))
    verdicts = quality.availability(good(muscle), wanted, tolerance, F.col("first"), leading=True)
    bad = kept(bad.unionByName(verdicts.where("verdict != 'ok'").select("recording_id", F.concat(F.lit("muscle frames: "), "verdict").alias("rule"))))
    asked = muscle.join(wanted, "recording_id").where("raw_frame_id < first + n_groups").drop("first", "n_groups")
    steady = kept(sync.reindex_muscle(asked.join(bad.select("recording_id").distinct(), "recording_id", "left_anti"), orphans, "raw_frame_id"))
    slots = sync.discard_trailing_slots(sync.detect_dropped_frames(steady, frame="muscle_frame_id"), n_groups)
    at = groups.select("recording_id", "slot", F.col("behavior_frame_id").alias("corresponding_behavior_frame_id"), *(F.col(c).cast("float").alias(c) for c in ("x_pos_mm_interp", "y_pos_mm_interp")))
    paired = sync.muscle_slot_join(slots, at)
    matrix = F.array(*map(F.lit, homography or IDENTITY)).cast("array<double>")
    if alignment is not None:
        m = alignment.select("recording_id", F.col("behavior_frame_id").alias("corresponding_behavior_frame_id"), g.as_3x3(F.col("m")).alias("alignment"))
        paired = paired.join(m, ["recording_id", "corresponding_behavior_frame_id"], "left")
        matrix = g.compose(F.col("alignment"), matrix)
    paired = paired.withColumn("alignment", matrix)
    if strict:
        refuse(bad)
    warped, size = None, (crop, crop) if alignment is not None else full_size
    if muscle_pixels is not None and size is None:
        raise ValueError("without alignment, full_size tells how large the resampled frames are")
    if muscle_pixels is not None:
        at = paired.select("recording_id", "raw_frame_id", "muscle_frame_id", F.col("alignment").alias("m"))
        frames = muscle_pixels.withColumnRenamed("frame_id", "raw_frame_id").join(at, ["recording_id", "raw_frame_id"])
        warped = pixels.warp_frame(frames, *size, smooth=True)
    return Processed(placed, alignment, paired, bad, warped)


def fit_arena_registration(scan: DataFrame, detections: DataFrame, tags: DataFrame, threshold: float = 0.5, trials: int = 1000) -> DataFrame:
    """One row for each calibration_id: weights both ways and the fit's figures; no points give no row.

    scan, detections and tags are those of calibration_points(), with calibration_id in scan. The points, and those that stay after
    outliers are left out, are written once, in the columns that are used; all that follows reads them, and shuffles few of them.
    """
    seen = quality.filter_detections(detections.withColumn("detected_id", F.coalesce("detected_id", "apriltag_id")))
    names = {"stage_x_mm": "stage_x", "stage_y_mm": "stage_y", "pixel_x_px": "pixel_x", "pixel_y_px": "pixel_y", "physical_x_mm": "physical_x", "physical_y_mm": "physical_y"}
    keys = ["calibration_id", "apriltag_id", "corner_id"]
    points = packed(cal.calibration_points(scan, seen, tags).where("physical_x_mm IS NOT NULL").select(*keys, "image_id", *names), "points")
    near = cal.mad_outlier_filter(points, keys).where("kept")
    keyed = packed(near.select("calibration_id", F.xxhash64("apriltag_id", "image_id", "corner_id").alias("point"), *(F.col(c).alias(n) for c, n in names.items())), "near_points")
    fit, judged = cal.ransac_linear_fit(keyed, "point", threshold, trials)
    return fit.join(cal.fit_metrics(judged), "calibration_id").withColumn("inverse_weights", g.invert_pixel_block(F.col("weights")))


def fit_homography(detections: DataFrame, threshold: float = 3.0, trials: int = 1000, noise_px: float = 1.0) -> DataFrame:
    """One row: the homography from muscle to behavior pixels, its inverse, and the reprojection figures; no matches give no row."""
    consensus = kept(cal.corner_consensus(detections, noise_px))
    sides = [consensus.where(F.col("camera") == k).select("stage_x", "stage_y", "corner_id", "x", "y") for k in ("muscle", "behavior")]
    shared = cal.common_positions(*sides)
    matches = kept(cal.match_corners(*(x.join(shared, ["stage_x", "stage_y"], "left_semi") for x in sides)))
    keyed = matches.withColumns({"calibration_id": F.lit(0), "point": F.xxhash64("stage_x", "stage_y", "corner_id")})
    fit, judged = cal.homography_fit(keyed, "point", threshold, trials)
    return fit.join(cal.reprojection_stats(judged).drop("n_inliers"), "calibration_id").withColumn("h_inverse", g.invert_3x3(F.col("h"))).drop("calibration_id")
