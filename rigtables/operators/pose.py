"""Keypoints of the fly: one row a frame, gaps filled, alignment transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtables.functions.geometry import apply_affine
from rigtables.operators.chunks import carried

KEYPOINTS = ("neck", "thorax", "abdomen")
FRAMES_A_CHUNK = 1_000_000


def pivot_pose(predictions: DataFrame, keypoints: tuple[str, ...] = KEYPOINTS) -> DataFrame:
    """(recording_id, behavior_frame_id, n_instances, <keypoint>_x, <keypoint>_y ...) from (.., instance_id, keypoint, x, y).

    A frame without a prediction for a keypoint has NaN there. More than one instance is for the caller to refuse.
    """
    pivoted = predictions.groupBy("recording_id", "behavior_frame_id")
    cells = [F.coalesce(F.min(F.when(F.col("keypoint") == k, F.col(c))), F.lit(float("nan"))).alias(f"{k}_{c}") for k in keypoints for c in ("x", "y")]
    return pivoted.agg(F.count_distinct("instance_id").alias("n_instances"), *cells)


def _valid(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def fill_pose_gaps(pose: DataFrame, keypoints: tuple[str, ...] = KEYPOINTS) -> DataFrame:
    """pose, each frame with a missing keypoint replaced whole by the last complete one, or the first one for those before.

    Recordings without a complete frame stay as they are.
    """
    columns = [f"{k}_{c}" for k in keypoints for c in ("x", "y")]
    whole = F.when(_valid(columns), F.struct(*columns))
    found = carried(pose, "behavior_frame_id", FRAMES_A_CHUNK, whole)
    use = F.coalesce("before", "after", F.struct(*columns))
    return found.withColumn("_use", use).select(*(F.col(f"_use.{c}").alias(c) if c in columns else F.col(c) for c in pose.columns))


def alignment_matrix(neck: tuple[Column, Column], thorax: tuple[Column, Column], abdomen: tuple[Column, Column], crop: int) -> Column:
    """2 x 3 matrix that turns the frame about the thorax until abdomen to neck points up, with the thorax in a crop's centre."""
    hx, hy = neck[0] - abdomen[0], neck[1] - abdomen[1]
    turn = F.radians(F.lit(-90.0)) - F.atan2(hy, hx)
    c, s = F.cos(turn), F.sin(turn)
    (x, y), half = thorax, crop / 2
    return F.array(c, -s, half - c * x + s * y, s, c, half - s * x - c * y)


def alignment_transform(pose: DataFrame, crop: int, keypoints: tuple[str, str, str] = KEYPOINTS) -> DataFrame:
    """(recording_id, behavior_frame_id, m, <keypoint>_x_aligned, ...) of filled poses."""
    neck, thorax, abdomen = ((F.col(f"{k}_x"), F.col(f"{k}_y")) for k in keypoints)
    made = pose.withColumn("m", alignment_matrix(neck, thorax, abdomen, crop))
    out = []
    for k in keypoints:
        x, y = apply_affine(F.col("m"), F.col(f"{k}_x"), F.col(f"{k}_y"))
        out += [x.alias(f"{k}_x_aligned"), y.alias(f"{k}_y_aligned")]
    return made.select("recording_id", "behavior_frame_id", "m", *out)
