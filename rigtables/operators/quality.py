"""Checks on recordings: gaps, clocks, availability, detections, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtables.operators.chunks import lagged

#: The states of a trial, those that end it, and those the dispatcher has work to do for.
TRIAL_STATES = ("waiting_on_input_copy", "input_copied", "processing_queued", "processing", "output_ready", "output_copying", "complete", "failed")
TERMINAL_STATES = ("complete", "failed")
DISPATCHER_STATES = ("waiting_on_input_copy", "input_copied", "processing_queued", "processing")
FRAMES_A_CHUNK = 1_000_000


def missing_frames(frames: DataFrame, stride: int = 1, frame: str = "frame_id") -> DataFrame:
    """(recording_id, missing_frame_id): ids 0, stride, ... up to each recording's last that have no row.

    The ids wanted are made in pieces of a million, so that a long recording is spread over tasks.
    """
    last = frames.groupBy("recording_id").agg(F.max(frame).alias("last")).where("last >= 0")
    piece = stride * FRAMES_A_CHUNK
    pieces = last.select("recording_id", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(piece))).alias("from"))
    wanted = pieces.select("recording_id", F.explode(F.sequence("from", F.least("last", F.col("from") + piece - stride), F.lit(stride))).alias("missing_frame_id"))
    have = frames.select("recording_id", F.col(frame).alias("missing_frame_id"))
    return wanted.join(have, ["recording_id", "missing_frame_id"], "left_anti")


def non_increasing(frames: DataFrame, clock: str = "acquired_time_us", order: str = "frame_id") -> DataFrame:
    """Rows whose clock does not exceed that of the row before, with that value; a tie counts."""
    before = lagged(frames, order, clock, "previous_us", FRAMES_A_CHUNK)
    return before.where(F.col(clock) <= F.col("previous_us"))


def check_monotonic(frames: DataFrame, clock: str = "acquired_time_us", order: str = "frame_id") -> DataFrame:
    """(recording_id, n_frames, n_violations, monotonic) for each recording."""
    bad = non_increasing(frames, clock, order).groupBy("recording_id").agg(F.count("*").alias("n_violations"))
    n = frames.groupBy("recording_id").agg(F.count("*").alias("n_frames")).join(bad, "recording_id", "left")
    return n.select("recording_id", "n_frames", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.col("n_violations").isNull().alias("monotonic"))


def availability(muscle: DataFrame, groups: DataFrame, tolerance: int = 3, first: Column | int = 0, frame: str = "raw_frame_id", leading: bool = False) -> DataFrame:
    """(recording_id, n_groups, kept, verdict) for groups (recording_id, n_groups, ...).

    Ids first .. first + n_groups - 1 are wanted; `first` may be a column of groups. One missing before the
    last that is there: `hole`, with `leading` also one of those before `first`. More than `tolerance` + `first`
    groups without a frame at the end: `too_few`. Else `ok`.
    """
    least = F.lit(0) if leading else F.col("_first")
    wanted = groups.select("recording_id", "n_groups", (first if isinstance(first, Column) else F.lit(first)).alias("_first"))
    ids = muscle.select("recording_id", F.col(frame).alias("_id")).join(wanted, "recording_id").where((F.col("_id") >= least) & (F.col("_id") < F.col("_first") + F.col("n_groups")))
    seen = ids.groupBy("recording_id").agg(F.count_distinct(F.when(F.col("_id") >= F.col("_first"), F.col("_id"))).alias("kept"), F.count_distinct("_id").alias("_there"))
    beyond = muscle.groupBy("recording_id").agg(F.max(frame).alias("_end"))
    every = wanted.join(seen, "recording_id", "left").join(beyond, "recording_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kept", "_there")})
    hole = F.least("_end", F.col("_first") + F.col("n_groups") - 1) - least + 1 > F.col("_there")
    few = F.col("n_groups") - F.col("kept") - F.col("_first") > tolerance
    return every.select("recording_id", "n_groups", "kept", F.when(hole, "hole").when(few, "too_few").otherwise("ok").alias("verdict"))


def filter_detections(detections: DataFrame, margin: float = 20.0) -> DataFrame:
    """Detections with a decision margin of at least `margin` and the tag that was expected."""
    return detections.where((F.col("decision_margin") >= margin) & (F.col("detected_id") == F.col("apriltag_id")))


def spurious_detections(detections: DataFrame, margin: float = 20.0) -> DataFrame:
    """(apriltag_id, n_confident, n_spurious): confident detections, and those of another tag than expected."""
    sure = F.col("decision_margin") >= margin
    return detections.groupBy("apriltag_id").agg(F.count_if(sure).alias("n_confident"), F.count_if(sure & (F.col("detected_id") != F.col("apriltag_id"))).alias("n_spurious"))


def alignment_flag_conflict(path: Column, aligned: Column) -> Column:
    """True where a path speaks of full-size frames though they are aligned, or of aligned ones though they are not."""
    plain = F.lower(F.translate(path, "_-", ""))
    return F.when(aligned, F.contains(plain, F.lit("fullsize"))).otherwise(F.contains(plain, F.lit("aligned")))


def status_class(status: Column) -> Column:
    """`terminal`, `dispatcher` (work to do there), `client`, or `invalid` for what is no state of a trial."""
    known = F.when(status.isin(*TERMINAL_STATES), "terminal").when(status.isin(*DISPATCHER_STATES), "dispatcher")
    return known.when(status.isin(*TRIAL_STATES), "client").otherwise("invalid")


def overrun_cycles(log: DataFrame, hz: int, clock: str = "timestamp_us") -> DataFrame:
    """Rows that came at least one period (1e6 div hz us) after the row before, with elapsed_us."""
    before = lagged(log, clock, clock, "previous_us", 3_600_000_000)
    elapsed = F.col(clock) - F.col("previous_us")
    return before.withColumn("elapsed_us", elapsed).where(F.col("elapsed_us") >= 1_000_000 // hz).drop("previous_us")
