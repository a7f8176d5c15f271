"""Pairing the slow muscle camera with the fast behavior camera."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigtables.durable import kept
from rigtables.operators.chunks import beside, carried, laid_out, lagged, last_at_or_before, numbered, starts

#: Frames of a chunk; frames around candidates that are sought by broadcast.
FRAMES_A_CHUNK, MOST_NEAR = 1_000_000, 1_000_000


def resolve_sync_ratio(params: DataFrame) -> DataFrame:
    """params with sync_ratio, used_legacy: muscle_sync_ratio of the current file, else the legacy sync_ratio, else of the sibling.

    A recording without any is an error of its own: sync_ratio null, ratio_error set.
    """
    ratio = F.coalesce("muscle_sync_ratio", "sync_ratio_legacy_key", "muscle_sync_ratio_sibling", "sync_ratio_sibling")
    return params.withColumns({
        "sync_ratio": ratio,
        "used_legacy": F.col("muscle_sync_ratio").isNull() & ratio.isNotNull(),
        "ratio_error": F.when(ratio.isNull(), "no sync ratio"),
    })


def sync_group_frames(frames: DataFrame, ratios: DataFrame, offset: int = 0, frame: str = "frame_id") -> DataFrame:
    """The behavior frames at which a muscle frame is due, numbered 0, 1, ... as `slot`; ratios: (recording_id, ratio)."""
    due = frames.join(ratios, "recording_id").where((F.col(frame) % F.col("ratio") == 0) & (F.col(frame) >= offset * F.col("ratio")))
    return numbered(due, frame, "slot", FRAMES_A_CHUNK)


def detect_dropped_frames(muscle: DataFrame, gap: float = 1.5, persistence: int = 12, frame: str = "frame_id", clock: str = "acquired_time_us", slack: float = 0.35) -> DataFrame:
    """muscle with slot and missed: exposures lost before each frame push its slot up.

    With period the median interval and excess the time in periods less the frame's index, a gap of over
    `gap` periods is a candidate. It is a drop if the median excess of the `persistence` frames from it on
    exceeds that of those before by nearly a whole number (half-even rounding, `slack`) of one or more.
    Fewer than 3 frames or a period of 0 or less: slot is the index. `frame` is unique in a recording.

    The frames move once, by chunks, and are kept there. Their index, interval and excess come with a row for each chunk;
    so do the chunk's drops, in which a frame finds how many there are up to it. Medians are taken for candidates alone, around
    which frames are sought by index: by broadcast up to MOST_NEAR of them, by a join beyond.
    """
    key, half = "recording_id", F.lit(0.5)
    last, inside = F.last(clock).over(W.partitionBy(key, "_chunk").orderBy(frame).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), W.partitionBy(key, "_chunk").orderBy(frame)
    columns = [c for c in muscle.columns if c not in ("slot", "missed")]
    rows = laid_out(muscle.select(*columns), frame, FRAMES_A_CHUNK, {"_before": F.lag(clock).over(inside), "_n": F.count("*").over(W.partitionBy(key, "_chunk")), "_last": last})
    chunks = rows.where("_row = 1").select(key, "_chunk", "_n", "_last", F.col(clock).alias("_first"))
    chunks = kept(chunks.select("*", starts(chunks).alias("_start"), F.lag("_last").over(W.partitionBy(key).orderBy("_chunk")).alias("_in")))
    rows, n = rows.drop("_n", "_last"), chunks.count()
    previous = F.when(F.col("_row") > 1, F.col("_before")).otherwise(F.col("_in"))
    stats = beside(rows, chunks.select(key, "_chunk", "_in"), n).groupBy(key).agg(F.percentile(F.col(clock) - previous, half).alias("_period"))
    whole = chunks.groupBy(key).agg(F.sum("_n").alias("_all"), F.min_by("_first", "_chunk").alias("_t0"))
    chunks = kept(chunks.join(stats, key, "left").join(whole, key))
    timed = beside(rows, chunks.select(key, "_chunk", "_in", "_start", "_period", "_all", "_t0"), n)
    timed = timed.withColumns({"_i": F.col("_start") + F.col("_row") - 1, "_ok": (F.col("_all") >= 3) & (F.col("_period") > 0), "_step": F.col(clock) - previous})
    timed = timed.withColumn("_excess", F.when(F.col("_ok"), (F.col(clock) - F.col("_t0")) / F.col("_period") - F.col("_i")))
    candidates = kept(timed.where(F.col("_ok") & (F.col("_step") > gap * F.col("_period"))).select(key, "_chunk", F.col("_i").alias("_at")))
    near = candidates.select(key, "_at", F.explode(F.sequence(F.col("_at") - persistence, F.col("_at") + persistence - 1)).alias("_i"))
    few = 2 * persistence * candidates.count() <= MOST_NEAR
    around = timed.select(key, "_i", "_excess").join(F.broadcast(near) if few else near, [key, "_i"]).groupBy(key, "_at")
    steps = around.agg(
        F.percentile(F.when(F.col("_i") < F.col("_at"), F.col("_excess")), half).alias("_before"),
        F.percentile(F.when(F.col("_i") >= F.col("_at"), F.col("_excess")), half).alias("_after"),
    ).withColumn("_shift", F.col("_after") - F.col("_before"))
    whole = F.rint("_shift")
    drops = steps.where((whole >= 1) & (F.abs(F.col("_shift") - whole) <= slack)).join(candidates, [key, "_at"]).select(key, "_chunk", "_at", whole.cast("long").alias("_lost"))
    drops = drops.withColumn("_total", F.sum("_lost").over(W.partitionBy(key, "_chunk").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)))
    one = F.sort_array(F.collect_list(F.struct("_at", "_lost", "_total")))  # of one chunk
    drops = kept(drops.groupBy(key, "_chunk").agg(one.alias("_drops"), F.sum("_lost").alias("_sum")))
    most = drops.agg(F.coalesce(F.max(F.size("_drops")), F.lit(0))).first()[0]
    earlier = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = chunks.join(drops, [key, "_chunk"], "left").select(key, "_chunk", "_start", earlier.alias("_base"), F.col("_drops._at").alias("_at"), F.col("_drops._lost").alias("_lost"), F.col("_drops._total").alias("_total"))
    found = beside(rows.drop("_before"), every, n).withColumn("_i", F.col("_start") + F.col("_row") - 1)
    found = found.withColumn("_k", F.coalesce(last_at_or_before(F.col("_at"), F.col("_i"), most), F.lit(-1)))
    total = F.col("_base") + F.coalesce(F.get("_total", F.col("_k")), F.lit(0))
    missed = F.when(F.get("_at", F.col("_k")) == F.col("_i"), F.get("_lost", F.col("_k"))).otherwise(0)
    return found.select(*columns, (F.col("_i") + total).cast("long").alias("slot"), F.coalesce(missed, F.lit(0)).alias("missed"))


def discard_trailing_slots(slots: DataFrame, groups: DataFrame) -> DataFrame:
    """Muscle frames whose slot has a group; groups: (recording_id, n_groups)."""
    return slots.join(groups, "recording_id").where("slot < n_groups").drop("n_groups")


def muscle_slot_join(slots: DataFrame, groups: DataFrame) -> DataFrame:
    """Each muscle frame with the behavior frame of its slot; groups: (recording_id, slot, ...)."""
    return slots.join(groups, ["recording_id", "slot"])


def alignment_at_muscle(alignment: DataFrame, ratios: DataFrame, offset: int = 0, frame: str = "behavior_frame_id") -> DataFrame:
    """Alignment rows at every ratio-th behavior frame from offset * ratio on, with the muscle frame they are for."""
    due = alignment.join(ratios, "recording_id").where((F.col(frame) % F.col("ratio") == 0) & (F.col(frame) >= offset * F.col("ratio")))
    return due.withColumn("muscle_frame_id", F.expr(f"{frame} div ratio") - offset)


def nearest_muscle_frame(behavior: DataFrame, muscle: DataFrame) -> DataFrame:
    """(recording_id, behavior_frame_id, muscle_frame_id) with the muscle frame nearest by behavior id; the earlier if two are.

    behavior: (recording_id, behavior_frame_id); muscle: (recording_id, muscle_frame_id, corresponding_behavior_frame_id).
    """
    at = F.struct(F.col("corresponding_behavior_frame_id").alias("at"), "muscle_frame_id")
    anchors = muscle.select("recording_id", F.col("corresponding_behavior_frame_id").alias("behavior_frame_id"), at.alias("anchor"), F.lit(0).alias("side"))
    asked = behavior.select("recording_id", "behavior_frame_id", F.lit(None).cast(anchors.schema["anchor"].dataType).alias("anchor"), F.lit(1).alias("side"))
    both = carried(anchors.unionByName(asked), "behavior_frame_id", FRAMES_A_CHUNK, F.col("anchor"), ties=["side"])
    b, earlier, later = F.col("behavior_frame_id"), F.col("before.at"), F.col("after.at")
    nearest = F.when(earlier.isNull() | (later - b < b - earlier), F.col("after.muscle_frame_id")).otherwise(F.col("before.muscle_frame_id"))
    return both.where("side = 1").select("recording_id", "behavior_frame_id", nearest.alias("muscle_frame_id"))


def skipped_groups(slots: DataFrame, ratios: DataFrame) -> DataFrame:
    """(recording_id, slot, behavior_frame_id) of groups between a recording's first and last slot that have no muscle frame."""
    before = lagged(slots.select("recording_id", "slot"), "slot", "slot", "previous", FRAMES_A_CHUNK).where("slot - previous > 1")
    gaps = before.select("recording_id", F.explode(F.sequence(F.col("previous") + 1, F.col("slot") - 1)).alias("slot"))
    return gaps.join(ratios, "recording_id").select("recording_id", "slot", (F.col("slot") * F.col("ratio")).alias("behavior_frame_id"))


def reindex_muscle(muscle: DataFrame, orphans: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Muscle frames without the leading orphans, numbered from 0; orphans: (recording_id, n_orphans), negative counts are refused."""
    orphans = orphans.withColumn("n_orphans", F.when(F.col("n_orphans") < 0, F.raise_error(F.lit("n_orphans must not be negative"))).otherwise(F.col("n_orphans")))
    placed = numbered(muscle, frame, "_i", FRAMES_A_CHUNK).join(orphans.select("recording_id", "n_orphans"), "recording_id", "left")
    n = F.coalesce("n_orphans", F.lit(0))
    return placed.where(F.col("_i") >= n).withColumn("muscle_frame_id", F.col("_i") - n).drop("_i", "n_orphans")


def group_of_three(frames: DataFrame, frame: str = "frame_id") -> DataFrame:
    """(recording_id, group_id, num_valid, frames): frames in groups of 3 by id; the last may hold 1 or 2."""
    return (
        frames.groupBy("recording_id", F.expr(f"{frame} div 3").alias("group_id"))
        .agg(F.count("*").alias("num_valid"), F.sort_array(F.collect_list(F.struct(frame, "acquired_time_us", "received_time_us"))).alias("frames"))
    )


def overlay_sample(muscle: DataFrame, num_samples: int) -> DataFrame:
    """Every max(1, n div num_samples)-th muscle frame of a recording in order of muscle_frame_id."""
    n = muscle.groupBy("recording_id").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {num_samples}")).alias("_step"))
    return numbered(muscle, "muscle_frame_id", "_i", FRAMES_A_CHUNK).join(n, "recording_id").where("_i % _step = 0").drop("_i", "_step")


def muscle_to_behavior(muscle_frame_id: Column, ratio: Column, offset: int = 0) -> Column:
    return (muscle_frame_id + offset) * ratio


def behavior_to_muscle(behavior_frame_id: Column, ratio: Column, method: str = "floor", offset: int = 0) -> Column:
    """`floor` truncates towards zero, `nearest` rounds half to even; the case of the name does not matter."""
    exact = behavior_frame_id / ratio - offset
    if method.lower() == "floor":
        return exact.cast("long")
    if method.lower() == "nearest":
        return F.rint(exact).cast("long")
    raise ValueError(f"method is floor or nearest, not {method}")
