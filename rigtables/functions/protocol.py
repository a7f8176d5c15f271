"""Experiment protocols: parsing, channel states by frame, the programmed stop, save names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigtables.durable import kept
from rigtables.operators.chunks import last_at_or_before

#: Steps and recordings that are sent to all tasks; shares of a recording's frames that meet its steps apart otherwise.
MOST_BROADCAST, SALTS = 1_000_000, 64


def parse_protocol(protocols: DataFrame, text: str = "protocol") -> DataFrame:
    """(recording_id, valid, steps): steps are an array of (step, frame_idx, channel, op), channel -1 for the stop.

    A `;`-list of `frame/channel/op`; null, empty or `;` has no steps. One trailing `;` and parts after the
    third are ignored. Channel 2 or 3 goes on or off; the last step, and it alone, is `x/stop`. Anything else
    is not valid and has null steps.
    """
    whole = F.coalesce(text, F.lit(""))
    none = (whole == "") | (whole == ";")
    tokens = F.split(F.regexp_replace(whole, ";$", ""), ";")

    def step(t: Column, i: Column) -> Column:
        toggled, stop = r"^(\d+)/ch([23])/(on|off)(/.*)?$", r"^(\d+)/x/stop(/.*)?$"
        number = F.regexp_extract(t, r"^(\d+)/", 1).try_cast("long")
        channel = F.when(F.rlike(t, F.lit(stop)), -1).when(F.rlike(t, F.lit(toggled)), F.regexp_extract(t, toggled, 2).try_cast("int"))
        op = F.when(F.rlike(t, F.lit(stop)), "stop").when(F.rlike(t, F.lit(toggled)), F.regexp_extract(t, toggled, 3))
        return F.struct(i.alias("step"), number.alias("frame_idx"), channel.alias("channel"), op.alias("op"))

    steps = F.transform(tokens, step)
    parsed = protocols.select("recording_id", none.alias("_none"), steps.alias("_steps"))
    good = F.forall("_steps", lambda s: s["op"].isNotNull() & s["frame_idx"].isNotNull())
    stops = F.size(F.filter("_steps", lambda s: s["op"] == "stop"))
    valid = F.col("_none") | (good & (stops == 1) & (F.get("_steps", F.size("_steps") - 1)["op"] == "stop"))
    return parsed.select("recording_id", valid.alias("valid"), F.when(F.col("_none"), F.slice("_steps", 1, 0)).when(valid, F.col("_steps")).alias("steps"))


def channel_intervals(parsed: DataFrame) -> DataFrame:
    """(recording_id, from_frame, to_frame, ch2, ch3): states between steps; to_frame is exclusive, null without end.

    A step waits for those before it, so it fires at the running maximum of their frames. Of steps that fire
    at one frame the last word on a channel counts. The stop turns both off for good. What was parsed is kept at a
    checkpoint: the plan would parse it again wherever it looks at a step.
    """
    each = kept(parsed.select("recording_id", "valid", "steps")).where("valid").select("recording_id", F.explode("steps").alias("s")).select("recording_id", "s.*")
    so_far = W.partitionBy("recording_id").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    state = lambda c: F.last(F.when(F.col("op") == "stop", False).when(F.col("channel") == c, F.col("op") == "on"), True).over(so_far)
    fired = each.select("recording_id", "step", F.max("frame_idx").over(so_far).alias("from_frame"), state(2).alias("ch2"), state(3).alias("ch3"))
    last = fired.groupBy("recording_id", "from_frame").agg(F.max_by(F.struct("ch2", "ch3"), "step").alias("s"))
    following = W.partitionBy("recording_id").orderBy("from_frame")
    return last.select("recording_id", "from_frame", F.lead("from_frame").over(following).alias("to_frame"), *(F.coalesce(f"s.{c}", F.lit(False)).alias(c) for c in ("ch2", "ch3")))


def state_arrays(parsed: DataFrame) -> DataFrame:
    """(recording_id, from_frames, states): the frames at which a recording's channels change, ascending, and what they are from there on."""
    step = F.struct("from_frame", F.struct("ch2", "ch3").alias("state"))
    each = channel_intervals(parsed).groupBy("recording_id").agg(F.sort_array(F.collect_list(step)).alias("_s"))  # the steps of one protocol
    return each.select("recording_id", F.col("_s.from_frame").alias("from_frames"), F.col("_s.state").alias("states"))


def protocol_state_join(frames: DataFrame, parsed: DataFrame, frame: str = "frame_id", most_broadcast: int = MOST_BROADCAST, salts: int = SALTS) -> DataFrame:
    """frames with ch2 and ch3; both off before the first step and without a valid protocol.

    Each recording's steps are an array in which a frame's is looked up. The arrays are counted: up to `most_broadcast` steps and
    recordings are sent to all tasks and no frame moves; more meet the frames by recording and one of `salts` shares of its frames.
    """
    arrays = kept(state_arrays(parsed))
    total, most = arrays.agg(F.coalesce(F.sum(1 + F.size("states")), F.lit(0)), F.coalesce(F.max(F.size("states")), F.lit(0))).first()
    if total <= most_broadcast:
        met = frames.join(F.broadcast(arrays), "recording_id", "left")
    else:
        shares = arrays.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = frames.withColumn("_share", F.pmod(F.xxhash64(frame), F.lit(salts)).cast("int")).join(shares, ["recording_id", "_share"], "left")
    at = last_at_or_before(F.col("from_frames"), F.col(frame), most)
    found = met.withColumn("_state", F.get("states", at))
    return found.select(*frames.columns, *(F.coalesce(f"_state.{c}", F.lit(False)).alias(c) for c in ("ch2", "ch3")))


def programmed_stop(frames: DataFrame, parsed: DataFrame, frame: str = "frame_id", every: Column | None = None) -> DataFrame:
    """Frames below the protocol's stop index (for muscle frames `every` is the sync ratio); all without a stop."""
    stop = parsed.where("valid").select("recording_id", F.get(F.filter("steps", lambda s: s["op"] == "stop"), F.lit(0))["frame_idx"].alias("_stop"))
    limit = F.col("_stop") if every is None else F.floor(F.col("_stop") / every)
    return frames.join(stop, "recording_id", "left").where(F.col("_stop").isNull() | (F.col(frame) < limit)).drop("_stop")


def increment_name(path: Column) -> Column:
    """The next name: its number plus one, as wide as before or wider; `_001` without a number; ends with `/`."""
    plain = F.regexp_replace(path, "/+$", "")
    stem, digits = F.regexp_extract(plain, r"^(.*?)(\d*)$", 1), F.regexp_extract(plain, r"(\d*)$", 1)
    next_ = (digits.try_cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")
    return F.when(digits == "", F.concat(plain, F.lit("_001/"))).otherwise(F.concat(stem, F.lpad(next_, F.greatest(F.length(digits), F.length(next_)), F.lit("0")), F.lit("/")))


def accessible_cells(mask: DataFrame, margin_cells: int) -> DataFrame:
    """Open cells (arena, col, row) without a wall cell or the arena's border in the ellipse of margin_cells around them.

    A row of the ellipse, r from its middle, reaches round(sqrt(margin^2 - r^2)) cells to both sides (half to even).

    mask: (arena, col, row, open) of all cells. Walls are runs along rows: a run closes one longer run in each of the 2 margin_cells + 1
    rows around. The runs that close cells of a row are merged, and each cell is looked up among them.
    """
    reach = F.array(*(F.struct(F.lit(r).cast("long").alias("r"), F.lit(round(math.sqrt(margin_cells * margin_cells - r * r))).cast("long").alias("n")) for r in range(-margin_cells, margin_cells + 1)))
    along = W.partitionBy("arena", "row").orderBy("col")
    walls = mask.where("NOT open").select("arena", "row", "col", (F.col("col") - F.row_number().over(along)).alias("_run"))
    runs = walls.groupBy("arena", "row", "_run").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    grown = runs.select("arena", F.explode(reach).alias("k"), "row", "a", "b").select("arena", (F.col("row") + F.col("k.r")).alias("row"), (F.col("a") - F.col("k.n")).alias("a"), (F.col("b") + F.col("k.n")).alias("b"))
    ordered = W.partitionBy("arena", "row").orderBy("a", "b")
    fresh = F.when(F.col("a") > F.max("b").over(ordered.rowsBetween(W.unboundedPreceding, -1)) + 1, 1).otherwise(0)
    merged = grown.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy("arena", "row", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    closed = merged.groupBy("arena", "row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_closed"))  # the runs of one row
    closed = kept(closed.select("arena", "row", F.col("_closed.a").alias("_from"), F.col("_closed.b").alias("_to")))
    most = closed.agg(F.coalesce(F.max(F.size("_from")), F.lit(0))).first()[0]
    size = mask.groupBy("arena").agg(F.max("col").alias("_cols"), F.max("row").alias("_rows"))
    m = margin_cells
    inner = mask.where("open").join(size, "arena").where((F.col("col") >= m) & (F.col("row") >= m) & (F.col("col") <= F.col("_cols") - m) & (F.col("row") <= F.col("_rows") - m))
    met = inner.join(closed, ["arena", "row"], "left").withColumn("_end", F.get("_to", last_at_or_before(F.col("_from"), F.col("col"), most)))
    return met.where("_end IS NULL OR _end < col").select("arena", "col", "row")


def inside_active_area(points: DataFrame, cells: DataFrame, resolution: float, x: str = "physical_x", y: str = "physical_y") -> DataFrame:
    """points (arena, ...) with `accessible`: whether their nearest cell is one of `cells`; outside the arena none is."""
    at = points.withColumns({"col": F.rint(F.col(x) / resolution).cast("long"), "row": F.rint(F.col(y) / resolution).cast("long")})
    known = cells.withColumn("_in", F.lit(True))
    return at.join(known, ["arena", "col", "row"], "left").select(*points.columns, F.col("_in").isNotNull().alias("accessible"))
