"""Where the stage was: positions at frame times, trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtables.operators.chunks import carried, numbered

#: A chunk of the log in us; knots in a spline's chunk, and beside it: a knot's influence falls to about 0.27 with each knot.
LOG_CHUNK_US, KNOTS, BESIDE = 3_600_000_000, 4096, 40
#: Knots, with those that only fill up, that are solved for in one array.
KNOTS_AT_ONCE = 1 << 18


def bracketed(frames: DataFrame, log: DataFrame, clock: str = "received_time_us", extra: list[str] | None = None) -> DataFrame:
    """frames with `before` and `after`: the last stage sample at or before the clock and the first at or after it."""
    sample = F.struct(F.col("timestamp_us").alias("t"), F.col("x_pos_mm").alias("x"), F.col("y_pos_mm").alias("y"), *(extra or []))
    knots = log.select("recording_id", F.col("timestamp_us").alias("_t"), sample.alias("_sample"))
    asked = frames.select("recording_id", F.col(clock).alias("_t"), F.struct(*frames.columns).alias("_frame"))
    both = knots.unionByName(asked, allowMissingColumns=True)
    found = carried(both, "_t", LOG_CHUNK_US, F.col("_sample"), ties=["_sample"])
    return found.where("_frame IS NOT NULL").select("_frame.*", "before", "after")


def interp_stage_linear(frames: DataFrame, log: DataFrame, clock: str = "received_time_us") -> DataFrame:
    """frames with x_pos_mm_interp, y_pos_mm_interp on the line between the samples around; the end sample beyond the log."""
    both = bracketed(frames, log, clock)
    share = (F.col(clock) - F.col("before.t")) / F.nullif(F.col("after.t") - F.col("before.t"), F.lit(0))
    at = lambda c: F.when(F.col("before").isNull(), F.col(f"after.{c}")).when(F.col("after").isNull() | share.isNull(), F.col(f"before.{c}")).otherwise(F.col(f"before.{c}") + share * (F.col(f"after.{c}") - F.col(f"before.{c}")))
    return both.select(*frames.columns, at("x").alias("x_pos_mm_interp"), at("y").alias("y_pos_mm_interp"))


def tridiagonal(low: np.ndarray, mid: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of a stack of tridiagonal systems (stack x n; right: stack x n x columns), all at once by cyclic reduction.

    Each round takes out of every equation the unknowns one, two, four ... places beside it, until each has its own alone.
    """
    n, step = mid.shape[1], 1
    low, mid, high, right = low.copy(), mid.copy(), high.copy(), right.copy()
    low[:, 0] = high[:, -1] = 0
    while step < n:
        up, down = np.zeros_like(mid), np.zeros_like(mid)
        up[:, step:] = -low[:, step:] / mid[:, :-step]
        down[:, :-step] = -high[:, :-step] / mid[:, step:]
        new_mid, new_right, new_low, new_high = mid.copy(), right.copy(), np.zeros_like(low), np.zeros_like(high)
        new_mid[:, step:] += up[:, step:] * high[:, :-step]
        new_mid[:, :-step] += down[:, :-step] * low[:, step:]
        new_right[:, step:] += up[:, step:, None] * right[:, :-step]
        new_right[:, :-step] += down[:, :-step, None] * right[:, step:]
        new_low[:, step:] = up[:, step:] * low[:, :-step]
        new_high[:, :-step] = down[:, :-step] * high[:, step:]
        low, mid, high, right, step = new_low, new_mid, new_high, new_right, 2 * step
    return right / mid[:, :, None]


def splines(t: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, pieces) of cubic splines with not-a-knot ends through a stack of knots; 2 knots give a line, 3 a parabola.

    t: stack x n, y: stack x n x columns, of which the first `sizes` count. pieces (stack x n x columns x 4) are the polynomials that begin
    at each knot, in (time - knot) / scale; the last knot's is that of the piece before it, goes on from there.
    """
    g, n = t.shape
    knot, inner = np.arange(n) < sizes[:, None], np.arange(1, n - 1)
    last = sizes - 1
    scale = (np.take_along_axis(t, last[:, None], 1)[:, 0] - t[:, 0]).astype(float)
    u = (t - t[:, :1]) / scale[:, None]
    piece = knot[:, 1:]  # what lies before each knot but the first
    h = np.where(piece, np.diff(u, axis=1), 1.0)
    d = np.where(piece[:, :, None], np.diff(y, axis=1), 0.0) / h[:, :, None]
    m = np.zeros_like(y, float)
    if n > 2:
        h0, h1, real = h[:, :-1], h[:, 1:], knot[:, 2:]
        low, mid, high = (np.where(real, k, fill) for k, fill in ((h0, 0.0), (2 * (h0 + h1), 1.0), (h1, 0.0)))
        right = np.where(real[:, :, None], 6 * np.diff(d, axis=1), 0.0)
        cubic = sizes >= 4
        first, end = np.where(cubic, h[:, 0] / h[:, 1], 0.0), np.maximum(sizes - 3, 0)
        at = (np.arange(g), end)
        b = np.where(cubic, h1[at] / h0[at], 0.0)  # the third derivative goes on over the second and the last but one knot
        mid[:, 0] += np.where(cubic, h0[:, 0] * (1 + first), 0.0)
        high[:, 0] -= np.where(cubic, h0[:, 0] * first, 0.0)
        mid[at] += np.where(cubic, h1[at] * (1 + b), 0.0)
        low[at] -= np.where(cubic, h1[at] * b, 0.0)
        high[at] = 0.0
        m[:, inner] = tridiagonal(low, mid, high, right)
        (three,) = (sizes == 3).nonzero()
        m[three, 1] = 2 * (d[three, 1] - d[three, 0]) / (h[three, 0] + h[three, 1])[:, None]
        a, z = np.where(cubic, first, 0.0)[:, None], b[:, None]
        row = np.arange(g)
        some = np.where(sizes >= 3)[0]
        m[some, 0] = (m[:, 1] * (1 + a) - m[:, min(2, n - 1)] * a)[some]
        m[some, last[some]] = (m[row, last - 1] * (1 + z) - m[row, np.maximum(last - 2, 0)] * z)[some]
    step = h[:, :, None]
    out = np.zeros((*y.shape, 4))
    out[..., 0] = y
    ahead = np.stack([d - step * (2 * m[:, :-1] + m[:, 1:]) / 6, m[:, :-1] / 2, (m[:, 1:] - m[:, :-1]) / (6 * step)], axis=-1)
    out[:, :-1, :, 1:] = ahead
    row, before = np.arange(g), np.maximum(last - 1, 0)
    out[row, last, :, 1] = d[row, before] + step[row, before] * (m[row, before] + 2 * m[row, last]) / 6
    out[row, last, :, 2] = m[row, last] / 2
    out[row, last, :, 3] = ahead[row, before][..., 2]
    return scale, out


def not_a_knot(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline through (t, y), whose columns are fitted together, at other times."""
    columns = y.reshape(len(t), -1).astype(float)
    scale, pieces = splines(t[None], columns[None], np.array([len(t)]))
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 1)
    x = ((at - t[k]) / scale[0])[:, None]
    c = pieces[0][k]
    got = c[..., 0] + x * (c[..., 1] + x * (c[..., 2] + x * c[..., 3]))
    return got.reshape(len(at), *y.shape[1:])


def bad_stage_logs(log: DataFrame) -> DataFrame:
    """(recording_id, rule): recordings whose log has fewer than two samples, or two at one time."""
    times = log.groupBy("recording_id", "timestamp_us").agg(F.count("*").alias("n"))
    state = times.groupBy("recording_id").agg(F.count("*").alias("knots"), F.max("n").alias("most"))
    return state.where("knots < 2 OR most > 1").select("recording_id", F.when(F.col("most") > 1, "stage timestamps repeat").otherwise("too few stage samples").alias("rule"))


def spline_pieces(log: DataFrame, knots: int = KNOTS, beside: int = BESIDE) -> DataFrame:
    """log, each sample with `piece` (scale, x, y): the polynomials of the not-a-knot spline that begin there, the last one's going on from it.

    Long logs are cut into chunks of `knots` knots with `beside` more on either side; a chunk is one row, and many chunks are solved
    as one array. Recordings named by bad_stage_logs() have no rows here.
    """
    good = log.join(bad_stage_logs(log).select("recording_id"), "recording_id", "left_anti")
    numbers = numbered(good.select("recording_id", "timestamp_us", "x_pos_mm", "y_pos_mm"), "timestamp_us", "_i", LOG_CHUNK_US)
    near = F.array_distinct(F.transform(F.array(F.lit(-beside), F.lit(0), F.lit(beside)), lambda s: F.floor((F.col("_i") + s) / knots).cast("long")))
    each = numbers.select("recording_id", F.explode(near).alias("chunk"), F.struct("timestamp_us", "x_pos_mm", "y_pos_mm", "_i").alias("k"))
    chunks = each.groupBy("recording_id", "chunk").agg(F.sort_array(F.collect_list("k")).alias("k"))  # at most knots + 2 * beside in one
    chunks = chunks.select("recording_id", "chunk", *(F.col(f"k.{c}").cast(f"array<{t}>").alias(c) for c, t in (("timestamp_us", "long"), ("x_pos_mm", "double"), ("y_pos_mm", "double"), ("_i", "long"))))
    kind = log.schema["recording_id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(k) for k in range(2, 6)]
            t, x, y, i = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            sizes = np.asarray(pc.list_value_length(lists[0]), np.int64)
            begins = np.cumsum(sizes) - sizes
            order = np.argsort(sizes, kind="stable")
            while len(order):  # chunks of like length, as many as make up KNOTS_AT_ONCE
                most = np.arange(1, len(order) + 1) * sizes[order] <= KNOTS_AT_ONCE
                some, order = np.split(order, [max(1, int(most.sum()) if most.all() else int(most.argmin()))])
                own, n = sizes[some], int(sizes[some].max(initial=0))
                inside = np.arange(n) < own[:, None]
                flat = (begins[some][:, None] + np.arange(n))[inside]
                ts, xy = np.zeros(inside.shape, np.int64), np.zeros((*inside.shape, 2))
                ts[inside], xy[inside] = t[flat], np.column_stack([x[flat], y[flat]])
                fit = own >= 2
                scale, pieces = np.ones(len(some)), np.zeros((*xy.shape, 4))
                scale[fit], pieces[fit] = splines(ts[fit], xy[fit], own[fit])
                chunk = b.column(1).to_numpy()[some]
                keep = inside & (i[np.where(inside, begins[some][:, None] + np.arange(n), 0)] // knots == chunk[:, None])
                row = np.repeat(some, keep.sum(axis=1))
                polynomial = lambda c: pa.FixedSizeListArray.from_arrays(pa.array(pieces[keep][:, c].ravel()), 4).cast(pa.list_(pa.float64()))  # noqa: E731, B023
                piece = pa.StructArray.from_arrays([pa.array(np.repeat(scale, keep.sum(axis=1))), polynomial(0), polynomial(1)], ["scale", "x", "y"])
                yield pa.RecordBatch.from_pydict({"recording_id": b.column(0).take(pa.array(row)), "timestamp_us": ts[keep], "x_pos_mm": xy[keep][:, 0].copy(), "y_pos_mm": xy[keep][:, 1].copy(), "piece": piece})

    return chunks.mapInArrow(solve, f"recording_id {kind}, timestamp_us long, x_pos_mm double, y_pos_mm double, piece struct<scale double, x array<double>, y array<double>>")


def interp_stage_cubic(frames: DataFrame, log: DataFrame, clock: str = "received_time_us", knots: int = KNOTS, beside: int = BESIDE) -> DataFrame:
    """frames with x_pos_mm_interp, y_pos_mm_interp on the not-a-knot spline through the recording's stage log.

    Only the log's knots are solved for; a frame finds the piece that begins at or before its clock (before the first knot, the
    first) as it finds samples, and its polynomial is a column expression. Recordings named by bad_stage_logs() have no rows here.
    """
    marked = bracketed(frames, spline_pieces(log, knots, beside), clock, extra=["piece"])
    known = marked.withColumn("_k", F.coalesce("before", "after")).where("_k IS NOT NULL")
    s = (F.col(clock) - F.col("_k.t")) / F.col("_k.piece.scale")
    c = lambda axis, k: F.get(F.col(f"_k.piece.{axis}"), F.lit(k))
    at = lambda axis: c(axis, 0) + s * (c(axis, 1) + s * (c(axis, 2) + s * c(axis, 3)))
    return known.select(*frames.columns, at("x").alias("x_pos_mm_interp"), at("y").alias("y_pos_mm_interp"))


def trajectory_bounds(log: DataFrame) -> DataFrame:
    """(recording_id, x_min, x_max, y_min, y_max): the ranges, wider by 5 % of the larger one on each side."""
    r = log.groupBy("recording_id").agg(*(f(c).alias(f"{n}_{k}") for c, n in (("x_pos_mm", "x"), ("y_pos_mm", "y")) for f, k in ((F.min, "lo"), (F.max, "hi"))))
    margin = 0.05 * F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    return r.select("recording_id", (F.col("x_lo") - margin).alias("x_min"), (F.col("x_hi") + margin).alias("x_max"), (F.col("y_lo") - margin).alias("y_min"), (F.col("y_hi") + margin).alias("y_max"))


def trajectory_segments(log: DataFrame) -> DataFrame:
    """(recording_id, t_s, x0, y0, x1, y1): each sample with the next; seconds from the recording's first sample."""
    start = log.groupBy("recording_id").agg(F.min("timestamp_us").alias("_t0"))
    point = F.struct("x_pos_mm", "y_pos_mm")
    next_ = carried(log, "timestamp_us", LOG_CHUNK_US, point, back=None, ahead="_next", strict=True)
    some = next_.where("_next IS NOT NULL").join(start, "recording_id")
    return some.select("recording_id", ((F.col("timestamp_us") - F.col("_t0")) / 1e6).alias("t_s"), F.col("x_pos_mm").alias("x0"), F.col("y_pos_mm").alias("y0"), F.col("_next.x_pos_mm").alias("x1"), F.col("_next.y_pos_mm").alias("y1"))


def latest_position(log: DataFrame) -> DataFrame:
    """(recording_id, timestamp_us, x_pos_mm, y_pos_mm): the last sample of each recording."""
    last = F.max_by(F.struct("timestamp_us", "x_pos_mm", "y_pos_mm"), "timestamp_us")
    return log.groupBy("recording_id").agg(last.alias("p")).select("recording_id", "p.*")
