"""Work on pixels: rows of (recording_id, frame_id, height, width, px array of numbers by row).

What is a statistic over pixels stays with Spark's own functions; what needs a frame's shape is a numpy
helper over stacks of frames of one shape: the Arrow buffer of their pixels seen as one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigtables.operators.chunks import lagged
from rigtables.operators.selection import quantiles

FRAMES_A_CHUNK = 256
#: Pixels (in or out) that a helper works on at once.
PIXELS_AT_ONCE = 1 << 22
#: Parts of a pixel to which the places of smooth resampling are rounded.
PARTS = 32


def _stacks(batch: pa.RecordBatch, out: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, frames as one array of rows x height x width), for rows of one shape, about PIXELS_AT_ONCE pixels at a time.

    Rows that follow each other are a view of the batch. `out` is how many pixels a frame will have, if it may be more.
    """
    px = batch.column(batch.schema.get_field_index("px"))
    if not len(px):
        return
    ends, values = px.offsets.to_numpy(), px.values.to_numpy(zero_copy_only=False)
    shape = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width")])
    if px.null_count or (np.diff(ends) != shape[0] * shape[1]).any():
        raise ValueError("a frame doesn't have height x width pixels")
    for h, w in np.unique(shape, axis=1).T.tolist():
        (rows,) = ((shape[0] == h) & (shape[1] == w)).nonzero()
        step = max(1, PIXELS_AT_ONCE // max(1, h * w, out))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            if some[-1] - some[0] + 1 == len(some):
                yield some, values[ends[some[0]] : ends[some[-1] + 1]].reshape(len(some), h, w)
            else:
                yield some, values[ends[some][:, None] + np.arange(h * w)].reshape(len(some), h, w)


def _lists(stack: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A stack of frames as a column of pixel arrays; nothing is copied."""
    n, size = len(stack), stack.shape[1] * stack.shape[2]
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(size))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(stack).ravel(), kind))


def _framewise(frames: DataFrame, make: Callable[[np.ndarray, pa.RecordBatch], dict[str, pa.Array]], columns: list[str], made: str, out: int = 0) -> DataFrame:
    """(columns, what `make` says of a stack and its rows, as named and typed in `made`)."""
    kinds = [f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, stack in _stacks(b, out):
                some = b.take(pa.array(rows))
                new = make(stack, some)
                yield pa.RecordBatch.from_pydict({c: some.column(some.schema.get_field_index(c)) for c in columns} | new)

    return frames.mapInArrow(run, ", ".join([*kinds, made]))


def adaptive_vrange(frames: DataFrame, places: DataFrame, q: tuple[float, float] = (97.0, 99.995), rate: float = 0.05) -> DataFrame:
    """(recording_id, vmin, vmax) from every max(1, int(1 / rate))-th frame; places: (recording_id, frame_id, place).

    Percentiles of each frame's nonzero pixels; then the 50th percentile of the low ones and the 95th of the
    high ones, cut off to whole numbers. Frames of zeros alone are passed over; recordings of such have no row.
    """
    some = frames.join(places.where(F.col("place") % max(1, int(1 / rate)) == 0), ["recording_id", "frame_id"])
    bright = some.select("recording_id", F.array_sort(F.filter("px", lambda v: v > 0)).alias("_s")).where(F.size("_s") > 0)
    each = bright.select("recording_id", *(percentile_of("_s", p).alias(n) for p, n in zip(q, ("lo", "hi"), strict=True)))
    ends = quantiles(each, ["recording_id"], {"vmin": (F.col("lo"), 0.5), "vmax": (F.col("hi"), 0.95)})
    return ends.select("recording_id", F.col("vmin").cast("long"), F.col("vmax").cast("long"))


def percentile_of(ordered: str, q: float) -> Column:
    """The q-th percentile of a sorted array that isn't empty, on the line between the two values around."""
    place = (F.size(ordered) - 1) * (q / 100)
    low = F.floor(place).cast("int")
    lower, upper = (F.get(ordered, k).cast("double") for k in (low, F.ceil(place).cast("int")))
    return lower + (place - low) * (upper - lower)


def percentile_stretch(frames: DataFrame, low: float = 10, high: float = 95) -> DataFrame:
    """frames with px stretched from the low to the high percentile onto 0 .. 255, cut off (1e-9 below a whole number is that number); a flat frame is 0."""
    ends = frames.withColumn("_s", F.array_sort("px")).withColumns({"_lo": percentile_of("_s", low), "_hi": percentile_of("_s", high)})
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    level = lambda x: F.coalesce(F.least(F.greatest((x - F.col("_lo")) * 255 / width, F.lit(0.0)), F.lit(255.0)), F.lit(0.0))
    return ends.withColumn("px", F.transform("px", lambda x: (level(x) + 1e-9).cast("int"))).drop("_lo", "_hi", "_s")


def burst_median_frame(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, px): each pixel's median over the frames of a burst, cut off to whole numbers.

    A burst is the few frames taken at one place, all of one shape; they are put side by side as one array.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def middle(key: tuple, burst: pa.Table) -> pa.Table:
        px = burst["px"].combine_chunks()
        sizes = np.diff(px.offsets.to_numpy())
        if (sizes != sizes[0]).any():
            raise ValueError("frames of a burst have several shapes")
        stack = px.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        values = np.median(stack, axis=0).astype(np.int32)
        return pa.table({k: burst[k].slice(0, 1) for k in keys} | {"px": pa.array([values], pa.list_(pa.int32()))})

    narrow = frames.select(*keys, "px")
    return narrow.groupBy(*keys).applyInArrow(middle, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "px array<int>"]))


def pixel_histogram(frames: DataFrame, low: int, high: int, bins: int = 256) -> DataFrame:
    """(recording_id, bin, n, height) of equal bins over [low, high + 1), height by the tallest bin; pixels outside don't count."""
    at = F.expr(f"width_bucket(CAST(v AS double), {float(low)}D, {float(high + 1)}D, {bins}) - 1")
    n = frames.select("recording_id", F.explode("px").alias("v")).select("recording_id", at.cast("long").alias("bin")).where(f"bin BETWEEN 0 AND {bins - 1}").groupBy("recording_id", "bin").agg(F.count("*").alias("n"))
    tallest = n.groupBy("recording_id").agg(F.max("n").alias("_most"))
    return n.join(tallest, "recording_id").select("recording_id", "bin", "n", (F.col("n") / F.col("_most")).alias("height"))


def window_to_8bit(v: Column, vmin: int, vmax: int) -> Column:
    """v * alpha - vmin * alpha with alpha = 255 / max(1, vmax - vmin), rounded half to even, within 0 .. 255."""
    alpha = 255.0 / max(1, vmax - vmin)
    return F.least(F.greatest(F.rint(v * alpha - vmin * alpha), F.lit(0.0)), F.lit(255.0)).cast("int")


def window_for_display(v: Column, vmin: float, vmax: float) -> Column:
    """The share of the window, within 0 .. 1, times 255, cut off."""
    return (F.least(F.greatest((v - vmin) / max(vmax - vmin, 1e-9), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def diff_autocorrelation(before: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Mean of the products of side by side and stacked neighbours in the difference, halved, by its variance; 0 if it has none.

    Both are frames, or stacks of frames that are compared one by one.
    """
    d = np.subtract(frame, before, dtype=np.float32, casting="unsafe").astype(np.float64)
    d -= d.mean(axis=(-2, -1), keepdims=True)
    power = np.square(d).mean(axis=(-2, -1))
    across, down = ((a * b).mean(axis=(-2, -1)) if a.size else 0.0 for a, b in ((d[..., 1:], d[..., :-1]), (d[..., 1:, :], d[..., :-1, :])))
    return np.where(power > 0, (across + down) / np.where(power > 0, 2 * power, 1.0), 0.0)


def successive_frames(frames: DataFrame, within: int | None = None) -> DataFrame:
    """frames with `previous_px`, the frame before in the recording; only the first `within` frames if that is set.

    Frames move once, by chunks of FRAMES_A_CHUNK; each chunk's last frame is carried to the next.
    """
    if within is not None:
        place = frames.select("recording_id", "frame_id").withColumn("_r", F.row_number().over(W.partitionBy("recording_id").orderBy("frame_id"))).where(F.col("_r") <= within).drop("_r")
        frames = frames.join(place, ["recording_id", "frame_id"], "left_semi")
    return lagged(frames, "frame_id", "px", "previous_px", FRAMES_A_CHUNK, keep=False)


def frame_change(frames: DataFrame, within: int | None = None) -> DataFrame:
    """(recording_id, frame_id, autocorrelation, mean_px, previous_mean_px) of each frame and the one before; nulls for the first."""
    pairs = successive_frames(frames, within).select("recording_id", "frame_id", "height", "width", "px", "previous_px")

    def measure(stack: np.ndarray, rows: pa.RecordBatch) -> dict[str, pa.Array]:
        old = rows.column(rows.schema.get_field_index("previous_px"))
        first = np.asarray(old.is_null())
        earlier = old.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, *stack.shape[1:])
        change, mean = np.full(len(stack), np.nan), np.full(len(stack), np.nan)
        change[~first] = diff_autocorrelation(earlier, stack[~first])
        mean[~first] = earlier.astype(np.float32).mean(axis=(1, 2), dtype=np.float64)
        own = stack.astype(np.float32).mean(axis=(1, 2), dtype=np.float64)
        return {"autocorrelation": pa.array(change, mask=first), "mean_px": pa.array(own), "previous_mean_px": pa.array(mean, mask=first)}

    return _framewise(pairs, measure, ["recording_id", "frame_id"], "autocorrelation double, mean_px double, previous_mean_px double")


def count_leading_orphans(frames: DataFrame, threshold: float = 0.12, within: int = 50) -> DataFrame:
    """(recording_id, n_orphans, onset_found): place of the first of the first `within` frames that brightens in a coherent shape; 0 if none does."""
    change = frame_change(frames, within)
    place = F.row_number().over(W.partitionBy("recording_id").orderBy("frame_id")) - 1
    onset = (F.col("autocorrelation") > threshold) & (F.col("mean_px") > F.col("previous_mean_px"))
    placed = change.withColumn("_place", place)
    first = F.min(F.when(onset, F.col("_place")))
    return placed.groupBy("recording_id").agg(F.coalesce(first, F.lit(0)).alias("n_orphans"), first.isNotNull().alias("onset_found"))


def _changed(frames: DataFrame, change: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], out: int = 0) -> DataFrame:
    """frames with px, height and width of the stacks that `change` makes."""
    fixed = [c for c in frames.columns if c not in ("px", "height", "width")]
    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("px", "height", "width")}

    def make(stack: np.ndarray, rows: pa.RecordBatch) -> dict[str, pa.Array]:
        new = change(stack, rows)
        sides = {c: pa.array(np.full(len(new), n), rows.schema.field(c).type) for c, n in (("height", new.shape[1]), ("width", new.shape[2]))}
        return sides | {"px": _lists(new, rows.schema.field("px").type.value_type)}

    made = _framewise(frames, make, fixed, ", ".join(f"{c} {kinds[c]}" for c in ("height", "width", "px")), out)
    return made.select(*frames.columns)


def reorient_frame(frames: DataFrame, camera: str) -> DataFrame:
    """A quarter turn counter-clockwise; behavior frames are then mirrored left to right."""
    if camera not in ("behavior", "muscle"):
        raise ValueError(f"camera is behavior or muscle, not {camera}")
    turned = lambda a, _: np.rot90(a, axes=(1, 2))[:, :, :: -1 if camera == "behavior" else 1]
    return _changed(frames, turned)


def expand_channels(groups: DataFrame) -> DataFrame:
    """Frames of groups (recording_id, group_id, num_valid, ch0, ch1, ch2, ...): frame_id = 3 group + channel; channels beyond num_valid are left out."""
    rest = [c for c in groups.columns if c not in ("ch0", "ch1", "ch2", "num_valid", "group_id")]
    each = groups.select(*rest, "group_id", "num_valid", F.posexplode(F.array("ch0", "ch1", "ch2")).alias("channel", "px"))
    return each.where("channel < num_valid").select(*rest, (3 * F.col("group_id") + F.col("channel")).alias("frame_id"), "px")


def places(matrices: np.ndarray, out_height: int, out_width: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of each output pixel in the input, for a stack of 3 x 3 matrices from input to output; (0, 0) where the divisor is 0.

    Matrices that aren't finite, or can't be inverted, lead outside.
    """
    good = np.isfinite(matrices).all(axis=(1, 2))
    good[good] = np.linalg.det(matrices[good]) != 0
    back = np.zeros_like(matrices)
    back[good] = np.linalg.inv(matrices[good])
    u, v = np.arange(out_width, dtype=float), np.arange(out_height, dtype=float)[:, None]
    part = lambda k: back[:, k, 0, None, None] * u + back[:, k, 1, None, None] * v + back[:, k, 2, None, None]
    w = part(2)
    scale = np.where(w != 0, 1 / np.where(w != 0, w, 1), 0.0)
    far = np.float64(1 << 30)
    x, y = (np.clip(part(k) * scale, -far, far) for k in (0, 1))
    x[~good] = y[~good] = -far
    return x, y


def resampled(stack: np.ndarray, matrices: np.ndarray, out_height: int, out_width: int, smooth: bool) -> np.ndarray:
    """Frames resampled by their matrices, all at once; beyond a frame's border all pixels are 0.

    Smooth: places are rounded to 1 / PARTS of a pixel (half to even), the four pixels around are weighted by them, and the sum
    is rounded half to even. Otherwise the nearest pixel counts.
    """
    n, h, w = stack.shape
    x, y = places(matrices, out_height, out_width)
    base = (np.arange(n, dtype=np.int64) * h * w)[:, None, None]
    flat = stack.reshape(-1)

    def pixel(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        return np.where(inside, flat[np.where(inside, base + r * w + c, 0)], 0)

    if not smooth:
        return pixel(np.floor(y + 0.5).astype(np.int64), np.floor(x + 0.5).astype(np.int64))
    x, y = (np.rint(k * PARTS).astype(np.int64) for k in (x, y))
    c, r, dx, dy = x // PARTS, y // PARTS, x % PARTS, y % PARTS
    total = (PARTS - dy) * ((PARTS - dx) * pixel(r, c) + dx * pixel(r, c + 1))
    total = total + dy * ((PARTS - dx) * pixel(r + 1, c) + dx * pixel(r + 1, c + 1))
    mixed = total / (PARTS * PARTS)
    return np.rint(mixed).astype(stack.dtype) if stack.dtype.kind in "iu" else mixed


def warp_frame(frames: DataFrame, out_height: int, out_width: int, matrix: str = "m", smooth: bool = False) -> DataFrame:
    """Frames resampled by their own matrix (6 or 9 numbers by row, from input to output pixels); 0 outside.

    The nearest input pixel counts (behavior frames), or with `smooth` the four around, weighted (muscle frames). A null
    matrix, or one that isn't finite or can't be inverted, gives a frame of zeros.
    """
    last_row = np.array([0.0, 0.0, 1.0])

    def change(stack: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
        given = rows.column(rows.schema.get_field_index(matrix)).to_pylist()  # a few numbers a frame
        full = [np.full(9, np.nan) if m is None else np.append(m, last_row[: 9 - len(m)]) for m in given]
        return resampled(stack, np.array(full, float).reshape(-1, 3, 3), out_height, out_width, smooth)

    return _changed(frames, change, out_height * out_width)


def overlay_frame(behavior: DataFrame, muscle: DataFrame, vmin: float, vmax: float) -> DataFrame:
    """(recording_id, frame_id, red, green): behavior pixels, and muscle pixels shown through a window, of equal shapes."""
    other = muscle.select("recording_id", "frame_id", F.col("px").alias("_m"))
    green = F.transform("_m", lambda v: window_for_display(v, vmin, vmax))
    return behavior.join(other, ["recording_id", "frame_id"]).select("recording_id", "frame_id", F.col("px").alias("red"), green.alias("green"))


def _cross(mask: np.ndarray, reduce: Callable, fill: bool) -> np.ndarray:
    """reduce over each pixel's 5 x 5 neighbourhood, rows then columns, in a stack of masks; beyond the frame is `fill`."""
    h, w = mask.shape[1:]
    padded = np.pad(mask, ((0, 0), (2, 2), (2, 2)), constant_values=fill)
    rows = reduce([padded[:, i : i + h] for i in range(5)])
    return reduce([rows[:, :, j : j + w] for j in range(5)])


def largest_blob(mask: np.ndarray) -> tuple[int, float, float] | None:
    """(area, x, y) of the largest 8-connected component; the first by its first pixel of equal ones."""
    if not mask.any():
        return None
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:  # the least label of the neighbourhood spreads along the component
        padded = np.pad(np.where(mask, label, h * w + 1), 1, constant_values=h * w + 1)
        least = np.minimum.reduce([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        new = np.where(mask, least, 0)
        jump = np.append(0, new.ravel())[new]  # and to where that one points
        new = np.where(mask, np.minimum(new, jump), 0)
        if (new == label).all():
            break
        label = new
    names, sizes = np.unique(label[mask], return_counts=True)
    name = names[sizes.argmax()]
    y, x = np.nonzero(label == name)
    return len(x), float(x.mean()), float(y.mean())


def blob_centroid(frames: DataFrame, threshold: float, least_area: int = 0) -> DataFrame:
    """(recording_id, frame_id, area, x, y) of the largest bright blob; nulls where none is larger than least_area.

    Pixels over the threshold are opened, then closed, by 5 x 5.
    """

    def find(stack: np.ndarray, rows: pa.RecordBatch) -> dict[str, pa.Array]:
        m = stack > threshold
        m = _cross(_cross(m, np.logical_and.reduce, True), np.logical_or.reduce, False)
        m = _cross(_cross(m, np.logical_or.reduce, False), np.logical_and.reduce, True)
        best = [largest_blob(one) for one in m]
        best = [b if b and b[0] > least_area else (None, None, None) for b in best]
        return {c: pa.array([b[k] for b in best], t) for k, (c, t) in enumerate((("area", pa.int64()), ("x", pa.float64()), ("y", pa.float64())))}

    return _framewise(frames.select("recording_id", "frame_id", "height", "width", "px"), find, ["recording_id", "frame_id"], "area long, x double, y double")
