"""Column functions between stage, pixel and physical coordinates, and for tracking and camera settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A 2 x 5 map is an array of 10 weights: x's, then y's, each on the first point's x and y, the second's x and y, and 1.
SINGULAR = 1e-12


def weight(m: Column, row: int, k: int) -> Column:
    return m[5 * row + k]


def apply_map(m: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Two 2-D points to one: stage and pixel to physical, or stage and physical to pixel."""
    at = lambda r: weight(m, r, 0) * x1 + weight(m, r, 1) * y1 + weight(m, r, 2) * x2 + weight(m, r, 3) * y2 + weight(m, r, 4)
    return at(0), at(1)


def whole_pixel(c: Column) -> Column:
    """Rounded half away from zero."""
    return F.round(c).cast("long")


def physical_to_stage(m: Column, physical_x: Column, physical_y: Column, pixel_x: Column, pixel_y: Column) -> tuple[Column, Column]:
    """The stage position of a stage-and-pixel-to-physical map; null where its stage block is singular."""
    a, b, e, f = weight(m, 0, 0), weight(m, 0, 1), weight(m, 1, 0), weight(m, 1, 1)
    det = a * f - b * e
    rx = physical_x - weight(m, 0, 2) * pixel_x - weight(m, 0, 3) * pixel_y - weight(m, 0, 4)
    ry = physical_y - weight(m, 1, 2) * pixel_x - weight(m, 1, 3) * pixel_y - weight(m, 1, 4)
    usable = F.abs(det) >= SINGULAR
    return F.when(usable, (f * rx - b * ry) / det), F.when(usable, (a * ry - e * rx) / det)


def invert_pixel_block(m: Column) -> Column:
    """The stage-and-physical-to-pixel map of a stage-and-pixel-to-physical map; null where its pixel block is singular."""
    a, b, c, d = weight(m, 0, 2), weight(m, 0, 3), weight(m, 1, 2), weight(m, 1, 3)
    det = a * d - b * c
    i, j, k, l = d / det, -b / det, -c / det, a / det  # noqa: E741
    row = lambda p, q: [-(p * weight(m, 0, 0) + q * weight(m, 1, 0)), -(p * weight(m, 0, 1) + q * weight(m, 1, 1)), p, q, -(p * weight(m, 0, 4) + q * weight(m, 1, 4))]
    return F.when(F.abs(det) >= SINGULAR, F.array(*row(i, j), *row(k, l)))


def cross_camera_affine(to_physical: Column, to_pixel: Column, stage_x: Column, stage_y: Column) -> Column:
    """2 x 3 matrix (6 numbers by row) from one camera's pixels to another's at a stage position."""
    a, b = to_physical, to_pixel
    rows = []
    for r in (0, 1):
        p, q = weight(b, r, 2), weight(b, r, 3)
        stage = [weight(b, r, k) + p * weight(a, 0, k) + q * weight(a, 1, k) for k in (0, 1)]
        shift = weight(b, r, 4) + p * weight(a, 0, 4) + q * weight(a, 1, 4)
        rows += [p * weight(a, 0, 2) + q * weight(a, 1, 2), p * weight(a, 0, 3) + q * weight(a, 1, 3), stage[0] * stage_x + stage[1] * stage_y + shift]
    return F.array(*rows)


def apply_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 2 x 3 matrix."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 matrix (9 numbers by row); null where it goes to infinity."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def invert_3x3(h: Column) -> Column:
    """The inverse by cofactors; null where the determinant is 0."""
    minor = lambda r1, c1, r2, c2: h[3 * r1 + c1] * h[3 * r2 + c2] - h[3 * r1 + c2] * h[3 * r2 + c1]
    cells = []
    for r in range(3):
        for c in range(3):  # the transposed cofactor
            rows, cols = [k for k in range(3) if k != c], [k for k in range(3) if k != r]
            m = minor(rows[0], cols[0], rows[1], cols[1])
            cells.append(-m if (r + c) % 2 else m)
    det = h[0] * cells[0] + h[1] * cells[3] + h[2] * cells[6]
    return F.when(det != 0, F.array(*(c / det for c in cells)))


def compose(outer: Column, inner: Column) -> Column:
    """outer after inner, both 3 x 3 by row."""
    return F.array(*(sum((outer[3 * r + k] * inner[3 * k + c] for k in range(1, 3)), outer[3 * r] * inner[c]) for r in range(3) for c in range(3)))


def as_3x3(m: Column) -> Column:
    """A 2 x 3 matrix with a last row 0, 0, 1; a 3 x 3 one unchanged."""
    return F.when(F.size(m) == 6, F.concat(m, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).otherwise(m)


def tracking_target(stage: tuple[Column, Column], fly: tuple[Column, Column], centre: tuple[Column, Column], threshold: float, limits: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Where the stage goes to bring the fly to the image centre: nowhere (null) within the threshold, else clamped to (x min, x max, y min, y max).

    The arena faces down, so the stage's x runs against the arena's.
    """
    dx, dy = fly[0] - centre[0], fly[1] - centre[1]
    far = F.sqrt(dx * dx + dy * dy) >= threshold
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))
    return F.when(far, clamp(stage[0] - dx, *limits[:2])), F.when(far, clamp(stage[1] + dy, *limits[2:]))


def tracking_acceleration(x: Column, y: Column, width: int, height: int, least: float, most: float, margin: float) -> Column:
    """From `least` in the image centre to `most` at `margin` from the nearer edge and beyond."""
    reach = min(width, height) / 2 - margin
    if reach <= 0:
        return F.lit(float(most))
    r = F.sqrt(F.pow(x - width / 2, F.lit(2.0)) + F.pow(y - height / 2, F.lit(2.0)))
    return least + F.least(r / reach, F.lit(1.0)) * (most - least)


def arena_to_stage(arena_x: Column, arena_y: Column, offset_x: Column, offset_y: Column) -> tuple[Column, Column]:
    """x runs against the stage, y with it."""
    return offset_x - arena_x, offset_y + arena_y


def arena_offset(stage_x: Column, stage_y: Column, mark_x: Column, mark_y: Column) -> tuple[Column, Column]:
    """Offset of the arena from the stage position at which its mark is seen."""
    return stage_x + mark_x, stage_y - mark_y


def stage_limits(offset_x: Column, offset_y: Column, width: Column, height: Column, range_x: float, range_y: float) -> list[Column]:
    """x min, x max, y min, y max of the arena's corners on the stage, within 0 and the stage's range."""
    clip = lambda c, hi: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(hi)))
    return [clip(offset_x - width, range_x), clip(offset_x, range_x), clip(offset_y, range_y), clip(offset_y + height, range_y)]


def muscle_timing(fps: Column, ratio: Column, light_us: Column, height: Column, line_us: Column, readout_us: Column) -> dict[str, Column]:
    """Times in whole us, cut off at each step; valid if the light fits into the common time."""
    interval = (F.lit(1_000_000.0) / (fps / ratio)).cast("int")
    rolling = (height * line_us).cast("int")
    nominal = interval - readout_us
    common = nominal - rolling
    buffer = common - light_us
    return {"interval_us": interval, "rolling_us": rolling, "nominal_exposure_us": nominal, "common_us": common, "buffer_us": buffer, "valid": buffer >= 0}


def roi_geometry(x0: Column, x1: Column, y0: Column, y1: Column, full_width: Column, full_height: Column) -> dict[str, Column]:
    """Of a 1-based region with both ends included."""
    inside = (x0 > 0) & (x1 <= full_width) & (y0 > 0) & (y1 <= full_height) & (x0 < x1) & (y0 < y1)
    half = lambda a, b: ((a + b) / 2).cast("long")
    return {"x_offset": x0 - 1, "y_offset": y0 - 1, "roi_width": x1 - x0 + 1, "roi_height": y1 - y0 + 1, "centre_x": half(x0, x1), "centre_y": half(y0, y1), "within_bounds": inside}


def nearest_multiple(value: Column, step: int) -> Column:
    """The nearest multiple of an even step, upwards from half."""
    left = value % step
    return value - left + F.when(left < step // 2, 0).otherwise(step)


def centred_offset(size: Column, full: Column, step: int = 64) -> Column:
    return nearest_multiple(((full - size) / 2).cast("long"), step)


def behavior_max_fps(rows: Column, row_time: int = 130, cycle: int = 1022, clock: int = 86_400_000) -> Column:
    """Fixed values are those of a region 1984 wide, 8 bit, over four CXP6 links."""
    extra = -(-203 // row_time) + 3
    return F.lit(float(clock)) / (row_time * (rows + extra + 2) + 1 + 3 * row_time + cycle)


def muscle_max_fps(light_us: Column, height: Column, line_us: float = 12.136, gap_us: float = 4.5) -> Column:
    return F.lit(1e6) / (height * line_us + light_us + gap_us)
