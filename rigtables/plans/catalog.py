"""Every registered query with its DuckDB oracle, over the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.functions import geometry as g
from rigtables.functions import protocol as pr
from rigtables.operators import calibration as cal
from rigtables.operators import jobs, pixels, pose, quality, stage, sync
from rigtables.plans import aligned as _aligned
from rigtables.plans import recordings as _recordings
from rigtables.plans import views as v
from rigtables.plans.registry import AUTOCORRELATION, ORACLES, QUERIES, query, r6
from rigtables.plans.registry import SLOTS as SLOTS_OF
from rigtables.plans.workflows import pair_cameras
from rigtables.sources.readers import frame_index, scan_position

__all__ = ["ORACLES", "QUERIES", "_aligned", "_recordings"]

def _some_frames(s: SparkSession, d: str) -> DataFrame:
    """Frames with losses: every eleventh frame has been dropped by the camera."""
    return v.frames(s, d).where("frame_id % 11 != 7")


SLOTS = SLOTS_OF.format(source="t_frames WHERE frame_id % 11 != 7")


def _slots(s: SparkSession, d: str) -> DataFrame:
    return sync.detect_dropped_frames(_some_frames(s, d))


def _groups(s: SparkSession, d: str) -> DataFrame:
    g_ = sync.sync_group_frames(v.frames(s, d), v.ratios(s, d))
    return g_.select("recording_id", F.col("frame_id").alias("behavior_frame_id"), "ratio", "slot")


# Sources


@query("SELECT recording_id, ratio AS sync_ratio, recording_id % 2 = 0 AS used_legacy FROM t_ratios")
def resolve_sync_ratio(s: SparkSession, d: str) -> DataFrame:
    even = F.col("recording_id") % 2 == 0
    params = v.ratios(s, d).select(
        "recording_id", F.when(~even, F.col("ratio")).alias("muscle_sync_ratio"), F.when(even, F.col("ratio")).alias("sync_ratio_legacy_key"),
        F.lit(None).cast("long").alias("muscle_sync_ratio_sibling"), F.lit(None).cast("long").alias("sync_ratio_sibling"),
    )
    return sync.resolve_sync_ratio(params).select("recording_id", "sync_ratio", "used_legacy")


@query("SELECT p_partkey, p_name || '_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.csv' AS path, p_partkey AS frame_id FROM part", views=False)
def frame_index_from_path(s: SparkSession, d: str) -> DataFrame:
    path = F.concat("p_name", F.lit("_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".csv"))
    return v.table(s, d, "part").select("p_partkey", path.alias("path")).withColumn("frame_id", frame_index(F.col("path")))


@query("SELECT s_suppkey, 1.5 * s_suppkey AS stage_x, -0.25 * s_suppkey AS stage_y, s_suppkey % 5 AS image_idx FROM supplier", views=False)
def parse_scan_filename(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("homography_scan_x"), (k * 1.5).cast("decimal(18,3)").cast("string"), F.lit("_y"), (k * -0.25).cast("decimal(18,3)").cast("string"), F.lit("_frame"), (k % 5).cast("string"), F.lit(".tif"))
    return v.table(s, d, "supplier").select("s_suppkey", scan_position(name).alias("p")).select("s_suppkey", "p.*")


# Quality


@query(", g AS (SELECT recording_id, max(frame_id) AS last FROM t_frames WHERE frame_id % 11 != 7 GROUP BY ALL) SELECT recording_id, unnest(range(0, last + 1)) AS missing_frame_id FROM g EXCEPT SELECT recording_id, frame_id FROM t_frames WHERE frame_id % 11 != 7")
def missing_frames(s: SparkSession, d: str) -> DataFrame:
    return quality.missing_frames(_some_frames(s, d))


@query(", l AS (SELECT *, received_time_us <= lag(received_time_us) OVER (PARTITION BY recording_id ORDER BY frame_id) AS bad FROM t_frames) SELECT recording_id, count(*) AS n_frames, count(*) FILTER (bad) AS n_violations, count(*) FILTER (bad) = 0 AS monotonic FROM l GROUP BY recording_id")
def check_monotonic_acquisition(s: SparkSession, d: str) -> DataFrame:
    return quality.check_monotonic(v.frames(s, d), "received_time_us")


def _group_counts(s: SparkSession, d: str) -> DataFrame:
    return v.frames(s, d).groupBy("recording_id").agg((F.count("*") - F.col("recording_id") % 9).alias("n_groups"))


@query(""", g AS (SELECT recording_id, count(*) - recording_id % 9 AS n_groups FROM t_frames GROUP BY recording_id),
m AS (SELECT recording_id, frame_id FROM t_frames WHERE recording_id % 4 != 1 OR frame_id != 3),
a AS (SELECT g.recording_id, n_groups, count(frame_id) AS kept, max(frame_id) AS last FROM g LEFT JOIN m ON m.recording_id = g.recording_id AND frame_id < n_groups AND (frame_id < 6 OR g.recording_id % 3 != 0) GROUP BY ALL)
SELECT recording_id, n_groups, kept, CASE WHEN last + 1 > kept THEN 'hole' WHEN n_groups - kept > 3 THEN 'too_few' ELSE 'ok' END AS verdict FROM a""")
def filter_muscle_availability(s: SparkSession, d: str) -> DataFrame:
    r, f = F.col("recording_id"), F.col("frame_id")
    have = v.frames(s, d).where(((r % 4 != 1) | (f != 3)) & ((f < 6) | (r % 3 != 0))).select("recording_id", f.alias("raw_frame_id"))
    return quality.availability(have, _group_counts(s, d))


@query(SLOTS + "SELECT s.recording_id, s.frame_id, s.slot FROM slots s JOIN (SELECT recording_id, count(*) AS n FROM groups GROUP BY recording_id) g USING (recording_id) WHERE slot < n")
def discard_trailing_slots(s: SparkSession, d: str) -> DataFrame:
    n = _groups(s, d).groupBy("recording_id").agg(F.count("*").alias("n_groups"))
    return sync.discard_trailing_slots(_slots(s, d), n).select("recording_id", "frame_id", "slot")


@query("SELECT recording_id, frame_id, ratio, row_number() OVER (PARTITION BY recording_id ORDER BY frame_id) - 1 AS slot FROM t_frames JOIN t_ratios USING (recording_id) WHERE frame_id % ratio = 0 AND frame_id >= 2 * ratio")
def sync_group_frames(s: SparkSession, d: str) -> DataFrame:
    return sync.sync_group_frames(v.frames(s, d), v.ratios(s, d), offset=2).select("recording_id", "frame_id", "ratio", "slot")


@query("SELECT apriltag_id, corner_id, image_id, round(pixel_x_px, 6) AS pixel_x_px, pixel_y_px FROM t_scan WHERE decision_margin >= 20 AND detected_id = apriltag_id")
def filter_detections(s: SparkSession, d: str) -> DataFrame:
    return quality.filter_detections(v.scan(s, d)).select("apriltag_id", "corner_id", "image_id", r6("pixel_x_px", "pixel_x_px"), "pixel_y_px")


@query("SELECT apriltag_id, count(*) FILTER (decision_margin >= 20) AS n_confident, count(*) FILTER (decision_margin >= 20 AND detected_id != apriltag_id) AS n_spurious FROM t_scan GROUP BY apriltag_id")
def spurious_detections(s: SparkSession, d: str) -> DataFrame:
    return quality.spurious_detections(v.scan(s, d))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN contains(replace(replace(lower(path), '_', ''), '-', ''), 'fullsize') ELSE contains(replace(replace(lower(path), '_', ''), '-', ''), 'aligned') END AS conflict FROM (SELECT *, p_name || CASE p_partkey % 4 WHEN 0 THEN '/Full-Size' WHEN 1 THEN '/full_size_x' WHEN 2 THEN '/ALIGNED' ELSE '/raw' END AS path FROM part)", views=False)
def check_alignment_flag(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.concat("p_name", F.when(k == 0, "/Full-Size").when(k == 1, "/full_size_x").when(k == 2, "/ALIGNED").otherwise("/raw"))
    return v.table(s, d, "part").select("p_partkey", quality.alignment_flag_conflict(path, F.col("p_size") % 2 == 0).alias("conflict"))


@query("SELECT trial_id, status, CASE WHEN status IN ('complete', 'failed') THEN 'terminal' ELSE 'dispatcher' END AS class FROM t_trials")
def validate_status(s: SparkSession, d: str) -> DataFrame:
    return v.trials(s, d).select("trial_id", "status", quality.status_class(F.col("status")).alias("class"))


@query(", l AS (SELECT *, timestamp_us - lag(timestamp_us) OVER (PARTITION BY recording_id ORDER BY timestamp_us) AS elapsed_us FROM t_stage) SELECT recording_id, timestamp_us, elapsed_us FROM l WHERE elapsed_us >= 1000000 // 75")
def overrun_cycles(s: SparkSession, d: str) -> DataFrame:
    return quality.overrun_cycles(v.stage(s, d), 75).select("recording_id", "timestamp_us", "elapsed_us")


# Joins


ASOF = """, a AS (SELECT c.*, b.timestamp_us AS t0, b.x_pos_mm AS x0, b.y_pos_mm AS y0 FROM t_clicks c ASOF LEFT JOIN t_stage b ON c.recording_id = b.recording_id AND c.received_time_us >= b.timestamp_us),
n AS (SELECT a.*, b.timestamp_us AS t1, b.x_pos_mm AS x1, b.y_pos_mm AS y1 FROM a ASOF LEFT JOIN t_stage b ON a.recording_id = b.recording_id AND a.received_time_us <= b.timestamp_us)
"""


@query(ASOF + """SELECT recording_id, frame_id, received_time_us,
  round(CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (received_time_us - t0) / (t1 - t0) * (x1 - x0) END, 6) AS x_pos_mm_interp,
  round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL OR t1 = t0 THEN y0 ELSE y0 + (received_time_us - t0) / (t1 - t0) * (y1 - y0) END, 6) AS y_pos_mm_interp FROM n""")
def interp_stage_linear_asof(s: SparkSession, d: str) -> DataFrame:
    out = stage.interp_stage_linear(v.clicks(s, d), v.stage(s, d))
    return out.select("recording_id", "frame_id", "received_time_us", r6("x_pos_mm_interp", "x_pos_mm_interp"), r6("y_pos_mm_interp", "y_pos_mm_interp"))


def _significant(c: str, name: str) -> tuple[str, str]:
    """SQL of a number's first six places and of its size, which may be large beyond the ends of a spline."""
    size = f"CASE WHEN abs({c}) < 1 THEN 0 ELSE CAST(floor(log10(abs({c}))) AS INTEGER) + 1 END"
    return f"round({c} / power(10, {size}), 6) + 0.0 AS {name}", f"{size} AS {name}_size"


#: SQL: the not-a-knot spline through each recording's log by a sweep over its knots and back; a line or parabola through 2 or 3.
CUBIC = """, good AS (SELECT recording_id FROM t_stage GROUP BY ALL HAVING count(*) >= 2 AND count(*) = count(DISTINCT timestamp_us)),
kn AS (SELECT recording_id, timestamp_us AS ts, x_pos_mm AS x, y_pos_mm AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n,
  (timestamp_us - min(timestamp_us) OVER (PARTITION BY recording_id)) / (max(timestamp_us) OVER (PARTITION BY recording_id) - min(timestamp_us) OVER (PARTITION BY recording_id)) AS t
  FROM t_stage SEMI JOIN good USING (recording_id) WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp_us)),
seg AS (SELECT *, lead(t) OVER w - t AS h, (lead(x) OVER w - x) / (lead(t) OVER w - t) AS dx, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS dy FROM kn WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
eq AS (SELECT recording_id, n, i, lag(h) OVER w AS h0, h AS h1, lag(h, 2) OVER w AS hm, lead(h) OVER w AS hp, 6 * (dx - lag(dx) OVER w) AS rx, 6 * (dy - lag(dy) OVER w) AS ry FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
co AS (SELECT recording_id, n, i, rx, ry, h0 - CASE WHEN i = n - 2 THEN h1 * h1 / h0 ELSE 0 END AS lo,
  2 * (h0 + h1) + CASE WHEN i = 1 THEN h0 * (1 + h0 / h1) ELSE 0 END + CASE WHEN i = n - 2 THEN h1 * (1 + h1 / h0) ELSE 0 END AS md, h1 - CASE WHEN i = 1 THEN h0 * h0 / h1 ELSE 0 END AS hi
  FROM eq WHERE n >= 4 AND i BETWEEN 1 AND n - 2),
fw AS (SELECT recording_id, n, i, hi / md AS c, rx / md AS px, ry / md AS py FROM co WHERE i = 1
  UNION ALL SELECT co.recording_id, co.n, co.i, hi / (md - lo * c), (rx - lo * px) / (md - lo * c), (ry - lo * py) / (md - lo * c) FROM fw JOIN co ON co.recording_id = fw.recording_id AND co.i = fw.i + 1),
bw AS (SELECT recording_id, i, px AS mx, py AS my FROM fw WHERE i = n - 2
  UNION ALL SELECT fw.recording_id, fw.i, px - c * mx, py - c * my FROM bw JOIN fw ON fw.recording_id = bw.recording_id AND fw.i = bw.i - 1),
mm AS (SELECT s.recording_id, s.i, s.n, mx, my, lag(h) OVER w AS hb, lag(h, 2) OVER w AS hbb, h, lead(h) OVER w AS ha FROM seg s LEFT JOIN bw USING (recording_id, i) WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
m2 AS (SELECT recording_id, i,
  CASE WHEN i = 0 THEN lead(mx) OVER w * (1 + h / ha) - lead(mx, 2) OVER w * h / ha WHEN i = n - 1 THEN lag(mx) OVER w * (1 + hb / hbb) - lag(mx, 2) OVER w * hb / hbb ELSE mx END AS mx,
  CASE WHEN i = 0 THEN lead(my) OVER w * (1 + h / ha) - lead(my, 2) OVER w * h / ha WHEN i = n - 1 THEN lag(my) OVER w * (1 + hb / hbb) - lag(my, 2) OVER w * hb / hbb ELSE my END AS my
  FROM mm WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
pc AS (SELECT s.*, m2.mx, m2.my, lead(m2.mx) OVER w AS mx1, lead(m2.my) OVER w AS my1, lead(dx) OVER w AS dx1, lead(dy) OVER w AS dy1, lag(dx) OVER w AS dx0, lag(dy) OVER w AS dy0, lag(h) OVER w AS hb, lead(h) OVER w AS ha
  FROM seg s JOIN m2 USING (recording_id, i) WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
sp AS (SELECT recording_id, min(ts) AS t0, max(ts) AS t1 FROM kn GROUP BY ALL),
ak AS (SELECT c.recording_id, c.frame_id, c.received_time_us, (c.received_time_us - t0) / (t1 - t0) AS u, greatest(0, least(coalesce(k.i, 0), coalesce(k.n, 2) - 2)) AS i
  FROM t_clicks c JOIN sp USING (recording_id) ASOF LEFT JOIN kn k ON k.recording_id = c.recording_id AND c.received_time_us >= k.ts),
va AS (SELECT ak.recording_id, ak.frame_id, received_time_us,
  CASE n WHEN 2 THEN x + (u - t) * dx WHEN 3 THEN x + (u - t) * dx + (u - t) * (u - t - h) * CASE WHEN pc.i = 0 THEN (dx1 - dx) / (h + ha) ELSE (dx - dx0) / (h + hb) END
    ELSE x + (u - t) * (dx - h * (2 * mx + mx1) / 6 + (u - t) * (mx / 2 + (u - t) * (mx1 - mx) / (6 * h))) END AS vx,
  CASE n WHEN 2 THEN y + (u - t) * dy WHEN 3 THEN y + (u - t) * dy + (u - t) * (u - t - h) * CASE WHEN pc.i = 0 THEN (dy1 - dy) / (h + ha) ELSE (dy - dy0) / (h + hb) END
    ELSE y + (u - t) * (dy - h * (2 * my + my1) / 6 + (u - t) * (my / 2 + (u - t) * (my1 - my) / (6 * h))) END AS vy
  FROM ak JOIN pc USING (recording_id, i))
"""


@query(CUBIC + f"SELECT recording_id, frame_id, received_time_us, {', '.join((*_significant('vx', 'x'), *_significant('vy', 'y')))} FROM va")
def interp_stage_cubic(s: SparkSession, d: str) -> DataFrame:
    """The first six places of each position, and how many there are before the point."""
    out = stage.interp_stage_cubic(v.clicks(s, d), v.stage(s, d))
    size = {c: F.when(F.abs(f"{c}_pos_mm_interp") < 1, 0).otherwise(F.floor(F.log10(F.abs(f"{c}_pos_mm_interp"))).cast("int") + 1) for c in "xy"}
    places = [r6(F.col(f"{c}_pos_mm_interp") / F.pow(F.lit(10.0), size[c]), c) for c in "xy"]
    return out.select("recording_id", "frame_id", "received_time_us", *places, *(size[c].alias(f"{c}_size") for c in "xy"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    f = F.col("frame_id")
    return v.frames(s, d).where((f % 6 == 0) & (f % 4 != 2)).select("recording_id", (f + 100).alias("muscle_frame_id"), f.alias("corresponding_behavior_frame_id"))


@query(""", m AS (SELECT recording_id, frame_id AS c, frame_id + 100 AS muscle_frame_id FROM t_frames WHERE frame_id % 6 = 0 AND frame_id % 4 != 2)
SELECT f.recording_id, f.frame_id AS behavior_frame_id, CASE WHEN b.c IS NULL OR a.c - f.frame_id < f.frame_id - b.c THEN a.muscle_frame_id ELSE b.muscle_frame_id END AS muscle_frame_id
FROM t_frames f ASOF LEFT JOIN m b ON f.recording_id = b.recording_id AND f.frame_id >= b.c ASOF LEFT JOIN m a ON f.recording_id = a.recording_id AND f.frame_id <= a.c""")
def nearest_muscle_frame(s: SparkSession, d: str) -> DataFrame:
    return sync.nearest_muscle_frame(v.frames(s, d).select("recording_id", F.col("frame_id").alias("behavior_frame_id")), _anchors(s, d))


@query(SLOTS + "SELECT s.recording_id, frame_id, slot, behavior_frame_id FROM slots s JOIN groups g USING (recording_id, slot)")
def muscle_slot_join(s: SparkSession, d: str) -> DataFrame:
    return sync.muscle_slot_join(_slots(s, d), _groups(s, d)).select("recording_id", "frame_id", "slot", "behavior_frame_id")


@query("SELECT recording_id, frame_id AS behavior_frame_id, frame_id // ratio - 1 AS muscle_frame_id FROM t_frames JOIN t_ratios USING (recording_id) WHERE frame_id % ratio = 0 AND frame_id >= ratio")
def alignment_at_muscle(s: SparkSession, d: str) -> DataFrame:
    rows = v.frames(s, d).select("recording_id", F.col("frame_id").alias("behavior_frame_id"))
    return sync.alignment_at_muscle(rows, v.ratios(s, d), offset=1).select("recording_id", "behavior_frame_id", "muscle_frame_id")


def _detections(s: SparkSession, d: str) -> DataFrame:
    """One detection for each tag, image and corner, seen in an image 1984 wide."""
    least = F.min(F.struct("pixel_x_px", "pixel_y_px")).alias("p")
    return v.scan(s, d).groupBy("apriltag_id", "image_id", "corner_id", "detected_id").agg(least).select(
        "apriltag_id", "image_id", "corner_id", "detected_id", F.lit(0).alias("detection_no"), F.col("p.pixel_x_px").alias("x_px"), F.col("p.pixel_y_px").alias("y_px"), F.lit(1984).alias("image_width")
    )


DETECTIONS = """, det AS (SELECT apriltag_id, image_id, corner_id, detected_id, min({'x': pixel_x_px, 'y': pixel_y_px}) AS p FROM t_scan GROUP BY ALL),
scan AS (SELECT DISTINCT apriltag_id, image_id, image_id % 97 * 0.5 AS stage_x_mm FROM t_scan),
tags AS (SELECT s_suppkey AS apriltag_id, unnest(range(1, 8)) AS corner_id FROM supplier WHERE s_suppkey % 3 != 0)
"""


def _scan_images(s: SparkSession, d: str) -> DataFrame:
    return v.scan(s, d).select("apriltag_id", "image_id", (F.col("image_id") % 97 * 0.5).alias("stage_x_mm")).distinct()


@query(DETECTIONS + """SELECT apriltag_id, image_id, corner_id, stage_x_mm, round(1983 - p.x, 6) AS pixel_x_px, p.y AS pixel_y_px, CASE WHEN t.corner_id IS NOT NULL THEN apriltag_id * 1.5 END AS physical_x_mm
FROM scan JOIN det USING (apriltag_id, image_id) LEFT JOIN tags t USING (apriltag_id, corner_id) WHERE detected_id = apriltag_id""")
def calibration_points(s: SparkSession, d: str) -> DataFrame:
    tags = v.table(s, d, "supplier").where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("apriltag_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("corner_id"), (F.col("s_suppkey") * 1.5).alias("physical_x_mm"))
    out = cal.calibration_points(_scan_images(s, d), _detections(s, d), tags)
    return out.select("apriltag_id", "image_id", "corner_id", "stage_x_mm", r6("pixel_x_px", "pixel_x_px"), "pixel_y_px", "physical_x_mm")


@query(DETECTIONS + "SELECT apriltag_id, image_id FROM scan WHERE NOT EXISTS (SELECT 1 FROM det WHERE det.apriltag_id = scan.apriltag_id AND det.image_id = scan.image_id AND detected_id = det.apriltag_id)")
def missing_detections(s: SparkSession, d: str) -> DataFrame:
    return cal.missing_detections(_scan_images(s, d), _detections(s, d)).select("apriltag_id", "image_id")


CONSENSUS = """, ref AS (SELECT stage_x, stage_y, camera, corner_id, x, y FROM t_corners WHERE is_reference),
dist AS (SELECT c.*, sqrt(power(c.x - r.x, 2) + power(c.y - r.y, 2)) AS distance FROM t_corners c JOIN ref r USING (stage_x, stage_y, camera, corner_id) WHERE NOT is_reference),
con AS (SELECT stage_x, stage_y, camera, corner_id, median(x) AS x, median(y) AS y, count(*) AS n FROM dist WHERE distance <= 1 GROUP BY ALL)
"""


@query(CONSENSUS + """, b AS (SELECT a.stage_x, a.stage_y, a.corner_id, a.x AS x_a, b.x AS x_b, count(*) OVER (PARTITION BY a.stage_x, a.stage_y) AS n
  FROM con a JOIN con b USING (stage_x, stage_y, corner_id) WHERE a.camera = 'behavior' AND b.camera = 'muscle')
SELECT stage_x, stage_y, corner_id, round(x_a, 6) AS x_a, round(x_b, 6) AS x_b FROM b WHERE n >= 4""")
def match_corners(s: SparkSession, d: str) -> DataFrame:
    c = cal.corner_consensus(v.corners(s, d))
    a, b = (c.where(F.col("camera") == k).select("stage_x", "stage_y", "corner_id", "x", "y") for k in ("behavior", "muscle"))
    return cal.match_corners(a, b).select("stage_x", "stage_y", "corner_id", r6("x_a", "x_a"), r6("x_b", "x_b"))


LOCAL = """, local AS (SELECT o_orderkey AS trial, epoch_us(o_orderdate) AS mtime FROM orders), remote AS (SELECT DISTINCT l_orderkey AS trial FROM lineitem)
"""


def _bases(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("trial"), v.micros("o_orderdate").alias("mtime")), v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("trial"))


@query(LOCAL + "SELECT trial, mtime FROM local ANTI JOIN remote USING (trial)")
def new_trials(s: SparkSession, d: str) -> DataFrame:
    return jobs.new_trials(*_bases(s, d))


@query(LOCAL + "SELECT trial FROM local EXCEPT SELECT trial FROM remote")
def trial_diff_set(s: SparkSession, d: str) -> DataFrame:
    return jobs.trial_diff_set(*_bases(s, d))


@query(LOCAL + "SELECT trial FROM local SEMI JOIN (SELECT l_orderkey AS trial FROM lineitem WHERE l_linenumber IN (1, 2, 3)) USING (trial)")
def output_conflicts(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.when(n == 1, "metadata").when(n == 2, "stage_position").when(n == 3, "processed").otherwise("raw")
    return jobs.output_conflicts(_bases(s, d)[0].select("trial"), v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("trial"), name.alias("name")))


INTERVALS = """, st AS (SELECT recording_id, on2 AS f2, greatest(on2, on3) AS f3, greatest(on2, on3, off2) AS g2, greatest(on2, on3, off2, stop) AS z FROM t_protocols WHERE valid AND NOT none)
"""


@query(INTERVALS + "SELECT f.recording_id, f.frame_id, coalesce(frame_id >= f2 AND frame_id < g2 AND frame_id < z, false) AS ch2, coalesce(frame_id >= f3 AND frame_id < z, false) AS ch3 FROM t_frames f LEFT JOIN st USING (recording_id)")
def protocol_state_join(s: SparkSession, d: str) -> DataFrame:
    return pr.protocol_state_join(v.frames(s, d).select("recording_id", "frame_id"), pr.parse_protocol(v.protocols(s, d)))


@query(""", p AS (SELECT stage_x, stage_y, pixel_x AS x, pixel_y * 9 AS y, CAST(round_even(pixel_x, 0) AS BIGINT) AS c, CAST(round_even(pixel_y * 9, 0) AS BIGINT) AS r FROM t_calib),
cell AS (SELECT range % 48 AS c, range // 48 AS r, NOT (range % 48 = 20 AND range // 48 BETWEEN 10 AND 40) AS open FROM range(48 * 72)),
ok AS (SELECT c, r FROM cell WHERE open AND c BETWEEN 2 AND 45 AND r BETWEEN 2 AND 69 AND NOT EXISTS (SELECT 1 FROM cell w WHERE NOT w.open AND abs(w.r - cell.r) <= 2 AND abs(w.c - cell.c) <= round_even(sqrt(4 - power(w.r - cell.r, 2)), 0)))
SELECT stage_x, stage_y, round(x, 6) AS x, round(y, 6) AS y, ok.c IS NOT NULL AS accessible FROM p LEFT JOIN ok USING (c, r)""")
def inside_active_area(s: SparkSession, d: str) -> DataFrame:
    p = v.calib(s, d).select(F.lit(0).cast("long").alias("arena"), "stage_x", "stage_y", F.col("pixel_x").alias("x"), (F.col("pixel_y") * 9).alias("y"))
    return pr.inside_active_area(p, pr.accessible_cells(v.mask(s), 2), 1.0, "x", "y").select("stage_x", "stage_y", r6("x", "x"), r6("y", "y"), "accessible")


@query(""", wall AS (SELECT DISTINCT l_suppkey % 2 AS arena, l_partkey * 7 % 600 AS c, l_orderkey * 11 % 480 AS r FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 499 = 0),
n AS (SELECT range AS d, round_even(sqrt(10000 - power(range, 2)), 0) AS n FROM range(-100, 101)),
grown AS (SELECT DISTINCT arena, r + d AS r, c - n AS a, c + n AS b FROM wall, n)
SELECT arena, r AS "row", c AS col FROM (SELECT DISTINCT l_suppkey % 2 AS arena FROM lineitem), (SELECT range AS c FROM range(100, 500)), (SELECT range AS r FROM range(100, 380))
EXCEPT SELECT arena, r, unnest(range(CAST(greatest(a, 100) AS BIGINT), CAST(least(b, 499) AS BIGINT) + 1)) FROM grown""")
def accessible_cells(s: SparkSession, d: str) -> DataFrame:
    """Two arenas of 600 x 480 cells with walls from the tables; 100 cells around each wall and border are closed."""
    c = F.col
    marks = v.table(s, d, "lineitem")
    walls = marks.where((c("l_linenumber") == 1) & (c("l_orderkey") % 499 == 0)).select((c("l_suppkey") % 2).alias("arena"), (c("l_partkey") * 7 % 600).alias("col"), (c("l_orderkey") * 11 % 480).alias("row")).distinct()
    arenas = marks.select((c("l_suppkey") % 2).alias("arena")).distinct()
    cells = arenas.select("arena", F.explode(F.sequence(F.lit(0), F.lit(600 * 480 - 1))).alias("k")).select("arena", (c("k") % 600).cast("long").alias("col"), F.floor(c("k") / 600).alias("row"))
    mask = cells.join(walls.withColumn("_w", F.lit(True)), ["arena", "col", "row"], "left").select("arena", "col", "row", c("_w").isNull().alias("open"))
    return pr.accessible_cells(mask, 100).select("arena", "row", "col")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'differs' ELSE 'identical' END AS state FROM documents", views=False)
def verify_copy(s: SparkSession, d: str) -> DataFrame:
    return jobs.verify_copy(*v.manifests(s, d))


# Aggregations


@query(""", a AS (SELECT *, median(pixel_x_px) OVER w AS mx, median(pixel_y_px) OVER w AS my FROM t_scan WINDOW w AS (PARTITION BY apriltag_id, corner_id)),
b AS (SELECT *, sqrt(power(pixel_x_px - mx, 2) + power(pixel_y_px - my, 2)) AS dist FROM a), c AS (SELECT *, median(dist) OVER (PARTITION BY apriltag_id, corner_id) AS md FROM b),
e2 AS (SELECT *, median(abs(dist - md)) OVER (PARTITION BY apriltag_id, corner_id) AS mad FROM c)
SELECT apriltag_id, corner_id, image_id, round(pixel_x_px, 6) AS pixel_x_px, round(dist, 6) AS distance, round(greatest(3 * 1.4826 * mad, 1.0), 6) AS lim, dist <= greatest(3 * 1.4826 * mad, 1.0) AS kept FROM e2""")
def mad_outlier_filter(s: SparkSession, d: str) -> DataFrame:
    out = cal.mad_outlier_filter(v.scan(s, d), ["apriltag_id", "corner_id"])
    return out.select("apriltag_id", "corner_id", "image_id", r6("pixel_x_px", "pixel_x_px"), r6("distance", "distance"), r6("limit", "lim"), "kept")


@query("SELECT apriltag_id, count(*) AS n_before, count(*) FILTER (decision_margin >= 20 AND detected_id = apriltag_id) AS n_after FROM t_scan GROUP BY apriltag_id")
def samples_per_tag(s: SparkSession, d: str) -> DataFrame:
    return cal.samples_per_tag(v.scan(s, d), quality.filter_detections(v.scan(s, d)))


@query(CONSENSUS + "SELECT stage_x, stage_y, camera, corner_id, round(x, 6) AS x, round(y, 6) AS y, n FROM con")
def corner_consensus(s: SparkSession, d: str) -> DataFrame:
    return cal.corner_consensus(v.corners(s, d)).select("stage_x", "stage_y", "camera", "corner_id", r6("x", "x"), r6("y", "y"), "n")


@query(CONSENSUS + "SELECT camera, count(*) AS n_total, count(*) FILTER (distance > 1) AS n_rejected, round(100 * count(*) FILTER (distance > 1) / count(*), 6) AS percent_rejected, round(avg(distance) FILTER (distance > 1), 6) AS mean_rejected_px, round(max(distance) FILTER (distance > 1), 6) AS max_rejected_px FROM dist GROUP BY camera")
def rejection_stats(s: SparkSession, d: str) -> DataFrame:
    c = ["percent_rejected", "mean_rejected_px", "max_rejected_px"]
    return cal.rejection_stats(v.corners(s, d)).select("camera", "n_total", "n_rejected", *(r6(x, x) for x in c))


FITTED = f"SELECT DISTINCT calibration_id, {', '.join(f'round(CAST({w} AS DOUBLE), 3) AS w{k}' for k, w in enumerate(v.MAP))}"


def _weights(fit: DataFrame) -> DataFrame:
    return fit.select("calibration_id", *(r6(F.col("weights")[k], f"w{k}", 3) for k in range(10)), "n")


@query(FITTED + ", count(*) OVER (PARTITION BY calibration_id) AS n FROM t_calib")
def linear_map_fit(s: SparkSession, d: str) -> DataFrame:
    """All points, each on the map."""
    x, y = g.apply_map(_m(), *(F.col(c) for c in STAGE_AND_PIXEL))
    return _weights(cal.linear_map_fit(v.calib(s, d).withColumns({"physical_x": x, "physical_y": y})))


@query(FITTED + ", count(*) FILTER (off = 0) OVER (PARTITION BY calibration_id) AS n FROM t_calib")
def ransac_linear_fit(s: SparkSession, d: str) -> DataFrame:
    return _weights(cal.ransac_linear_fit(v.calib(s, d), "point")[0])


@query(""", r AS (SELECT calibration_id, off = 0 AS inlier FROM t_calib)
SELECT calibration_id, count(*) AS n_total, count(*) FILTER (inlier) AS n_inliers, count(*) FILTER (NOT inlier) AS n_outliers, round(100 * count(*) FILTER (NOT inlier) / count(*), 4) AS percent_outliers,
  0.0 AS rmse, 0.0 AS max_residual, 1.0 AS r2_x, 1.0 AS r2_y FROM r GROUP BY calibration_id""")
def fit_metrics(s: SparkSession, d: str) -> DataFrame:
    m = cal.fit_metrics(cal.ransac_linear_fit(v.calib(s, d), "point")[1])
    return m.select("calibration_id", "n_total", "n_inliers", "n_outliers", *(r6(c, c, 4) for c in ("percent_outliers", "rmse", "max_residual", "r2_x", "r2_y")))


#: Fixed test homography.
H = (1.1, 0.02, 5.0, -0.03, 0.95, -2.0, 0.0004, 0.0002, 1.0)
MATCHES = f""", m AS (SELECT calibration_id, pixel_x AS x, stage_x AS y, off, {H[6]} * pixel_x + {H[7]} * stage_x + 1 AS w FROM t_calib)
"""


def _matches(s: SparkSession, d: str) -> DataFrame:
    c = v.calib(s, d).withColumn("_off", F.abs(F.col("physical_x") - sum((F.lit(v.MAP[k]) * F.col(n) for k, n in enumerate(("stage_x", "stage_y", "pixel_x", "pixel_y"))), F.lit(v.MAP[4]))))
    x, y = g.apply_homography(F.array(*map(F.lit, H)), F.col("pixel_x"), F.col("stage_x"))
    return c.select("calibration_id", "point", F.col("pixel_x").alias("x_a"), F.col("stage_x").alias("y_a"), (x + F.when(F.col("_off") > 1, 50.0).otherwise(0.0)).alias("x_b"), y.alias("y_b"))


@query(MATCHES + f"SELECT calibration_id, count(*) FILTER (off = 0) AS n_inliers, {', '.join(f'round(CAST({h} AS DOUBLE), 4) AS h{k}' for k, h in enumerate(H))} FROM m GROUP BY calibration_id")
def homography_fit(s: SparkSession, d: str) -> DataFrame:
    fit, _ = cal.homography_fit(_matches(s, d), "point")
    return fit.select("calibration_id", "n_inliers", *(r6(F.col("h")[k], f"h{k}", 4) for k in range(9)))


@query(", m AS (SELECT calibration_id, stage_x AS e, pixel_y < 5 AS inlier FROM t_calib) SELECT calibration_id, count(*) AS n_total, count(*) FILTER (inlier) AS n_inliers, round(100 * count(*) FILTER (inlier) / count(*), 6) AS percent_inliers, round(avg(e) FILTER (inlier), 6) AS mean_px, round(median(e) FILTER (inlier), 6) AS median_px, round(stddev_pop(e) FILTER (inlier), 6) AS std_px, round(max(e) FILTER (inlier), 6) AS max_px FROM m GROUP BY calibration_id")
def reprojection_stats(s: SparkSession, d: str) -> DataFrame:
    m = v.calib(s, d).select("calibration_id", F.col("stage_x").alias("error_px"), (F.col("pixel_y") < 5).alias("inlier"))
    return cal.reprojection_stats(m).select("calibration_id", "n_total", "n_inliers", *(r6(c, c) for c in ("percent_inliers", "mean_px", "median_px", "std_px", "max_px")))


@query(""", f AS (SELECT recording_id, frame_id, quantile_cont(v, 0.97) AS lo, quantile_cont(v, 0.99995) AS hi FROM t_pixels WHERE frame_id % 20 = 0 AND v > 0 GROUP BY ALL)
SELECT recording_id, CAST(floor(quantile_cont(lo, 0.5)) AS BIGINT) AS vmin, CAST(floor(quantile_cont(hi, 0.95)) AS BIGINT) AS vmax FROM f GROUP BY recording_id""")
def adaptive_vrange(s: SparkSession, d: str) -> DataFrame:
    f = v.images(s, d)
    return pixels.adaptive_vrange(f, f.select("recording_id", "frame_id", F.col("frame_id").alias("place")))


PX = "SELECT recording_id, frame_id, string_agg(CAST({} AS VARCHAR), ',' ORDER BY pos) AS px FROM {} GROUP BY ALL"


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("recording_id", "frame_id", *(F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in columns or ("px",)))


@query(", q AS (SELECT recording_id, frame_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.95) AS hi FROM t_pixels GROUP BY ALL), z AS (SELECT recording_id, frame_id, pos, CAST(floor(least(greatest((v - lo) * 255 / (hi - lo), 0), 255) + 1e-9) AS INTEGER) AS v FROM t_pixels JOIN q USING (recording_id, frame_id)) " + PX.format("v", "z"))
def percentile_stretch(s: SparkSession, d: str) -> DataFrame:
    return _text(pixels.percentile_stretch(v.images(s, d)))


@query(", z AS (SELECT recording_id, frame_id // 10 AS frame_id, pos, CAST(floor(median(v)) AS INTEGER) AS v FROM t_pixels GROUP BY ALL) " + PX.format("v", "z"))
def burst_median_frame(s: SparkSession, d: str) -> DataFrame:
    bursts = v.images(s, d).withColumn("frame_id", F.expr("frame_id div 10"))
    return _text(pixels.burst_median_frame(bursts, ["recording_id", "frame_id"]))


@query(", h AS (SELECT recording_id, CAST(floor((v - 200) / 601.0 * 256) AS BIGINT) AS bin, count(*) AS n FROM t_pixels WHERE v BETWEEN 200 AND 800 GROUP BY ALL) SELECT recording_id, bin, n, round(n / max(n) OVER (PARTITION BY recording_id), 6) AS height FROM h")
def pixel_histogram(s: SparkSession, d: str) -> DataFrame:
    return pixels.pixel_histogram(v.images(s, d), 200, 800).select("recording_id", "bin", "n", r6("height", "height"))


@query(", r AS (SELECT min(value) AS lo, max(value) AS hi FROM e) SELECT least(CAST(floor((value - lo) / (hi - lo) * 40) AS BIGINT), 39) AS bin, count(*) AS n FROM e, r GROUP BY ALL")
def residual_histogram(s: SparkSession, d: str) -> DataFrame:
    return cal.equal_bins(v.table(s, d, "events").select("value"), "value", 40)


@query(", b AS (SELECT recording_id, min(x_pos_mm) AS x0, max(x_pos_mm) AS x1, min(y_pos_mm) AS y0, max(y_pos_mm) AS y1 FROM t_stage GROUP BY ALL) SELECT recording_id, round(x0 - m, 6) AS x_min, round(x1 + m, 6) AS x_max, round(y0 - m, 6) AS y_min, round(y1 + m, 6) AS y_max FROM (SELECT *, 0.05 * greatest(x1 - x0, y1 - y0) AS m FROM b)")
def trajectory_bounds(s: SparkSession, d: str) -> DataFrame:
    return stage.trajectory_bounds(v.stage(s, d)).select("recording_id", *(r6(c, c) for c in ("x_min", "x_max", "y_min", "y_max")))


NEAR5 = "abs(a.pos % 8 - b.pos % 8) <= 2 AND abs(a.pos // 8 - b.pos // 8) <= 2"


def _morphed(name: str, source: str, reduce: str) -> str:
    return f"{name} AS (SELECT a.recording_id, a.frame_id, a.pos, {reduce}(b.m) AS m FROM {source} a JOIN {source} b ON a.recording_id = b.recording_id AND a.frame_id = b.frame_id AND {NEAR5} GROUP BY ALL)"


@query(", s0 AS (SELECT recording_id, frame_id, pos, v > 450 AS m FROM t_pixels), " + ", ".join([_morphed("s1", "s0", "bool_and"), _morphed("s2", "s1", "bool_or"), _morphed("s3", "s2", "bool_or"), _morphed("s4", "s3", "bool_and")]) + """,
lit AS (SELECT recording_id, frame_id, pos FROM s4 WHERE m),
reach AS (SELECT recording_id, frame_id, pos, pos AS dot FROM lit
  UNION SELECT r.recording_id, r.frame_id, r.pos, l.pos FROM reach r JOIN lit l ON l.recording_id = r.recording_id AND l.frame_id = r.frame_id AND abs(l.pos % 8 - r.dot % 8) <= 1 AND abs(l.pos // 8 - r.dot // 8) <= 1),
named AS (SELECT recording_id, frame_id, pos, min(dot) AS blob FROM reach GROUP BY ALL),
sizes AS (SELECT recording_id, frame_id, blob, count(*) AS area, avg(pos % 8) AS x, avg(pos // 8) AS y FROM named GROUP BY ALL),
best AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY recording_id, frame_id ORDER BY area DESC, blob) = 1)
SELECT t_images.recording_id, t_images.frame_id, area, round(x, 6) AS x, round(y, 6) AS y FROM t_images LEFT JOIN best ON best.recording_id = t_images.recording_id AND best.frame_id = t_images.frame_id AND area > 2""")
def blob_centroid(s: SparkSession, d: str) -> DataFrame:
    return pixels.blob_centroid(v.images(s, d), 450.0, 2).select("recording_id", "frame_id", "area", r6("x", "x"), r6("y", "y"))


@query("SELECT job_id, count(*) AS n_trials, count(*) FILTER (status = 'failed') AS n_failed, CASE WHEN count(*) FILTER (status = 'processing') > 0 THEN 'running' WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'all_fail' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial_fail' ELSE 'complete' END AS job_status FROM t_trials GROUP BY job_id")
def job_rollup(s: SparkSession, d: str) -> DataFrame:
    return jobs.job_rollup(v.trials(s, d))


POSE = [f"{k}_{c}" for k in pose.KEYPOINTS for c in ("x", "y")]


@query("SELECT recording_id, behavior_frame_id, CASE WHEN gap THEN 0 ELSE 1 END AS n_instances, " + ", ".join(f"CASE WHEN gap THEN NULL ELSE round({c}, 6) END AS {c}" for c in POSE) + " FROM t_pose")
def pivot_pose(s: SparkSession, d: str) -> DataFrame:
    p = v.pose(s, d)
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("keypoint"), F.col(f"{k}_x").alias("x"), F.col(f"{k}_y").alias("y")) for k in pose.KEYPOINTS)))
    long = p.select("recording_id", "behavior_frame_id", points.alias("p")).select("recording_id", "behavior_frame_id", F.when(~F.isnan("p.x"), 1).alias("instance_id"), "p.*")
    out = pose.pivot_pose(long)
    return out.select("recording_id", "behavior_frame_id", F.col("n_instances").cast("int").alias("n_instances"), *(r6(F.when(~F.isnan(c), F.col(c)), c) for c in POSE))


# Windows


@query(SLOTS + "SELECT recording_id, frame_id, slot, missed FROM slots")
def detect_dropped_frames(s: SparkSession, d: str) -> DataFrame:
    return _slots(s, d).select("recording_id", "frame_id", "slot", "missed")


@query(SLOTS + ", n AS (SELECT *, lead(slot) OVER (PARTITION BY recording_id ORDER BY slot) AS next FROM slots), u AS (SELECT recording_id, unnest(range(slot + 1, next)) AS slot FROM n WHERE next - slot > 1) SELECT recording_id, slot, slot * ratio AS behavior_frame_id FROM u JOIN t_ratios USING (recording_id)")
def skipped_groups(s: SparkSession, d: str) -> DataFrame:
    return sync.skipped_groups(_slots(s, d), v.ratios(s, d))


FILLED = """, l AS (SELECT *, max(CASE WHEN NOT gap THEN behavior_frame_id END) OVER (PARTITION BY recording_id ORDER BY behavior_frame_id) AS b, min(CASE WHEN NOT gap THEN behavior_frame_id END) OVER (PARTITION BY recording_id) AS a FROM t_pose),
filled AS (SELECT l.recording_id, l.behavior_frame_id, p.neck_x, p.neck_y, p.thorax_x, p.thorax_y, p.abdomen_x, p.abdomen_y FROM l LEFT JOIN t_pose p ON p.recording_id = l.recording_id AND p.behavior_frame_id = coalesce(b, a))
"""


def _filled(s: SparkSession, d: str) -> DataFrame:
    return pose.fill_pose_gaps(v.pose(s, d))


@query(FILLED + "SELECT recording_id, behavior_frame_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in POSE) + " FROM filled")
def fill_pose_gaps(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).select("recording_id", "behavior_frame_id", *(r6(F.when(~F.isnan(c), F.col(c)), c) for c in POSE))


@query(AUTOCORRELATION + """, mean AS (SELECT recording_id, frame_id, avg(v) AS m FROM t_pixels GROUP BY ALL),
o AS (SELECT h.recording_id, min(h.frame_id) FILTER (0.5 * (across + down) / power > 0.12 AND b.m > a.m) AS n FROM h JOIN mean a ON a.recording_id = h.recording_id AND a.frame_id = h.frame_id - 1
  JOIN mean b ON b.recording_id = h.recording_id AND b.frame_id = h.frame_id WHERE h.frame_id < 50 GROUP BY ALL)
SELECT i.recording_id, coalesce(o.n, 0) AS n_orphans, o.n IS NOT NULL AS onset_found FROM (SELECT DISTINCT recording_id FROM t_images) i LEFT JOIN o USING (recording_id)""")
def count_leading_orphans(s: SparkSession, d: str) -> DataFrame:
    return pixels.count_leading_orphans(v.images(s, d))


@query("SELECT recording_id, frame_id, row_number() OVER (PARTITION BY recording_id ORDER BY frame_id) - 1 - recording_id % 3 AS muscle_frame_id FROM t_frames WHERE frame_id % 11 != 7 QUALIFY muscle_frame_id >= 0")
def reindex_muscle(s: SparkSession, d: str) -> DataFrame:
    orphans = v.ratios(s, d).select("recording_id", (F.col("recording_id") % 3).alias("n_orphans"))
    return sync.reindex_muscle(_some_frames(s, d), orphans).select("recording_id", "frame_id", "muscle_frame_id")


@query(", n AS (SELECT recording_id, (timestamp_us - min(timestamp_us) OVER (PARTITION BY recording_id)) / 1e6 AS t_s, x_pos_mm AS x0, y_pos_mm AS y0, lead(x_pos_mm) OVER w AS x1, lead(y_pos_mm) OVER w AS y1 FROM t_stage WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp_us)) SELECT recording_id, round(t_s, 6) AS t_s, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1")) + " FROM n WHERE x1 IS NOT NULL")
def trajectory_segments(s: SparkSession, d: str) -> DataFrame:
    return stage.trajectory_segments(v.stage(s, d)).select("recording_id", *(r6(c, c) for c in ("t_s", "x0", "y0", "x1", "y1")))


@query("SELECT recording_id, frame_id // 3 AS group_id, count(*) AS num_valid, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frame_ids FROM t_frames GROUP BY ALL")
def group_of_three(s: SparkSession, d: str) -> DataFrame:
    ids = F.concat_ws(",", F.transform("frames", lambda f: f["frame_id"].cast("string")))
    return sync.group_of_three(v.frames(s, d)).select("recording_id", "group_id", "num_valid", ids.alias("frame_ids"))


# Sort, limit, sampling, sets


@query("SELECT job_id, us AS submission_time FROM t_trials ORDER BY us DESC, job_id DESC LIMIT 1")
def latest_job(s: SparkSession, d: str) -> DataFrame:
    return jobs.latest_job(v.trials(s, d).select("job_id", F.col("us").alias("submission_time")))


@query("SELECT job_id, trial_id, status, CASE WHEN status = 'failed' THEN error END AS error FROM t_trials")
def job_status_report(s: SparkSession, d: str) -> DataFrame:
    return jobs.job_status_report(v.trials(s, d))


@query(", n AS (SELECT recording_id, frame_id + 100 AS muscle_frame_id, frame_id AS corresponding_behavior_frame_id, row_number() OVER (PARTITION BY recording_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM t_frames WHERE frame_id % 6 = 0 AND frame_id % 4 != 2) SELECT recording_id, muscle_frame_id, corresponding_behavior_frame_id FROM n WHERE i % greatest(1, n // 3) = 0")
def overlay_sample(s: SparkSession, d: str) -> DataFrame:
    return sync.overlay_sample(_anchors(s, d), 3)


@query(", st AS (SELECT recording_id, CASE WHEN valid AND NOT none THEN stop END AS stop FROM t_protocols) SELECT recording_id, frame_id FROM t_frames JOIN st USING (recording_id) WHERE stop IS NULL OR frame_id < stop")
def programmed_stop(s: SparkSession, d: str) -> DataFrame:
    return pr.programmed_stop(v.frames(s, d).select("recording_id", "frame_id"), pr.parse_protocol(v.protocols(s, d)))


@query("SELECT DISTINCT a.stage_x, a.stage_y FROM t_corners a JOIN t_corners b USING (stage_x, stage_y) WHERE a.camera = 'behavior' AND b.camera = 'muscle'")
def common_positions(s: SparkSession, d: str) -> DataFrame:
    c = v.corners(s, d)
    return cal.common_positions(c.where("camera = 'behavior'"), c.where("camera = 'muscle'"))


# Scalar and geometry functions


def _m() -> Column:
    return F.array(*map(F.lit, v.MAP))


INVERSE = f""", q AS (SELECT *, {v.MAP[2]} * {v.MAP[8]} - {v.MAP[3]} * {v.MAP[7]} AS det FROM t_calib)"""
STAGE_AND_PIXEL = ("stage_x", "stage_y", "pixel_x", "pixel_y")
MAPPED = ", ".join(f"round({c}, 6) AS {c}" for c in STAGE_AND_PIXEL)


@query(f"""SELECT {MAPPED}, round({v.MAP[0]} * stage_x + {v.MAP[1]} * stage_y + {v.MAP[2]} * pixel_x + {v.MAP[3]} * pixel_y + {v.MAP[4]}, 9) AS physical_x,
  round({v.MAP[5]} * stage_x + {v.MAP[6]} * stage_y + {v.MAP[7]} * pixel_x + {v.MAP[8]} * pixel_y + {v.MAP[9]}, 9) AS physical_y FROM t_calib""")
def stage_pixel_to_physical(s: SparkSession, d: str) -> DataFrame:
    x, y = g.apply_map(_m(), *(F.col(c) for c in STAGE_AND_PIXEL))
    return v.calib(s, d).select(*(r6(c, c) for c in STAGE_AND_PIXEL), r6(x, "physical_x", 9), r6(y, "physical_y", 9))


@query(f"SELECT {MAPPED}, CAST(round(pixel_x + 0.25, 0) AS BIGINT) AS col, CAST(round(pixel_y + 0.25, 0) AS BIGINT) AS row FROM t_calib")
def stage_physical_to_pixel(s: SparkSession, d: str) -> DataFrame:
    shift_x, shift_y = 0.25 * v.MAP[2] + 0.25 * v.MAP[3], 0.25 * v.MAP[7] + 0.25 * v.MAP[8]
    px, py = g.apply_map(_m(), *(F.col(c) for c in STAGE_AND_PIXEL))
    x, y = g.apply_map(g.invert_pixel_block(_m()), F.col("stage_x"), F.col("stage_y"), px + shift_x, py + shift_y)
    return v.calib(s, d).select(*(r6(c, c) for c in STAGE_AND_PIXEL), g.whole_pixel(F.round(x, 9)).alias("col"), g.whole_pixel(F.round(y, 9)).alias("row"))


@query(f"SELECT {MAPPED}, round(stage_x, 5) AS back_x, round(stage_y, 5) AS back_y FROM t_calib")
def physical_pixel_to_stage(s: SparkSession, d: str) -> DataFrame:
    px, py = g.apply_map(_m(), *(F.col(c) for c in STAGE_AND_PIXEL))
    x, y = g.physical_to_stage(_m(), px, py, F.col("pixel_x"), F.col("pixel_y"))
    return v.calib(s, d).select(*(r6(c, c) for c in STAGE_AND_PIXEL), r6(x, "back_x", 5), r6(y, "back_y", 5))


@query(""", w AS (SELECT s_suppkey, 1.0 + s_suppkey % 3 AS a, 0.5 AS b, 0.25 AS c, 2.0 AS d, 1.5 AS sx, s_suppkey * 1.0 AS bias FROM supplier)
SELECT s_suppkey, round(d / (a * d - b * c), 6) AS i00, round(-b / (a * d - b * c), 6) AS i01, round(-c / (a * d - b * c), 6) AS i10, round(a / (a * d - b * c), 6) AS i11,
  round(-(d * sx) / (a * d - b * c), 6) AS s00, round(-(d * bias) / (a * d - b * c), 6) AS b0 FROM w""")
def invert_pixel_block(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    zero = F.lit(0.0)
    m = F.array(F.lit(1.5), zero, 1.0 + k % 3, F.lit(0.5), k * 1.0, zero, zero, F.lit(0.25), F.lit(2.0), zero)
    i = v.table(s, d, "supplier").select("s_suppkey", g.invert_pixel_block(m).alias("i"))
    at = {"i00": 2, "i01": 3, "i10": 7, "i11": 8, "s00": 0, "b0": 4}
    return i.select("s_suppkey", *(r6(F.col("i")[n], c) for c, n in at.items()))


@query(f"SELECT {MAPPED}, round(pixel_x, 5) AS other_x, round(pixel_y, 5) AS other_y FROM t_calib")
def cross_camera_affine(s: SparkSession, d: str) -> DataFrame:
    affine = g.cross_camera_affine(_m(), g.invert_pixel_block(_m()), F.col("stage_x"), F.col("stage_y"))
    x, y = g.apply_affine(affine, F.col("pixel_x"), F.col("pixel_y"))
    return v.calib(s, d).select(*(r6(c, c) for c in STAGE_AND_PIXEL), r6(x, "other_x", 5), r6(y, "other_y", 5))


@query(MATCHES + f"SELECT round(x, 6) AS x, round(y, 6) AS y, round(({H[0]} * x + {H[1]} * y + {H[2]}) / w, 6) AS u, round(({H[3]} * x + {H[4]} * y + {H[5]}) / w, 6) AS v, round(x, 5) AS back_x, round(y, 5) AS back_y FROM m")
def homography_points(s: SparkSession, d: str) -> DataFrame:
    h = F.array(*map(F.lit, H))
    u, w = g.apply_homography(h, F.col("pixel_x"), F.col("stage_x"))
    bx, by = g.apply_homography(g.invert_3x3(h), u, w)
    return v.calib(s, d).select(r6("pixel_x", "x"), r6("stage_x", "y"), r6(u, "u"), r6(w, "v"), r6(bx, "back_x", 5), r6(by, "back_y", 5))


@query(FILLED + """, r AS (SELECT *, radians(-90.0) - atan2(neck_y - abdomen_y, neck_x - abdomen_x) AS a FROM filled WHERE neck_x IS NOT NULL)
SELECT recording_id, behavior_frame_id, round(cos(a), 6) + 0.0 AS m0, round(sin(a), 6) + 0.0 AS m3, round(cos(a) * (neck_x - thorax_x) - sin(a) * (neck_y - thorax_y) + 50, 6) AS neck_x_aligned,
  round(sin(a) * (neck_x - thorax_x) + cos(a) * (neck_y - thorax_y) + 50, 6) AS neck_y_aligned, 50.0 AS thorax_x_aligned, 50.0 AS thorax_y_aligned FROM r""")
def alignment_transform(s: SparkSession, d: str) -> DataFrame:
    out = pose.alignment_transform(_filled(s, d).where(~F.isnan("neck_x")), 100)
    points = ("neck_x_aligned", "neck_y_aligned", "thorax_x_aligned", "thorax_y_aligned")
    return out.select("recording_id", "behavior_frame_id", r6(F.col("m")[0], "m0"), r6(F.col("m")[3], "m3"), *(r6(c, c) for c in points))


@query(f"SELECT round(pixel_x, 6) AS pixel_x, round(stage_x, 6) AS stage_x, {', '.join(f'round({H[3 * r]} * {a} + {H[3 * r + 1]} * {b} + {H[3 * r + 2]} * {c}, 9) AS c{r}{k}' for r in range(3) for k, (a, b, c) in enumerate((('pixel_x', '0.5', '0'), ('-1', '2', '0'), ('stage_x', '3', '1'))))} FROM t_calib")
def compose_transforms(s: SparkSession, d: str) -> DataFrame:
    inner = F.array(F.col("pixel_x"), F.lit(-1.0), F.col("stage_x"), F.lit(0.5), F.lit(2.0), F.lit(3.0))
    c = v.calib(s, d).select("pixel_x", "stage_x", g.compose(F.array(*map(F.lit, H)), g.as_3x3(inner)).alias("c"))
    return c.select(r6("pixel_x", "pixel_x"), r6("stage_x", "stage_x"), *(r6(F.col("c")[3 * r + k], f"c{r}{k}", 9) for r in range(3) for k in range(3)))


@query("SELECT recording_id, frame_id, (frame_id + 1) * ratio AS behavior_id, CAST(trunc(frame_id / ratio - 1) AS BIGINT) AS floor_id, CAST(round_even(frame_id / ratio - 1, 0) AS BIGINT) AS nearest_id FROM t_frames JOIN t_ratios USING (recording_id)")
def match_frame_ids(s: SparkSession, d: str) -> DataFrame:
    f, r = F.col("frame_id"), F.col("ratio")
    return v.frames(s, d).join(v.ratios(s, d), "recording_id").select("recording_id", "frame_id", sync.muscle_to_behavior(f, r, 1).alias("behavior_id"), sync.behavior_to_muscle(f, r, "Floor", 1).alias("floor_id"), sync.behavior_to_muscle(f, r, "nearest", 1).alias("nearest_id"))


@query(AUTOCORRELATION + "SELECT recording_id, frame_id, round(0.5 * (across + down) / power, 4) AS autocorrelation FROM h")
def diff_autocorrelation(s: SparkSession, d: str) -> DataFrame:
    out = pixels.frame_change(v.images(s, d)).where("autocorrelation IS NOT NULL")
    return out.select("recording_id", "frame_id", r6("autocorrelation", "autocorrelation", 4))


@query(", z AS (SELECT recording_id, 3 * (frame_id // 3) + frame_id % 3 AS frame_id, pos, v FROM t_pixels) " + PX.format("v", "z"))
def expand_channels(s: SparkSession, d: str) -> DataFrame:
    f = v.images(s, d).withColumn("group_id", F.expr("frame_id div 3"))
    ch = [F.max_by("px", F.when(F.col("frame_id") % 3 == k, F.lit(1))).alias(f"ch{k}") for k in range(3)]
    groups = f.groupBy("recording_id", "group_id").agg(F.count("*").alias("num_valid"), *ch)
    return _text(pixels.expand_channels(groups))


@query(", z AS (SELECT recording_id, frame_id, 8 * (pos % 8) + pos // 8 AS pos, v FROM t_pixels), y AS (SELECT recording_id, frame_id, 8 * (7 - pos // 8) + (7 - pos % 8) AS pos, v FROM z) " + PX.format("v", "y"))
def reorient_frame(s: SparkSession, d: str) -> DataFrame:
    return _text(pixels.reorient_frame(v.images(s, d), "behavior"))


@query(", z AS (SELECT p.recording_id, p.frame_id, t.pos, CASE WHEN t.pos % 8 >= 2 AND t.pos // 8 >= 1 AND p.pos = t.pos - 10 THEN p.v END AS v FROM t_pixels p, (SELECT range AS pos FROM range(64)) t), y AS (SELECT recording_id, frame_id, pos, coalesce(max(v), 0) AS v FROM z GROUP BY ALL) " + PX.format("v", "y"))
def warp_frame(s: SparkSession, d: str) -> DataFrame:
    shifted = v.images(s, d).withColumn("m", F.array(*map(F.lit, (1.0, 0.0, 2.0, 0.0, 1.0, 1.0))))
    return _text(pixels.warp_frame(shifted, 8, 8))


@query(", z AS (SELECT recording_id, frame_id, pos, CAST(least(greatest(round_even(v * (255.0 / 600) - 200 * (255.0 / 600), 0), 0), 255) AS INTEGER) AS v FROM (SELECT * REPLACE (CAST(v AS DOUBLE) AS v) FROM t_pixels)) " + PX.format("v", "z"))
def window_to_8bit(s: SparkSession, d: str) -> DataFrame:
    return _text(v.images(s, d).withColumn("px", F.transform("px", lambda x: pixels.window_to_8bit(x, 200, 800))))


@query(", z AS (SELECT recording_id, frame_id, pos, v, CAST(floor(least(greatest((CAST(v AS DOUBLE) - 200) / 600.0, 0), 1) * 255) AS INTEGER) AS w FROM t_pixels) SELECT recording_id, frame_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS red, string_agg(CAST(w AS VARCHAR), ',' ORDER BY pos) AS green FROM z GROUP BY ALL")
def overlay_frame(s: SparkSession, d: str) -> DataFrame:
    f = v.images(s, d)
    return _text(pixels.overlay_frame(f, f, 200, 800), "red", "green")


@query(""", t AS (SELECT stage_x, stage_y, pixel_x, pixel_y, pixel_x - 50 AS dx, pixel_y - 4 AS dy FROM t_calib)
SELECT round(stage_x, 6) AS stage_x, round(stage_y, 6) AS stage_y, round(pixel_x, 6) AS pixel_x, round(pixel_y, 6) AS pixel_y, CASE WHEN sqrt(dx * dx + dy * dy) >= 5 THEN round(least(greatest(stage_x - dx, 0), 40), 6) END AS target_x,
  CASE WHEN sqrt(dx * dx + dy * dy) >= 5 THEN round(least(greatest(stage_y + dy, 0), 8), 6) END AS target_y FROM t""")
def tracking_target(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    x, y = g.tracking_target((c("stage_x"), c("stage_y")), (c("pixel_x"), c("pixel_y")), (F.lit(50.0), F.lit(4.0)), 5.0, (0.0, 40.0, 0.0, 8.0))
    return v.calib(s, d).select(*(r6(n, n) for n in STAGE_AND_PIXEL), r6(x, "target_x"), r6(y, "target_y"))


@query("SELECT round(pixel_x, 6) AS pixel_x, round(stage_x, 6) AS stage_x, round(20 + least(sqrt(power(pixel_x - 100, 2) + power(stage_x - 50, 2)) / 40, 1) * 230, 9) AS acceleration FROM t_calib")
def tracking_acceleration(s: SparkSession, d: str) -> DataFrame:
    a = g.tracking_acceleration(F.col("pixel_x"), F.col("stage_x"), 200, 100, 20, 250, 10)
    return v.calib(s, d).select(r6("pixel_x", "pixel_x"), r6("stage_x", "stage_x"), r6(a, "acceleration", 9))


@query("SELECT p_partkey, 30.5 - p_size AS stage_x, 4.25 + p_size AS stage_y, round(greatest(30.5 - p_size, 0), 6) AS x_min, round(least(4.25 + p_size, 50), 6) AS y_max FROM part", views=False)
def arena_to_stage(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    ox, oy = g.arena_offset(F.lit(10.5), F.lit(9.25), F.lit(20.0), F.lit(5.0))
    x, y = g.arena_to_stage(size, size, ox, oy)
    limits = g.stage_limits(ox, oy, size, size, 100.0, 50.0)
    return v.table(s, d, "part").select("p_partkey", x.alias("stage_x"), y.alias("stage_y"), r6(limits[0], "x_min"), r6(limits[3], "y_max"))


@query(""", t AS (SELECT p_partkey, CAST(trunc(1000000.0 / (100.0 / (2 + p_size % 3))) AS INTEGER) AS interval_us, CAST(trunc((200 + p_size) * 20.5) AS INTEGER) AS rolling_us, p_size * 300 AS light FROM part)
SELECT p_partkey, interval_us, rolling_us, interval_us - 1000 AS nominal_exposure_us, interval_us - 1000 - rolling_us AS common_us, interval_us - 1000 - rolling_us - light AS buffer_us, interval_us - 1000 - rolling_us - light >= 0 AS valid FROM t""")
def muscle_timing(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    t = g.muscle_timing(F.lit(100.0), 2 + size % 3, size * 300, 200 + size, F.lit(20.5), F.lit(1000))
    return v.table(s, d, "part").select("p_partkey", *(c.alias(n) for n, c in t.items()))


@query("""SELECT p_partkey, p_size - 3 AS x_offset, 20 AS y_offset, 100 AS roi_width, p_size AS roi_height, (p_size - 2 + p_size + 97) // 2 AS centre_x, (21 + 20 + p_size) // 2 AS centre_y,
  p_size > 2 AND p_size + 97 <= 140 AND p_size > 1 AS within_bounds, (p_size * 7 + 32) // 64 * 64 AS rounded, ((2000 - p_size * 7) // 2 + 32) // 64 * 64 AS centred FROM part""", views=False)
def roi_geometry(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("int")
    r = g.roi_geometry(n - 2, n + 97, F.lit(21), 20 + n, F.lit(140), F.lit(220))
    r |= {"rounded": g.nearest_multiple(n * 7, 64), "centred": g.centred_offset(n * 7, F.lit(2000))}
    return v.table(s, d, "part").select("p_partkey", *(c.cast("int").alias(k) if k != "within_bounds" else c.alias(k) for k, c in r.items()))


@query("SELECT p_partkey, round(86400000 / (130 * (100 * p_size + 7) + 1 + 390 + 1022), 6) AS behavior_fps, round(1e6 / (1120 * 12.136 + 100 * p_size + 4.5), 6) AS muscle_fps FROM part", views=False)
def max_frame_rate(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") * 100
    return v.table(s, d, "part").select("p_partkey", r6(g.behavior_max_fps(n), "behavior_fps"), r6(g.muscle_max_fps(n, F.lit(1120)), "muscle_fps"))


@query(""", s AS (SELECT recording_id, unnest([{'step': 0, 'frame_idx': on2, 'channel': 2, 'op': 'on'}, {'step': 1, 'frame_idx': on3, 'channel': 3, 'op': 'on'},
  {'step': 2, 'frame_idx': off2, 'channel': 2, 'op': 'off'}, {'step': 3, 'frame_idx': stop, 'channel': -1, 'op': 'stop'}], recursive := true) FROM t_protocols WHERE valid AND NOT none)
SELECT recording_id, valid, coalesce(step, -1) AS step, coalesce(frame_idx, -1) AS frame_idx, coalesce(channel, 0) AS channel, coalesce(op, '') AS op FROM t_protocols LEFT JOIN s USING (recording_id)""")
def parse_protocol(s: SparkSession, d: str) -> DataFrame:
    return pr.parse_protocol(v.protocols(s, d)).select("recording_id", "valid", F.explode_outer("steps").alias("s")).select("recording_id", "valid", *(F.coalesce(f"s.{c}", F.lit(none)).alias(c) for c, none in (("step", -1), ("frame_idx", -1), ("channel", 0), ("op", ""))))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'run_001/' ELSE 'run' || CASE p_partkey % 3 WHEN 1 THEN '' ELSE '_' END
  || lpad(CAST(p_partkey + 1 AS VARCHAR), CAST(greatest(length(CAST(p_partkey AS VARCHAR)) + CASE p_partkey % 3 WHEN 2 THEN 1 ELSE 0 END, length(CAST(p_partkey + 1 AS VARCHAR))) AS INTEGER), '0') || '/' END AS name FROM part""", views=False)
def increment_name(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.lit("run//")).when(k % 3 == 1, F.concat(F.lit("run"), k.cast("string"))).otherwise(F.concat(F.lit("run_0"), k.cast("string"), F.lit("/")))
    return v.table(s, d, "part").select("p_partkey", pr.increment_name(path).alias("name"))


# Live data, as batches


@query("SELECT job_id, max(us) AS last_us, max(us) < epoch_us(TIMESTAMP '1998-01-01') - 120000000 AS stale FROM t_trials GROUP BY job_id")
def heartbeat_timeout(s: SparkSession, d: str) -> DataFrame:
    beats = v.table(s, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("beat"))
    return jobs.stale_jobs(beats, "1998-01-01 00:00:00").select("job_id", v.micros("last_beat").alias("last_us"), "stale")


LIFE = """, ev AS (SELECT user_id % 20 AS job_id, user_id AS trial_id, CASE event_id % 40 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'processing' END AS status, epoch_us(ts) AS pos, event_id FROM events)
"""


@query(LIFE + """, l AS (SELECT job_id, trial_id, coalesce(min_by(status, event_id) FILTER (status != 'processing'), max_by(status, event_id)) AS status FROM ev GROUP BY ALL)
SELECT job_id, trial_id, CASE WHEN job_id % 5 = 0 AND status = 'processing' THEN 'failed' ELSE status END AS status FROM l""")
def trial_lifecycle(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 40
    events = v.table(s, d, "events").select((F.col("user_id") % 20).alias("job_id"), F.col("user_id").alias("trial_id"), F.when(k == 0, "complete").when(k == 1, "failed").otherwise("processing").alias("status"), v.micros("ts").alias("at"), "event_id")
    return jobs.trial_lifecycle(events, events.where("job_id % 5 = 0"))


@query("SELECT recording_id, max(timestamp_us) AS timestamp_us, round(max_by(x_pos_mm, timestamp_us), 6) AS x_pos_mm, round(max_by(y_pos_mm, timestamp_us), 6) AS y_pos_mm FROM t_stage GROUP BY recording_id")
def latest_stage_position(s: SparkSession, d: str) -> DataFrame:
    return stage.latest_position(v.stage(s, d)).select("recording_id", "timestamp_us", r6("x_pos_mm", "x_pos_mm"), r6("y_pos_mm", "y_pos_mm"))


# Whole jobs


@query(SLOTS + ASOF.replace("t_clicks c", "t_frames c") + """SELECT g.recording_id, s.frame_id AS muscle_frame_id, behavior_frame_id,
  round(CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (n.received_time_us - t0) / (t1 - t0) * (x1 - x0) END, 6) AS x_pos_mm,
  round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL OR t1 = t0 THEN y0 ELSE y0 + (n.received_time_us - t0) / (t1 - t0) * (y1 - y0) END, 6) AS y_pos_mm
FROM slots s JOIN groups g USING (recording_id, slot) JOIN n ON n.recording_id = g.recording_id AND n.frame_id = g.behavior_frame_id""")
def sync_muscle_to_behavior(s: SparkSession, d: str) -> DataFrame:
    out = pair_cameras(_some_frames(s, d), v.frames(s, d), v.stage(s, d), v.ratios(s, d))
    return out.select("recording_id", F.col("frame_id").alias("muscle_frame_id"), "behavior_frame_id", r6("x_pos_mm_interp", "x_pos_mm"), r6("y_pos_mm_interp", "y_pos_mm"))
