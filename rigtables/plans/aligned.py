"""Queries on smooth resampling: frames by projective matrices, and the whole job with poses, alignment and muscle pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.operators import pixels
from rigtables.plans import views as v
from rigtables.plans import workflows
from rigtables.plans.registry import AUTOCORRELATION, SLOTS, query

#: Fixed test homography, muscle to behavior pixels.
H = (1.02, 0.03, 0.4, -0.02, 0.97, -0.3, 0.002, 0.001, 1.0)

#: SQL: frames `z` (recording_id, frame_id, m0 .. m8) of t_pixels resampled into 8 x 8 by their matrices, the four pixels around weighted in 1/32.
RESAMPLED = """
, b AS (SELECT recording_id, frame_id, m4*m8 - m5*m7 AS b0, m2*m7 - m1*m8 AS b1, m1*m5 - m2*m4 AS b2, m5*m6 - m3*m8 AS b3, m0*m8 - m2*m6 AS b4, m2*m3 - m0*m5 AS b5,
  m3*m7 - m4*m6 AS b6, m1*m6 - m0*m7 AS b7, m0*m4 - m1*m3 AS b8 FROM z),
spot AS (SELECT recording_id, frame_id, t.pos, CAST(round_even(32 * (b0 * (t.pos % 8) + b1 * (t.pos // 8) + b2) / (b6 * (t.pos % 8) + b7 * (t.pos // 8) + b8), 0) AS BIGINT) AS x,
  CAST(round_even(32 * (b3 * (t.pos % 8) + b4 * (t.pos // 8) + b5) / (b6 * (t.pos % 8) + b7 * (t.pos // 8) + b8), 0) AS BIGINT) AS y FROM b, (SELECT range AS pos FROM range(64)) t),
tap AS (SELECT recording_id, frame_id, pos, floor(x / 32.0) + i AS c, floor(y / 32.0) + j AS r,
  abs(32 * (1 - i) - (x - 32 * floor(x / 32.0))) * abs(32 * (1 - j) - (y - 32 * floor(y / 32.0))) AS weight FROM spot, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
warped AS (SELECT a.recording_id, a.frame_id, a.pos, CAST(round_even(sum(weight * coalesce(p.v, 0)) / 1024, 0) AS INTEGER) AS v
  FROM tap a LEFT JOIN t_pixels p ON p.recording_id = a.recording_id AND p.frame_id = a.frame_id AND p.pos = r * 8 + c AND c BETWEEN 0 AND 7 AND r BETWEEN 0 AND 7 GROUP BY ALL)
"""


@query(""", z AS (SELECT recording_id, frame_id, 1.1 AS m0, 0.07 AS m1, frame_id % 5 * 0.37 - 0.6 AS m2, -0.05 AS m3, 0.9 AS m4, recording_id * 0.21 AS m5, 0.003 AS m6, frame_id % 3 * 0.002 AS m7, 1.0 AS m8 FROM t_images)"""
  + RESAMPLED + "SELECT recording_id, frame_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS px FROM warped GROUP BY ALL")
def warp_frame_smooth(s: SparkSession, d: str) -> DataFrame:
    """A projective matrix of its own for each frame."""
    k, r = F.col("frame_id"), F.col("recording_id")
    m = (F.lit(1.1), F.lit(0.07), k % 5 * 0.37 - 0.6, F.lit(-0.05), F.lit(0.9), r * 0.21, F.lit(0.003), k % 3 * 0.002, F.lit(1.0))
    warped = pixels.warp_frame(v.images(s, d).withColumn("m", F.array(*m)), 8, 8, smooth=True)
    return warped.select("recording_id", "frame_id", F.concat_ws(",", F.col("px").cast("array<string>")).alias("px"))


@query(AUTOCORRELATION + """, mean AS (SELECT recording_id, frame_id, avg(v) AS m FROM t_pixels WHERE NOT (recording_id = 7 AND frame_id = 15) GROUP BY ALL),
onset AS (SELECT h.recording_id, min(h.frame_id) FILTER (0.5 * (across + down) / power > 0.12 AND b.m > a.m) AS first FROM h JOIN mean a ON a.recording_id = h.recording_id AND a.frame_id = h.frame_id - 1
  JOIN mean b ON b.recording_id = h.recording_id AND b.frame_id = h.frame_id WHERE h.frame_id < 50 GROUP BY ALL),
fine AS (SELECT recording_id, coalesce(o.first, 0) AS first FROM (SELECT DISTINCT recording_id FROM t_images WHERE recording_id NOT IN (7, 8)) LEFT JOIN onset o USING (recording_id)),
mus AS (SELECT recording_id, i.frame_id - first AS frame_id, i.frame_id AS raw, 2000 * (i.frame_id + 1) + CASE WHEN recording_id % 3 = 1 AND i.frame_id >= 35 THEN 2000 ELSE 0 END AS acquired_time_us, 0 AS received_time_us
  FROM t_images i JOIN fine USING (recording_id) WHERE i.frame_id >= first)""" + SLOTS.format(source="mus") + """
, got AS (SELECT s.recording_id, s.frame_id AS muscle_frame_id, s.frame_id + first AS frame_id, 2 * slot AS beh, CASE WHEN slot = 0 THEN 2 WHEN 2 * slot % 7 = 3 THEN 2 * slot - 1 ELSE 2 * slot END AS p
  FROM slots s JOIN fine USING (recording_id) WHERE slot < (SELECT count(*) FROM t_images i WHERE i.recording_id = s.recording_id)),
po AS (SELECT *, 3.5 + p % 4 * 0.1 AS tx, 3.6 AS ty, radians(-90) - atan2(1 + p % 3 * 0.2 - 6.3 - p % 2 * 0.1, 3 + p % 5 * 0.3 - 4.2) AS turn FROM got),
al AS (SELECT *, cos(turn) AS a0, -sin(turn) AS a1, 4 - cos(turn) * tx + sin(turn) * ty AS a2, sin(turn) AS a3, cos(turn) AS a4, 4 - sin(turn) * tx - cos(turn) * ty AS a5 FROM po),
z AS (SELECT recording_id, frame_id, muscle_frame_id, beh, """
  + ", ".join([*(f"a{3 * r} * {H[c]} + a{3 * r + 1} * {H[3 + c]} + a{3 * r + 2} * {H[6 + c]} AS m{3 * r + c}" for r in range(2) for c in range(3)), *(f"{H[6 + c]} AS m{6 + c}" for c in range(3))])
  + " FROM al)" + RESAMPLED + """
SELECT recording_id, NULL AS rule, any_value(muscle_frame_id) AS muscle_frame_id, any_value(beh) AS corresponding_behavior_frame_id, round(any_value(beh) + 1.0, 3) AS x_mm, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS px
FROM warped JOIN z USING (recording_id, frame_id) GROUP BY recording_id, frame_id
UNION ALL SELECT recording_id, CASE recording_id WHEN 7 THEN 'muscle frames: hole' ELSE 'several instances in a frame' END, NULL, NULL, NULL, NULL FROM t_images WHERE recording_id IN (7, 8) GROUP BY recording_id""")
def postprocess_aligned(s: SparkSession, d: str) -> DataFrame:
    """Frames of each label with poses that have gaps, a homography, orphans counted from pixels, a lost exposure, a hole and a second fly."""
    r, k = F.col("recording_id"), F.col("frame_id")
    images = v.images(s, d).where(~((r == 7) & (k == 15)))
    b = v.images(s, d).select(r, F.explode(F.array(2 * k, 2 * k + 1)).alias("behavior_frame_id"))
    at = F.col("behavior_frame_id")
    behavior = b.withColumns({"acquired_time_us": 1000 * (at + 1), "received_time_us": 1000 * (at + 1)})
    log = b.groupBy("recording_id").agg(F.max("behavior_frame_id").alias("last"))
    log = log.select(r, F.explode(F.array(F.lit(0).cast("long"), F.col("last") + 1)).alias("t")).select(r, (1000 * F.col("t")).alias("timestamp_us"), F.col("t").cast("double").alias("x_pos_mm"), F.lit(0.0).alias("y_pos_mm"))
    point = lambda name, x, y: F.struct(F.lit(name).alias("keypoint"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    fly = F.array(point("neck", 3 + at % 5 * 0.3, 1 + at % 3 * 0.2), point("thorax", 3.5 + at % 4 * 0.1, F.lit(3.6)), point("abdomen", F.lit(4.2), 6.3 + at % 2 * 0.1))
    seen = b.select("recording_id", "behavior_frame_id", F.explode(fly).alias("p")).where((F.col("p.keypoint") != "thorax") | ((at % 7 != 3) & (at >= 2)))
    flies = F.when((r == 8) & (at == 4), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    predictions = seen.select("recording_id", "behavior_frame_id", F.explode(flies).alias("instance_id"), "p.*")
    clock = 2000 * (k + 1) + F.when((r % 3 == 1) & (k >= 35), 2000).otherwise(0)
    muscle = images.select("recording_id", k.alias("raw_frame_id"), clock.alias("acquired_time_us"), F.lit(0).cast("long").alias("received_time_us"))
    params = images.select("recording_id", F.lit(2).alias("ratio")).distinct()
    out = workflows.postprocess_recordings(behavior, log, predictions, muscle, params, images, crop=8, homography=list(H))
    ids = out.muscle.select("recording_id", "raw_frame_id", "corresponding_behavior_frame_id", F.round(F.col("x_pos_mm_interp").cast("double"), 3).alias("x_mm"))
    made = out.warped.join(ids, ["recording_id", "raw_frame_id"])
    none = F.lit(None)
    rows = made.select("recording_id", none.cast("string").alias("rule"), "muscle_frame_id", "corresponding_behavior_frame_id", "x_mm", F.concat_ws(",", F.col("px").cast("array<string>")).alias("px"))
    return rows.unionByName(out.errors.select("recording_id", "rule", *(none.cast(t).alias(c) for c, t in (("muscle_frame_id", "long"), ("corresponding_behavior_frame_id", "long"), ("x_mm", "double"), ("px", "string")))))
