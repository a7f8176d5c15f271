"""Rig recordings seen in the tables of a scale-factor folder, for Spark and as DuckDB SQL.

Each view has the same rows in both; WITH holds the SQL, for use before a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONG = "CAST({} AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', CAST({ts} AS timestamp_ntz))")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("recording_id"), micros("ts").alias("us"), "ts", "event_type", "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a frame of its user's recording."""
    order = W.partitionBy("recording_id").orderBy("us", "event_id")
    return _events(spark, sf_dir).select(
        "recording_id", (F.row_number().over(order) - 1).cast("long").alias("frame_id"), F.col("us").alias("acquired_time_us"),
        (F.col("us") + F.floor(F.col("value") * 100)).alias("received_time_us"), "value",
    )


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id")).distinct()
    return users.withColumn("ratio", 2 + F.col("recording_id") % 5)


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are stage samples."""
    e = _events(spark, sf_dir).where("event_type = 'view'")
    return e.select("recording_id", F.col("us").alias("timestamp_us"), F.col("value").alias("x_pos_mm"), (F.col("value") / 2 + F.col("recording_id") % 7).alias("y_pos_mm"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose position is asked for: all events but views."""
    e = _events(spark, sf_dir).where("event_type != 'view'")
    return e.select("recording_id", F.col("event_id").alias("frame_id"), F.col("us").alias("received_time_us"))


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of each frame; gaps in every fifth frame and the first two."""
    gap = (F.col("frame_id") % 5 == 3) | (F.col("frame_id") < 2)
    at = lambda dx, dy: [F.when(gap, F.lit(float("nan"))).otherwise(F.col("value") + dx), F.when(gap, F.lit(float("nan"))).otherwise(F.col("frame_id") % 11 + dy)]
    cells = {}
    for name, dx, dy in (("neck", 3.0, 1.0), ("thorax", 1.0, 0.5), ("abdomen", -2.0, -1.0)):
        x, y = at(dx + 0.0, dy)
        cells |= {f"{name}_x": x, f"{name}_y": y}
    return frames(spark, sf_dir).select("recording_id", F.col("frame_id").alias("behavior_frame_id"), *(c.alias(n) for n, c in cells.items()))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("apriltag_id"), c("l_linenumber").alias("corner_id"), c("l_orderkey").alias("image_id"), (c("l_suppkey") + F.when(c("l_partkey") % 17 == 0, 1).otherwise(0)).alias("detected_id"),
        (c("l_extendedprice") / 1000).alias("pixel_x_px"), c("l_quantity").alias("pixel_y_px"), (c("l_tax") * 1000).alias("decision_margin"),
    )


#: Fixed test map: physical x and y on stage x, stage y, pixel x, pixel y and 1.
MAP = (1.0, 0.25, 0.5, 0.02, 100.0, -0.1, 1.0, 0.03, 0.5, 200.0)


def calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of five calibrations under one map, every fiftieth order's off by 25 mm."""
    c = F.col
    p = table(spark, sf_dir, "lineitem").select(
        (c("l_suppkey") % 5).alias("calibration_id"), c("l_quantity").alias("stage_x"), (c("l_discount") * 100).alias("stage_y"), (c("l_extendedprice") / 1000).alias("pixel_x"), (c("l_tax") * 100).alias("pixel_y"),
        F.when(c("l_orderkey") % 50 == 0, 25.0).otherwise(0.0).alias("_off"), F.struct(*table(spark, sf_dir, "lineitem").columns).alias("_row"),
    )
    at = lambda k: sum((F.lit(MAP[k + i]) * c(n) for i, n in enumerate(("stage_y", "pixel_x", "pixel_y"), 1)), F.lit(MAP[k]) * c("stage_x")) + F.lit(MAP[k + 4])
    return p.withColumns({"physical_x": at(0) + c("_off"), "physical_y": at(5), "point": F.xxhash64("_row")}).drop("_off", "_row")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 8 x 8 pixels."""
    order = W.partitionBy("label").orderBy("vec_id")
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 500).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), px.alias("px"))


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each position, camera, image and corner."""
    c = F.col
    keys = [(c("l_suppkey") % 10).alias("stage_x"), c("l_linenumber").alias("stage_y"), F.when(c("l_orderkey") % 2 == 0, "behavior").otherwise("muscle").alias("camera"), (F.floor(c("l_orderkey") / 2) % 3).alias("image_idx"), (c("l_partkey") % 8).alias("corner_id")]
    found = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min(c("l_tax") * 20).alias("x"), F.min(c("l_discount") * 10).alias("y"))
    return found.withColumn("is_reference", c("image_idx") == 0)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    status = F.when(c("o_orderstatus") == "F", "complete").when(c("o_orderstatus") == "O", "processing").otherwise("failed")
    return table(spark, sf_dir, "orders").select(c("o_custkey").alias("job_id"), c("o_orderkey").alias("trial_id"), status.alias("status"), c("o_orderpriority").alias("error"), micros("o_orderdate").alias("us"))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("text"), F.lit("x"))).otherwise(F.col("text"))
    source = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("checksum"))
    return source, d.where("doc_id % 7 != 0").select(F.col("doc_id").alias("path"), F.sha2(changed, 256).alias("checksum"))


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("recording_id")
    part = lambda c, tail: F.concat(c.cast("string"), F.lit(tail))
    good = F.concat(part(r % 5, "/ch2/on;"), part(3 + r % 7, "/ch3/on;"), part(9 + r % 3, "/ch2/off;"), part(20 + r % 13, "/x/stop"))
    text = F.when(r % 9 == 0, F.lit("5/ch4/on;9/x/stop")).when(r % 10 == 1, F.lit(";")).otherwise(good)
    return ratios(spark, sf_dir).select("recording_id", text.alias("protocol"))


def mask(spark: SparkSession) -> DataFrame:
    """A 48 x 72 mm arena in cells of 1 mm with a wall across; the cells follow from the arena alone."""
    cells = spark.range(48 * 72).select(F.lit(0).cast("long").alias("arena"), (F.col("id") % 48).alias("col"), F.floor(F.col("id") / 48).alias("row"))
    return cells.withColumn("open", ~((F.col("col") == 20) & F.col("row").between(10, 40)))


WITH = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id AS recording_id, epoch_us(ts) AS us, event_type, value FROM events),
t_frames AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY us, event_id) - 1 AS frame_id, us AS acquired_time_us,
  us + CAST(floor(value * 100) AS BIGINT) AS received_time_us, value FROM e),
t_ratios AS (SELECT DISTINCT recording_id, 2 + recording_id % 5 AS ratio FROM e),
t_stage AS (SELECT recording_id, us AS timestamp_us, value AS x_pos_mm, value / 2 + recording_id % 7 AS y_pos_mm FROM e WHERE event_type = 'view'),
t_clicks AS (SELECT recording_id, event_id AS frame_id, us AS received_time_us FROM e WHERE event_type != 'view'),
t_pose AS (SELECT recording_id, frame_id AS behavior_frame_id, frame_id % 5 = 3 OR frame_id < 2 AS gap, value + 3.0 AS neck_x, frame_id % 11 + 1.0 AS neck_y,
  value + 1.0 AS thorax_x, frame_id % 11 + 0.5 AS thorax_y, value - 2.0 AS abdomen_x, frame_id % 11 - 1.0 AS abdomen_y FROM t_frames),
t_scan AS (SELECT l_suppkey AS apriltag_id, l_linenumber AS corner_id, l_orderkey AS image_id, l_suppkey + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS detected_id,
  l_extendedprice / 1000 AS pixel_x_px, l_quantity AS pixel_y_px, l_tax * 1000 AS decision_margin FROM lineitem),
t_calib0 AS (SELECT l_suppkey % 5 AS calibration_id, l_quantity AS stage_x, l_discount * 100 AS stage_y, l_extendedprice / 1000 AS pixel_x, l_tax * 100 AS pixel_y,
  CASE WHEN l_orderkey % 50 = 0 THEN 25.0 ELSE 0.0 END AS off FROM lineitem),
t_calib AS (SELECT *, {MAP[0]} * stage_x + {MAP[1]} * stage_y + {MAP[2]} * pixel_x + {MAP[3]} * pixel_y + {MAP[4]} + off AS physical_x,
  {MAP[5]} * stage_x + {MAP[6]} * stage_y + {MAP[7]} * pixel_x + {MAP[8]} * pixel_y + {MAP[9]} AS physical_y FROM t_calib0),
t_images AS (SELECT CAST(label AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_id,
  [CAST(floor((CAST(v AS DOUBLE) + 1) * 500) AS INTEGER) FOR v IN embedding] AS px FROM embeddings),
t_pixels AS (SELECT recording_id, frame_id, unnest(px) AS v, unnest(range(64)) AS pos FROM t_images),
t_corners AS (SELECT l_suppkey % 10 AS stage_x, l_linenumber AS stage_y, CASE WHEN l_orderkey % 2 = 0 THEN 'behavior' ELSE 'muscle' END AS camera,
  l_orderkey // 2 % 3 AS image_idx, l_partkey % 8 AS corner_id, min(l_tax * 20) AS x, min(l_discount * 10) AS y, l_orderkey // 2 % 3 = 0 AS is_reference FROM lineitem GROUP BY ALL),
t_trials AS (SELECT o_custkey AS job_id, o_orderkey AS trial_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
  o_orderpriority AS error, epoch_us(o_orderdate) AS us FROM orders),
t_protocols AS (SELECT recording_id, recording_id % 9 != 0 AS valid, recording_id % 9 != 0 AND recording_id % 10 = 1 AS none,
  recording_id % 5 AS on2, 3 + recording_id % 7 AS on3, 9 + recording_id % 3 AS off2, 20 + recording_id % 13 AS stop FROM t_ratios)
"""
