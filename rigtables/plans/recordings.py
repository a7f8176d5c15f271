"""Queries on recordings as files, on streams and by whole jobs: files are made from the tables, written and read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.durable import fresh_path
from rigtables.plans import views as v
from rigtables.plans import workflows
from rigtables.plans.registry import SLOTS, query, r6
from rigtables.sources import outputs, readers
from rigtables.sources.files import write_text_files
from rigtables.streaming import live

CSV = "frame_id,acquired_time_us,received_time_us\n"


def _id() -> Column:
    return F.col("recording_id").cast("long").alias("recording_id")


def _lines(head: str, *columns: str) -> Column:
    """Text of a CSV file of the rows of a group, in the order of the first column."""
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    return F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: F.concat_ws(",", *(r[c].cast("string") for c in columns))), "\n"), F.lit("\n"))


def _behavior_files(s: SparkSession, d: str) -> str:
    """A hundred frames in each file."""
    root = fresh_path(s, "recordings")
    groups = v.frames(s, d).groupBy("recording_id", F.expr("frame_id div 100").alias("k")).agg(_lines(CSV, "frame_id", "acquired_time_us", "received_time_us").alias("text"))
    write_text_files(groups.select(F.format_string("%d/behavior_images/behavior_frames_%09d.csv", "recording_id", "k").alias("path"), "text"), root)
    return root


@query("SELECT recording_id, frame_id AS behavior_frame_id, acquired_time_us, received_time_us FROM t_frames")
def read_behavior_frames(s: SparkSession, d: str) -> DataFrame:
    read = readers.read_behavior_frames(s, f"{_behavior_files(s, d)}/*/behavior_images/*.csv")
    return read.select(_id(), "behavior_frame_id", "acquired_time_us", "received_time_us")


@query("SELECT recording_id, frame_id AS raw_frame_id, acquired_time_us, received_time_us FROM t_frames JOIN t_ratios USING (recording_id) WHERE frame_id % ratio = 0")
def read_muscle_frames(s: SparkSession, d: str) -> DataFrame:
    """A muscle frame is due at every ratio-th frame; a second row in its file does not count."""
    root = fresh_path(s, "recordings")
    due = v.frames(s, d).join(v.ratios(s, d), "recording_id").where("frame_id % ratio = 0")
    text = F.format_string(CSV.replace("%", "%%") + "%d,%d,%d\n9,9,9\n", "frame_id", "acquired_time_us", "received_time_us")
    write_text_files(due.select(F.format_string("%d/muscle_images/muscle_frame_%09d.csv", "recording_id", "frame_id").alias("path"), text.alias("text")), root)
    read = readers.read_muscle_frames(s, f"{root}/*/muscle_images/*.csv")
    return read.select(_id(), "raw_frame_id", "acquired_time_us", "received_time_us")


@query("SELECT recording_id, timestamp_us, round(x_pos_mm, 6) AS x_pos_mm, round(y_pos_mm, 6) AS y_pos_mm FROM t_stage")
def read_stage_positions(s: SparkSession, d: str) -> DataFrame:
    root = fresh_path(s, "recordings")
    days = v.stage(s, d).groupBy("recording_id", F.expr("timestamp_us div 86400000000").alias("k")).agg(_lines("timestamp_us,x_pos_mm,y_pos_mm\n", "timestamp_us", "x_pos_mm", "y_pos_mm").alias("text"))
    write_text_files(days.select(F.format_string("%d/stage_%d.csv", "recording_id", "k").alias("path"), "text"), root)
    return readers.read_stage_positions(s, f"{root}/*/stage_*.csv").select(_id(), "timestamp_us", r6("x_pos_mm", "x_pos_mm"), r6("y_pos_mm", "y_pos_mm"))


@query("""SELECT recording_id, 396 AS behavior_fps, CASE WHEN recording_id % 2 = 1 THEN ratio END AS muscle_sync_ratio, CASE WHEN recording_id % 2 = 0 THEN ratio END AS sync_ratio,
  recording_id % 3 = 0 AS muscle_imaging_enabled, CASE WHEN recording_id % 4 != 0 THEN '300/ch2/on;' || recording_id || '/x/stop' END AS experiment_protocol FROM t_ratios""")
def read_experiment_params(s: SparkSession, d: str) -> DataFrame:
    root, r = fresh_path(s, "recordings"), F.col("recording_id")
    protocol = F.when(r % 4 != 0, F.format_string("'300/ch2/on;%d/x/stop'", r)).otherwise("")
    key = F.when(r % 2 == 1, "muscle_sync_ratio").otherwise("sync_ratio")
    text = F.format_string("# by hand\nbehavior_fps: 396\n\n%s: %d\nmuscle_imaging_enabled: %s\nexperiment_protocol: %s\n", key, "ratio", (r % 3 == 0).cast("string"), protocol)
    write_text_files(v.ratios(s, d).select(F.format_string("%d/metadata/experiment_parameters.yaml", r).alias("path"), text.alias("text")), root)
    read = readers.read_experiment_params(s, f"{root}/*/metadata/experiment_parameters.yaml")
    return read.select(_id(), "behavior_fps", "muscle_sync_ratio", "sync_ratio", "muscle_imaging_enabled", "experiment_protocol")


@query("""SELECT s_suppkey, unnest(['x', 'y']) AS name, unnest([1.0, -0.5]) AS stage_x, unnest([0.25, s_suppkey * 1.5]) AS pixel_y, unnest([s_suppkey * 1.0, -200.0]) AS bias FROM supplier""", views=False)
def read_calibration(s: SparkSession, d: str) -> DataFrame:
    root = fresh_path(s, "calibrations")
    k = F.col("s_suppkey")
    text = F.format_string("stage_and_pixel_to_physical:\n  x: [1, 0, 2.5e-1, 0.25, %d]\n  y:\n  - [-0.5, 0, 0, %.1f, -200]\n", k, k * 1.5)
    write_text_files(v.table(s, d, "supplier").select(F.format_string("linear_map_%d.yaml", k).alias("path"), text.alias("text")), root)
    n = F.col("numbers")
    return readers.read_calibration(s, f"{root}/*.yaml").select(readers.frame_index(F.col("path")).alias("s_suppkey"), "name", n[0].alias("stage_x"), n[3].alias("pixel_y"), n[4].alias("bias"))


@query("""SELECT 'a' || s_nationkey AS arena, CAST(s_suppkey AS INTEGER) AS apriltag_id, CAST(unnest([0, 2, 3]) AS INTEGER) AS corner_id, unnest([s_suppkey + 0.5, s_suppkey + 3.5, s_suppkey + 0.5]) AS physical_x_mm,
  unnest([7.0, 10.0, 10.0]) AS physical_y_mm FROM supplier""", views=False)
def read_arena_tags(s: SparkSession, d: str) -> DataFrame:
    root = fresh_path(s, "arenas")
    at = lambda dx, y: F.array(F.col("s_suppkey") + dx, F.lit(y))
    corners = F.create_map(F.lit("bottomleft"), at(0.5, 7.0), F.lit("topright"), at(3.5, 10.0), F.lit("topleft"), at(0.5, 10.0))
    tags = F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), corners)))  # of one arena
    arenas = v.table(s, d, "supplier").groupBy(F.concat(F.lit("a"), F.col("s_nationkey").cast("string")).alias("arena")).agg(tags.alias("apriltag_positions"))
    arenas.withColumn("arena_dim", F.array(F.lit(48.0), F.lit(72.0))).write.json(root)
    return readers.read_arena_tags(s, root)


@query("SELECT recording_id, frame_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS px FROM t_pixels GROUP BY ALL")
def read_frame_pixels(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "pixels")
    v.images(s, d).write.partitionBy("recording_id").parquet(path)
    return readers.read_frame_pixels(s, path).select(_id(), "frame_id", F.concat_ws(",", F.col("px").cast("array<string>")).alias("px"))


@query("SELECT 'n' || s_nationkey || CASE s_suppkey % 4 WHEN 0 THEN '/x/y' ELSE '' END || '/r' || s_suppkey AS recording FROM supplier WHERE s_suppkey % 4 NOT IN (2, 3) UNION ALL SELECT 'n' || s_nationkey || '/a/b/c/d/r' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 3", views=False)
def discover_recordings(s: SparkSession, d: str) -> DataFrame:
    """Of four suppliers one has images four folders down, one images and parameters, one images alone that lie too deep, one parameters there."""
    root, k = fresh_path(s, "tree"), F.col("s_suppkey") % 4
    nation, name = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    base = F.concat(F.lit("n"), nation, F.when(k == 0, "/x/y").when(k == 1, "").otherwise("/a/b/c/d"), F.lit("/r"), name)
    image, marked = F.concat(base, F.lit("/behavior_images/f_1.csv")), F.concat(base, F.lit("/metadata/experiment_parameters.yaml"))
    files = F.when(k == 0, F.array(image)).when(k == 1, F.array(image, marked, F.concat(base, F.lit("/notes.txt")))).when(k == 2, F.array(image)).otherwise(F.array(marked))
    write_text_files(v.table(s, d, "supplier").select(F.explode(files).alias("path"), F.lit("x").alias("text")), root)
    return readers.discover_recordings(s, root)


@query("""SELECT recording_id, frame_id, CASE WHEN recording_id % 3 = 0 THEN -acquired_time_us ELSE acquired_time_us END AS v, true AS refused, recording_id % 5 = 1 AS reused FROM t_frames""")
def write_outputs(s: SparkSession, d: str) -> DataFrame:
    """Recordings are added to a folder, refused if they are there, replaced if that is asked, kept if that is, and taken up again."""
    path, r = fresh_path(s, "outputs"), F.col("recording_id")
    rows = v.frames(s, d).select("recording_id", "frame_id", F.col("acquired_time_us").alias("v"))
    outputs.write_outputs(rows.where(r % 2 == 0), path)
    outputs.write_outputs(rows.where(r % 4 == 1), path)
    try:
        outputs.write_outputs(rows.where(r % 4 < 3).withColumn("v", F.lit(0).cast("long")), path)
        refused = False
    except FileExistsError:
        refused = True
    outputs.write_outputs(rows.where((r % 4 == 3) | (r % 2 == 0)), path, existing="keep")
    outputs.write_outputs(rows.where(r % 3 == 0).withColumn("v", -F.col("v")), path, existing="overwrite")
    again = outputs.reuse_outputs(s, path, rows.where(r % 5 == 1).select("recording_id"))
    rest = outputs.read_outputs(s, path).where(r % 5 != 1)
    both = again.withColumn("reused", F.lit(True)).unionByName(rest.withColumn("reused", F.lit(False)))
    return both.select("recording_id", "frame_id", "v", F.lit(refused).alias("refused"), "reused")


@query("SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(trial_id AS VARCHAR) AS trial_id, 'T' || trial_id AS display_name, status, CASE WHEN status = 'failed' THEN error END AS error FROM t_trials")
def read_job_documents(s: SparkSession, d: str) -> DataFrame:
    """One JSON document for each job, with a trial that is no object in every one."""
    root = fresh_path(s, "jobs")
    t = F.col("trial_id").cast("string")
    trial = F.to_json(F.struct(F.concat(F.lit("T"), t).alias("display_name"), "status", F.when(F.col("status") == "failed", F.col("error")).alias("error")))
    trials = F.array_join(F.collect_list(F.format_string('"%s": %s', t, trial)), ", ")  # of one job
    docs = v.trials(s, d).groupBy("job_id").agg(trials.alias("t")).select(F.format_string("job_%d.json", "job_id").alias("path"), F.format_string('{"job_id": "%d", "trials": {"none": null, %s}}', "job_id", "t").alias("text"))
    write_text_files(docs, root)
    return readers.read_job_documents(s, f"{root}/*.json").select("job_id", "trial_id", "display_name", "status", "error")


# Streams

DAY_US = 86_400_000_000


def _streamed(s: SparkSession, batches: list[DataFrame], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream with state makes of the batches, one trigger each, in their order."""
    source, out = fresh_path(s, "batches"), fresh_path(s, "streamed")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)  # a trigger takes one file
    key, before = "spark.sql.streaming.stateStore.providerClass", s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        made = job(s.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source))
        live.write_stream(made, out, fresh_path(s, "stream"), once=True).awaitTermination()
    finally:
        s.conf.set(key, before)
    return s.read.schema(made.schema).parquet(out)


@query("SELECT recording_id, frame_id, acquired_time_us, received_time_us FROM t_frames")
def stream_frame_metadata(s: SparkSession, d: str) -> DataFrame:
    """The files are worked off by a stream into Parquet."""
    frames = live.stream_frame_metadata(s, f"{_behavior_files(s, d)}/*/behavior_images/*.csv")
    out = fresh_path(s, "streamed")
    live.write_stream(frames, out, fresh_path(s, "stream"), once=True).awaitTermination()
    return s.read.schema(frames.schema).parquet(out).select(_id(), "frame_id", "acquired_time_us", "received_time_us")


@query(""", sv AS (SELECT recording_id AS session, us, CAST(floor(value * 100) AS BIGINT) AS save_us, event_id % 20 AS queue, row_number() OVER (PARTITION BY recording_id ORDER BY us, floor(value * 100), event_id % 20) AS i FROM e),
r AS (SELECT session, us AS start_us, CAST(0 AS BIGINT) AS after_i, CAST(2000000 AS BIGINT) AS len, 0 AS step FROM sv WHERE i = 1
  UNION ALL SELECT c.session, c.us, c.i, 60000000, c.step + 1 FROM (
    SELECT r.session, sv.us, sv.i, r.step, row_number() OVER (PARTITION BY r.session, r.step ORDER BY sv.i) AS k
    FROM r JOIN sv ON sv.session = r.session AND sv.i > r.after_i AND sv.us - r.start_us >= r.len) c WHERE c.k = 1),
z AS (SELECT session, start_us, after_i, lead(start_us) OVER o AS end_us, lead(after_i) OVER o AS last_i FROM r WINDOW o AS (PARTITION BY session ORDER BY step))
SELECT z.session, start_us, end_us, count(*) AS n, CAST(sum(save_us) // count(*) AS BIGINT) AS mean_save_us, round(avg(queue), 6) AS mean_queue_length
FROM z JOIN sv ON sv.session = z.session AND sv.i > after_i AND sv.i <= last_i WHERE end_us IS NOT NULL GROUP BY ALL""")
def saver_perf_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows that restart at the save which closes them, by a stream with state; saves come in three interleaved batches."""
    saves = v._events(s, d).select(F.col("recording_id").alias("session"), F.col("us").alias("at_us"), F.floor(F.col("value") * 100).alias("save_us"), (F.col("event_id") % 20).alias("queue_length"))
    end = saves.agg(F.max("at_us").alias("t")).select(F.lit(-1).cast("long").alias("session"), (F.col("t") + 5000 * DAY_US).alias("at_us"), F.lit(0).cast("long").alias("save_us"), F.lit(0).cast("long").alias("queue_length"))
    k = F.pmod(F.xxhash64("at_us"), F.lit(3))
    windows = _streamed(s, [*(saves.where(k == i) for i in range(3)), end], lambda stream: live.saver_perf_windows(stream, late="4000 days"))
    return windows.select("session", "start_us", "end_us", "n", "mean_save_us", r6("mean_queue_length", "mean_queue_length"))


@query("SELECT recording_id, frame_id // 3 AS group_id, count(*) AS num_valid, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frame_ids, CASE WHEN count(*) = 3 THEN 'full' WHEN recording_id % 2 = 0 THEN 'ended' ELSE 'quiet' END AS why FROM t_frames GROUP BY recording_id, frame_id // 3")
def stream_partial_groups(s: SparkSession, d: str) -> DataFrame:
    """Frames of a group come in three batches, last first; then half of the recordings end, and the others are quiet."""
    r = F.col("recording_id")
    frames = v.frames(s, d).select("recording_id", "frame_id", F.timestamp_micros("acquired_time_us").alias("at"), F.lit(False).alias("ended"))
    last = frames.groupBy("recording_id").agg(F.max("at").alias("at"))
    none = F.lit(None).cast("long").alias("frame_id")
    ends = last.where(r % 2 == 0).select("recording_id", none, "at", F.lit(True).alias("ended"))
    later = last.agg(F.max("at").alias("t")).select(F.lit(-1).cast("long").alias("recording_id"), none, F.expr("t + INTERVAL 5000 DAYS").alias("at"), F.lit(False).alias("ended"))
    groups = _streamed(s, [*(frames.where(F.col("frame_id") % 3 == 2 - i) for i in range(3)), ends, later], lambda stream: live.stream_partial_groups(stream, late="4000 days"))
    return groups.select("recording_id", "group_id", "num_valid", F.concat_ws(",", F.col("frame_ids").cast("array<string>")).alias("frame_ids"), "why")


@query(""", ev AS (SELECT user_id % 20 AS job_id, user_id AS trial_id, CASE event_id % 40 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'processing' END AS status, event_id FROM events),
cut AS (SELECT max(event_id) // 2 AS half FROM events),
seen AS (SELECT ev.*, job_id % 5 = 0 AND event_id > half AS after FROM ev, cut WHERE job_id % 5 != 1 OR event_id <= half),
t AS (SELECT job_id, trial_id, min(event_id) AS first, min_by(status, event_id) AS first_status, min(event_id) FILTER (status != 'processing' AND NOT after) AS own, min_by(status, event_id) FILTER (status != 'processing' AND NOT after) AS own_status, bool_and(after) AS late FROM seen GROUP BY ALL)
SELECT job_id, trial_id, CASE WHEN own IS NOT NULL THEN own_status WHEN late THEN CASE WHEN first_status = 'processing' THEN 'failed' ELSE first_status END ELSE 'failed' END AS status,
  CASE WHEN own IS NOT NULL OR (late AND first_status != 'processing') THEN 'own' WHEN job_id % 5 = 0 THEN 'aborted' ELSE 'silent' END AS why
FROM t WHERE own IS NOT NULL OR job_id % 5 < 2""")
def live_jobs(s: SparkSession, d: str) -> DataFrame:
    """One stream of trials, beats and an abort in its middle: every fifth job is aborted there, every fifth beats once and falls silent."""
    k, j = F.col("event_id") % 40, F.col("job_id")
    status = F.when(k == 0, "complete").when(k == 1, "failed").otherwise("processing")
    trials = v._events(s, d).select((F.col("recording_id") % 20).alias("job_id"), F.lit("trial").alias("kind"), F.col("recording_id").alias("trial_id"), status.alias("status"), F.timestamp_micros("us").alias("at"), "event_id")
    half = (trials.agg(F.max("event_id")).first()[0] or 0) // 2
    early, late = trials.where(F.col("event_id") <= half), trials.where(F.col("event_id") > half)
    named = lambda kind, jobs: early.groupBy("job_id").agg(F.max("at").alias("at"), F.max("event_id").alias("event_id")).where(jobs).select(j, F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("trial_id"), F.lit(None).cast("string").alias("status"), "at", "event_id")
    batches = [early.unionByName(named("beat", j % 5 == 1)), named("abort", j % 5 == 0), late.where(j % 5 != 1)]
    return _streamed(s, batches, lambda stream: live.live_jobs(stream, idle_s=40_000 * 86_400))


# Whole jobs


@query(""", beh AS (SELECT recording_id, frame_id, CASE WHEN recording_id % 10 = 1 AND frame_id = 5 THEN 0 ELSE acquired_time_us END AS t FROM t_frames),
unsteady AS (SELECT DISTINCT recording_id, 'acquisition times do not increase' AS rule FROM (SELECT *, lag(t) OVER (PARTITION BY recording_id ORDER BY frame_id) AS b FROM beh) WHERE t <= b),
knots AS (SELECT recording_id, count(DISTINCT timestamp_us) AS k, count(*) AS n FROM t_stage GROUP BY ALL),
logs AS (SELECT recording_id, CASE WHEN n > k THEN 'stage timestamps repeat' ELSE 'too few stage samples' END AS rule FROM knots WHERE n > k OR k < 2),
nolog AS (SELECT recording_id, 'no stage samples' AS rule FROM t_ratios ANTI JOIN t_stage USING (recording_id)),
noratio AS (SELECT recording_id, 'no sync ratio' AS rule FROM t_ratios WHERE recording_id % 12 = 5),
early AS (FROM unsteady UNION ALL FROM logs UNION ALL FROM nolog UNION ALL FROM noratio),
fine AS (SELECT recording_id, ratio, recording_id % 3 AS first FROM t_ratios ANTI JOIN early USING (recording_id)),
due AS (SELECT recording_id, first, frame_id // ratio AS g, acquired_time_us, received_time_us FROM t_frames JOIN fine USING (recording_id) WHERE frame_id % ratio = 0),
total AS (SELECT recording_id, first, count(*) AS n_groups FROM due GROUP BY ALL),
raw AS (SELECT recording_id, n_groups, first, g + first AS id, g, acquired_time_us, received_time_us FROM due JOIN total USING (recording_id, first)
  WHERE NOT (recording_id % 7 = 3 AND g = 4) AND NOT (recording_id % 11 = 4 AND g >= n_groups // 2)),
verdict AS (SELECT recording_id, n_groups, total.first, count(g) AS kept, coalesce(max(id), max(CASE WHEN total.first > 0 THEN total.first - 1 END)) AS last FROM total LEFT JOIN (SELECT recording_id, g, id FROM raw) USING (recording_id) GROUP BY ALL),
late AS (SELECT recording_id, CASE WHEN least(last, first + n_groups - 1) - first + 1 > kept THEN 'muscle frames: hole' WHEN n_groups - kept - first > 3 THEN 'muscle frames: too_few' END AS rule FROM verdict),
mus AS (SELECT recording_id, g AS frame_id, acquired_time_us, received_time_us FROM raw SEMI JOIN (SELECT recording_id FROM late WHERE rule IS NULL) USING (recording_id))""" + SLOTS.format(source="mus") + """
SELECT s.recording_id, NULL AS rule, frame_id AS muscle_frame_id, slot, behavior_frame_id AS corresponding_behavior_frame_id FROM slots s JOIN groups USING (recording_id, slot)
UNION ALL SELECT recording_id, rule, NULL, NULL, NULL FROM early UNION ALL SELECT recording_id, rule, NULL, NULL, NULL FROM late WHERE rule IS NOT NULL""")
def postprocess_recordings(s: SparkSession, d: str) -> DataFrame:
    """Recordings with planted faults: clocks that go back, logs too short, no ratio, holes, muscle cameras that stop early; leading orphans."""
    r, frames = F.col("recording_id"), v.frames(s, d)
    behavior = frames.select("recording_id", F.col("frame_id").alias("behavior_frame_id"), F.when((r % 10 == 1) & (F.col("frame_id") == 5), 0).otherwise(F.col("acquired_time_us")).alias("acquired_time_us"), "received_time_us")
    due = frames.join(v.ratios(s, d), "recording_id").where("frame_id % ratio = 0").withColumn("g", F.expr("frame_id div ratio"))
    n = due.groupBy("recording_id").agg(F.count("*").alias("n"))
    lit = due.join(n, "recording_id").where(~((r % 7 == 3) & (F.col("g") == 4)) & ~((r % 11 == 4) & (F.col("g") >= F.floor(F.col("n") / 2))))
    orphan = v.ratios(s, d).where(r % 3 > 0).select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), r % 3 - 1)).alias("raw_frame_id"))
    muscle = lit.select("recording_id", (F.col("g") + r % 3).alias("raw_frame_id"), "acquired_time_us", "received_time_us").unionByName(orphan.withColumns({"acquired_time_us": F.col("raw_frame_id"), "received_time_us": F.col("raw_frame_id")}))
    ratios = v.ratios(s, d)
    out = workflows.postprocess_recordings(behavior, v.stage(s, d), muscle=muscle, params=ratios.where(r % 12 != 5), orphans=ratios.select("recording_id", (r % 3).alias("n_orphans")), align_fly=False)
    none = F.lit(None).cast("long")
    paired = out.muscle.select("recording_id", F.lit(None).cast("string").alias("rule"), "muscle_frame_id", "slot", "corresponding_behavior_frame_id")
    return paired.unionByName(out.errors.select("recording_id", "rule", none.alias("muscle_frame_id"), none.alias("slot"), none.alias("corresponding_behavior_frame_id")))


@query("SELECT DISTINCT l_suppkey % 5 AS calibration_id, " + ", ".join(f"round(CAST({w} AS DOUBLE), 3) AS w{k}" for k, w in enumerate(v.MAP)) + ", 0.0 AS rmse, 1.0 AS r2_x, 1.0 AS r2_y FROM lineitem", views=False)
def fit_arena_registration(s: SparkSession, d: str) -> DataFrame:
    """Tags at fixed places seen through the fixed test map; unsure detections, wrong tags, and every fiftieth image off."""
    c, m = F.col, v.MAP
    seen = v.scan(s, d).withColumns({"stage_x_mm": c("image_id") % 97 * 0.5, "stage_y_mm": c("image_id") % 89 * 0.25})
    x, y = (c("apriltag_id") % 10 * 10 + c("corner_id")).cast("double"), (c("apriltag_id") % 7 * 20 + c("corner_id") * c("corner_id")).cast("double")
    a, b = (p - m[k] * c("stage_x_mm") - m[k + 1] * c("stage_y_mm") - m[k + 4] for p, k in ((x, 0), (y, 5)))
    det = m[2] * m[8] - m[3] * m[7]
    column, row = (m[8] * a - m[3] * b) / det + F.when(c("image_id") % 50 == 0, 400.0).otherwise(0.0), (m[2] * b - m[7] * a) / det
    detections = seen.select("apriltag_id", "image_id", "corner_id", "detected_id", F.lit(0).alias("detection_no"), (F.lit(1983) - column).alias("x_px"), row.alias("y_px"), F.lit(1984).alias("image_width"), "decision_margin")
    scan = seen.select((c("apriltag_id") % 5).alias("calibration_id"), "apriltag_id", "image_id", "stage_x_mm", "stage_y_mm").distinct()
    tags = seen.select("apriltag_id", "corner_id", x.alias("physical_x_mm"), y.alias("physical_y_mm")).distinct()
    fit = workflows.fit_arena_registration(scan, detections, tags)
    return fit.select("calibration_id", *(r6(c("weights")[k], f"w{k}", 3) for k in range(10)), *(r6(n, n, 3) for n in ("rmse", "r2_x", "r2_y")))


#: Fixed test homography, muscle to behavior pixels.
H = (1.1, 0.02, 5.0, -0.03, 0.95, -2.0, 0.0004, 0.0002, 1.0)


@query("SELECT " + ", ".join(f"CAST({h} AS DOUBLE) AS h{k}" for k, h in enumerate(H)) + ", 0.0 AS mean_px, 0.0 AS max_px", views=False)
def fit_homography(s: SparkSession, d: str) -> DataFrame:
    """Corners of a board at fixed places in muscle images, seen through the fixed homography in behavior images; some are off."""
    c = F.col
    keys = [(c("l_suppkey") % 4).alias("stage_x"), c("l_linenumber").alias("stage_y"), F.when(F.floor(c("l_orderkey") / 3) % 2 == 0, "behavior").otherwise("muscle").alias("camera"), (c("l_orderkey") % 3).alias("image_idx"), (c("l_partkey") % 12).alias("corner_id")]
    seen = v.table(s, d, "lineitem").select(*keys).distinct()
    x = (c("corner_id") % 4 * 37 + c("stage_x") * 5 + c("stage_y")).cast("double")
    y = (F.floor(c("corner_id") / 4) * 41 + c("stage_y") * 3 - c("stage_x")).cast("double")
    w = H[6] * x + H[7] * y + H[8]
    off = F.when((c("corner_id") == 11) & (c("stage_x") == 0), 50.0).otherwise(0.0)
    behavior = c("camera") == "behavior"
    at = {"x": F.when(behavior, (H[0] * x + H[1] * y + H[2]) / w + off).otherwise(x), "y": F.when(behavior, (H[3] * x + H[4] * y + H[5]) / w).otherwise(y), "is_reference": c("image_idx") == 0}
    fit = workflows.fit_homography(seen.withColumns(at))
    return fit.select(*(r6(c("h")[k], f"h{k}", 4) for k in range(9)), r6("mean_px", "mean_px", 3), r6("max_px", "max_px", 3))
