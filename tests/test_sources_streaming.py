"""Files to tables and back, and live data worked off by streaming queries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rigtables.operators import sync
from rigtables.sources import outputs, readers
from rigtables.streaming import live


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("rec")
    for r in ("a", "b"):
        for folder in ("behavior_images", "muscle_images", "metadata"):
            (root / r / folder).mkdir(parents=True)
        for k in range(4):
            rows = "\n".join(f"{3 * k + j},{1000 * (3 * k + j)},{1000 * (3 * k + j) + 7}" for j in range(3 if k < 3 else 1))
            (root / r / "behavior_images" / f"behavior_frames_{k:09d}.csv").write_text("frame_id,acquired_time_us,received_time_us\n" + rows + "\n")
            (root / r / "muscle_images" / f"muscle_frame_{k:09d}.csv").write_text(f"frame_id,acquired_time_us,received_time_us\n{k},{k * 6000},{k * 6000 + 5}\n99,1,1\n")
        (root / r / "behavior_images" / "notes.csv").write_text("frame_id,acquired_time_us,received_time_us\n5,5,5\n")
        (root / r / "stage.csv").write_text("timestamp_us,x_pos_mm,y_pos_mm\n1,0.5,1.5\n9,2.5,3.5\n")
    (root / "a/metadata/experiment_parameters.yaml").write_text("# set by hand\nbehavior_fps: 396\nmuscle_sync_ratio: 6\nexperiment_protocol: '300/ch2/on;900/x/stop'\nmuscle_imaging_enabled: true\n")
    (root / "b/metadata/experiment_parameters.yaml").write_text("behavior_fps: 396\nsync_ratio: 5\n")
    return root


def test_read_recordings(spark, recordings):
    behavior = readers.read_behavior_frames(spark, f"{recordings}/*/behavior_images/*.csv").where("recording_id = 'a'")
    assert sorted(r.behavior_frame_id for r in behavior.collect()) == list(range(10))
    muscle = readers.read_muscle_frames(spark, f"{recordings}/*/muscle_images/*.csv")
    assert sorted((r.recording_id, r.raw_frame_id, r.acquired_time_us) for r in muscle.collect()) == [(r, k, 6000 * k) for r in "ab" for k in range(4)]
    assert {(r.recording_id, r.x_pos_mm) for r in readers.read_stage_positions(spark, f"{recordings}/*/stage.csv").collect()} == {(r, x) for r in "ab" for x in (0.5, 2.5)}
    params = {r.recording_id: r for r in readers.read_experiment_params(spark, f"{recordings}/*/metadata/*.yaml").collect()}
    assert (params["a"].muscle_sync_ratio, params["a"].experiment_protocol, params["a"].muscle_imaging_enabled) == (6, "300/ch2/on;900/x/stop", True)
    assert (params["b"].muscle_sync_ratio, params["b"].sync_ratio, params["b"].experiment_protocol) == (None, 5, None)
    found = readers.discover_recordings(spark, str(recordings))
    assert {r.recording for r in found.collect()} == {"a", "b"}


def test_sidecars_are_found_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Odd files give the rows that Spark's own reader gives, and the driver lists none of them."""
    head, root = "frame_id,acquired_time_us,received_time_us", tmp_path / "my recordings"
    odd = {
        "a/muscle_images/m_1.csv": f"{head}\r\n1,10,11\r\n9,9,9\r\n", "a/muscle_images/m_2.csv": f"\n  \n{head}\n\n2,20,21", "a/muscle_images/m_3.csv": head,
        "a/muscle_images/m_4.csv": "", "a/muscle_images/_m_5.csv": f"{head}\n5,5,5\n", "a/muscle_images/.m_6.csv": f"{head}\n6,6,6\n", "a/muscle_images/m_7.txt": f"{head}\n7,7,7\n",
        "a/notes.csv": f"{head}\n0,0,0\n", "b c%é/muscle_images/m_8.csv": f'{head}\n"8",80,x\n', "b c%é/muscle_images/m_9.csv": f"{head}\n9\n", "c/muscle_images/m_10.csv/m_11.csv": f"{head}\r11,110,111\r12,1,1\r",
        "d/other/m_13.csv": f"{head}\n13,1,1\n", "muscle_images": "no folder",
    }
    for path, text in odd.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    for glob in (f"{root}/*/muscle_images/*.csv", f"file://{root}/[a-c]*/muscle_images/m_*.csv", f"{root}/a/muscle_images/m_1.csv", f"{root}/a/muscle_images"):
        made = [f(spark, glob) for f in (readers.read_muscle_frames, readers.read_behavior_frames)]
        assert not any(df.inputFiles() for df in made)
        with monkeypatch.context() as m:
            m.setattr(readers, "read_lines", lambda *_: None)
            want = [f(spark, glob) for f in (readers.read_muscle_frames, readers.read_behavior_frames)]
            assert all(df.inputFiles() for df in want)
        for one, two in zip(made, want, strict=True):
            assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) != []
    assert readers.read_muscle_frames(spark, f"{root}/{{a,d}}/*/m_[12].csv").count() == 2  # a glob for Spark alone
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_muscle_frames(spark, f"{root}/*/none/*.csv").count()


def test_ratio_sources(spark):
    df = spark.createDataFrame([(1, 6, 5, None, None), (2, None, 5, 4, None), (3, None, None, None, 3), (4, None, None, None, None)], "recording_id long, muscle_sync_ratio long, sync_ratio_legacy_key long, muscle_sync_ratio_sibling long, sync_ratio_sibling long")
    got = {r.recording_id: (r.sync_ratio, r.used_legacy, r.ratio_error) for r in sync.resolve_sync_ratio(df).collect()}
    assert got == {1: (6, False, None), 2: (5, True, None), 3: (3, True, None), 4: (None, False, "no sync ratio")}


def test_calibration_and_arena(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("stage_and_pixel_to_physical:\n  x: [1, 0, 0.5, 0, 100]\n  y: [0, 1.5e0, 0, 0.5, -200]\n")
    got = {r.name: list(r.numbers) for r in readers.read_calibration(spark, str(tmp_path / "c.yaml")).collect()}
    assert got == {"x": [1, 0, 0.5, 0, 100], "y": [0, 1.5, 0, 0.5, -200]}
    bad = readers.bad_calibrations(readers.read_calibration(spark, str(tmp_path / "c.yaml")), ("x", "z"))
    assert [list(r.missing) for r in bad.collect()] == [["z"]]
    (tmp_path / "arena.json").write_text(json.dumps({"arena": "small", "arena_dim": [48, 72], "apriltag_positions": {"0": {"topleft": [6.5, 34.5], "bottomright": [9.5, 37.5]}}}))
    assert {(r.apriltag_id, r.corner_id, r.physical_x_mm) for r in readers.read_arena_tags(spark, str(tmp_path / "arena.json")).collect()} == {(0, 3, 6.5), (0, 1, 9.5)}


def png(pixels, width):
    """An 8-bit grey PNG."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(pixels[i : i + width]) for i in range(0, len(pixels), width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_as_pixels(spark, tmp_path):
    px = [10 * k for k in range(12)]
    (tmp_path / "frame_000000007.png").write_bytes(png(px, 4))
    (r,) = readers.read_frame_pixels(spark, f"{tmp_path}/*").collect()
    assert (r.frame_id, r.height, r.width, r.channels, list(r.data)) == (7, 3, 4, 1, px)


def test_files_by_name(spark, tmp_path):
    from rigtables.sources.files import write_text_files

    df = spark.createDataFrame([("a/b/x_1.txt", "one\n"), ("a/y.txt", None), ("ä.txt", "ü")], "path string, text string")
    for _ in range(2):  # a task that runs again does no harm
        assert write_text_files(df, f"file://{tmp_path}/root") == 3
    assert (tmp_path / "root/a/b/x_1.txt").read_text() == "one\n" and (tmp_path / "root/a/y.txt").read_text() == "" and (tmp_path / "root/ä.txt").read_text() == "ü"
    assert write_text_files(df.limit(0), str(tmp_path)) == 0


def test_values_of_flat_yaml_keep_their_ends(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("a: 0\nb: 1\nc: 32\nd: 'x: 3'\n")
    (r,) = readers._flat_yaml(spark, str(tmp_path / "p.yaml")).collect()
    assert r["values"] == {"a": "0", "b": "1", "c": "32", "d": "x: 3"}


def test_scan_images(spark):
    df = spark.createDataFrame([("d/homography_scan_x1_y2.5_frame1.tif",), ("d/homography_scan_x1_y2.5_frame0.tif",), ("d/other.tif",)], "path string")
    (r,) = readers.scan_images(df).collect()
    assert (r.stage_x, r.stage_y, [i.image_idx for i in r.images]) == (1.0, 2.5, [0, 1])


def test_job_documents(spark):
    doc = {"job_id": "j", "submission_time": "2024-01-02T03:04:05Z", "trials": {"t1": {"display_name": "T", "status": "failed", "error": "e"}, "t2": None}}
    rows = readers.parse_job_documents(spark.createDataFrame([(json.dumps(doc),), ("no json",)], "value string")).collect()
    assert [(r.job_id, r.trial_id, r.status, r.submission_time) for r in rows] == [("j", "t1", "failed", dt.datetime(2024, 1, 2, 3, 4, 5))]


def test_outputs_are_published_by_recording(spark, tmp_path):
    df = spark.createDataFrame([("007", 5), ("b", 6)], "recording_id string, v long")
    path, now = str(tmp_path / "out"), lambda: {(r.recording_id, r.v) for r in outputs.read_outputs(spark, path).collect()}
    with pytest.raises(FileNotFoundError):
        outputs.read_outputs(spark, path)
    outputs.write_outputs(df.limit(0), path)
    assert outputs.published(spark, path) is None
    outputs.write_outputs(df, path)
    more = spark.createDataFrame([("b", 7), ("c", 8), ("c", 9)], df.schema)
    with pytest.raises(FileExistsError, match="recordings b are"):
        outputs.write_outputs(more, path)
    assert now() == {("007", 5), ("b", 6)}
    outputs.write_outputs(more, path, existing="keep")
    assert now() == {("007", 5), ("b", 6), ("c", 8), ("c", 9)}
    outputs.write_outputs(more.where("v < 9"), path, existing="overwrite")
    assert now() == {("007", 5), ("b", 7), ("c", 8)}
    assert {r.v for r in outputs.reuse_outputs(spark, path, df.limit(1)).collect()} == {5}
    with pytest.raises(FileNotFoundError, match="recordings d have|recordings d are"):
        outputs.reuse_outputs(spark, path, spark.createDataFrame([("d",), ("b",)], "recording_id string"))
    with pytest.raises(ValueError, match="columns"):
        outputs.write_outputs(df.withColumn("w", F.lit(1)), path, existing="overwrite")


def test_a_lost_run_leaves_nothing_that_is_read(spark, tmp_path):
    df = spark.createDataFrame([(k, k) for k in range(20)], "recording_id long, v long")
    path = str(tmp_path / "out")
    outputs.write_outputs(df.where("recording_id < 3"), path)
    broken = df.repartition(4).withColumn("v", F.when(F.col("recording_id") == 17, F.raise_error(F.lit("lost")).cast("long")).otherwise(-F.col("v")))
    with pytest.raises(Exception, match="lost"):
        outputs.write_outputs(broken, path, existing="overwrite")
    with pytest.raises(Exception, match="without recording_id"):
        outputs.write_outputs(spark.createDataFrame([(None, 1)], df.schema), path)
    # a run whose rows and list of recordings are there, but not its last file
    df.withColumn("v", -F.col("v")).write.parquet(f"{path}/data/run=dead")
    df.groupBy("recording_id").agg(F.count("*").alias("n_rows")).write.parquet(f"{path}/recordings/run=dead")
    assert {(r.recording_id, r.v) for r in outputs.read_outputs(spark, path).collect()} == {(0, 0), (1, 1), (2, 2)}
    outputs.write_outputs(df.where("recording_id = 17"), path)
    assert outputs.read_outputs(spark, path).count() == 4


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def streamed(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_of_sidecars(spark, recordings, tmp_path):
    df = live.stream_frame_metadata(spark, f"{recordings}/*/behavior_images/behavior_frames_*.csv", files=3)
    live.write_stream(df, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("recording_id").count().collect() and spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_stream_states(spark, tmp_path):
    log = spark.createDataFrame([(1, 5, 0.5, 1.0), (1, 9, 2.5, 3.0), (2, 1, 7.0, 8.0)], "recording_id long, timestamp_us long, x_pos_mm double, y_pos_mm double")
    out = run(spark, live.latest_stage_position(streamed(spark, log, str(tmp_path / "log"))), "latest", "complete")
    assert {(r.recording_id, r.x_pos_mm) for r in out.collect()} == {(1, 2.5), (2, 7.0)}
    events = spark.createDataFrame([(1, 1, "processing", 1, 1), (1, 1, "complete", 2, 2), (1, 1, "processing", 3, 3), (1, 2, "input_copied", 1, 4)], "job_id long, trial_id long, status string, at long, event_id long")
    out = run(spark, live.trial_lifecycle_updates(streamed(spark, events, str(tmp_path / "ev"))), "life", "complete")
    assert {(r.trial_id, r.status) for r in out.collect()} == {(1, "complete"), (2, "input_copied")}


def test_saver_grid(spark):
    at = dt.datetime(2024, 1, 1)
    saves = spark.createDataFrame([(1, at + dt.timedelta(seconds=s), u, q) for s, u, q in ((0, 10, 1), (30, 15, 2), (61, 7, 3))], "session long, at timestamp, save_us long, queue_length long")
    got = [(r.n, r.mean_save_us, r.mean_queue_length) for r in live.saver_perf_grid(saves).orderBy("window_start").collect()]
    assert got == [(2, 12, 1.5), (1, 7, 3.0)]


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batches(spark, path, schema, *parts):
    """A stream that takes one part a trigger."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


AT = dt.datetime(2024, 1, 1)
LATER = AT + dt.timedelta(days=30)


def after(seconds):
    return AT + dt.timedelta(seconds=seconds)


def test_groups_leave_when_full_ended_or_quiet(spark, tmp_path, state_store):
    # minutes apart, a group over three batches, a repeated frame, an end with an open group, a frame after its group has left
    first = [(1, 2, after(0), False), (2, 0, after(1), False), (2, 1, after(1), False), (3, 7, after(1), None)]
    second = [(1, 0, after(120), False), (1, 0, after(120), False), (1, 3, after(121), False), (2, None, after(122), True)]
    third = [(1, 1, after(240), False), (1, 4, after(240), False), (1, 5, after(241), False), (1, 6, after(242), False)]
    fourth = [(1, 2, after(250), False), (9, 0, LATER, False)]
    stream = batches(spark, str(tmp_path / "f"), "recording_id long, frame_id long, at timestamp, ended boolean", first, second, third, fourth)
    got = run(spark, live.stream_partial_groups(stream, late="10 minutes", quiet_s=60), "groups").collect()
    assert sorted((r.recording_id, r.group_id, r.frame_ids, r.why) for r in got) == [
        (1, 0, [0, 1, 2], "full"), (1, 0, [2], "quiet"), (1, 1, [3, 4, 5], "full"), (1, 2, [6], "quiet"), (2, 0, [0, 1], "ended"), (3, 2, [7], "quiet"),
    ]
    assert all(r.num_valid == len(r.frame_ids) for r in got)


def test_restarting_windows_of_saves_that_come_late(spark, tmp_path, state_store):
    s = 1_000_000
    base = int(AT.replace(tzinfo=dt.timezone.utc).timestamp()) * s
    saves = [(1, base + t, u, q) for t, u, q in ((0, 10, 0), (s, 20, 1), (2 * s, 31, 2), (50 * s, 5, 1), (62 * s, 8, 2), (63 * s, 9, 9))]
    parts = [saves[k::3][::-1] for k in (2, 0, 1)]
    end = [(7, base + 10_000 * s, 0, 0)]
    stream = batches(spark, str(tmp_path / "s"), "session long, at_us long, save_us long, queue_length long", *parts, end, [(7, base + 400_000 * s, 0, 0)])
    out = run(spark, live.saver_perf_windows(stream, late="5 minutes"), "perf").where("session = 1")
    assert sorted((r.start_us - base, r.end_us - base, r.n, r.mean_save_us, r.mean_queue_length) for r in out.collect()) == [(0, 2 * s, 3, 20, 1.0), (2 * s, 62 * s, 2, 6, 1.5)]


def test_sessions_share_states_and_wait_in_blocks(spark, tmp_path, state_store, monkeypatch):
    """400 sessions, one of them long, one null, in three states: few rows of the state store, and the windows that a plain loop finds."""
    import random

    monkeypatch.setattr(live, "SHELVES", 3)
    monkeypatch.setattr(live, "BLOCK", 64)
    rng, s = random.Random(5), 1_000_000
    base = int(AT.replace(tzinfo=dt.timezone.utc).timestamp()) * s
    saves = [(k or None, base + rng.randrange(300) * s, rng.randrange(90), rng.randrange(9)) for k in range(400) for _ in range(1500 if k == 7 else 5)]
    rng.shuffle(saves)
    want = []
    for k in range(400):
        start, n, took, queue, first = None, 0, 0, 0, True
        for _, at, u, q in sorted(x for x in saves if x[0] == (k or None)):
            start, n, took, queue = at if start is None else start, n + 1, took + u, queue + q
            if at - start >= (2 if first else 60) * s:
                want.append((k or None, start, at, n, took // n, queue / n))
                start, n, took, queue, first = at, 0, 0, 0, False
    far = [[(9999, base + x * s, 0, 0)] for x in (100_000, 1_000_000)]
    stream = batches(spark, str(tmp_path / "s"), "session long, at_us long, save_us long, queue_length long", saves[::2], saves[1::2], *far)
    q = live.saver_perf_windows(stream, late="10 minutes").writeStream.format("memory").queryName("shelves").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("shelves").where("session IS NULL OR session < 9999")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) != []
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 400


def test_jobs_that_are_aborted_or_fall_silent(spark, tmp_path, state_store):
    e = lambda job, kind, t, trial=None, status=None: (job, kind, trial, status, after(t), t)
    first = [e(1, "trial", 0, 10, "processing"), e(1, "trial", 2, 11, "complete"), e(1, "beat", 3), e(2, "trial", 4, 20, "input_copied"), e(2, "trial", 5, 21, "failed"), e(3, "trial", 6, 30, "processing"), e(3, "beat", 6)]
    second = [e(2, "abort", 20), e(2, "trial", 19, 22, "processing"), e(2, "trial", 21, 20, "complete"), e(1, "trial", 22, 11, "failed"), e(3, "beat", 100)]
    third = [e(2, "trial", 40, 23, "processing"), e(3, "trial", 110, 30, "complete"), e(3, "beat", 115)]
    far = [(9, "beat", None, None, LATER, 0)]
    stream = batches(spark, str(tmp_path / "j"), "job_id long, kind string, trial_id long, status string, at timestamp, event_id long", first, second, third, far)
    got = run(spark, live.live_jobs(stream, late="2 minutes"), "jobs").collect()
    assert sorted((r.job_id, r.trial_id, r.status, r.why) for r in got) == [
        (1, 10, "failed", "silent"), (1, 11, "complete", "own"), (2, 20, "failed", "aborted"), (2, 21, "failed", "own"), (2, 22, "failed", "aborted"),
        (2, 23, "failed", "aborted"), (3, 30, "complete", "own"),
    ]


def test_silent_jobs(spark, tmp_path, state_store):
    at = dt.datetime(2024, 1, 1)
    beats = spark.createDataFrame([(1, at), (1, at + dt.timedelta(seconds=30)), (2, at + dt.timedelta(hours=1))], "job_id long, at timestamp")
    out = run(spark, live.heartbeat_timeouts(streamed(spark, beats, str(tmp_path / "b"))), "silent")
    assert [r.job_id for r in out.where(F.col("job_id") == 1).collect()] == [1]
