"""Planted truth and edge cases for the operators that SQL does not settle."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigtables.functions import protocol
from rigtables.operators import calibration as cal
from rigtables.operators import chunks, jobs, pixels, pose, quality, selection, stage, sync
from rigtables.plans import workflows


def frames(spark, times, recording=1):
    return spark.createDataFrame([(recording, k, int(t)) for k, t in enumerate(times)], "recording_id long, frame_id long, acquired_time_us long")


def slots(spark, times):
    return [r.slot for r in sync.detect_dropped_frames(frames(spark, times)).orderBy("frame_id").collect()]


def test_one_lost_exposure_shifts_all_later_slots(spark):
    rng = np.random.default_rng(0)
    t = np.arange(200) * 15151 + rng.integers(-200, 200, 200)
    assert slots(spark, np.delete(t, 70)) == [k for k in range(200) if k != 70]
    assert slots(spark, np.delete(t, [50, 51, 120])) == [k for k in range(200) if k not in (50, 51, 120)]


def test_what_is_no_lost_exposure(spark):
    t = np.arange(100) * 15151
    late = t.copy()
    late[40] += int(0.8 * 15151)  # a jitter that is repaid
    assert slots(spark, late) == list(range(100))
    hiccup = t.copy()
    hiccup[40:] += int(0.6 * 15151)
    assert slots(spark, hiccup) == list(range(100))
    assert slots(spark, [5, 9]) == [0, 1]
    assert slots(spark, [7, 7, 7, 7]) == [0, 1, 2, 3]


def cubic(t, y, at):
    """Not-a-knot spline by solving for all coefficients at once."""
    n = len(t)
    a, b = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1))
    r = 0
    for k in range(n - 1):
        for x, v in ((t[k], y[k]), (t[k + 1], y[k + 1])):
            a[r, 4 * k : 4 * k + 4], b[r] = [1, x, x**2, x**3], v
            r += 1
    for k in range(n - 2):
        x = t[k + 1]
        for row in ([0, 1, 2 * x, 3 * x**2], [0, 0, 2, 6 * x]):
            a[r, 4 * k : 4 * k + 8] = [*row, *(-q for q in row)]
            r += 1
    for k in (0, n - 3):
        a[r, 4 * k + 3], a[r, 4 * k + 7] = 1, -1
        r += 1
    c = np.linalg.solve(a, b).reshape(-1, 4)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    return (c[k] * np.power.outer(at, np.arange(4))).sum(axis=1)


def test_spline_equals_full_solution():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 14):
        t, y = np.sort(rng.uniform(0, 1, n)), rng.normal(size=n)
        at = np.linspace(-0.1, 1.1, 50)
        assert stage.not_a_knot(t, y, at) == pytest.approx(cubic(t, y, at), rel=1e-6, abs=1e-6)
        both = stage.not_a_knot(t, np.column_stack([y, y**2]), at)
        assert np.allclose(both[:, 0], stage.not_a_knot(t, y, at)) and np.allclose(both[:, 1], stage.not_a_knot(t, y**2, at))
    assert stage.not_a_knot(np.array([0, 2]), np.array([1.0, 5.0]), np.array([-1, 3])) == pytest.approx([-1, 7])
    x = np.array([0, 1, 3])
    assert stage.not_a_knot(x, x**2.0, np.array([-2, 5])) == pytest.approx([4, 25])


def test_chunked_spline_equals_whole(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(9000, 17000, 1200))
    log = spark.createDataFrame([(1, int(a), float(np.sin(a / 1e6)), float(np.cos(a / 2e6))) for a in t] + [(2, 5, 1.0, 1.0), (3, 5, 1.0, 1.0), (3, 5, 2.0, 1.0)], "recording_id long, timestamp_us long, x_pos_mm double, y_pos_mm double")
    asked = rng.integers(-20000, t[-1] + 20000, 400)
    df = spark.createDataFrame([(1, k, int(a)) for k, a in enumerate(asked)] + [(2, 0, 6), (3, 0, 6)], "recording_id long, frame_id long, received_time_us long")
    whole, parts = (stage.interp_stage_cubic(df, log, knots=n).orderBy("frame_id").toPandas() for n in (1 << 20, 100))
    assert len(whole) == len(parts) == 400
    assert np.allclose(whole["x_pos_mm_interp"], stage.not_a_knot(t, np.sin(t / 1e6), asked), atol=1e-12)
    assert np.allclose(whole[["x_pos_mm_interp", "y_pos_mm_interp"]], parts[["x_pos_mm_interp", "y_pos_mm_interp"]], atol=1e-9)
    assert {(r.recording_id, r.rule) for r in stage.bad_stage_logs(log).collect()} == {(2, "too few stage samples"), (3, "stage timestamps repeat")}


def test_pose_gaps(spark):
    nan = float("nan")
    rows = [(1, 0, nan), (1, 1, 5.0), (1, 2, nan), (1, 3, 7.0), (2, 0, nan), (2, 1, nan)]
    df = spark.createDataFrame([(r, f, x, 1.0, x, 1.0, x, 1.0) for r, f, x in rows], "recording_id long, behavior_frame_id long, " + ", ".join(f"{k}_{c} double" for k in pose.KEYPOINTS for c in "xy"))
    got = [r.neck_x for r in pose.fill_pose_gaps(df).orderBy("recording_id", "behavior_frame_id").collect()]
    assert got[:4] == [5, 5, 5, 7] and np.isnan(got[4:]).all()


def test_alignment_points_up_from_the_centre(spark):
    df = spark.createDataFrame([(1, 0, 30.0, 20.0, 25.0, 20.0, 10.0, 20.0)], "recording_id long, behavior_frame_id long, neck_x double, neck_y double, thorax_x double, thorax_y double, abdomen_x double, abdomen_y double")
    r = pose.alignment_transform(df, 100).first()
    assert (r.thorax_x_aligned, r.thorax_y_aligned, r.neck_x_aligned, r.neck_y_aligned) == pytest.approx((50, 50, 50, 45))


def test_nearest_takes_the_earlier_of_two_and_clamps(spark):
    muscle = spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "recording_id long, muscle_frame_id long, corresponding_behavior_frame_id long")
    behavior = spark.createDataFrame([(1, k) for k in (0, 10, 15, 16, 20, 99)], "recording_id long, behavior_frame_id long")
    got = {r.behavior_frame_id: r.muscle_frame_id for r in sync.nearest_muscle_frame(behavior, muscle).collect()}
    assert got == {0: 0, 10: 0, 15: 0, 16: 1, 20: 1, 99: 1}


@pytest.mark.parametrize("everywhere", [cal.EVERYWHERE, 0])
def test_ransac_and_homography_find_planted_maps(spark, monkeypatch, everywhere):
    monkeypatch.setattr(cal, "EVERYWHERE", everywhere)
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (400, 4))
    w = np.array([[1, 0.2, 0.5, 0.1, 7], [-0.3, 1, 0.2, 0.6, 9]])
    xy = np.column_stack([p, np.ones(400)]) @ w.T
    xy[::5] += rng.uniform(5, 50, (80, 2))
    df = spark.createDataFrame([(1, k, *map(float, (*p[k], *xy[k]))) for k in range(400)], "calibration_id int, point long, stage_x double, stage_y double, pixel_x double, pixel_y double, physical_x double, physical_y double")
    fit, judged = cal.ransac_linear_fit(df, "point", trials=100)
    r = fit.first()
    assert r.n == 320 and r.weights == pytest.approx(w.ravel().tolist(), abs=1e-6)
    m = cal.fit_metrics(judged).first()
    assert (m.n_inliers, m.n_outliers) == (320, 80) and m.rmse < 1e-6 and m.r2_x == pytest.approx(1)
    h = np.array([[1.2, 0.1, 3], [-0.1, 0.9, 8], [0.0005, 0.0002, 1]])
    q = np.column_stack([p[:, :2], np.ones(400)]) @ h.T
    uv = q[:, :2] / q[:, 2:]
    uv[::4] += 40
    df = spark.createDataFrame([(1, k, *map(float, (*p[k, :2], *uv[k]))) for k in range(400)], "calibration_id int, point long, x_a double, y_a double, x_b double, y_b double")
    r = cal.homography_fit(df, "point", trials=60)[0].first()
    assert r.n_inliers == 300 and r.h == pytest.approx(h.ravel().tolist(), abs=1e-6)


def test_blobs_and_orphans(spark):
    a = np.zeros((24, 24), int)
    a[3:10, 3:10], a[15:20, 15:20], a[0, 23] = 9, 9, 9
    df = spark.createDataFrame([(1, 0, 24, 24, a.ravel().tolist()), (1, 1, 24, 24, [0] * 576)], "recording_id long, frame_id long, height int, width int, px array<int>")
    got = {r.frame_id: (r.area, r.x, r.y) for r in pixels.blob_centroid(df, 5).collect()}
    assert got == {0: (49, 6.0, 6.0), 1: (None, None, None)}
    rng = np.random.default_rng(4)
    dark = [rng.integers(90, 110, (20, 20)) for _ in range(3)]
    y, x = np.mgrid[:20, :20]
    lit = dark[0] + (300 * np.exp(-((y - 10) ** 2 + (x - 10) ** 2) / 20)).astype(int)
    rows = [(1, k, 20, 20, f.ravel().tolist()) for k, f in enumerate([*dark, lit, lit])] + [(2, k, 20, 20, f.ravel().tolist()) for k, f in enumerate(dark)]
    df = spark.createDataFrame(rows, df.schema)
    assert {r.recording_id: r.n_orphans for r in pixels.count_leading_orphans(df).collect()} == {1: 3, 2: 0}


def test_identity_warp_leaves_pixels_alone(spark):
    px = list(range(12))
    for m in ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]):
        df = spark.createDataFrame([(1, 0, 3, 4, px, m)], "recording_id long, frame_id long, height int, width int, px array<int>, m array<double>")
        for smooth in (False, True):
            assert pixels.warp_frame(df, 3, 4, smooth=smooth).first().px == px


def test_empty_tables(spark):
    none = frames(spark, [])
    assert quality.missing_frames(none).count() == 0
    assert sync.detect_dropped_frames(none).count() == 0
    assert jobs.latest_job(spark.createDataFrame([], "job_id long, submission_time long")).count() == 0


def test_postprocess_goes_on_without_bad_recordings(spark):
    rows = [(r, k, 1000 * k if (r, k) != (2, 5) else 0, 1000 * k + 50) for r in (1, 2, 3, 4) for k in range(60)]
    behavior = spark.createDataFrame(rows, "recording_id long, behavior_frame_id long, acquired_time_us long, received_time_us long")
    log = spark.createDataFrame([(r, 13000 * k, float(k), 2.0 * k) for r in (1, 2, 3, 4) for k in range(6)], "recording_id long, timestamp_us long, x_pos_mm double, y_pos_mm double")
    points = spark.createDataFrame([(r, k, 0, p, x, 1.0) for r in (1, 2, 3, 4) for k in range(0, 60, 2) for p, x in (("neck", 3.0), ("thorax", 2.0), ("abdomen", 0.0))], "recording_id long, behavior_frame_id long, instance_id long, keypoint string, x double, y double")
    muscle = spark.createDataFrame([(r, k, 6000 * k, 6000 * k + 9) for r in (1, 2, 3, 4) for k in range(12) if (r, k) != (3, 4)], "recording_id long, raw_frame_id long, acquired_time_us long, received_time_us long")
    params = spark.createDataFrame([(r, 6) for r in (1, 2, 3, 4)], "recording_id long, ratio long")
    out = workflows.postprocess_recordings(behavior, log, points, muscle, params, crop=20)
    assert {r.recording_id: r.rule for r in out.errors.collect()} == {2: "acquisition times do not increase", 3: "muscle frames: hole"}
    assert {r.recording_id: r["count"] for r in out.behavior.groupBy("recording_id").count().collect()} == {1: 60, 3: 60, 4: 60}
    paired = {(r.recording_id, r.slot): r.corresponding_behavior_frame_id for r in out.muscle.collect()}
    assert paired == {(r, k): 6 * k for r in (1, 4) for k in range(10)}
    with pytest.raises(ValueError, match="2: acquisition times do not increase; 3: muscle frames: hole"):
        workflows.postprocess_recordings(behavior, log, points, muscle, params, crop=20, strict=True)
    assert out.alignment.where(F.col("recording_id") == 2).count() == 0


def test_a_hole_among_leading_orphans_ends_a_recording(spark):
    """Recordings 1 to 3 have 3 orphans; 2 lacks the orphan 1, 3 ends before its first frame."""
    behavior = spark.createDataFrame([(r, k, 1000 * k, 1000 * k + 50) for r in (1, 2, 3) for k in range(60)], "recording_id long, behavior_frame_id long, acquired_time_us long, received_time_us long")
    log = spark.createDataFrame([(r, 13000 * k, float(k), 2.0 * k) for r in (1, 2, 3) for k in range(6)], "recording_id long, timestamp_us long, x_pos_mm double, y_pos_mm double")
    muscle = spark.createDataFrame([(r, k, 6000 * k, 6000 * k + 9) for r in (1, 2, 3) for k in range(13) if (r, k) != (2, 1) and (r < 3 or k < 3)], "recording_id long, raw_frame_id long, acquired_time_us long, received_time_us long")
    params, orphans = (spark.createDataFrame([(r, n) for r in (1, 2, 3)], f"recording_id long, {c} long") for c, n in (("ratio", 6), ("n_orphans", 3)))
    out = workflows.postprocess_recordings(behavior, log, muscle=muscle, params=params, orphans=orphans)
    assert {r.recording_id: r.rule for r in out.errors.collect()} == {2: "muscle frames: hole", 3: "muscle frames: too_few"}
    assert {(r.recording_id, r.raw_frame_id): r.slot for r in out.muscle.collect()} == {(1, k + 3): k for k in range(10)}


def test_what_lies_ahead_takes_one_pass(spark):
    """60,000 rows of one chunk, each with the next value of every tenth row: in seconds, not by going over the rest of the chunk for each."""
    df = spark.range(60_000).select(F.lit(1).alias("recording_id"), F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("v"))
    began = time.monotonic()
    for keep in (True, False):
        for strict in (True, False):
            found = chunks.carried(df, "k", 1_000_000, F.col("v"), strict=strict, keep=keep)
            edge = 1 if strict else 0
            want = F.ceil((F.col("k") + edge) / 10) * 10
            assert found.where(~F.col("after").eqNullSafe(F.when(want < 60_000, want))).count() == 0
            assert found.where(~F.col("before").eqNullSafe(F.when(F.col("k") >= edge, F.floor((F.col("k") - edge) / 10) * 10))).count() == 0
    assert time.monotonic() - began < 30


def test_smooth_warp_weighs_by_parts_of_a_pixel(spark):
    schema = "recording_id long, frame_id long, height int, width int, px array<int>, m array<double>"
    moved = lambda dx: [1.0, 0.0, dx, 0.0, 1.0, 0.0]
    rows = [(1, 0, 1, 2, [0, 100], moved(0.5)), (1, 1, 1, 2, [0, 100], moved(-0.75)), (1, 2, 1, 2, [10, 20], [2.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (1, 3, 1, 2, [7, 9], None), (1, 4, 1, 2, [7, 9], [0.0] * 9), (1, 5, 2, 1, [8, 4], moved(0.0))]
    got = {r.frame_id: r.px for r in pixels.warp_frame(spark.createDataFrame(rows, schema), 1, 2, smooth=True).collect()}
    assert got == {0: [0, 50], 1: [75, 25], 2: [10, 15], 3: [0, 0], 4: [0, 0], 5: [8, 0]}


def test_stacked_warps_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    stack = rng.integers(0, 60000, (5, 7, 9)).astype(np.int32)
    m = np.eye(3) + rng.normal(0, 0.05, (5, 3, 3)) * [[1, 1, 9], [1, 1, 9], [0.05, 0.05, 0]]
    got = pixels.resampled(stack, m, 6, 8, True)
    for k in range(5):
        back = np.linalg.inv(m[k])
        for v in range(6):
            for u in range(8):
                x, y, w = back @ [u, v, 1]
                px, py = round(x / w * 32), round(y / w * 32)
                c, r, total = px // 32, py // 32, 0
                for i in (0, 1):
                    for j in (0, 1):
                        if 0 <= r + j < 7 and 0 <= c + i < 9:
                            total += int(stack[k, r + j, c + i]) * abs(32 * (1 - i) - px % 32) * abs(32 * (1 - j) - py % 32)
                assert got[k, v, u] == round(total / 1024)


def test_job_without_alignment_warps_by_the_homography_alone(spark):
    beh = spark.createDataFrame([(1, k, 10 * k + 1, 10 * k + 1) for k in range(8)], "recording_id long, behavior_frame_id long, acquired_time_us long, received_time_us long")
    log = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 100, 1.0, 1.0)], "recording_id long, timestamp_us long, x_pos_mm double, y_pos_mm double")
    muscle = spark.createDataFrame([(1, k, 20 * k + 1, 20 * k + 1) for k in range(4)], "recording_id long, raw_frame_id long, acquired_time_us long, received_time_us long")
    px = spark.createDataFrame([(1, k, 1, 3, [0, 100, 40]) for k in range(4)], "recording_id long, frame_id long, height int, width int, px array<int>")
    ratio = spark.createDataFrame([(1, 2)], "recording_id long, ratio long")
    none = spark.createDataFrame([(1, 0)], "recording_id long, n_orphans long")
    job = lambda **o: workflows.postprocess_recordings(beh, log, None, muscle, ratio, px, none, homography=[1.0, 0, 0.5, 0, 1.0, 0, 0, 0, 1.0], **o)
    assert [r.px for r in job(full_size=(1, 4)).warped.collect()] == [[0, 50, 70, 20]] * 4
    with pytest.raises(ValueError):
        job()


def test_burst_and_change_refuse_other_shapes(spark):
    df = spark.createDataFrame([(1, 0, 1, 2, [1, 2]), (1, 1, 1, 3, [1, 2, 3])], "recording_id long, frame_id long, height int, width int, px array<int>")
    with pytest.raises(Exception, match="several shapes"):
        pixels.burst_median_frame(df, ["recording_id"]).collect()
    with pytest.raises(Exception, match="height x width"):
        pixels.reorient_frame(df.withColumn("width", F.lit(5)), "muscle").collect()


def test_erosion_by_runs_equals_the_kernel(spark):
    rng = np.random.default_rng(7)
    walls = {(a, int(c), int(r)) for a in (0, 1) for c, r in rng.integers(0, 40, (30, 2))} | {(1, c, 20) for c in range(5, 30)}
    cells = [(a, c, r) for a in (0, 1, 2) for c in range(40) for r in range(40)]
    mask = spark.createDataFrame([(*x, x not in walls) for x in cells], "arena long, col long, row long, open boolean")
    for m in (0, 1, 5):
        reach = {r: round((m * m - r * r) ** 0.5) for r in range(-m, m + 1)}
        near = lambda a, c, r: any((a, c + i, r + j) in walls for j, n in reach.items() for i in range(-n, n + 1))  # noqa: B023, E731
        want = {x for x in cells if min(x[1:]) >= m and max(x[1:]) <= 39 - m and not near(*x)}
        assert {tuple(x) for x in protocol.accessible_cells(mask, m).select("arena", "col", "row").collect()} == want


def test_protocol_states_whichever_way_they_meet_the_frames(spark):
    texts = {1: "5/ch2/on;3/ch3/on;9/ch2/off;20/x/stop", 2: None, 3: "bad", 4: "0/ch3/on;0/ch3/off;0/ch2/on;7/x/stop"}
    parsed = protocol.parse_protocol(spark.createDataFrame(list(texts.items()), "recording_id long, protocol string"))
    frames_ = spark.createDataFrame([(r, f) for r in (1, 2, 3, 4, 5) for f in range(25)], "recording_id long, frame_id long")
    on = {1: lambda f: (5 <= f < 9, 5 <= f < 20), 4: lambda f: (f < 7, False)}
    want = {(r, f, *on.get(r, lambda _: (False, False))(f)) for r in (1, 2, 3, 4, 5) for f in range(25)}
    for most in (1_000_000, 0):
        joined = protocol.protocol_state_join(frames_, parsed, most_broadcast=most, salts=3)
        assert {tuple(x) for x in joined.collect()} == want
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "BroadcastHashJoin" in plan or most == 0


def test_binary_search_in_arrays(spark):
    for n in (0, 1, 2, 3, 8, 9):
        rows = spark.createDataFrame([([2 * k for k in range(n)], v) for v in range(-2, 2 * n + 2)], "a array<long>, v long")
        got = rows.select("v", chunks.last_at_or_before(F.col("a"), F.col("v"), n).alias("at")).collect()
        assert all(r.at == max([k for k in range(n) if 2 * k <= r.v], default=-1) for r in got)


def moves(df, column):
    """How often rows that have the column are moved in the plan of df."""
    plan = df._jdf.queryExecution().executedPlan()
    nodes, n = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], 0
    while nodes:
        node = nodes.pop()
        n += node.nodeName() == "Exchange" and column in node.output().toString()
        below = node.children()
        nodes += [below.apply(k) for k in range(below.size())]
    return n


def test_ordered_steps_move_frames_once(spark, monkeypatch):
    """Every plan that is kept or returned on the way moves the frames at most once, and there is one that does."""
    rng = np.random.default_rng(8)
    rows = [(r, k, int(t), f"row {k}") for r in (1, 2) for k, t in enumerate(np.delete(np.arange(300) * 15151 + rng.integers(-200, 200, 300), [70, 200]))]
    df = spark.createDataFrame(rows, "recording_id long, frame_id long, acquired_time_us long, carried_along string")
    plans, original = [], chunks.kept
    note = lambda d: (plans.append(d), original(d))[1]
    monkeypatch.setattr(chunks, "kept", note)
    monkeypatch.setattr(sync, "kept", note)
    monkeypatch.setattr(chunks, "MOST_CHUNKS", 1_000)
    slots_ = sync.detect_dropped_frames(df)
    assert [moves(p, "carried_along") for p in plans if "carried_along" in p.columns] == [1] and moves(slots_, "carried_along") == 0
    plans.clear()
    ratios = spark.createDataFrame([(1, 1), (2, 1)], "recording_id long, ratio long")
    groups = sync.sync_group_frames(df.withColumnRenamed("carried_along", "behavior_row"), ratios).select("recording_id", "slot", "behavior_row")
    assert [moves(p, "behavior_row") for p in plans if "behavior_row" in p.columns] == [1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        paired = sync.muscle_slot_join(slots_, groups)
        assert moves(paired, "carried_along") == moves(paired, "behavior_row") == 1  # the second and last time, by slot
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.slot for r in slots_.where("recording_id = 1").orderBy("frame_id").collect()] == [k for k in range(300) if k not in (70, 200)]


def test_a_registration_moves_its_points_once(spark):
    """What is returned reads the points that were written, and shuffles none of them with its pixel; the planted map is found."""
    key, rng = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", np.random.default_rng(3)
    before = spark.conf.get(key, None)
    place = {(t, i): rng.uniform(0, 50, 2) for t in range(6) for i in range(10)}
    at = {(t, c): (10.0 * t + c, 20.0 * (t % 3) + c * c) for t in range(6) for c in range(4)}
    scan = spark.createDataFrame([(1, t, i, float(x), float(y)) for (t, i), (x, y) in place.items()], "calibration_id long, apriltag_id long, image_id long, stage_x_mm double, stage_y_mm double")
    tags = spark.createDataFrame([(t, c, *p) for (t, c), p in at.items()], "apriltag_id long, corner_id int, physical_x_mm double, physical_y_mm double")
    pixel = [(t, i, c, t, 0, float(999 - 2 * (at[t, c][0] - x)), float(4 * (at[t, c][1] - y)), 1000, 50.0) for (t, i), (x, y) in place.items() for c in range(4)]
    detections = spark.createDataFrame(pixel, "apriltag_id long, image_id long, corner_id int, detected_id long, detection_no int, x_px double, y_px double, image_width int, decision_margin double")
    fit = workflows.fit_arena_registration(scan, detections, tags, trials=50)
    assert moves(fit, "pixel_") == 0 and spark.conf.get(key, None) == before
    (r,) = fit.collect()
    assert np.allclose(r.weights, [1, 0, 0.5, 0, 0, 0, 1, 0, 0.25, 0], atol=1e-6) and r.n_inliers == r.n_total > 100


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("most", [0, 200_000])
def test_drops_whatever_a_chunk_holds_and_however_chunks_are_met(spark, monkeypatch, size, most):
    monkeypatch.setattr(sync, "FRAMES_A_CHUNK", size)
    monkeypatch.setattr(chunks, "MOST_CHUNKS", most)
    monkeypatch.setattr(sync, "MOST_NEAR", most)
    t = np.arange(60) * 15151
    assert slots(spark, np.delete(t, [20, 21, 40])) == [k for k in range(60) if k not in (20, 21, 40)]


def test_selected_quantiles_equal_percentiles(spark):
    rng = np.random.default_rng(9)
    hot = [(1, "a", float(v), float(w)) for v, w in zip(np.round(rng.normal(0, 1e3, 3000), 2), rng.integers(0, 3, 3000), strict=True)]
    rows = hot + [(2, "a", 7.0, None)] * 50 + [(None, "b", float(k), -1e308 * (k % 3 - 1)) for k in range(9)] + [(4, None, None, None), (5, "inf", float("inf"), 1.0), (5, "inf", 3.0, float("nan")), (5, "inf", -float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "k long, s string, v double, w double")
    wanted = {"mid": (F.col("v"), 0.5), "low": (F.col("w"), 0.3), "high": (F.col("v") * 2, 0.95)}
    text = lambda found: sorted([(str(r.k), str(r.s), *(f"{x:.9g}" if x is not None else "-" for x in (r.mid, r.low, r.high))) for r in found.collect()])
    want = text(selection.quantiles(df, ["k", "s"], wanted))
    for bins, last in ((4, 5), (4096, 10_000)):
        assert text(selection.quantiles(df, ["k", "s"], wanted, small=1, bins=bins, last=last)) == want


def test_outliers_of_a_hot_tag(spark):
    """One tag with nearly all points: the same ones stay, whichever way its medians are found."""
    rng = np.random.default_rng(10)
    xy = rng.normal(100, 2, (2000, 2))
    xy[::50] += 60
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [(2, k, float(k), 0.0) for k in range(7)], "tag long, k long, pixel_x_px double, pixel_y_px double")
    kept_ = [{(r.tag, r.k) for r in cal.mad_outlier_filter(df, ["tag"], small=n).where("kept").collect()} for n in (10, 100_000)]
    assert kept_[0] == kept_[1] and not any((1, k) in kept_[0] for k in range(0, 2000, 50))
