"""Hand-computed facts: coordinates, timing, regions, protocols, names, pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigtables.functions import geometry as g
from rigtables.functions import protocol as pr
from rigtables.operators import pixels, sync
from rigtables.sources.readers import frame_index, scan_position


def value(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
    return tuple(row)


def lit(*numbers):
    return F.array(*map(F.lit, numbers))


def test_linear_map_there_and_back(spark):
    m = lit(1.0, 0.0, 0.5, 0.0, 100.0, 0.0, 1.0, 0.0, 0.5, 200.0)
    assert value(spark, *g.apply_map(m, F.lit(5.0), F.lit(7.0), F.lit(60.0), F.lit(40.0))) == (135, 227)
    assert value(spark, *g.physical_to_stage(m, F.lit(135.0), F.lit(227.0), F.lit(60.0), F.lit(40.0))) == pytest.approx((5, 7), abs=1e-9)
    inverse = value(spark, g.invert_pixel_block(m))[0]
    assert inverse == pytest.approx([-2, 0, 2, 0, -200, 0, -2, 0, 2, -400])
    for physical_y, row in ((227.2, 40), (227.3, 41)):
        x, y = g.apply_map(lit(*inverse), F.lit(5.0), F.lit(7.0), F.lit(135.0), F.lit(physical_y))
        assert value(spark, g.whole_pixel(F.round(x, 9)), g.whole_pixel(F.round(y, 9))) == (60, row)


def test_singular_map_has_no_inverse(spark):
    m = lit(1.0, 2.0, 1.0, 2.0, 0.0, 1.0, 2.0, 1.0, 2.0, 0.0)
    assert value(spark, *g.physical_to_stage(m, *(F.lit(1.0),) * 4), g.invert_pixel_block(m)) == (None, None, None)


def test_generic_map(spark):
    m = lit(1.0, 2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 30.0, 40.0, 50.0)
    assert value(spark, *g.apply_map(m, *(F.lit(1.0),) * 4)) == (15, 150)
    assert value(spark, *g.apply_map(m, F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == (7, 70)


def test_homography_inverse(spark):
    h = lit(1.1, 0.02, 5.0, -0.03, 0.95, -2.0, 0.0004, 0.0002, 1.0)
    u, v = g.apply_homography(h, F.lit(30.0), F.lit(40.0))
    assert value(spark, *g.apply_homography(g.invert_3x3(h), u, v)) == pytest.approx((30, 40))
    assert value(spark, g.invert_3x3(lit(*[1.0] * 9))) == (None,)


@pytest.mark.parametrize("x, margin, want", [(100, 10, 20), (140, 10, 250), (180, 10, 250), (120, 10, 135), (120, 100, 250)])
def test_tracking_acceleration(spark, x, margin, want):
    assert value(spark, g.tracking_acceleration(F.lit(float(x)), F.lit(50.0), 200, 100, 20, 250, margin)) == (want,)


@pytest.mark.parametrize("ratio, light, want", [(2, 5000, (19000, 15000, 10000, True)), (1, 5000, (9000, 5000, 0, True)), (1, 5001, (9000, 5000, -1, False))])
def test_muscle_timing(spark, ratio, light, want):
    t = g.muscle_timing(F.lit(100.0), F.lit(ratio), F.lit(light), F.lit(200), F.lit(20.0), F.lit(1000))
    assert value(spark, t["nominal_exposure_us"], t["common_us"], t["buffer_us"], t["valid"]) == want


def test_region_of_interest(spark):
    r = g.roi_geometry(*(F.lit(k) for k in (11, 110, 21, 220, 640, 480)))
    assert value(spark, *r.values()) == (10, 20, 100, 200, 60, 120, True)
    c = g.roi_geometry(*(F.lit(k) for k in (10, 20, 100, 200, 640, 480)))
    assert value(spark, c["centre_x"], c["centre_y"]) == (15, 150)


def test_frame_rates(spark):
    assert value(spark, g.behavior_max_fps(F.lit(1500)))[0] == pytest.approx(437.86, abs=0.01)
    assert value(spark, g.muscle_max_fps(F.lit(1000), F.lit(1120)))[0] == pytest.approx(68.5, abs=0.05)


PROTOCOLS = {
    "300/ch2/on;600/ch2/off;900/x/stop": 3, "900/x/stop": 1, "900/x/stop;": 1, "": 0, ";": 0, None: 0, "5/ch3/on/extra;9/x/stop": 2,
    "300/ch2/on": None, "9/x/stop;300/ch2/on": None, "1/x/stop;2/x/stop": None, "1/ch1/on;2/x/stop": None, "1/ch2/stop;2/x/stop": None, "-1/ch2/on;2/x/stop": None, "a/ch2/on;2/x/stop": None, "1/ch2/on;;2/x/stop": None, "99999999999999999999/x/stop": None,
}


def test_protocols(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(PROTOCOLS)], "recording_id long, protocol string")
    got = {r.recording_id: (r.valid, None if r.steps is None else len(r.steps)) for r in pr.parse_protocol(df).collect()}
    assert got == {k: (n is not None, n) for k, n in enumerate(PROTOCOLS.values())}


def test_protocol_steps_wait_for_those_before(spark):
    df = spark.createDataFrame([(1, "10/ch2/on;5/ch3/on;20/ch2/off;30/x/stop")], "recording_id long, protocol string")
    frames = spark.createDataFrame([(1, f) for f in (0, 5, 9, 10, 19, 20, 29, 30, 99)], "recording_id long, frame_id long")
    got = {r.frame_id: (r.ch2, r.ch3) for r in pr.protocol_state_join(frames, pr.parse_protocol(df)).collect()}
    assert got == {0: (False, False), 5: (False, False), 9: (False, False), 10: (True, True), 19: (True, True), 20: (False, True), 29: (False, True), 30: (False, False), 99: (False, False)}


@pytest.mark.parametrize("path, want", [("a/run", "a/run_001/"), ("a/run_009//", "a/run_010/"), ("a/run_999", "a/run_1000/"), ("x7y", "x7y_001/"), ("12", "13/")])
def test_increment_name(spark, path, want):
    assert value(spark, pr.increment_name(F.lit(path))) == (want,)


def test_frame_ids_of_paths(spark):
    assert value(spark, frame_index(F.lit("d_7/behavior_frame_000000012.csv")), frame_index(F.lit("d/x.csv"))) == (12, None)
    assert tuple(value(spark, scan_position(F.lit("homography_scan_x1.5_y-2_frame3.tif")))[0]) == (1.5, -2.0, 3)


def test_reorientation(spark):
    df = spark.createDataFrame([(1, 0, 2, 3, [11, 0, 22, 33, 0, 44])], "recording_id long, frame_id long, height int, width int, px array<int>")
    for camera, corners in (("muscle", [22, 44, 11, 33]), ("behavior", [44, 22, 33, 11])):
        r = pixels.reorient_frame(df, camera).first()
        assert (r.height, r.width) == (3, 2)
        a = np.array(r.px).reshape(3, 2)
        assert [a[0, 0], a[0, 1], a[2, 0], a[2, 1]] == corners


@pytest.mark.parametrize("v, low, high, want", [(500, 0, 1000, 128), (1000, 0, 1000, 255), (100, 200, 800, 0), (500, 200, 800, 128), (1000, 200, 800, 255)])
def test_16_to_8_bit(spark, v, low, high, want):
    assert value(spark, pixels.window_to_8bit(F.lit(float(v)), low, high)) == (want,)


def test_packed_channels(spark):
    df = spark.createDataFrame([(1, 0, 3, [10], [20], [30]), (1, 1, 2, [10], [20], [0]), (1, 2, 1, [10], [0], [0])], "recording_id long, group_id long, num_valid int, ch0 array<int>, ch1 array<int>, ch2 array<int>")
    got = {r.frame_id: r.px[0] for r in pixels.expand_channels(df).collect()}
    assert got == {0: 10, 1: 20, 2: 30, 3: 10, 4: 20, 6: 10}


def test_frame_id_methods(spark):
    f, r = F.lit(9), F.lit(6)
    assert value(spark, sync.behavior_to_muscle(f, r, "FLOOR"), sync.behavior_to_muscle(f, r, "nearest"), sync.behavior_to_muscle(F.lit(15), r, "nearest"), sync.muscle_to_behavior(F.lit(3), r, 2)) == (1, 2, 2, 30)
    with pytest.raises(ValueError):
        sync.behavior_to_muscle(f, r, "up")
