"""Column functions against hand values, window operators on small tracks."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerotrace.functions import angles, geometry, kernels
from aerotrace.operators import spatial, windows


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_angles(spark):
    r = one(
        spark, angles.wrap360(-10.0), angles.wrap360(360.0), angles.angle_error(359.0, 1.0), angles.signed_difference(0.0, 180.0), angles.signed_difference(10.0, 350.0), angles.axis_difference(10.0, 185.0),
        angles.bearing(0.0, 0.0), angles.bearing360(0.0, -1.0), angles.facing(F.lit(0.0), F.lit(180.0)), angles.facing(F.lit(0.0), F.lit(90.0)), angles.gaussian(40.0, 40.0), angles.log_gaussian(35.0, 35.0),
        *angles.axis_error(F.lit(10.0), F.lit(195.0)), *angles.axis_error(F.lit(0.0), F.lit(90.0)), angles.circular_mean([(350.0, 1.0), (10.0, 1.0)]), angles.angle_error_any(-10.0, 710.0),
    )
    want = [350, 0, 2, -180, 20, 5, 0, 270, 180, 0, math.exp(-0.5), -0.5, 5, 190, 90, 0, 0, 0]
    for i, w in enumerate(want):
        assert abs((r[i] - w + 180) % 360 - 180) < 1e-9, (i, r[i], w)


def test_geometry(spark):
    r = one(
        spark, geometry.distance_to_segment(5.0, 3.0, 0.0, 0.0, 10.0, 0.0), geometry.distance_to_segment(-3.0, 4.0, 0.0, 0.0, 10.0, 0.0), geometry.distance_to_segment(3.0, 4.0, 0.0, 0.0, 0.0, 0.0),
        *geometry.project_guarded(5.0, 3.0, 1.0, 1.0, 1.0, 1.0), *geometry.project_soft(5.0, 3.0, 0.0, 0.0, 10.0, 0.0), *geometry.affine(2.0, 3.0, (1, 10, 100, 2, 20, 200)), geometry.clip(1.4, 0.0, 0.9),
        geometry.float32(0.1), geometry.round_even(2.5, 0), *geometry.tangent_blend(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)),
    )
    want = [3, 5, 5, 1, 1, 5, 0, 132, 264, 0.9, 0.10000000149011612, 2, 0.5, 0.5]
    assert all(abs(a - b) < 1e-5 for a, b in zip(r, want, strict=True)), list(r)
    r = one(spark, geometry.local_time(F.lit(0)), *geometry.content_digest(F.lit("abc")))
    assert list(r) == ["1970-01-01 08:00:00", 3, "a9993e364706"]
    assert geometry.day_range("20240228", "20240301") == ["20240228", "20240229", "20240301"]


def track(spark, points, **more):
    rows = [(1, i, float(x), float(z), 10 * i, *more.values()) for i, (x, z) in enumerate(points)]
    return spark.createDataFrame(rows, "traj_id long, seq int, x double, z double, t long" + "".join(f", {k} string" for k in more))


def values(df, col):
    return [r[0] for r in df.orderBy("seq").select(col).collect()]


def test_still_tracks_have_no_direction_and_stops_inherit(spark):
    still = windows.filled_direction(windows.window_direction(track(spark, [(1, 1)] * 5)))
    assert set(values(still, "direction_source")) == {"STATIC"}
    moving = [(i, 0) for i in range(15)] + [(14, 0)] * 30 + [(14, k) for k in range(1, 15)]
    rows = windows.filled_direction(windows.window_direction(track(spark, moving)))
    src = values(rows, "direction_source")
    assert "OBS_INHERIT" in src and src[0] == "OBS_WIN" and values(rows, "observation_dir")[30] == 0.0
    lead = [(0, 0)] * 25 + [(0, k) for k in range(1, 9)]
    assert values(windows.filled_direction(windows.window_direction(track(spark, lead))), "observation_dir")[0] == 90.0


def test_mean_heading_to_the_last_bit(spark):
    """Bearings of opposite signs cancel: these five add up to 945."""
    turns = [(36, -5), (48, -8), (50, -10), (58, -8), (62, -8), (62, -12), (64, -11)]
    assert values(windows.trailing_motion(track(spark, turns)), "f2v_dir")[6] == 189.0
    turns = [(13, 0), (17, -3), (28, -6), (35, -6), (43, -5), (46, -2)]
    steps = [(math.atan2(d - b, c - a) * (180.0 / math.pi) + 360.0) % 360.0 for (a, b), (c, d) in zip(turns, turns[1:], strict=False)]
    assert values(windows.trailing_motion(track(spark, turns)), "f2v_dir")[1:5] == steps[:4]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny_tracks(spark, n):
    rows = track(spark, [(i, 0) for i in range(n)])
    assert all(v is None for v in values(windows.extrapolated(rows), "cvm_x")[: 2 if n > 2 else n])
    assert values(windows.trailing_motion(rows), "f2v_x") == [None] * n
    assert len(values(windows.trimmed(rows), "seq")) == n
    place, heading = kernels.turning_filter(rows.select("x", "z").toPandas().to_numpy())
    assert math.isnan(place[0, 0]) and math.isnan(heading[0])


def test_gaps_split_only_beyond_the_limit(spark):
    times = [0, 180, 360, 541, 542]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "traj_id long, seq int, t long")
    assert [r.t for r in windows.longest_session(rows).orderBy("t").collect()] == [0, 180, 360]


def test_held_positions_interpolate(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, "a"), (1, 1, 1, 0.0, 0.0, "b"), (1, 2, 2, 4.0, 0.0, "c"), (1, 3, 4, 4.0, 0.0, "d")], "traj_id long, seq int, t long, x double, z double, event_type string")
    got = [(r.sec, r.x, r.event_type) for r in windows.resampled(rows).orderBy("sec").collect()]
    assert got == [(0, 0.0, "a"), (1, 2.0, "b"), (2, 4.0, "c"), (3, 4.0, "c"), (4, 4.0, "d")]


def test_radius_and_knn_joins_equal_brute_force(spark):
    import random

    rnd = random.Random(4)
    pts = [(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, x double, z double")
    got = {(r.id, r.r_id) for r in spatial.radius_join(df, df, 12.0).collect()}
    assert got == {(a, b) for a, ax, az in pts for b, bx, bz in pts if math.hypot(ax - bx, az - bz) <= 12.0}
    near = spatial.knn_join(df.select("id", "x", "z"), df, 5, ["id"], ["id"], 4.0, 200.0)
    want = {(a, b) for a, ax, az in pts for b in [q[1] for q in sorted((math.hypot(ax - bx, az - bz), b) for b, bx, bz in pts)[:5]]}
    assert {(r.id, r.r_id) for r in near.collect()} == want
    segs = spark.createDataFrame([(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(25)], "s int, ax double, az double, bx double, bz double")
    d = geometry.distance_to_segment("x", "z", "ax", "az", "bx", "bz")
    assert {(r.id, r.s) for r in spatial.segment_radius_join(df, segs, 15.0).collect()} == {(r.id, r.s) for r in df.crossJoin(segs).where(d < 15.0).collect()}


@settings(max_examples=60, deadline=None)
@given(st.floats(-1e4, 1e4), st.floats(-1e4, 1e4))
def test_kernel_angles(a, b):
    assert 0 <= kernels.error(a, b) <= 180 and -180 <= kernels.signed(a, b) <= 180
    assert -180 < kernels.half_open(a) <= 180


def test_feature_distances_by_arrays_and_by_cells(spark):
    rnd = random.Random(6)
    points = spark.createDataFrame([(i, rnd.uniform(-500, 900), rnd.uniform(-300, 300)) for i in range(120)] + [(999, 1e5, 1e5)], "id long, x double, z double")
    rows = [(rnd.choice("rs"), x := rnd.uniform(0, 500), z := rnd.uniform(-200, 200), x + rnd.uniform(-40, 40), z + rnd.uniform(-40, 40)) for _ in range(60)]
    features = spark.createDataFrame(rows, "kind string, ax double, az double, bx double, bz double")
    a, b = ({(r.id, r.kind): r.distance for r in spatial.feature_distance(points, features, ["id"], most).collect()} for most in (100, 10))
    assert set(a) == set(b) and len(a) == 242 and all(abs(a[k] - b[k]) < 1e-9 * max(1, a[k]) for k in a)
    assert spatial.feature_distance(points, features.limit(0), ["id"], -1).count() == 0


def test_rings_hold_points(spark):
    """Crossing parity by bands of z, for small and for very wide rings, against the plain rule."""
    rnd, rings = random.Random(7), {}
    for n in range(6):
        x, z, size = rnd.uniform(0, 400), rnd.uniform(0, 400), rnd.choice((5, 40, 900))
        rings[f"r{n}"] = [(x + size * rnd.uniform(0.4, 1) * math.cos(t), z + size * rnd.uniform(0.4, 1) * math.sin(t)) for t in np.linspace(0, 6.0, 9)]
    edges = [(k, *a, *b) for k, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    points = [(i, rnd.uniform(-100, 600), rnd.uniform(-100, 600)) for i in range(300)]
    got = {(r.id, r.ring) for r in spatial.inside(spark.createDataFrame(points, "id long, x double, z double"), spark.createDataFrame(edges, "ring string, ax double, az double, bx double, bz double"), ["id"]).collect()}
    want = {(i, k) for i, x, z in points for k in rings if sum((az > z) != (bz > z) and x < ax + (z - az) * (bx - ax) / (bz - az) for r, ax, az, bx, bz in edges if r == k) % 2}
    assert got == want and got
