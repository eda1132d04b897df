"""Registered queries: operators over the surrogate trajectories and network, with DuckDB SQL for the same rows.

Doubles are rounded to six places on both sides, and 0.0 is added so that there is no negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles, geometry
from ..operators import baselines, estimator, extract, matcher, network, scoring, spatial, windows
from ..operators.shared import shared_dir
from .surrogate import WITH, features, net, obs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql
        return f

    return add


def r6(x, name: str | None = None) -> Column:
    c = angles.col(x)
    return (F.round(c.cast("double"), 6) + 0.0).alias(name or x)


def _r(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x}"


KEY = ("traj_id", "seq")
W = "(PARTITION BY traj_id ORDER BY seq)"


def _frame(reach: int) -> str:
    return f"(PARTITION BY traj_id ORDER BY seq ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"


def _bearing360(dx: str, dz: str) -> str:
    return f"((degrees(atan2({dz}, {dx})) + 360.0) % 360.0)"


def _diff(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 360.0 - abs({a} - {b}))"


_REFDIR = "((coalesce(angle_graph, angle_self, 0.0) % 360) + 360) % 360"


# windows over a trajectory


@query("SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS seq, event_id FROM obs WHERE origin_lon IS NOT NULL AND origin_lat IS NOT NULL AND NOT (abs(origin_lon) < 1e-9 AND abs(origin_lat) < 1e-9)")
def drop_missing_obs(spark, d):
    return windows.drop_missing(obs(spark, d)).select(*KEY, "event_id")


@query(f", r AS (SELECT traj_id, seq, coalesce(angle_graph, angle_self, 0.0) AS a FROM obs) SELECT traj_id, seq, {_r('((a % 360) + 360) % 360', 'refdir')} FROM r")
def reference_direction(spark, d):
    return obs(spark, d).select(*KEY, r6(windows.reference_direction(F.col("angle_graph"), F.col("angle_self")), "refdir"))


_WIN = """, win AS (SELECT *, last_value(x) OVER f - first_value(x) OVER f AS wx, last_value(z) OVER f - first_value(z) OVER f AS wz FROM obs WINDOW f AS {frame}),
dirs AS (SELECT *, CASE WHEN sqrt(wx * wx + wz * wz) >= 0.5 THEN {angle} END AS win_dir FROM win)"""
_WIN10 = _WIN.format(frame=_frame(10), angle=_bearing360("wx", "wz"))


@query(_WIN10 + f" SELECT traj_id, seq, {_r('win_dir')} FROM dirs")
def window_direction_10(spark, d):
    return windows.window_direction(obs(spark, d)).select(*KEY, r6("win_dir"))


@query(_WIN.format(frame=_frame(20), angle="degrees(atan2(wz, wx))") + f" SELECT traj_id, seq, {_r('win_dir')} FROM dirs")
def window_direction_20(spark, d):
    return windows.window_direction(obs(spark, d), 20, signed=True).select(*KEY, r6("win_dir"))


_FILL = _WIN10 + """, fill AS (SELECT *, coalesce(last_value(win_dir IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(win_dir IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS observation_dir FROM dirs)"""


@query(_FILL + f" SELECT traj_id, seq, {_r('observation_dir')}, CASE WHEN win_dir IS NOT NULL THEN 'OBS_WIN' WHEN observation_dir IS NOT NULL THEN 'OBS_INHERIT' ELSE 'STATIC' END AS direction_source FROM fill")
def direction_fill_source(spark, d):
    return windows.filled_direction(windows.window_direction(obs(spark, d))).select(*KEY, r6("observation_dir"), "direction_source")


@query(f""", c AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS dz FROM obs WINDOW w AS {W})
SELECT traj_id, seq, {_r('degrees(atan2(dz, dx))', 'self_dir')}, {_r('CASE WHEN sqrt(dx*dx + dz*dz) >= 0.5 THEN degrees(atan2(dz, dx)) END', 'clean_dir')} FROM c""")
def central_difference_direction(spark, d):
    return windows.central_direction(obs(spark, d)).select(*KEY, r6("self_dir"), r6("clean_dir"))


_CVM = f""", lagged AS (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, count(*) OVER (PARTITION BY traj_id) AS n FROM obs WINDOW w AS {W}),
cvm AS (SELECT *, CASE WHEN n >= 3 THEN 2 * x1 - x2 END AS cvm_x, CASE WHEN n >= 3 THEN 2 * z1 - z2 END AS cvm_z, CASE WHEN n >= 3 AND x2 IS NOT NULL THEN {_bearing360('x1 - x2', 'z1 - z2')} END AS cvm_dir FROM lagged)"""


@query(_CVM + f" SELECT traj_id, seq, {_r('cvm_x')}, {_r('cvm_z')}, {_r('cvm_dir')} FROM cvm")
def cvm_baseline(spark, d):
    return windows.extrapolated(obs(spark, d)).select(*KEY, r6("cvm_x"), r6("cvm_z"), r6("cvm_dir"))


_F2V = f""", steps AS (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz, lead(x) OVER w AS nx, lead(z) OVER w AS nz, count(*) OVER (PARTITION BY traj_id) AS n FROM obs WINDOW w AS {W}),
rated AS (SELECT *, CASE WHEN px IS NOT NULL THEN sqrt((x - px) ** 2 + (z - pz) ** 2) END AS speed, CASE WHEN px IS NOT NULL THEN {_bearing360('x - px', 'z - pz')} ELSE {_bearing360('nx - x', 'nz - z')} END AS heading FROM steps),
meaned AS (SELECT *, coalesce(avg(speed) FILTER (WHERE speed > 0) OVER (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS v,
 avg(heading) OVER (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM rated),
f2v AS (SELECT *, CASE WHEN n > 5 THEN CASE WHEN seq < 5 THEN x ELSE px + v * cos(radians(h)) END END AS f2v_x, CASE WHEN n > 5 THEN CASE WHEN seq < 5 THEN z ELSE pz + v * sin(radians(h)) END END AS f2v_z,
 CASE WHEN n > 5 THEN CASE WHEN seq < 5 THEN heading ELSE h END END AS f2v_dir FROM meaned)"""


@query(_F2V + f" SELECT traj_id, seq, {_r('f2v_x')}, {_r('f2v_z')}, {_r('f2v_dir')} FROM f2v")
def flight2vec_baseline(spark, d):
    return windows.trailing_motion(obs(spark, d)).select(*KEY, r6("f2v_x"), r6("f2v_z"), r6("f2v_dir"))


@query(""", b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY traj_id ORDER BY t) > 180 THEN 1 ELSE 0 END AS s FROM obs),
g AS (SELECT *, sum(s) OVER (PARTITION BY traj_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM b),
k AS (SELECT traj_id, session, row_number() OVER (PARTITION BY traj_id ORDER BY count(*) DESC, session) AS place FROM g GROUP BY traj_id, session)
SELECT g.traj_id, g.seq, g.t FROM g JOIN k ON g.traj_id = k.traj_id AND g.session = k.session AND k.place = 1""")
def gap_sessions_longest(spark, d):
    return windows.longest_session(obs(spark, d)).select(*KEY, "t")


@query(""", b AS (SELECT *, abs(z) < 40 AS ok FROM obs),
g AS (SELECT *, sum(CASE WHEN NOT ok OR NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(ok) OVER (PARTITION BY traj_id ORDER BY seq) AS p FROM b)),
k AS (SELECT traj_id, run, row_number() OVER (PARTITION BY traj_id ORDER BY count(*) DESC, run) AS place FROM g WHERE ok GROUP BY traj_id, run)
SELECT g.traj_id, g.seq FROM g JOIN k ON g.traj_id = k.traj_id AND g.run = k.run AND k.place = 1 WHERE ok""")
def longest_predicate_run(spark, d):
    return windows.longest_run(obs(spark, d), F.abs("z") < 40).select(*KEY)


@query(f""", s AS (SELECT *, row_number() OVER w - 1 AS i, sqrt((lead(x, 10) OVER w - x) ** 2 + (lead(z, 10) OVER w - z) ** 2) / 10 >= 2.0 AS fast, count(*) OVER (PARTITION BY traj_id) AS n FROM obs WINDOW w AS {W}),
e AS (SELECT *, min(i) FILTER (WHERE fast) OVER (PARTITION BY traj_id) AS a, max(i) FILTER (WHERE fast) OVER (PARTITION BY traj_id) + 10 AS b FROM s)
SELECT traj_id, seq FROM e WHERE n < 40 OR a IS NULL OR (i >= a AND i < b)""")
def trim_low_speed(spark, d):
    return windows.trimmed(obs(spark, d)).select(*KEY)


@query(f""", m AS (SELECT *, coalesce(abs(x - lag(x) OVER w) > 1e-9 OR abs(z - lag(z) OVER w) > 1e-9, true) AS moved, lead(t) OVER w AS nt FROM obs WINDOW w AS {W}),
k AS (SELECT *, last_value(CASE WHEN moved THEN t END IGNORE NULLS) OVER a AS t0, last_value(CASE WHEN moved THEN x END IGNORE NULLS) OVER a AS x0, last_value(CASE WHEN moved THEN z END IGNORE NULLS) OVER a AS z0,
 first_value(CASE WHEN moved THEN t END IGNORE NULLS) OVER b AS t1, first_value(CASE WHEN moved THEN x END IGNORE NULLS) OVER b AS x1, first_value(CASE WHEN moved THEN z END IGNORE NULLS) OVER b AS z1
 FROM m WINDOW a AS (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
grid AS (SELECT *, unnest(range(t, coalesce(nt, t + 1))) AS sec FROM k)
SELECT traj_id, sec, {_r('CASE WHEN t1 IS NULL THEN x0 ELSE x0 + CAST(sec - t0 AS DOUBLE) / (t1 - t0) * (x1 - x0) END', 'x')}, {_r('CASE WHEN t1 IS NULL THEN z0 ELSE z0 + CAST(sec - t0 AS DOUBLE) / (t1 - t0) * (z1 - z0) END', 'z')}, event_type FROM grid""")
def resample_grid(spark, d):
    return windows.resampled(obs(spark, d)).select("traj_id", "sec", r6("x"), r6("z"), "event_type")


# extraction


@query("SELECT traj_id, seq FROM obs WHERE x BETWEEN 50 AND 400 AND z BETWEEN -30 AND 30")
def bbox_filter(spark, d):
    return extract.in_box(obs(spark, d), 50, 400, -30, 30).select(*KEY)


@query(", s AS (SELECT *, t // 4 AS sec FROM obs) SELECT traj_id, seq, sec FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, sec ORDER BY seq) AS n FROM s) q WHERE n = 1")
def dedup_same_second(spark, d):
    return windows.first_per_second(obs(spark, d).withColumn("sec", F.floor(F.col("t") / 4)), ["traj_id"], "sec", ["seq"]).select(*KEY, "sec")


def _distance_sql(px="x", pz="z") -> str:
    t = f"greatest(0.0, least(1.0, (({px} - ax) * (bx - ax) + ({pz} - az) * (bz - az)) / greatest((bx - ax) ** 2 + (bz - az) ** 2, 1e-12)))"
    return f"sqrt(({px} - (ax + {t} * (bx - ax))) ** 2 + ({pz} - (az + {t} * (bz - az))) ** 2)"


@query(f" SELECT traj_id, seq, kind, {_r(f'min({_distance_sql()})', 'distance')} FROM obs, features GROUP BY traj_id, seq, kind")
def nearest_feature(spark, d):
    return spatial.feature_distance(obs(spark, d), features(spark, d), list(KEY)).select(*KEY, "kind", r6("distance"))


_RINGS = "rings AS (SELECT * FROM (VALUES (1, 0, -50, 300, -50), (1, 300, -50, 300, 50), (1, 300, 50, 0, 50), (1, 0, 50, 0, -50), (2, 400, -100, 700, 20), (2, 700, 20, 400, 90), (2, 400, 90, 400, -100)) v(ring, ax, az, bx, bz))"


def _rings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0.0, -50.0, 300.0, -50.0), (1, 300.0, -50.0, 300.0, 50.0), (1, 300.0, 50.0, 0.0, 50.0), (1, 0.0, 50.0, 0.0, -50.0), (2, 400.0, -100.0, 700.0, 20.0), (2, 700.0, 20.0, 400.0, 90.0), (2, 400.0, 90.0, 400.0, -100.0)], "ring int, ax double, az double, bx double, bz double")


_INSIDE = f", {_RINGS}, inside AS (SELECT traj_id, seq, ring FROM obs, rings WHERE az <> bz AND (az > z) <> (bz > z) AND x < ax + (z - az) * (bx - ax) / (CAST(bz AS DOUBLE) - az) GROUP BY traj_id, seq, ring HAVING count(*) % 2 = 1)"


@query(_INSIDE + " SELECT traj_id, seq, ring FROM inside")
def point_in_polygon(spark, d):
    return spatial.inside(obs(spark, d), _rings(spark), list(KEY)).select(*KEY, "ring")


_ENDS = f""", {_RINGS}, numbered AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY traj_id) AS n FROM obs),
parts AS (SELECT *, greatest(2, CAST(floor(0.4 * n) AS BIGINT)) AS k FROM numbered),
sampled AS (SELECT *, 'front' AS part FROM parts WHERE i < k AND i % 2 = 0 UNION ALL SELECT *, 'back' AS part FROM parts WHERE i >= n - k AND (i - (n - k)) % 2 = 0),
dist AS (SELECT traj_id, seq, part, min({_distance_sql()}) FILTER (WHERE kind = 'runway') AS rw, min({_distance_sql()}) FILTER (WHERE kind = 'apron') AS ap, min({_distance_sql()}) FILTER (WHERE kind = 'stand') AS st FROM sampled, features GROUP BY traj_id, seq, part),
inside AS (SELECT DISTINCT traj_id, seq FROM (SELECT traj_id, seq, ring FROM obs, rings WHERE az <> bz AND (az > z) <> (bz > z) AND x < ax + (z - az) * (bx - ax) / (CAST(bz AS DOUBLE) - az) GROUP BY traj_id, seq, ring HAVING count(*) % 2 = 1) q),
ends AS (SELECT d.traj_id, bool_or(rw < 35) FILTER (WHERE part = 'front') AS front_rw, bool_or(ap < 100 OR st < 30 OR i.seq IS NOT NULL) FILTER (WHERE part = 'front') AS front_ap,
 bool_or(rw < 35) FILTER (WHERE part = 'back') AS back_rw, bool_or(ap < 100 OR st < 30 OR i.seq IS NOT NULL) FILTER (WHERE part = 'back') AS back_ap FROM dist d LEFT JOIN inside i ON d.traj_id = i.traj_id AND d.seq = i.seq GROUP BY d.traj_id)"""


@query(_ENDS + " SELECT traj_id, front_rw, front_ap, back_rw, back_ap, CASE WHEN front_rw AND back_ap THEN 'A' WHEN front_ap AND back_rw THEN 'D' END AS movement FROM ends")
def movement_class(spark, d):
    return extract.movement(obs(spark, d), features(spark, d), _rings(spark)).select("traj_id", "front_rw", "front_ap", "back_rw", "back_ap", "movement")


@query(""", files AS (SELECT traj_id, flio, count(*) AS points FROM obs GROUP BY traj_id, flio),
ranked AS (SELECT *, row_number() OVER (PARTITION BY flio ORDER BY traj_id) - 1 AS i, count(*) OVER (PARTITION BY flio) AS n FROM files)
SELECT DISTINCT flio, traj_id FROM ranked, range(6) r(k) WHERE i = least(n - 1, CAST(floor(k * CAST(n AS DOUBLE) / 6 + CAST(n AS DOUBLE) / 12) AS BIGINT))""")
def even_grid_sample(spark, d):
    return extract.even_sample(obs(spark, d).groupBy("traj_id", "flio").count(), "flio", "traj_id", 6).select("flio", "traj_id")


@query(""", f AS (SELECT traj_id, concat(flio, '-', CAST(traj_id % 10 AS VARCHAR)) AS base FROM (SELECT DISTINCT traj_id, flio FROM obs) q), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY traj_id) AS k FROM f)
SELECT traj_id, CASE WHEN k = 1 THEN base ELSE concat(base, '_', CAST(k AS VARCHAR)) END AS name FROM n""")
def unique_output_name(spark, d):
    files = obs(spark, d).select("traj_id", "flio").distinct().withColumn("base", F.concat("flio", F.lit("-"), (F.col("traj_id") % 10).cast("string")))
    return windows.numbered_names(files, "base", "traj_id").select("traj_id", "name")


@query(""", n AS (SELECT traj_id, count(*) AS points, max(t) - min(t) AS seconds FROM obs GROUP BY traj_id)
SELECT CASE WHEN points < 60 THEN 'reject_short' WHEN seconds > 2000 THEN 'reject_long' ELSE 'kept' END AS status, count(*) AS tracks, CAST(sum(points) AS BIGINT) AS points FROM n GROUP BY status""")
def rejection_counters(spark, d):
    return extract.counters(obs(spark, d), 60, 2000)


# network


def _points(spark, d) -> DataFrame:
    n = net(spark, d)
    last = n.groupBy("pathname", "path_no").agg(F.max_by(F.struct("seg_idx", "bx", "bz"), "seg_idx").alias("l"))
    return n.select("pathname", F.col("seg_idx").alias("seq"), F.col("ax").alias("x"), F.col("az").alias("z")).unionByName(last.select("pathname", (F.col("l.seg_idx") + 1).alias("seq"), F.col("l.bx").alias("x"), F.col("l.bz").alias("z")))


_SEG = ", seg AS (SELECT *, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS length FROM net WHERE sqrt((bx - ax) ** 2 + (bz - az) ** 2) >= 1e-6)"


@query(_SEG + f" SELECT pathname, seg_idx AS raw_idx, row_number() OVER (PARTITION BY pathname ORDER BY seg_idx) - 1 AS idx, {_r('ax')}, {_r('az')}, {_r('bx')}, {_r('bz')}, {_r('length')}, {_r(_bearing360('bx - ax', 'bz - az'), 'dir_f')} FROM seg")
def segments_from_paths(spark, d):
    return network.segments_of(_points(spark, d)).select("pathname", "raw_idx", "idx", *map(r6, ("ax", "az", "bx", "bz", "length", "dir_f")))


_PATHDIR = f""", pd AS (SELECT pathname, degrees(atan2(sum(bz - az), sum(bx - ax))) AS path_dir, CASE WHEN sqrt((arg_max(bx, seg_idx) - arg_min(ax, seg_idx)) ** 2 + (arg_max(bz, seg_idx) - arg_min(az, seg_idx)) ** 2) > 1e-6
 THEN {_bearing360('arg_max(bx, seg_idx) - arg_min(ax, seg_idx)', 'arg_max(bz, seg_idx) - arg_min(az, seg_idx)')} ELSE 0 END AS net_dir FROM net GROUP BY pathname)"""


@query(_PATHDIR + f" SELECT pathname, {_r('path_dir')}, {_r('net_dir')} FROM pd")
def path_net_direction(spark, d):
    return network.path_direction(net(spark, d)).select("pathname", r6("path_dir"), r6("net_dir"))


_NB = """, e AS (SELECT *, bx - ax AS dx, bz - az AS dz, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS length FROM net),
nb AS (SELECT *, coalesce(lag(dx) OVER w, dx) AS prev_dx, coalesce(lag(dz) OVER w, dz) AS prev_dz, coalesce(lead(dx) OVER w, dx) AS next_dx, coalesce(lead(dz) OVER w, dz) AS next_dz,
 avg(dx / length) OVER f AS cx, avg(dz / length) OVER f AS cz FROM e WINDOW w AS (PARTITION BY path_no ORDER BY seg_idx), f AS (PARTITION BY path_no ORDER BY seg_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


@query(_NB + f" SELECT pathname, seg_idx, {_r('degrees(atan2(cz, cx))', 'course')} FROM nb")
def local_course(spark, d):
    return network.with_neighbours(net(spark, d)).select("pathname", "seg_idx", r6("course"))


@query(_NB + " SELECT pathname, seg_idx, prev_dx, prev_dz, next_dx, next_dz FROM nb")
def neighbour_vectors(spark, d):
    return network.with_neighbours(net(spark, d)).select("pathname", "seg_idx", "prev_dx", "prev_dz", "next_dx", "next_dz")


def _unit(x: str, p: str) -> str:
    return f"{p}d{x} / sqrt({p}dx ** 2 + {p}dz ** 2)"


@query(_NB + f""", b AS (SELECT *, (seg_idx % 5) / 4.0 AS t FROM nb), k AS (SELECT *, greatest(0, 0.5 - t) AS wp, greatest(0, t - 0.5) AS wn FROM b),
v AS (SELECT *, (1 - wp - wn) * {_unit('x', '')} + wp * {_unit('x', 'prev_')} + wn * {_unit('x', 'next_')} AS tx, (1 - wp - wn) * {_unit('z', '')} + wp * {_unit('z', 'prev_')} + wn * {_unit('z', 'next_')} AS tz FROM k)
SELECT pathname, seg_idx, {_r('tx')}, {_r('tz')} FROM v""")
def segment_tangent(spark, d):
    n = network.with_neighbours(net(spark, d)).withColumn("t", (F.col("seg_idx") % 5) / 4.0)

    def unit(p):
        length = F.sqrt(F.col(f"{p}dx") ** 2 + F.col(f"{p}dz") ** 2)
        return F.col(f"{p}dx") / length, F.col(f"{p}dz") / length

    tx, tz = geometry.tangent_blend("t", *unit(""), *unit("prev_"), *unit("next_"))
    return n.select("pathname", "seg_idx", r6(tx, "tx"), r6(tz, "tz"))


_TURN = """, e AS (SELECT *, bx - ax AS dx, bz - az AS dz FROM net WHERE bx <> ax OR bz <> az), p AS (SELECT *, lag(dx) OVER w AS px, lag(dz) OVER w AS pz FROM e WINDOW w AS (PARTITION BY pathname ORDER BY seg_idx)),
turns AS (SELECT pathname, coalesce(max(degrees(acos(greatest(-1.0, least(1.0, (dx * px + dz * pz) / (sqrt(dx * dx + dz * dz) * sqrt(px * px + pz * pz))))))), 0) AS max_turn FROM p GROUP BY pathname)"""


@query(_TURN + f" SELECT pathname, {_r('max_turn')}, CASE WHEN max_turn < 5 THEN 'N' ELSE 'R' END AS kind FROM turns")
def max_turn_classification(spark, d):
    return network.max_turn(_points(spark, d)).select("pathname", r6("max_turn"), "kind")


_ARC = _SEG + ", arc AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY pathname ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along FROM seg)"


@query(_ARC + f" SELECT pathname, seg_idx, {_r('length')}, {_r('along')} FROM arc")
def cumulative_arc_length(spark, d):
    return network.arc_lengths(net(spark, d)).select("pathname", "seg_idx", r6("length"), r6("along"))


_ANC = _ARC + """, n AS (SELECT *, greatest(1, CAST(round_even(length, 0) AS BIGINT)) AS n FROM arc), pts AS (SELECT *, unnest(range(n)) AS s FROM n),
anc AS (SELECT pathname, seg_idx, s, round(ax + (s / n) * (bx - ax), 2) AS x, round(az + (s / n) * (bz - az), 2) AS z, round(along + (s / n) * length, 2) AS along, round(s / n, 3) AS t FROM pts)"""


@query(_ANC + " SELECT pathname, seg_idx, CAST(s AS INTEGER) AS s, x + 0.0 AS x, z + 0.0 AS z, along, t FROM anc")
def anchors_1m(spark, d):
    a = network.anchors(net(spark, d))
    return a.select("pathname", "seg_idx", "s", (F.col("x") + 0.0).alias("x"), (F.col("z") + 0.0).alias("z"), "along", "t")


_EN = """, pe AS (SELECT pathname, 0 AS side, arg_min(ax, seg_idx) AS x, arg_min(az, seg_idx) AS z FROM net GROUP BY pathname UNION ALL SELECT pathname, 1 AS side, arg_max(bx, seg_idx) AS x, arg_max(bz, seg_idx) AS z FROM net GROUP BY pathname),
nodes AS (SELECT *, concat(CAST(CAST(round_even(x, 0) AS BIGINT) AS VARCHAR), ',', CAST(CAST(round_even(z, 0) AS BIGINT) AS VARCHAR)) AS node FROM pe),
strict AS (SELECT DISTINCT a.pathname AS src, b.pathname AS dst FROM nodes a JOIN nodes b ON a.node = b.node AND a.pathname <> b.pathname)"""
_SPACE = _EN + _PATHDIR + """, se AS (SELECT pathname, ax AS x, az AS z FROM net UNION SELECT pathname, bx, bz FROM net), near AS (SELECT DISTINCT a.pathname AS src, b.pathname AS dst FROM se a JOIN se b ON a.pathname < b.pathname AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 30),
half AS (SELECT n.src, n.dst FROM near n JOIN pd a ON a.pathname = n.src JOIN pd b ON b.pathname = n.dst WHERE NOT EXISTS (SELECT 1 FROM strict s WHERE s.src = n.src AND s.dst = n.dst)
 AND least(abs(a.path_dir - b.path_dir), 360 - abs(a.path_dir - b.path_dir)) >= 20), space AS (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half),
total AS MATERIALIZED (SELECT src, dst FROM strict UNION SELECT src, dst FROM space)"""


@query(_EN + f" SELECT pathname, side, {_r('x')}, {_r('z')}, node FROM nodes")
def nodes_by_snap(spark, d):
    return network.snapped_nodes(network.path_ends(net(spark, d))).select("pathname", "side", r6("x"), r6("z"), "node")


def _edges(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n = net(spark, d)
    ends = network.path_ends(n)
    strict = network.strict_edges(network.snapped_nodes(ends))
    space = network.space_edges(network.segment_ends(n), strict, network.path_direction(n))
    return n.select("pathname").distinct(), strict, space, network.total_edges(strict, space)


def _alike(spark, d) -> network.Alike | None:
    shared_dir(spark)
    n = net(spark, d)
    return network.alike(network.segment_ends(n), network.snapped_nodes(network.path_ends(n)), network.path_direction(n), 30.0, 20.0)


@query(_EN + " SELECT src, dst FROM strict")
def adjacency_strict(spark, d):
    return _edges(spark, d)[1]


@query(_SPACE + " SELECT src, dst FROM space")
def adjacency_space(spark, d):
    classes = _alike(spark, d)
    return classes.edges(("space",)).select("src", "dst") if classes else _edges(spark, d)[2]


@query(_SPACE + " SELECT src, dst FROM total")
def adjacency_total(spark, d):
    classes = _alike(spark, d)
    return classes.edges().select("src", "dst") if classes else _edges(spark, d)[3]


@query(_EN + " SELECT DISTINCT a.pathname AS src, b.pathname AS dst FROM pe a JOIN pe b ON a.pathname <> b.pathname AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) <= 80")
def adjacency_endpoint_80m(spark, d):
    shared_dir(spark)
    ends = network.path_ends(net(spark, d))
    classes = network.alike(ends, None, None, 80.0)
    return classes.edges(("space",)).select("src", "dst") if classes else network.near_edges(ends)


def _transitions(spark, d) -> DataFrame:
    if classes := _alike(spark, d):
        return classes.transitions()
    paths, *_, total = _edges(spark, d)
    return network.transitions(paths, total)


def _components(spark, d) -> DataFrame:
    if classes := _alike(spark, d):
        return classes.components()
    paths, *_, total = _edges(spark, d)
    return network.components(paths, total)


@query(_SPACE + f" SELECT src, dst, {_r('0.3 / count(*) OVER (PARTITION BY src)', 'p')} FROM total UNION ALL SELECT DISTINCT pathname, pathname, CAST(0.7 AS DOUBLE) FROM net")
def transition_matrix(spark, d):
    if classes := _alike(spark, d):
        return classes.transitions(digits=6)
    return _transitions(spark, d).select("src", "dst", r6("p"))


@query(_SPACE + ", reach(pathname, other) AS (SELECT DISTINCT pathname, pathname FROM net UNION SELECT r.pathname, t.dst FROM reach r JOIN total t ON r.other = t.src) SELECT pathname, min(other) AS component FROM reach GROUP BY pathname")
def connected_components(spark, d):
    return _components(spark, d)


@query(_SPACE + ", paths AS (SELECT DISTINCT pathname FROM net) SELECT p.pathname, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM total t WHERE t.src = p.pathname), '') AS neighbours FROM paths p")
def neighbour_lists(spark, d):
    classes = _alike(spark, d)
    paths, *_, total = _edges(spark, d)
    lists = classes.neighbour_lists() if classes else network.neighbour_lists(paths, total)
    return lists.select("pathname", F.concat_ws(",", "neighbours").alias("neighbours"))


_REACH = _SPACE + """, reach(pathname, other) AS (SELECT DISTINCT pathname, pathname FROM net UNION SELECT r.pathname, t.dst FROM reach r JOIN total t ON r.other = t.src),
comp AS (SELECT pathname, min(other) AS component FROM reach GROUP BY pathname), sz AS (SELECT component, count(*) AS paths FROM comp GROUP BY component)"""


@query(_ANC + _REACH + """ SELECT (SELECT count(DISTINCT pathname) FROM net) AS n_paths, (SELECT count(DISTINCT node) FROM nodes) AS n_nodes, (SELECT count(*) FROM seg) AS n_segments, (SELECT count(*) FROM anc) AS n_internal_points,
 (SELECT count(*) FROM strict) AS adjacency_strict, (SELECT count(*) FROM space) AS adjacency_space, (SELECT count(*) FROM total) AS adjacency_total, (SELECT count(*) FROM sz) AS n_components, (SELECT max(paths) FROM sz) AS max_component""")
def network_meta(spark, d):
    n = net(spark, d)
    tables = network.snapped_nodes(network.path_ends(n)), network.segments_of(_points(spark, d)), network.anchors(n)
    if classes := _alike(spark, d):
        return network.meta(n.select("pathname").distinct(), *tables, None, None, None, classes.components(), classes.counts())
    paths, strict, space, total = _edges(spark, d)
    return network.meta(paths, *tables, strict, space, total, network.components(paths, total))


@query(_REACH + " SELECT rank, component, paths FROM (SELECT row_number() OVER (ORDER BY paths DESC, component) AS rank, * FROM sz) q WHERE rank <= 8")
def largest_components(spark, d):
    return network.largest_components(_components(spark, d))


@query(_EN + """, ends AS (SELECT *, row_number() OVER (ORDER BY pathname, side) AS i, round_even(x, 0) AS kx, round_even(z, 0) AS kz FROM pe),
greedy(i, node, centres) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS STRUCT(n BIGINT, x DOUBLE, z DOUBLE, kx DOUBLE, kz DOUBLE)[])
 UNION ALL SELECT i, coalesce(hit, len(centres)), CASE WHEN hit IS NULL THEN list_append(centres, {'n': CAST(len(centres) AS BIGINT), 'x': round(x, 2), 'z': round(z, 2), 'kx': kx, 'kz': kz}) ELSE centres END
 FROM (SELECT e.*, centres, list_sort(list_transform(list_filter(centres, lambda c: abs(c.kx - e.kx) <= 1 AND abs(c.kz - e.kz) <= 1 AND sqrt((c.x - e.x) ** 2 + (c.z - e.z) ** 2) <= 1), lambda c: {'kx': c.kx, 'kz': c.kz, 'n': c.n}))[1].n AS hit FROM greedy g JOIN ends e ON e.i = g.i + 1) q)
SELECT pathname, side, node FROM greedy JOIN ends USING (i)""")
def greedy_nodes(spark, d):
    return network.greedy_nodes(network.path_ends(net(spark, d)), ["pathname", "side"]).select("pathname", "side", "node")


@query(""", m AS (SELECT path_no + CASE WHEN path_no % 11 = 4 THEN 1000000 ELSE 0 END AS path_no, seg_idx, CASE WHEN path_no % 7 = 3 THEN ax + 1 ELSE ax END AS ax, CASE WHEN seg_idx % 6 = 5 THEN az - 2 ELSE az END AS az FROM net),
d AS (SELECT coalesce(o.path_no, m.path_no) AS path_no, coalesce(o.seg_idx, m.seg_idx) AS seg_idx, CASE WHEN m.path_no IS NULL THEN 'missing' WHEN o.path_no IS NULL THEN 'extra' WHEN o.ax IS DISTINCT FROM m.ax OR o.az IS DISTINCT FROM m.az THEN 'changed' END AS status,
 CASE WHEN o.path_no IS NULL OR m.path_no IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.ax IS DISTINCT FROM m.ax THEN 'ax' END, CASE WHEN o.az IS DISTINCT FROM m.az THEN 'az' END) END AS columns FROM net o FULL JOIN m ON o.path_no = m.path_no AND o.seg_idx = m.seg_idx)
SELECT * FROM d WHERE status IS NOT NULL""")
def network_compare(spark, d):
    """The network against one with some paths renamed and some vertices moved."""
    old = net(spark, d).select("path_no", "seg_idx", "ax", "az")
    new = old.select(
        (F.col("path_no") + F.when(F.col("path_no") % 11 == 4, 1_000_000).otherwise(0)).alias("path_no"), "seg_idx",
        F.when(F.col("path_no") % 7 == 3, F.col("ax") + 1).otherwise(F.col("ax")).alias("ax"), F.when(F.col("seg_idx") % 6 == 5, F.col("az") - 2).otherwise(F.col("az")).alias("az"),
    )
    return network.compare(old, new, ["path_no", "seg_idx"])


# OpenStreetMap shapes over the order tables: orders are ways, lines their positions, parts the nodes

_WAYS = ", wn AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS node FROM lineitem), uses AS (SELECT node, count(DISTINCT way) AS ways FROM wn GROUP BY node)"


def _way_nodes(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("way"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_partkey").alias("node"))


@query(_WAYS + """, c AS (SELECT wn.*, ways >= 2 AND pos > min(pos) OVER (PARTITION BY way) AND pos < max(pos) OVER (PARTITION BY way) AS cut FROM wn JOIN uses ON wn.node = uses.node),
p AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos ROWS UNBOUNDED PRECEDING) AS piece FROM c)
SELECT way, CAST(piece AS BIGINT) AS piece, pos, node FROM p UNION ALL SELECT way, CAST(piece - 1 AS BIGINT), pos, node FROM p WHERE cut""")
def junction_split(spark, d):
    return network.split_at_junctions(_way_nodes(spark, d))


_PIECES = _WAYS + """, c AS (SELECT wn.*, ways >= 2 AND pos > min(pos) OVER (PARTITION BY way) AND pos < max(pos) OVER (PARTITION BY way) AS cut FROM wn JOIN uses ON wn.node = uses.node),
p AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos ROWS UNBOUNDED PRECEDING) AS piece FROM c), pieces AS (SELECT way, CAST(piece AS BIGINT) AS piece, pos, node FROM p UNION ALL SELECT way, CAST(piece - 1 AS BIGINT), pos, node FROM p WHERE cut),
named AS (SELECT *, kind || '-' || row_number() OVER (PARTITION BY kind ORDER BY way, piece) AS pathname FROM (SELECT DISTINCT way, piece, CASE WHEN way % 3 = 0 THEN 'R' ELSE 'N' END AS kind FROM pieces) q)"""


@query(_PIECES + " SELECT p.way, p.piece, p.pos, p.node, pathname, row_number() OVER (ORDER BY kind, p.way, p.piece, p.pos) - 1 AS pointname FROM pieces p JOIN named n ON p.way = n.way AND p.piece = n.piece")
def path_point_numbers(spark, d):
    pieces = network.split_at_junctions(_way_nodes(spark, d))
    kinds = pieces.select("way", "piece").distinct().withColumn("kind", F.when(F.col("way") % 3 == 0, "R").otherwise("N"))
    return network.numbered_points(pieces, kinds)


@query(" SELECT p_partkey AS node, 'J' || (row_number() OVER (ORDER BY p_size DESC, p_partkey % 50, p_partkey) - 1) AS label FROM part")
def junction_labels(spark, d):
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("lat"), (F.col("p_partkey") % 50).alias("lon"))
    return network.junction_numbers(nodes).select("node", "label")


@query(_WAYS + """, w AS (SELECT o_orderkey AS way, o_custkey AS relation, o_orderstatus = 'F' AS kept FROM orders), r AS (SELECT c_custkey AS relation, c_mktsegment = 'BUILDING' AS kept FROM customer),
kw AS (SELECT way FROM w WHERE kept UNION SELECT w.way FROM w JOIN r ON w.relation = r.relation AND r.kept), kn AS (SELECT wn.node FROM wn JOIN kw ON wn.way = kw.way UNION SELECT p_partkey FROM part WHERE p_size = 7)
SELECT 'relation' AS kind, relation AS id FROM r WHERE kept UNION ALL SELECT 'way', way FROM kw UNION ALL SELECT 'node', node FROM kn""")
def keep_set_closure(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    ways = o.select(F.col("o_orderkey").alias("way"), (F.col("o_orderstatus") == "F").alias("kept"))
    members = o.select(F.col("o_custkey").alias("relation"), F.col("o_orderkey").alias("way"))
    relations = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("relation"), (F.col("c_mktsegment") == "BUILDING").alias("kept"))
    nodes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), (F.col("p_size") == 7).alias("kept"))
    return network.keep_closure(ways, _way_nodes(spark, d), members, relations, nodes)


@query(_WAYS + " SELECT way, node FROM wn WHERE node NOT IN (SELECT ps FROM (SELECT s_suppkey AS ps FROM supplier) q) GROUP BY way, node")
def dangling_references(spark, d):
    source = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("node"))
    return network.dangling(_way_nodes(spark, d), source)


@query(" SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY o_orderstatus")
def kind_histogram(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))


@query(_ARC + f""", p AS (SELECT pathname, sum(length) AS len, count(*) + 1 AS pts FROM arc GROUP BY pathname)
SELECT count(*) AS paths, {_r('sum(len)', 'total')}, {_r('avg(pts)', 'mean_points')}, {_r('quantile_cont(pts, 0.5)', 'median_points')}, max(pts) AS max_points FROM p""")
def path_statistics(spark, d):
    p = network.arc_lengths(net(spark, d)).groupBy("pathname").agg(F.sum("length").alias("len"), (F.count("*") + 1).alias("pts"))
    return p.agg(F.count("*").alias("paths"), r6(F.sum("len"), "total"), r6(F.avg("pts"), "mean_points"), r6(F.percentile("pts", F.lit(0.5)), "median_points"), F.max("pts").alias("max_points"))


@query(f" SELECT {_r('avg(ax)', 'x')}, {_r('avg(az)', 'z')}, {_r('min(least(ax, bx)) - 800', 'x0')}, {_r('max(greatest(ax, bx)) + 800', 'x1')}, {_r('min(least(az, bz)) - 800', 'z0')}, {_r('max(greatest(az, bz)) + 800', 'z1')} FROM net")
def centroid_and_box(spark, d):
    return extract.centroid_box(net(spark, d), 800.0).select(*map(r6, ("x", "z", "x0", "x1", "z0", "z1")))


# functions


def _pmod(a: str) -> str:
    return f"((({a}) % 360 + 360) % 360)"


_AB = f", ab AS (SELECT *, coalesce(angle_self, 0.0) AS a, coalesce(angle_graph, 0.0) AS b, event_id % 3 + 1.5 AS w FROM obs), ab2 AS (SELECT *, least(abs(a - b) % 360, 360 - abs(a - b) % 360) AS d FROM ab)"
_SINES = "w * sin(radians(a)) + 2 * sin(radians(b)), w * cos(radians(a)) + 2 * cos(radians(b))"


@query(_AB + f""" SELECT traj_id, seq, {_r('d', 'unsigned')}, {_r(_pmod('a - b + 180') + ' - 180', 'signed')}, {_r('CASE WHEN d > 90 THEN 180 - d ELSE d END', 'axis')},
 {_r(f"CASE WHEN {_diff(_pmod('a'), _pmod('b'))} > 90 THEN {_pmod('a + 180')} ELSE {_pmod('a')} END", 'facing')}, {_r(_pmod(f'degrees(atan2({_SINES}))'), 'mean')} FROM ab2""")
def angle_functions(spark, d):
    rows = obs(spark, d).withColumn("a", F.coalesce("angle_self", F.lit(0.0))).withColumn("b", F.coalesce("angle_graph", F.lit(0.0))).withColumn("w", F.col("event_id") % 3 + 1.5)
    turned = angles.facing(angles.wrap360("a"), angles.wrap360("b"))
    return rows.select(*KEY, r6(angles.angle_error_any("a", "b"), "unsigned"), r6(angles.signed_difference("a", "b"), "signed"), r6(angles.axis_difference("a", "b"), "axis"), r6(turned, "facing"), r6(angles.circular_mean([("a", "w"), ("b", F.lit(2.0))]), "mean"))


@query(f" SELECT traj_id, {_r(_pmod('degrees(atan2(sum((event_id % 7 + 1) * sin(radians(angle_graph))), sum((event_id % 7 + 1) * cos(radians(angle_graph)))))'), 'mean')} FROM obs GROUP BY traj_id")
def circular_mean_of_track(spark, d):
    return obs(spark, d).groupBy("traj_id").agg(r6(angles.circular_mean_agg("angle_graph", F.col("event_id") % 7 + 1), "mean"))


_FEET = """, on_net AS (SELECT o.*, ax, az, bx, bz, bx - ax AS dx, bz - az AS dz, (x - ax) * (bx - ax) + (z - az) * (bz - az) AS dot, (bx - ax) ** 2 + (bz - az) ** 2 AS d2 FROM obs o JOIN net n ON n.path_no = o.event_id % 25 AND n.seg_idx = o.event_id % 19),
feet AS (SELECT *, greatest(0.0, least(1.0, dot / (d2 + 1e-6))) AS ts, greatest(0.0, least(1.0, dot / d2)) AS tg FROM on_net)"""


@query(_FEET + f" SELECT traj_id, seq, {_r('ax + ts * dx', 'soft_x')}, {_r('az + ts * dz', 'soft_z')}, {_r('CASE WHEN d2 < 1e-9 THEN ax ELSE ax + tg * dx END', 'guarded_x')}, {_r('CASE WHEN d2 < 1e-9 THEN az ELSE az + tg * dz END', 'guarded_z')} FROM feet")
def projections(spark, d):
    near = net(spark, d).select("path_no", "seg_idx", "ax", "az", "bx", "bz")
    o = obs(spark, d)
    rows = o.join(near, (F.col("path_no") == F.col("event_id") % 25) & (F.col("seg_idx") == F.col("event_id") % 19))
    ends = ("x", "z", "ax", "az", "bx", "bz")
    soft, guarded = geometry.project_soft(*ends), geometry.project_guarded(*ends)
    return rows.select(*KEY, r6(soft[0], "soft_x"), r6(soft[1], "soft_z"), r6(guarded[0], "guarded_x"), r6(guarded[1], "guarded_z"))


@query(f""" SELECT traj_id, seq, {_r('0.5 * x - 0.25 * z + 10', 'affine_x')}, {_r('0.25 * x + 0.5 * z - 7', 'affine_z')}, {_r('(x / 1000 - 108) * 111320.0 * cos(radians(34)) / 1000', 'east_km')}, {_r('(z / 1000 - 34) * 110540.0 / 1000', 'north_km')},
 {_r('CAST(CAST(x * 0.1 AS FLOAT) AS DOUBLE)', 'single')}, {_r('greatest(-50, least(200, x))', 'clipped')}, strftime(make_timestamp((t + 1700000000 + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS time, strlen(event_type) AS bytes, left(sha1(event_type), 12) AS digest FROM obs""")
def plane_and_labels(spark, d):
    rows = obs(spark, d)
    a = geometry.affine("x", "z", (0.5, -0.25, 10.0, 0.25, 0.5, -7.0))
    e = geometry.equidistant(F.col("x") / 1000, F.col("z") / 1000, 108.0, 34.0)
    size, digest = geometry.content_digest("event_type")
    return rows.select(*KEY, r6(a[0], "affine_x"), r6(a[1], "affine_z"), r6(e[0] / 1000, "east_km"), r6(e[1] / 1000, "north_km"), r6(geometry.float32(F.col("x") * 0.1), "single"), r6(geometry.clip("x", -50.0, 200.0), "clipped"), geometry.local_time(F.col("t") + 1700000000).alias("time"), size.cast("bigint").alias("bytes"), digest.alias("digest"))


@query(", m AS (SELECT *, CAST(CAST(floor(t / 60) AS BIGINT) AS VARCHAR) AS day FROM obs) SELECT day, count(DISTINCT traj_id) AS tracks, count(*) AS points FROM m GROUP BY ROLLUP (day)")
def daily_totals(spark, d):
    """Minutes stand for days, as the tracks are shorter than a day."""
    return extract.daily_totals(obs(spark, d).withColumn("day", F.floor(F.col("t") / 60).cast("string")))


@query(f", rw AS (SELECT concat('rw', CAST(path_no AS VARCHAR)) AS name, * FROM features WHERE kind = 'runway'), best AS (SELECT traj_id, name, min({_distance_sql()}) AS distance FROM obs, rw GROUP BY traj_id, name), top AS (SELECT traj_id, min(struct_pack(d := distance, n := name)) AS b FROM best GROUP BY traj_id) SELECT traj_id, CASE WHEN b.d <= 175 THEN b.n ELSE '' END AS name FROM top")
def nearest_runway(spark, d):
    runways = features(spark, d).where("kind = 'runway'").select(F.concat(F.lit("rw"), F.col("path_no").cast("string")).alias("name"), "ax", "az", "bx", "bz")
    return extract.runway_of(obs(spark, d), runways)


@query(", raw AS (SELECT traj_id, seq, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(x AS VARCHAR) END AS a, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS b FROM obs) SELECT traj_id, seq, TRY_CAST(a AS DOUBLE) AS a, TRY_CAST(b AS DOUBLE) AS b FROM raw WHERE TRY_CAST(a AS DOUBLE) IS NOT NULL")
def tolerant_numbers(spark, d):
    raw = obs(spark, d).select(*KEY, F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("x").cast("string")).alias("a"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_id").cast("string")).alias("b"))
    return extract.tolerant(raw, needed=("a",), wanted=("b",))


# candidates, matching

_PAIRS = f", gid AS (SELECT *, row_number() OVER (ORDER BY path_no, seg_idx) - 1 AS gid FROM net), pairs AS (SELECT traj_id, seq, x, z, gid, pathname, seg_idx, ax, az, bx, bz, {_distance_sql()} AS distance FROM obs, gid)"


@query(_PAIRS + f" SELECT traj_id, seq, gid, {_r('distance')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY round(distance, 9), gid) AS rank FROM pairs WHERE distance < 150) q WHERE rank <= 8")
def nearest_segments_topk(spark, d):
    return matcher.nearest_segments(obs(spark, d), estimator.load_network(net(spark, d)), 8, 150.0).select(*KEY, "gid", r6("distance"), "rank")


@query(_PAIRS + """, best AS (SELECT traj_id, seq, gid FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY round(distance, 9), gid) AS rank FROM pairs WHERE distance < 150) q WHERE rank = 1),
m AS (SELECT o.traj_id, o.seq, coalesce(b.gid, -1) AS gid FROM obs o LEFT JOIN best b ON o.traj_id = b.traj_id AND o.seq = b.seq),
c AS (SELECT *, CASE WHEN gid = lag(gid) OVER (PARTITION BY traj_id ORDER BY seq) THEN 0 ELSE 1 END AS s FROM m), g AS (SELECT *, sum(s) OVER (PARTITION BY traj_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT traj_id, CAST(run AS BIGINT) AS run, any_value(gid) AS gid, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS samples FROM g GROUP BY traj_id, run""")
def matched_runs(spark, d):
    found = matcher.nearest_segments(obs(spark, d), estimator.load_network(net(spark, d)), 1, 150.0)
    best = obs(spark, d).select(*KEY).join(found.select(*KEY, "gid"), list(KEY), "left").withColumn("gid", F.coalesce("gid", F.lit(-1).cast("bigint")))
    changed = ~F.col("gid").eqNullSafe(F.lag("gid").over(windows.ordered()))
    return windows.islands(best, changed, out="run").groupBy("traj_id", "run").agg(F.first("gid").alias("gid"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("samples"))


_EMIT = _FILL + _PAIRS.replace(", gid AS", ", gid AS", 1) + f""", dirs2 AS (SELECT p.*, f.observation_dir AS od, {_bearing360('bx - ax', 'bz - az')} AS fwd FROM pairs p JOIN fill f ON p.traj_id = f.traj_id AND p.seq = f.seq),
errs AS (SELECT *, CASE WHEN od IS NULL THEN 0 ELSE least({_diff('fwd', 'od')}, {_diff('((fwd + 180) % 360)', 'od')}) END AS err, CASE WHEN od IS NULL OR {_diff('fwd', 'od')} <= {_diff('((fwd + 180) % 360)', 'od')} THEN fwd ELSE (fwd + 180) % 360 END AS seg_dir FROM dirs2),
em AS (SELECT *, exp(-distance * distance / 3200) * exp(-err * err / 5000) AS emission FROM errs), ranked AS (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY round(emission, 12) DESC, gid) AS rank FROM em)"""


@query(_EMIT + f" SELECT traj_id, seq, rank, gid, {_r('emission')}, {_r('distance')}, {_r('err', 'angle_error')} FROM ranked WHERE rank <= 8")
def emission_topk(spark, d):
    """Candidates among all segments around the raw positions; estimate_tracks takes the smoothed ones and anchors."""
    rows = windows.filled_direction(windows.window_direction(obs(spark, d)))
    return estimator.emission(rows, estimator.load_network(net(spark, d)), position=("x", "z")).select(*KEY, "rank", "gid", r6("emission"), r6("distance"), r6("angle_error"))


def _knn_sql(points: str) -> str:
    """(traj_id, seq, p, s, d): the 64 nearest anchors of each point, by cells where these have enough, else among all."""
    far = "round(sqrt((o.x - a.x) ** 2 + (o.z - a.z) ** 2), 9)"
    return f""", acell AS (SELECT pathname, seg_idx, along, x, z, CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(z / 20) AS BIGINT) AS cz FROM anc),
ocell AS (SELECT traj_id, seq, x, z, CAST(floor(x / 20) AS BIGINT) + i AS cx, CAST(floor(z / 20) AS BIGINT) + j AS cz FROM {points}, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)),
close AS (SELECT traj_id, seq, min(struct_pack(d := {far}, p := pathname, s := seg_idx, g := along), 64) AS k FROM ocell o JOIN acell a ON o.cx = a.cx AND o.cz = a.cz WHERE {far} <= 20 GROUP BY traj_id, seq),
rest AS (SELECT * FROM {points} p WHERE NOT EXISTS (SELECT 1 FROM close c WHERE c.traj_id = p.traj_id AND c.seq = p.seq AND len(k) = 64)),
wide AS (SELECT traj_id, seq, min(struct_pack(d := {far}, p := pathname, s := seg_idx, g := along), 64) AS k FROM rest o, anc a GROUP BY traj_id, seq),
knn AS (SELECT traj_id, seq, unnest(k) AS k FROM close WHERE len(k) = 64 UNION ALL SELECT traj_id, seq, unnest(k) FROM wide)"""


@query(_ANC + _knn_sql("obs") + f""", gid AS (SELECT pathname, seg_idx, row_number() OVER (ORDER BY path_no, seg_idx) - 1 AS gid FROM net), owners AS (SELECT traj_id, seq, gid, min(k.d) AS distance FROM knn JOIN gid ON gid.pathname = k.p AND gid.seg_idx = k.s GROUP BY traj_id, seq, gid)
SELECT traj_id, seq, gid, {_r('distance')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY distance, gid) AS rank FROM owners) q WHERE rank <= 16""")
def knn_anchor_segments(spark, d):
    n = net(spark, d)
    return estimator.anchor_segments(obs(spark, d), estimator.load_network(n, shapes=network.shape_anchors(n)), 64, 16).select(*KEY, "gid", r6("distance"), "rank")


# estimator

_GAINS = """, g(i, kp, kv, p11, p12, p22) AS (SELECT 0, a / (a + 5), b / (a + 5), (1 - a / (a + 5)) * a, (1 - a / (a + 5)) * b, dd - b / (a + 5) * b FROM (SELECT CAST(1000.1 AS DOUBLE) AS a, CAST(500 AS DOUBLE) AS b, CAST(501 AS DOUBLE) AS dd) q
 UNION ALL SELECT i + 1, a / (a + 5), b / (a + 5), (1 - a / (a + 5)) * a, (1 - a / (a + 5)) * b, dd - b / (a + 5) * b FROM (SELECT i, p11 + 2 * p12 + p22 + 0.1 AS a, p12 + p22 AS b, p22 + 1 AS dd FROM g) q WHERE i < 199)"""


@query(_GAINS + f" SELECT i, {_r('kp')}, {_r('kv')} FROM g")
def kalman_gain_table(spark, d):
    return estimator.gain_table(spark, 200).select("i", r6("kp"), r6("kv"))


_KF = _GAINS + """, kf(traj_id, seq, kx, kz, vx, vz, rx, rz) AS (SELECT traj_id, 0, x, z, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM obs WHERE seq = 0
 UNION ALL SELECT k.traj_id, k.seq + 1, kx + vx + kp * (o.x - kx - vx), kz + vz + kp * (o.z - kz - vz), vx + kv * (o.x - kx - vx), vz + kv * (o.z - kz - vz), o.x - kx - vx, o.z - kz - vz
 FROM kf k JOIN obs o ON o.traj_id = k.traj_id AND o.seq = k.seq + 1 JOIN g ON g.i = k.seq + 1)"""


@query(_KF + f" SELECT traj_id, CAST(seq AS BIGINT) AS seq, {_r('kx', 'kf_x')}, {_r('kz', 'kf_z')}, {_r('vx', 'kf_vx')}, {_r('vz', 'kf_vz')}, {_r('sqrt(vx * vx + vz * vz)', 'kf_speed')}, {_r('sqrt(rx * rx + rz * rz)', 'innovation_residual')} FROM kf")
def kalman_track(spark, d):
    return estimator.motion(obs(spark, d)).select("traj_id", F.col("seq").cast("bigint").alias("seq"), *map(r6, ("kf_x", "kf_z", "kf_vx", "kf_vz", "kf_speed", "innovation_residual")))


def _network(spark, d, anchors: bool = True):
    n = net(spark, d)
    shapes = network.shape_anchors(n) if anchors else None
    if classes := _alike(spark, d):
        return estimator.load_network(n, classes=classes, shapes=shapes)
    return estimator.load_network(n, _transitions(spark, d), shapes=shapes)


def _any_network(spark, d):
    """As arrays, or as tables if it is too large for that."""
    shared_dir(spark)
    n = net(spark, d).checkpoint()
    shapes = network.shape_anchors(n)
    if (classes := _alike(spark, d)) and n.count() <= estimator.MOST_SEGMENTS and (shapes.agg(F.sum(F.size("x"))).first()[0] or 0) <= estimator.MOST_ANCHORS:
        return estimator.load_network(n, classes=classes, shapes=shapes)
    paths, *_, total = _edges(spark, d)
    return estimator.network_of(n, network.transitions(paths, total).checkpoint(), network.anchors(n))


def _measured(spark, d) -> DataFrame:
    """What the estimator takes of the samples."""
    return obs(spark, d).select(*KEY, "origin_lon", "origin_lat", "angle_self", "angle_graph", "x", "z")


# Decoding in SQL: scores of a sample's candidates are a list, which one recursion carries along all tracks at once.

_CLEAN = ", clean AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS seq FROM obs WHERE origin_lon IS NOT NULL AND origin_lat IS NOT NULL AND NOT (abs(origin_lon) < 1e-9 AND abs(origin_lat) < 1e-9))"
_SMOOTH = (_FILL + _KF).replace("FROM obs", "FROM clean").replace("JOIN obs o", "JOIN clean o") + f""", kp AS MATERIALIZED (SELECT traj_id, seq, kx AS x, kz AS z, sqrt(vx * vx + vz * vz) AS speed, {_bearing360('vx', 'vz')} AS kf_dir, sqrt(rx * rx + rz * rz) AS residual FROM kf)"""
_OWNED = f""", numbers AS (SELECT *, row_number() OVER (ORDER BY path_no, seg_idx) - 1 AS gid, {_bearing360('bx - ax', 'bz - az')} AS fwd FROM net),
owned AS (SELECT DISTINCT k.traj_id, k.seq, n.gid FROM knn k JOIN numbers n ON n.pathname = k.k.p AND n.seg_idx = k.k.s)"""
_CANDS = _CLEAN + _SMOOTH + _ANC + _knn_sql("kp") + _OWNED + f""", near_segs AS (SELECT o.traj_id, o.seq, n.gid, n.pathname, n.seg_idx, n.ax, n.az, n.bx, n.bz, n.fwd, f.observation_dir AS od, {_distance_sql()} AS distance FROM owned o JOIN numbers n ON n.gid = o.gid JOIN kp p ON p.traj_id = o.traj_id AND p.seq = o.seq JOIN (SELECT traj_id, seq, observation_dir FROM fill) f ON f.traj_id = o.traj_id AND f.seq = o.seq),
erred AS (SELECT *, CASE WHEN od IS NULL THEN 0 ELSE least({_diff('fwd', 'od')}, {_diff('((fwd + 180) % 360)', 'od')}) END AS err, CASE WHEN od IS NULL OR {_diff('fwd', 'od')} <= {_diff('((fwd + 180) % 360)', 'od')} THEN fwd ELSE (fwd + 180) % 360 END AS dir FROM near_segs),
weighed AS (SELECT *, exp(-distance * distance / 3200) * exp(-err * err / 5000) AS e FROM erred),
cand AS MATERIALIZED (SELECT *, ln(e + 1e-12) AS own FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY round(e, 12) DESC, gid) AS r FROM weighed) q WHERE r <= 8)"""
_MOVES = ", moves AS (SELECT src, dst, (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) / count(*) OVER (PARTITION BY src) AS p FROM total UNION ALL SELECT DISTINCT pathname, pathname, CAST(0.7 AS DOUBLE) FROM net)"
_DECODED = _CANDS + _SPACE + _MOVES + f""", pair AS (SELECT c.traj_id, c.seq, c.r AS j, a.r AS i, ln(m.p + 1e-12) AS m, CASE WHEN c.pathname = a.pathname AND abs(c.seg_idx - a.seg_idx) <= 1 THEN 0.5 ELSE 0.0 END AS near,
 -(({_diff('a.dir', 'c.dir')}) ** 2) / (2 * 35.0 * 35.0 + 1e-12) * CASE WHEN k.speed < 3 THEN 0.5 ELSE 1.0 END AS turn, c.own FROM cand c JOIN cand a ON a.traj_id = c.traj_id AND a.seq = c.seq - 1 JOIN kp k ON k.traj_id = c.traj_id AND k.seq = c.seq LEFT JOIN moves m ON m.src = a.pathname AND m.dst = c.pathname),
lists AS (SELECT traj_id, seq, j, list(struct_pack(m := m, near := near, turn := turn, own := own) ORDER BY i) AS l FROM pair GROUP BY traj_id, seq, j),
steps_in AS MATERIALIZED (SELECT traj_id, seq, list(l ORDER BY j) AS l FROM lists GROUP BY traj_id, seq), owns AS MATERIALIZED (SELECT traj_id, seq, list(own ORDER BY r) AS own FROM cand GROUP BY traj_id, seq),
vit(traj_id, seq, score, back) AS (SELECT traj_id, seq, own, CAST([] AS BIGINT[]) FROM owns WHERE seq = 0
 UNION ALL SELECT traj_id, seq, CASE WHEN list_max(list_transform(t, lambda x: list_max(x))) IS NULL THEN list_transform(range(1, len(t) + 1), lambda k: CASE WHEN k = 1 THEN own[1] END) ELSE list_transform(t, lambda x: list_max(x)) END,
  list_transform(t, lambda x: CAST(coalesce(list_position(x, list_max(x)), 1) AS BIGINT))
 FROM (SELECT s.traj_id, s.seq, o.own, list_transform(s.l, lambda row: list_transform(range(1, len(row) + 1), lambda i: v.score[i] + row[i].m + row[i].own + row[i].near + row[i].turn)) AS t FROM vit v JOIN steps_in s ON s.traj_id = v.traj_id AND s.seq = v.seq + 1 JOIN owns o ON o.traj_id = s.traj_id AND o.seq = s.seq) q),
bt(traj_id, seq, r, score) AS (SELECT traj_id, seq, CAST(list_position(score, list_max(score)) AS BIGINT), list_max(score) FROM vit v WHERE seq = (SELECT max(seq) FROM vit w WHERE w.traj_id = v.traj_id)
 UNION ALL SELECT v.traj_id, v.seq, n.back[b.r], v.score[n.back[b.r]] FROM bt b JOIN vit n ON n.traj_id = b.traj_id AND n.seq = b.seq JOIN vit v ON v.traj_id = b.traj_id AND v.seq = b.seq - 1)"""


@query(_DECODED + f" SELECT b.traj_id, b.seq, c.pathname AS temporal_best_path, c.seg_idx AS temporal_segment_index, {_r('coalesce(b.score, 0.0)', 'temporal_log_probability')} FROM bt b JOIN cand c ON c.traj_id = b.traj_id AND c.seq = b.seq AND c.r = b.r")
def viterbi_path(spark, d):
    out = estimator.decoded(windows.drop_missing(_measured(spark, d)), _any_network(spark, d), tops=False)
    return out.select(*KEY, "temporal_best_path", "temporal_segment_index", r6("temporal_log_probability"))


def _facing(a: str, b: str) -> str:
    return f"CASE WHEN {_diff(a, b)} > 90 THEN ({a} + 180) % 360 ELSE {a} END"


_REFINED = _DECODED + f""", best AS (SELECT c.* FROM bt b JOIN cand c ON c.traj_id = b.traj_id AND c.seq = b.seq AND c.r = b.r),
around AS (SELECT c.traj_id, c.seq, sum(CASE WHEN c.pathname = b.pathname THEN c.e ELSE 0 END) AS topo, {_pmod('degrees(atan2(sum(c.e * sin(radians(c.dir))), sum(c.e * cos(radians(c.dir)))))')} AS circular FROM cand c JOIN best b ON b.traj_id = c.traj_id AND b.seq = c.seq GROUP BY c.traj_id, c.seq),
fused AS (SELECT b.traj_id, b.seq, b.pathname, b.ax, b.az, b.bx, b.bz, k.x, k.z, k.speed, k.kf_dir, k.residual, f.win_dir, a.topo, a.circular, {_REFDIR.replace('angle_graph', 'f.angle_graph').replace('angle_self', 'f.angle_self')} AS refdir,
 CASE WHEN sqrt((b.bx - b.ax) ** 2 + (b.bz - b.az) ** 2) > 1e-6 THEN b.fwd END AS axis, f.win_dir IS NOT NULL AND k.speed >= 3 AS moving FROM best b JOIN kp k ON k.traj_id = b.traj_id AND k.seq = b.seq JOIN fill f ON f.traj_id = b.traj_id AND f.seq = b.seq JOIN around a ON a.traj_id = b.traj_id AND a.seq = b.seq),
turned AS (SELECT *, {_facing('axis', 'win_dir')} AS ahead FROM fused), agreed AS (SELECT *, CASE WHEN moving AND {_diff('ahead', 'win_dir')} < 45 THEN ahead END AS agreed FROM turned),
lasts AS (SELECT *, last_value(agreed IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM agreed),
topos AS (SELECT *, coalesce(CASE WHEN moving THEN ahead WHEN win_dir IS NOT NULL THEN CASE WHEN last IS NOT NULL THEN {_facing('axis', 'last')} ELSE axis END ELSE {_facing('axis', 'refdir')} END, circular) AS td, exp(-(residual * residual) / 3200) AS mc, least(1.0, 20 * topo) AS tc,
 greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / ((bx - ax) ** 2 + (bz - az) ** 2 + 1e-6))) AS foot FROM lasts),
mixed AS (SELECT *, CASE WHEN speed < 3 THEN 0.0 ELSE greatest(0.0, least(0.9, least(mc / (mc + tc + 1e-6), speed / (speed + 20)))) END AS alpha FROM topos)"""


@query(_REFINED + f""" SELECT traj_id, seq, {_r('0.25 * x + 0.75 * (ax + foot * (bx - ax))', 'fusion_x')}, {_r('0.25 * z + 0.75 * (az + foot * (bz - az))', 'fusion_z')},
 {_r(_pmod('degrees(atan2(alpha * sin(radians(kf_dir)) + (1 - alpha) * sin(radians(td)), alpha * cos(radians(kf_dir)) + (1 - alpha) * cos(radians(td))))'), 'fusion_dir')}, {_r('alpha', 'fusion_alpha')}, pathname AS fusion_path FROM mixed""")
def refined_state(spark, d):
    out = estimator.run(_measured(spark, d), _any_network(spark, d), tops=False)
    return out.select(*KEY, *map(r6, ("fusion_x", "fusion_z", "fusion_dir", "fusion_alpha")), "fusion_path")


@query()
def matcher_viterbi(spark, d):
    out = matcher.map_match(obs(spark, d), net(spark, d))
    return out.select(*KEY, "graph_seg_idx", r6("graph_match_dist"))


@query()
def map_match(spark, d):
    out = matcher.map_match(obs(spark, d), net(spark, d))
    return out.select(*KEY, r6("angle_self_new"), r6("angle_graph_new"), "graph_seg_idx", r6("graph_match_dist"))


def _baseline(name):
    def f(spark, d):
        bare = {"ekf": lambda: None, "thmm": lambda: estimator.load_network(net(spark, d)), "kf_hmm": lambda: estimator.load_network(net(spark, d))}
        out = baselines.METHODS[name](obs(spark, d), bare.get(name, lambda: _network(spark, d))())
        return out.select(*KEY, *map(r6, ("est_x", "est_z", "est_dir")))

    f.__name__ = f"{name}_baseline"
    return query()(f)


for _name in ("ekf", "thmm", "hmm_mm", "kf_hmm"):
    _baseline(_name)


# scoring

def _metrics_sql(e: str, p: str) -> str:
    return ", ".join([_r(f"avg(abs({e}))", f"{p}_mae"), _r(f"sqrt(avg({e} * {e}))", f"{p}_rmse"), _r(f"stddev_pop({e})", f"{p}_std"), _r(f"quantile_cont(abs({e}), 0.5)", f"{p}_p50"), _r(f"quantile_cont(abs({e}), 0.9)", f"{p}_p90")])


_AGG = f"count(ex) AS n, {_metrics_sql('ex', 'x')}, {_metrics_sql('ez', 'z')}, {_metrics_sql('(CASE WHEN eh <= 150 THEN eh END)', 'h')}, count(*) FILTER (WHERE eh > 150) AS reversed"


def _errs(source: str, x: str, z: str, a: str) -> str:
    return f"SELECT traj_id, seq, flio, {x} - x AS ex, {z} - z AS ez, {_diff(a, _REFDIR)} AS eh FROM {source} WHERE {x} IS NOT NULL"


def _method_errors(rows: DataFrame, p: str) -> DataFrame:
    ref = windows.reference_direction(F.col("angle_graph"), F.col("angle_self"))
    rows = rows.withColumn("refdir", ref).withColumn("speed", F.lit(0.0)).where(F.col(f"{p}_x").isNotNull())
    return scoring.errors(rows, f"{p}_x", f"{p}_z", f"{p}_dir", "speed").select(*KEY, "flio", "ex", "ez", "eh")


_METRICS = [f"{p}_{m}" for p in "xzh" for m in ("mae", "rmse", "std", "p50", "p90")]


@query(_CVM + f", e AS ({_errs('cvm', 'cvm_x', 'cvm_z', 'cvm_dir')}) SELECT coalesce(flio, 'all') AS flio, {_AGG} FROM e GROUP BY ROLLUP (flio)")
def error_metrics_rollup(spark, d):
    errs = _method_errors(windows.extrapolated(obs(spark, d)), "cvm")
    return scoring.table(errs, ["flio"]).select("flio", "n", *map(r6, _METRICS), "reversed")


_TRUTH = f"traj_id, seq, flio, event_id % 45 <= 30 AS ok, {_REFDIR} AS refdir, x, z"


@query(_CVM + f", e AS (SELECT flio, CASE WHEN event_id % 45 <= 30 THEN cvm_x - x END AS ex, CASE WHEN event_id % 45 <= 30 THEN cvm_z - z END AS ez, CASE WHEN event_id % 45 <= 30 THEN {_diff('cvm_dir', _REFDIR)} END AS eh FROM cvm) SELECT coalesce(flio, 'all') AS flio, {_AGG} FROM e GROUP BY ROLLUP (flio)")
def error_metrics_masked(spark, d):
    """Samples faster than the mask allows have no errors; the speed is made up from the event's number."""
    rows = windows.extrapolated(obs(spark, d)).withColumn("refdir", windows.reference_direction(F.col("angle_graph"), F.col("angle_self"))).withColumn("speed", (F.col("event_id") % 45).cast("double"))
    return scoring.table(scoring.errors(rows, "cvm_x", "cvm_z", "cvm_dir", "speed"), ["flio"]).select("flio", "n", *map(r6, _METRICS), "reversed")


_COMPARED = _CVM + _F2V + f""", est AS (SELECT 'cvm' AS method, traj_id, seq, cvm_x AS est_x, cvm_z AS est_z, cvm_dir AS est_dir FROM cvm UNION ALL SELECT 'kf_hmm', traj_id, seq, f2v_x, f2v_z, CASE WHEN seq % 9 > 0 THEN f2v_dir END FROM f2v),
truth AS (SELECT {_TRUTH} FROM obs), er AS (SELECT method, flio, CASE WHEN ok THEN est_x - x END AS ex, CASE WHEN ok THEN est_z - z END AS ez, CASE WHEN ok THEN {_diff('est_dir', 'refdir')} END AS eh FROM est e JOIN truth t ON e.traj_id = t.traj_id AND e.seq = t.seq),
mk AS (SELECT *, method = 'cvm' OR (ex IS NOT NULL AND ez IS NOT NULL AND eh IS NOT NULL) AS counts FROM er), e AS (SELECT method, flio, CASE WHEN counts THEN ex END AS ex, CASE WHEN counts THEN ez END AS ez, CASE WHEN counts THEN eh END AS eh FROM mk)"""


@query(_COMPARED + f" SELECT method, coalesce(flio, 'all') AS flio, {_AGG} FROM e GROUP BY GROUPING SETS ((method, flio), (method))")
def comparison_table(spark, d):
    """The comparison's masks on two methods that SQL can express; the second is masked as the graph-prior ones are."""
    rows = obs(spark, d)
    est = windows.extrapolated(rows).select(F.lit("cvm").alias("method"), *KEY, F.col("cvm_x").alias("est_x"), F.col("cvm_z").alias("est_z"), F.col("cvm_dir").alias("est_dir"))
    est = est.unionByName(windows.trailing_motion(rows).select(F.lit("kf_hmm").alias("method"), *KEY, F.col("f2v_x").alias("est_x"), F.col("f2v_z").alias("est_z"), F.when(F.col("seq") % 9 > 0, F.col("f2v_dir")).alias("est_dir")))
    truth = rows.select(*KEY, "flio", "x", "z", (F.col("event_id") % 45).cast("double").alias("kf_speed"), windows.reference_direction(F.col("angle_graph"), F.col("angle_self")).alias("refdir"))
    return scoring.table(baselines.comparison_errors(est, truth), ["method", "flio"]).select("method", "flio", "n", *map(r6, _METRICS), "reversed")


@query()
def seven_methods(spark, d):
    """All seven methods by movement: the whole comparison."""
    rows, loaded = obs(spark, d), _network(spark, d)
    truth = estimator.motion(rows).select(*KEY, "flio", "x", "z", "kf_speed", "refdir")
    errs = baselines.comparison_errors(baselines.all_methods(rows, loaded), truth)
    return scoring.table(errs, ["method", "flio"]).select("method", "flio", "n", *map(r6, _METRICS), "reversed")


@query()
def layer_latency(spark, d):
    """Milliseconds a sample of each layer, one track at a time; the figures differ from run to run."""
    return scoring.latency(estimator.layer_timings(obs(spark, d), _network(spark, d))).select("layer", *map(r6, ("mean", "median", "p95", "p99", "max", "total", "share")))


_BOTH = _CVM + _F2V + f", e AS (SELECT 'CVM' AS method, q.* FROM ({_errs('cvm', 'cvm_x', 'cvm_z', 'cvm_dir')}) q UNION ALL SELECT 'Flight2Vec', q.* FROM ({_errs('f2v', 'f2v_x', 'f2v_z', 'f2v_dir')}) q)"


def _both(spark, d) -> DataFrame:
    rows = obs(spark, d)
    parts = [("CVM", windows.extrapolated(rows), "cvm"), ("Flight2Vec", windows.trailing_motion(rows), "f2v")]
    a, b = (_method_errors(r, p).withColumn("method", F.lit(m)) for m, r, p in parts)
    return a.unionByName(b)


@query(_BOTH + f" SELECT method, coalesce(flio, 'all') AS flio, {_AGG} FROM e GROUP BY GROUPING SETS ((method, flio), (method))")
def error_metrics_by_method(spark, d):
    return scoring.table(_both(spark, d), ["method", "flio"]).select("method", "flio", "n", *map(r6, _METRICS), "reversed")


@query(_BOTH + f" SELECT DISTINCT method, {_r('eh', 'size')}, {_r('CAST(count(*) OVER (PARTITION BY method ORDER BY round(eh, 6) RANGE UNBOUNDED PRECEDING) AS DOUBLE) / count(*) OVER (PARTITION BY method)', 'share')} FROM e")
def error_distribution(spark, d):
    return scoring.distribution(_both(spark, d), ["method"]).select("method", r6("size"), r6("share"))


_SUMMARY = _CVM + f""", e AS (SELECT o.traj_id, o.seq, {_diff('c.cvm_dir', '(((coalesce(o.angle_graph, o.angle_self, 0.0) % 360) + 360) % 360)')} AS eh, CASE WHEN o.angle_graph IS NOT NULL THEN 1 END AS matched FROM obs o JOIN cvm c ON o.traj_id = c.traj_id AND o.seq = c.seq),
su AS (SELECT traj_id, count(eh) AS n, avg(eh) AS mean, quantile_cont(eh, 0.5) AS median, quantile_cont(eh, 0.25) AS p25, quantile_cont(eh, 0.75) AS p75, avg(CAST(eh < 15 AS INTEGER)) AS under15, avg(CAST(eh < 35 AS INTEGER)) AS under35, CAST(count(matched) AS DOUBLE) / count(*) AS matched_ratio FROM e GROUP BY traj_id HAVING count(eh) > 0)"""


def _summary(spark, d) -> DataFrame:
    rows = windows.extrapolated(obs(spark, d)).withColumn("refdir", windows.reference_direction(F.col("angle_graph"), F.col("angle_self")))
    rows = rows.withColumn("eh", angles.angle_error("cvm_dir", "refdir")).withColumn("matched", F.when(F.col("angle_graph").isNotNull(), 1))
    return scoring.track_summary(rows)


@query(_SUMMARY + f" SELECT traj_id, n, {', '.join(_r(c) for c in ('mean', 'median', 'p25', 'p75', 'under15', 'under35', 'matched_ratio'))} FROM su")
def track_summary(spark, d):
    return _summary(spark, d).select("traj_id", "n", *map(r6, ("mean", "median", "p25", "p75", "under15", "under35", "matched_ratio")))


@query(_SUMMARY + f" SELECT count(*) AS tracks, {_r('avg(mean)', 'mean')}, {_r('avg(median)', 'median')}, {_r('avg(matched_ratio)', 'matched_ratio')} FROM su")
def mean_of_track_means(spark, d):
    return scoring.mean_of_means(_summary(spark, d)).select("tracks", *map(r6, ("mean", "median", "matched_ratio")))


_TIMES = ", tm AS (SELECT traj_id, event_type AS layer, CAST(sum(event_id % 17) AS DOUBLE) / 10 AS ms, count(*) AS samples FROM obs GROUP BY traj_id, event_type)"


def _timings(spark, d) -> DataFrame:
    return obs(spark, d).groupBy("traj_id", F.col("event_type").alias("layer")).agg((F.sum(F.col("event_id") % 17).cast("double") / 10).alias("ms"), F.count("*").alias("samples"))


@query(_TIMES + f""", c AS (SELECT *, ms / samples AS cost FROM tm) SELECT layer, {_r('avg(cost)', 'mean')}, {_r('quantile_cont(cost, 0.5)', 'median')}, {_r('quantile_cont(cost, 0.95)', 'p95')}, {_r('quantile_cont(cost, 0.99)', 'p99')}, {_r('max(cost)', 'max')}, {_r('sum(ms)', 'total')}, {_r('sum(ms) / sum(sum(ms)) OVER ()', 'share')} FROM c GROUP BY layer""")
def latency_stats(spark, d):
    return scoring.latency(_timings(spark, d)).select("layer", *map(r6, ("mean", "median", "p95", "p99", "max", "total", "share")))


@query(_TIMES + f" SELECT {_r('regr_slope(ms, samples)', 'slope')}, {_r('corr(ms, samples)', 'correlation')} FROM tm")
def cost_slope(spark, d):
    return scoring.cost_growth(_timings(spark, d)).select(r6("slope"), r6("correlation"))
