"""Trajectory extraction from surveillance rows: filters, movement classes, the whole chain, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import local_time
from . import spatial, windows

RUNWAY, APRON, STAND, SHARE, STEP = 35.0, 100.0, 30.0, 0.4, 2


def in_box(rows: DataFrame, x0, x1, z0, z1) -> DataFrame:
    """Both bounds included; pushed into the scan where rows come from one."""
    return rows.where(F.col("x").between(x0, x1) & F.col("z").between(z0, z1))


def tolerant(rows: DataFrame, needed=("flight_transform_x", "flight_transform_z"), wanted=("flight_rotation", "speed")) -> DataFrame:
    """Rows whose needed numbers can't be read go; other bad numbers become null."""
    for c in (*needed, *wanted):
        rows = rows.withColumn(c, F.col(c).try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast({c} as double)"))
    return rows.dropna(subset=list(needed))


def end_samples(rows: DataFrame) -> DataFrame:
    """Every second row of the first and of the last 40 % (two rows at least) of each track, marked front and back."""
    w, whole = windows.ordered(), Window.partitionBy("traj_id")
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(whole))
    rows = rows.withColumn("__k", F.greatest(F.lit(2), F.floor(SHARE * F.col("__n"))))
    front = (F.col("__i") < F.col("__k")) & (F.col("__i") % STEP == 0)
    start = F.greatest(F.col("__n") - F.col("__k"), F.lit(0))
    back = (F.col("__i") >= start) & ((F.col("__i") - start) % STEP == 0)
    parts = F.filter(F.array(F.when(front, "front"), F.when(back, "back")), lambda p: p.isNotNull())
    return rows.withColumn("part", F.explode(parts)).drop("__i", "__n", "__k")


def movement(rows: DataFrame, features: DataFrame, rings: DataFrame) -> DataFrame:
    """A if a track starts at a runway and ends at an apron or stand, D if the other way round, else null."""
    ends = end_samples(rows)
    d = spatial.feature_distance(ends.select("traj_id", "seq", "part", "x", "z"), features, ["traj_id", "seq", "part"])
    d = d.groupBy("traj_id", "seq", "part").agg(*[F.min(F.when(F.col("kind") == k, F.col("distance"))).alias(k) for k in ("runway", "apron", "stand")])
    held = spatial.inside(rows, rings, ["traj_id", "seq"]).select("traj_id", "seq", F.lit(True).alias("held")).distinct()
    near = F.coalesce(F.col("apron") < APRON, F.lit(False)) | F.coalesce(F.col("stand") < STAND, F.lit(False)) | F.coalesce("held", F.lit(False))
    marks = d.join(held, ["traj_id", "seq"], "left").select("traj_id", "part", F.coalesce(F.col("runway") < RUNWAY, F.lit(False)).alias("rw"), near.alias("ap"))
    out = marks.groupBy("traj_id").agg(*[F.bool_or(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("front", "back") for c in ("rw", "ap")])
    return out.withColumn("movement", F.when(F.col("front_rw") & F.col("back_ap"), "A").when(F.col("front_ap") & F.col("back_rw"), "D"))


def even_sample(files: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """k files of each class at the middles of k equal parts of their order; all of them where there are fewer."""
    w = Window.partitionBy(by)
    ranked = files.withColumn("__i", F.row_number().over(w.orderBy(name)) - 1).withColumn("__n", F.count("*").over(w))
    n = F.col("__n").cast("double")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.least(F.col("__n") - 1, F.floor(j * n / k + n / (2 * k))))
    return ranked.where(F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def counters(rows: DataFrame, least: int, seconds: int) -> DataFrame:
    tracks = rows.groupBy("traj_id").agg(F.count("*").alias("points"), (F.max("t") - F.min("t")).alias("seconds"))
    status = F.when(F.col("points") < least, "reject_short").when(F.col("seconds") > seconds, "reject_long").otherwise("kept")
    return tracks.groupBy(status.alias("status")).agg(F.count("*").alias("tracks"), F.sum("points").alias("points"))


def daily_totals(rows: DataFrame) -> DataFrame:
    """Tracks and points of each day, and of all days (null)."""
    return rows.rollup("day").agg(F.countDistinct("traj_id").alias("tracks"), F.count("*").alias("points"))


def centroid_box(segments: DataFrame, buffer: float) -> DataFrame:
    low = [F.min(F.least(f"a{c}", f"b{c}")) - buffer for c in "xz"]
    high = [F.max(F.greatest(f"a{c}", f"b{c}")) + buffer for c in "xz"]
    return segments.agg(F.avg("ax").alias("x"), F.avg("az").alias("z"), low[0].alias("x0"), high[0].alias("x1"), low[1].alias("z0"), high[1].alias("z1"))


def trajectories(raw: DataFrame, features: DataFrame, rings: DataFrame, least: int = 8, field: float = 300.0, least_field: int = 30) -> tuple[DataFrame, DataFrame]:
    """raw (traj_id, t, x, z, event_type): one row a second of every accepted track, and (traj_id, movement).

    First row of a second, longest session, longest stretch near the field, class, trimming, 1 Hz. Each step rejects
    tracks that it leaves too short."""

    def renumbered(df):
        return df.withColumn("seq", F.row_number().over(windows.ordered(key="t")) - 1)

    def long_enough(df, n):
        return df.withColumn("__n", F.count("*").over(Window.partitionBy("traj_id"))).where(F.col("__n") >= n).drop("__n")

    rows = long_enough(renumbered(windows.first_per_second(raw, ["traj_id"], "t", ["x", "z"])), least)
    rows = long_enough(renumbered(windows.longest_session(rows)), least)
    d = spatial.feature_distance(rows.select("traj_id", "seq", "x", "z"), features, ["traj_id", "seq"]).groupBy("traj_id", "seq").agg(F.min("distance").alias("field"))
    rows = long_enough(renumbered(windows.longest_run(rows.join(d, ["traj_id", "seq"], "left"), F.col("field") < field)), least_field)
    kinds = movement(rows, features, rings).where("movement is not null").select("traj_id", "movement")
    rows = long_enough(renumbered(windows.trimmed(rows.join(kinds, "traj_id"))), least)
    out = windows.resampled(rows).join(kinds, "traj_id")
    return out.withColumn("time", local_time("sec")), kinds


def runway_of(rows: DataFrame, runways: DataFrame, limit: float = 5 * RUNWAY) -> DataFrame:
    """runways (name, ax, az, bx, bz): the nearest one to any point of a track, '' beyond the limit."""
    named = runways.withColumnRenamed("name", "kind")
    d = spatial.nearest_feature_name(rows.select("traj_id", "seq", "x", "z"), named, ["traj_id", "seq"]).groupBy("traj_id", "kind").agg(F.min("distance").alias("distance"))
    return spatial.nearest_name(d.withColumnRenamed("kind", "name"), ["traj_id"], "name", limit)
