"""Operators over one trajectory's or path's rows in order: windows, fills, islands, resampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import bearing, bearing360, wrap360

TRACK = ["traj_id"]


def ordered(by: list[str] | None = None, key: str = "seq"):
    return Window.partitionBy(*(by or TRACK)).orderBy(key)


def drop_missing(obs: DataFrame) -> DataFrame:
    """Without rows whose origin is null, or near 0 in both; seq is counted anew from 0."""
    near0 = (F.abs("origin_lon") < 1e-9) & (F.abs("origin_lat") < 1e-9)
    kept = obs.where(F.col("origin_lon").isNotNull() & F.col("origin_lat").isNotNull() & ~near0)
    return kept.withColumn("seq", F.row_number().over(ordered()) - 1)


def reference_direction(graph: Column, own: Column) -> Column:
    return wrap360(F.coalesce(graph, own, F.lit(0.0)))


def window_direction(obs: DataFrame, reach: int = 10, least: float = 0.5, out: str = "win_dir", signed: bool = False) -> DataFrame:
    """Bearing from the first to the last position of the window seq +- reach; null under `least` metres."""
    w = ordered().rowsBetween(-reach, reach)
    dx, dz = F.last("x").over(w) - F.first("x").over(w), F.last("z").over(w) - F.first("z").over(w)
    angle = bearing(dx, dz) if signed else bearing360(dx, dz)
    return obs.withColumn(out, F.when(F.sqrt(dx * dx + dz * dz) >= least, angle))


def filled_direction(obs: DataFrame, source: str = "win_dir") -> DataFrame:
    """observation_dir: the direction, else the last one before, else the first one after. direction_source names which."""
    before = ordered().rowsBetween(Window.unboundedPreceding, 0)
    after = ordered().rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last(source, ignorenulls=True).over(before), F.first(source, ignorenulls=True).over(after))
    label = F.when(F.col(source).isNotNull(), "OBS_WIN").when(F.col("observation_dir").isNotNull(), "OBS_INHERIT").otherwise("STATIC")
    return obs.withColumn("observation_dir", filled).withColumn("direction_source", label)


def central_direction(obs: DataFrame, least: float = 0.5) -> DataFrame:
    """self_dir: bearing from the previous to the next position, one-sided at the ends; clean_dir: null under `least`."""
    w = ordered()
    ends = [F.coalesce(f(c).over(w), F.col(c)) for c in ("x", "z") for f in (F.lead, F.lag)]
    dx, dz = ends[0] - ends[1], ends[2] - ends[3]
    angle = bearing(dx, dz)
    return obs.withColumn("self_dir", angle).withColumn("clean_dir", F.when(F.sqrt(dx * dx + dz * dz) >= least, angle))


def extrapolated(obs: DataFrame) -> DataFrame:
    """Constant velocity: the position that the last two positions predict, and the heading of that step.

    Tracks under three positions have none."""
    w = ordered()
    n = F.count("*").over(Window.partitionBy(*TRACK))
    out = obs
    for c in ("x", "z"):
        out = out.withColumn(f"__d{c}", F.lag(c, 1).over(w) - F.lag(c, 2).over(w)).withColumn(f"cvm_{c}", F.when(n >= 3, F.lag(c, 1).over(w) + F.col(f"__d{c}")))
    heading = F.when(F.col("cvm_x").isNotNull(), bearing360("__dx", "__dz"))
    return out.withColumn("cvm_dir", heading).drop("__dx", "__dz")


def exact_bearing360(dx: Column, dz: Column) -> Column:
    """bearing360() by the C library, as the JVM's atan2 is off by a unit in the last place now and then. Means of such
    bearings meet the bound of reversed headings exactly."""

    @F.pandas_udf("double")
    def bearings(x: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([None if a != a or b != b else (math.atan2(b, a) * (180.0 / math.pi) + 360.0) % 360.0 for a, b in zip(x.tolist(), z.tolist(), strict=True)], dtype=float)

    return bearings(dx, dz)


def trailing_motion(obs: DataFrame, reach: int = 5) -> DataFrame:
    """Mean positive speed and arithmetic mean heading of the last steps, and the position they predict.

    Step s goes from row s to row s + 1. The first `reach` rows have their own position and the bearing of the step
    that ends there (row 0: of the first step). Tracks of at most `reach` rows have none."""
    w, whole = ordered(), Window.partitionBy(*TRACK)
    dx, dz = F.col("x") - F.lag("x").over(w), F.col("z") - F.lag("z").over(w)
    # of the step that ends at the row; row 0 takes the next row's
    rows = obs.withColumn("__dx", F.coalesce(dx, F.lead("x").over(w) - F.col("x"))).withColumn("__dz", F.coalesce(dz, F.lead("z").over(w) - F.col("z")))
    rows = rows.withColumn("__speed", F.when(F.lag("x").over(w).isNotNull(), F.sqrt(F.col("__dx") ** 2 + F.col("__dz") ** 2))).withColumn("__heading", exact_bearing360(F.col("__dx"), F.col("__dz")))
    last, past = w.rowsBetween(1 - reach, 0), w.rowsBetween(-reach, -1)
    # the steps that end at rows i - reach + 1 .. i are the steps i - reach .. i - 1
    speed = F.coalesce(F.avg(F.when(F.col("__speed") > 0, F.col("__speed"))).over(last), F.lit(0.0))
    heading = F.avg("__heading").over(past)
    early, some = F.col("seq") < reach, F.count("*").over(whole) > reach
    rows = rows.withColumn("__v", speed).withColumn("__h", heading)
    x = F.lag("x").over(w) + F.col("__v") * F.cos(F.radians("__h"))
    z = F.lag("z").over(w) + F.col("__v") * F.sin(F.radians("__h"))
    out = rows.withColumn("f2v_x", F.when(some, F.when(early, F.col("x")).otherwise(x))).withColumn("f2v_z", F.when(some, F.when(early, F.col("z")).otherwise(z)))
    return out.withColumn("f2v_dir", F.when(some, F.when(early, F.col("__heading")).otherwise(wrap360("__h")))).drop("__dx", "__dz", "__speed", "__heading", "__v", "__h")


def islands(rows: DataFrame, starts: Column, by: list[str] | None = None, key: str = "seq", out: str = "island") -> DataFrame:
    """Numbers runs of rows; `starts` is true at the first row of a run."""
    return rows.withColumn("__start", starts).withColumn(out, F.sum(F.when(F.col("__start"), 1).otherwise(0)).over(ordered(by, key).rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def longest(rows: DataFrame, island: str, key: str = "seq", by: list[str] | None = None) -> DataFrame:
    """The rows of the longest run of each trajectory, the first of those as long."""
    by = by or TRACK
    sized = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by, island)))
    sized = sized.withColumn("__best", F.max(F.struct("__n", (-F.col(island)).alias("i"))).over(Window.partitionBy(*by)))
    return sized.where(F.col(island) == -F.col("__best.i")).drop("__n", "__best")


def longest_session(rows: DataFrame, gap: int = 180, time: str = "t") -> DataFrame:
    """The longest stretch without a gap of more than `gap` seconds."""
    return longest(islands(rows, F.col(time) - F.lag(time).over(ordered(key=time)) > gap, key=time, out="session"), "session", time)


def longest_run(rows: DataFrame, predicate: Column) -> DataFrame:
    """The longest run of consecutive rows for which the predicate holds; none gives no rows."""
    flagged = rows.withColumn("__ok", F.coalesce(predicate, F.lit(False)))
    runs = islands(flagged, ~F.col("__ok") | ~F.lag("__ok", 1, False).over(ordered()), out="run")
    return longest(runs.where("__ok"), "run").drop("__ok")


def trimmed(rows: DataFrame, lead: int = 10, speed: float = 2.0, least: int = 40) -> DataFrame:
    """From the first to the end of the last stretch of `lead` steps with a mean speed of `speed`.

    Tracks under `least` rows and those without such a stretch stay whole."""
    w, whole = ordered(), Window.partitionBy(*TRACK)
    dx, dz = F.lead("x", lead).over(w) - F.col("x"), F.lead("z", lead).over(w) - F.col("z")
    fast = F.sqrt(dx * dx + dz * dz) / lead >= speed
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__fast", F.when(fast, F.row_number().over(w) - 1))
    rows = rows.withColumn("__n", F.count("*").over(whole)).withColumn("__a", F.min("__fast").over(whole)).withColumn("__b", F.max("__fast").over(whole) + lead)
    keep = (F.col("__n") < least) | F.col("__a").isNull() | ((F.col("__i") >= F.col("__a")) & (F.col("__i") < F.col("__b")))
    return rows.where(keep).drop("__i", "__fast", "__n", "__a", "__b")


def resampled(rows: DataFrame, time: str = "t", carry: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """A row a second from the first time to the last. Positions are linear between rows where the position changed,
    flat outside; other attributes are those of the last row at or before the second."""
    w = ordered(key=time)
    moved = F.coalesce((F.abs(F.col("x") - F.lag("x").over(w)) > 1e-9) | (F.abs(F.col("z") - F.lag("z").over(w)) > 1e-9), F.lit(True))
    events = rows.withColumn("__moved", moved)
    spans = events.withColumn("__next", F.lead(time).over(w))
    for c in (time, "x", "z"):
        known = F.when(F.col("__moved"), F.col(c))
        spans = spans.withColumn(f"__{c}0", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        spans = spans.withColumn(f"__{c}1", F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    until = F.coalesce(F.col("__next") - 1, F.col(time))
    grid = spans.where(f"__next is null or __next > {time}").withColumn("sec", F.explode(F.sequence(F.col(time), until)))
    share = (F.col("sec") - F.col(f"__{time}0")) / (F.col(f"__{time}1") - F.col(f"__{time}0"))
    place = {c: F.when(F.col(f"__{time}1").isNull(), F.col(f"__{c}0")).otherwise(F.col(f"__{c}0") + share * (F.col(f"__{c}1") - F.col(f"__{c}0"))) for c in ("x", "z")}
    return grid.select(*TRACK, "sec", place["x"].alias("x"), place["z"].alias("z"), *carry)


def numbered_names(rows: DataFrame, base: str, first: str, out: str = "name") -> DataFrame:
    """base, base_2, base_3, ... in the order of `first`."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(first))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string"))))


def first_per_second(rows: DataFrame, by: list[str], time: str, order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by, time).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
