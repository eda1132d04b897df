"""Trajectories and a network derived from the driver's tables: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: traj_id, flio, seq, event_id, event_type, origin_lon, origin_lat, angle_self, angle_graph, x, z, t
OBS = """
select traj_id, flio, seq, event_id, event_type, origin_lon, origin_lat, angle_self, angle_graph,
 cast(sum(dx) over w as double) as x, cast(sum(dz) over w as double) as z, cast(sum(gap) over w as bigint) as t
from (select q.*, case when seq between 20 and 45 then 0 else (event_id*7 + v) % 13 end as dx,
   case when seq between 20 and 45 then 0 else (event_id*11 + v) % 9 - 4 end as dz,
   case when event_id % 23 = 0 then 300 else event_id % 5 + 1 end as gap
 from (select user_id as traj_id, case when user_id % 2 = 0 then 'A' else 'D' end as flio, event_id, event_type,
   cast(floor(value) as bigint) as v,
   case when event_id % 97 = 0 then cast(0 as double) else cast(108 as double) end as origin_lon,
   case when event_id % 97 = 0 then cast(0 as double) else cast(34 as double) end as origin_lat,
   case when event_id % 15 = 0 then null else cast((event_id*13) % 360 - 180 as double) end as angle_self,
   case when event_id % 10 = 0 then null else cast((event_id*29) % 360 - 180 as double) end as angle_graph,
   row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events) q) r
window w as (partition by traj_id order by seq rows between unbounded preceding and current row)
"""

#: pathname, path_no, seg_idx, ax, az, bx, bz
NET = """
select pathname, path_no, seg_idx, ax, az, bx, bz from (
 select q.*, lead(ax) over w as bx, lead(az) over w as bz from (
  select path_no, i as seg_idx, concat(case when path_no % 4 = 3 then 'R-' else 'N-' end, cast(path_no as varchar(20))) as pathname,
   case when path_no % 4 = 3 then cast(((path_no*31) % 19)*30 + j as double) else cast(i*30 as double) end as ax,
   case when path_no % 4 = 3 then cast(i*10 - 95 as double) else cast((path_no*17) % 120 - 60 + j as double) end as az
  from (select cast(floor(p_partkey/20) as bigint) as path_no, p_partkey % 20 as i, p_size % 7 as j from part) p) q
 window w as (partition by path_no order by seg_idx)) r
where bx is not null
"""

#: kind, path_no, ax, az, bx, bz
FEATURES = "select case path_no % 10 when 0 then 'runway' when 1 then 'apron' else 'stand' end as kind, path_no, ax, az, bx, bz from net where path_no % 10 < 3"

#: WITH clause of every oracle.
WITH = f"WITH RECURSIVE obs AS ({OBS}), net AS ({NET}), features AS ({FEATURES})"


def _sql(spark: SparkSession, text: str, sf_dir: str, *tables: str) -> DataFrame:
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        text = text.replace(f"from {t})", f"from {{{t}}})")
    return spark.sql(text, **names)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, OBS, sf_dir, "events")


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, NET, sf_dir, "part")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FEATURES.replace("from net", "from {net}"), net=net(spark, sf_dir))
