"""Minute-sharded SQLite surveillance logs as a Spark data source: a partition a file, columns and predicates pushed.

    spark.dataSource.register(TrackSource)
    spark.read.format("aerotrace_sqlite").option("days", "20240501:20240503").load("/logs")
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import day_range

SCHEMA = (
    "day string, shard string, row_id bigint, flight_id string, craft string, flight_no string, send_data_at bigint, flight_transform_x string, flight_transform_z string, "
    "flight_rotation string, speed string, flight_type string, craft_site string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")][3:]


class Shard(InputPartition):
    def __init__(self, day: str, path: str):
        self.day, self.path = day, path


class TrackReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.root, self.days, self.box = options["path"], options.get("days"), options.get("box")
        self.names = [f.name for f in schema.fields]

    def partitions(self):
        """Files of the days that exist, by name."""
        found = sorted(d for d in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, d)))
        wanted = set(day_range(*self.days.split(":"))) if self.days else set(found)
        return [Shard(d, os.path.join(self.root, d, f)) for d in found if d in wanted for f in sorted(os.listdir(os.path.join(self.root, d))) if f.endswith(".db")] or [Shard("", "")]

    def read(self, partition):
        if not partition.path:
            return
        where, args = "flight_id is not null and flight_id <> '' and flight_transform_x is not null and flight_transform_z is not null", []
        if self.box:
            where += " and cast(flight_transform_x as real) between ? and ? and cast(flight_transform_z as real) between ? and ?"
            args = [float(v) for v in self.box.split(",")]
        kept = [c for c in self.names if c in COLUMNS]
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"select rowid{''.join(f', {c}' for c in kept)} from track where {where} order by rowid", args):
                values = dict(zip(kept, row[1:], strict=True)) | {"day": partition.day, "shard": os.path.basename(partition.path), "row_id": row[0]}
                yield tuple(v if n in ("send_data_at", "row_id") and v is None else int(v) if n in ("send_data_at", "row_id") else None if v is None else str(v) for n, v in ((n, values[n]) for n in self.names))


class TrackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "aerotrace_sqlite"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TrackReader(self.options, schema)
