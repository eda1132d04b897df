"""OpenStreetMap XML: nodes, ways and relations as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import affine, equidistant, float32

TAG = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
# Aeroway kinds that make the graph.
GRAPH_KINDS = ("taxiway", "taxilane", "runway", "parking_position", "stopway")


def _tags(df: DataFrame) -> DataFrame:
    entries = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda t: F.struct(t["_k"], t["_v"]))
    return df.withColumn("tags", F.map_from_entries(entries)).drop("tag")


def read_osm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (node, lat, lon, tags), ways (way, tags), way_nodes (way, pos, node), relations (relation, tags), members.

    Schemas are given: what is inferred from a single child would differ from what many give."""

    def scan(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    nodes = _tags(scan("node", f"_id BIGINT, _lat DOUBLE, _lon DOUBLE, {TAG}")).select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "tags")
    ways = _tags(scan("way", f"_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, {TAG}"))
    relations = _tags(scan("relation", f"_id BIGINT, member ARRAY<STRUCT<_type: STRING, _ref: BIGINT>>, {TAG}"))
    members = relations.select(F.col("_id").alias("relation"), F.explode("member").alias("m")).where("m._type = 'way'").select("relation", F.col("m._ref").alias("way"))
    return {
        "nodes": nodes, "ways": ways.select(F.col("_id").alias("way"), "tags"), "way_nodes": ways.select(F.col("_id").alias("way"), F.posexplode("nd").alias("pos", "n")).select("way", "pos", F.col("n._ref").alias("node")),
        "relations": relations.select(F.col("_id").alias("relation"), "tags"), "members": members,
    }


def aeroway(df: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Adds kept: whether a row's aeroway tag is one of kinds (any at all without kinds)."""
    kind = F.element_at("tags", "aeroway")
    return df.withColumn("kept", F.coalesce(kind.isin(*kinds) if kinds else kind.isNotNull(), F.lit(False)))


def polylines(osm: dict[str, DataFrame], kinds: tuple[str, ...] = GRAPH_KINDS) -> DataFrame:
    """(way, pos, node, lat, lon) of ways of these kinds, without unresolved references, of at least two nodes."""
    kept = aeroway(osm["ways"], kinds).where("kept").select("way")
    rows = osm["way_nodes"].join(kept, "way", "left_semi").join(osm["nodes"].select("node", "lat", "lon"), "node")
    enough = rows.groupBy("way").count().where("count >= 2").select("way")
    return rows.join(enough, "way", "left_semi").select("way", "pos", "node", "lat", "lon")


def projected(rows: DataFrame, nodes: DataFrame, coefficients: tuple | None = None) -> DataFrame:
    """Adds x and z in metres, rounded to float32 and six places: by six affine coefficients, else around the mean of
    all nodes of the file."""
    if coefficients:
        x, z = affine("lon", "lat", coefficients)
    else:
        origin = nodes.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
        rows = rows.crossJoin(F.broadcast(origin))  # one row
        x, z = equidistant("lon", "lat", "lon0", "lat0")
    return rows.withColumn("x", F.round(float32(x), 6)).withColumn("z", F.round(float32(z), 6)).drop("lon0", "lat0")


def write_osm(tables: dict[str, DataFrame], folder: str) -> None:
    """XML of nodes, ways and relations, each in a folder of its own."""

    def tag(df: DataFrame) -> DataFrame:
        return df.withColumn("tag", F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v")))).drop("tags")

    nodes = tag(tables["nodes"]).withColumnsRenamed({"node": "_id", "lat": "_lat", "lon": "_lon"})
    refs = tables["way_nodes"].groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda n: F.struct(n["node"].alias("_ref"))).alias("nd"))
    ways = tag(tables["ways"]).join(refs, "way").withColumnRenamed("way", "_id")
    member = tables["members"].groupBy("relation").agg(F.transform(F.array_sort(F.collect_list("way")), lambda w: F.struct(F.lit("way").alias("_type"), w.alias("_ref"))).alias("member"))
    relations = tag(tables["relations"]).join(member, "relation", "left").withColumnRenamed("relation", "_id")
    for name, df in (("node", nodes), ("way", ways), ("relation", relations)):
        df.write.mode("overwrite").format("xml").option("rowTag", name).option("rootTag", "osm").save(f"{folder}/{name}")
