"""Trajectory records and network documents as JSON: scans, sinks, sample bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import bearing360
from ..functions.geometry import content_digest

PROPERTIES = "x DOUBLE, z DOUBLE, lon DOUBLE, lat DOUBLE, originLon STRING, originLat STRING, angle_self DOUBLE, angle_graph DOUBLE, graph_match_dist DOUBLE, graph_seg_idx INT"
HEADER = ("cfno", "afn", "flio", "stno", "dapn", "rway", "flid", "starttime", "endtime")
RECORD = f"{', '.join(f'{c} STRING' for c in HEADER)}, pointcount INT, data ARRAY<STRUCT<time: STRING, properties: STRUCT<{PROPERTIES.replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING').replace(' INT', ': INT')}>>>"
POINT = "pointname: INT, x: DOUBLE, y: DOUBLE, z: DOUBLE, roa: DOUBLE"
META = "n_paths: BIGINT, n_nodes: BIGINT, n_segments: BIGINT, n_internal_points: BIGINT, internal_step_m: DOUBLE, adjacency_strict: BIGINT, adjacency_space: BIGINT, adjacency_total: BIGINT, space_R_m: DOUBLE, min_cross_ang: DOUBLE, n_components: BIGINT, max_component: BIGINT, stay_prob: DOUBLE, node_r_m: DOUBLE"
NETWORK = (
    f"meta STRUCT<{META}>, path_dict MAP<STRING, STRUCT<start: BIGINT, end: BIGINT>>, segments MAP<STRING, ARRAY<STRUCT<idx: INT, a: ARRAY<DOUBLE>, b: ARRAY<DOUBLE>, len: DOUBLE, dir: DOUBLE>>>, "
    f"paths ARRAY<STRUCT<pathname: STRING, startpoint: STRING, endpoint: STRING, pathLength: DOUBLE, points: ARRAY<STRUCT<{POINT}>>>>, "
    "nodes MAP<STRING, STRUCT<x: DOUBLE, z: DOUBLE, paths: ARRAY<STRING>>>, adjacency MAP<STRING, ARRAY<STRING>>, adjacency_strict MAP<STRING, ARRAY<STRING>>, adjacency_space MAP<STRING, ARRAY<STRING>>, "
    "transition_matrix MAP<STRING, MAP<STRING, DOUBLE>>, internal_points MAP<STRING, ARRAY<ARRAY<DOUBLE>>>"
)
# Files of a record folder that aren't records.
NOT_RECORDS = r"(^|/)manifest\.json$|\.truth\.json$"


def read_records(spark: SparkSession, folder: str, limit: int | None = None, recursive: bool = False, bad: bool = False) -> DataFrame:
    """A row a record file: (file, header columns, data). An array root gives its first element.

    Files that can't be parsed are left out, or with `bad` kept as rows with their text in _corrupt_record. The first
    `limit` files by name of each folder."""
    schema = RECORD + ", _corrupt_record STRING"
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    glob = folder if folder.endswith(".json") else f"{folder.rstrip('/')}"
    rows = reader.option("pathGlobFilter", "*.json").json(glob)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("__n"), "*").where(~F.col("file").rlike(NOT_RECORDS))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("file").orderBy("__n"))).where("__k = 1").drop("__k", "__n")
    if limit is not None:
        own = Window.partitionBy(F.regexp_extract("file", "^(.*)/", 1)).orderBy("file")
        rows = rows.withColumn("__k", F.row_number().over(own)).where(F.col("__k") <= limit).drop("__k")
    return rows if bad else rows.where("_corrupt_record is null and data is not null").drop("_corrupt_record")


def samples(records: DataFrame, key: str = "file") -> DataFrame:
    """A row a sample: (traj_id, flio, seq, time, properties, origin_lon, origin_lat). A missing flio is A."""
    rows = records.select(F.col(key).alias("traj_id"), F.coalesce("flio", F.lit("A")).alias("flio"), F.posexplode("data").alias("seq", "d"))
    rows = rows.select("traj_id", "flio", "seq", "d.time", "d.properties.*")
    return rows.withColumn("origin_lon", F.expr("try_cast(originLon as double)")).withColumn("origin_lat", F.expr("try_cast(originLat as double)"))


def as_records(rows: DataFrame, header: list[str], properties: list[str]) -> DataFrame:
    """A row a trajectory again, samples in order; null properties are left out of the JSON."""
    item = F.struct("seq", F.struct("time", F.struct(*properties).alias("properties")).alias("d"))
    out = rows.groupBy("traj_id", *header).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"]).alias("data"))
    return out.withColumn("pointcount", F.size("data"))


def write_records(records: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One JSON document for each trajectory; without `overwrite` what is there already is skipped."""
    spark = records.sparkSession
    if not overwrite:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            done = spark.read.option("recursiveFileLookup", False).json(folder).select("traj_id").distinct()
            records = records.join(done, "traj_id", "left_anti")
    records.write.mode("overwrite" if overwrite else "append").partitionBy("traj_id").json(folder)


def slim(records: DataFrame, header: list[str], properties: list[str]) -> DataFrame:
    """Only the named fields, as far as a record has them."""
    kept = F.transform("data", lambda d: F.struct(d["time"].alias("time"), F.struct(*[d["properties"][p].alias(p) for p in properties]).alias("properties")))
    return records.select("file", *[c for c in header if c in records.columns], kept.alias("data"))


def bundle(records: DataFrame) -> DataFrame:
    """(file, movement, points, bytes, sha1, json): the documents of a sample bundle with their digests."""
    out = records.withColumn("json", F.to_json(F.struct(*[c for c in records.columns if c != "file"])))
    size, digest = content_digest("json")
    return out.select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), F.col("flio").alias("movement"), F.size("data").alias("points"), size.alias("bytes"), digest.alias("sha1"), "json")


def manifest(documents: DataFrame, airport: str, source: str, note: str = "") -> DataFrame:
    """One row of JSON that lists a bundle's files, their sums and how they were chosen."""
    item = F.struct("file", "movement", "points", "bytes", "sha1")
    out = documents.agg(F.array_sort(F.collect_list(item)).alias("files"), F.count("*").alias("n_files"), F.sum("points").alias("n_points"))
    return out.select(F.to_json(F.struct(F.lit(airport).alias("airport"), F.lit(source).alias("source_directory"), F.lit("even grid by movement").alias("selection"), F.lit(note).alias("note"), "files", "n_files", "n_points")).alias("value"))


def read_network(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a network document: segments, transitions, anchors, adjacency (in all, strict, space), nodes, path_dict
    and meta. Documents with paths only give their segments, with empty tables for the rest: see whole_network()."""
    doc = spark.read.schema(NETWORK).option("multiLine", True).json(path)
    points = doc.select(F.posexplode("paths").alias("path_no", "p")).select("path_no", "p.pathname", F.posexplode("p.points").alias("seg_idx", "a"))
    w = Window.partitionBy("pathname").orderBy("seg_idx")
    ends = points.select("pathname", "path_no", "seg_idx", F.col("a.x").alias("ax"), F.col("a.z").alias("az"), F.lead("a.x").over(w).alias("bx"), F.lead("a.z").over(w).alias("bz"))
    segments = ends.where("bx is not null and sqrt(pow(bx - ax, 2) + pow(bz - az, 2)) >= 1e-6")
    moves = doc.select(F.explode("transition_matrix").alias("src", "m")).select("src", F.explode("m").alias("dst", "p"))
    anchors = doc.select(F.explode("internal_points").alias("pathname", "l")).select("pathname", F.explode("l").alias("v"))
    anchors = anchors.select("pathname", F.col("v")[3].cast("int").alias("seg_idx"), F.col("v")[0].alias("x"), F.col("v")[1].alias("z"), F.col("v")[2].alias("along"), F.col("v")[4].alias("t"))
    edges = {name: doc.select(F.explode(name).alias("src", "l")).select("src", F.explode("l").alias("dst")) for name in ("adjacency", "adjacency_strict", "adjacency_space")}
    nodes = doc.select(F.explode("nodes").alias("node", "v")).select(F.col("node").cast("bigint").alias("node"), "v.x", "v.z", "v.paths")
    ends = doc.select(F.explode("path_dict").alias("pathname", "v")).select("pathname", "v.start", "v.end")
    meta = doc.where("meta is not null").select("meta.*")
    return {"segments": segments, "transitions": moves, "anchors": anchors, **edges, "nodes": nodes, "path_dict": ends, "meta": meta}


def whole_network(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """read_network(), with what a document of paths only lacks derived from them: adjacency by shared and near ends,
    transitions and anchors."""
    from ..operators import network

    out = read_network(spark, path)
    if not out["transitions"].isEmpty():
        return out
    segments = out["segments"]
    edges = network.legacy_edges(network.path_ends(segments))
    return out | {"adjacency": edges, "transitions": network.transitions(segments.select("pathname").distinct(), edges), "anchors": network.anchors(segments)}


def network_document(segments: DataFrame, transitions: DataFrame, anchors: DataFrame, adjacency: DataFrame, strict: DataFrame | None = None, space: DataFrame | None = None, nodes: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """One row (value): the network as JSON with keys in order. A map of one airport is a few MB.

    nodes as operators.network.greedy_nodes() has them, meta as meta() has it; blocks of tables that aren't given are left out."""

    def entries(df: DataFrame, key: str, value) -> DataFrame:
        def by_key(a, b):
            return F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)

        return df.groupBy(key).agg(value.alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "v")), by_key)).alias("m"))

    last = segments.groupBy("pathname", "path_no").agg(F.max(F.struct("seg_idx", "bx", "bz")).alias("l"))
    points = segments.select("path_no", "pathname", "seg_idx", F.col("ax").alias("x"), F.col("az").alias("z")).unionByName(last.select("path_no", "pathname", (F.col("l.seg_idx") + 1).alias("seg_idx"), F.col("l.bx").alias("x"), F.col("l.bz").alias("z")))
    path = points.groupBy("path_no", "pathname").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "x", "z"))).alias("p"))
    path = path.select("path_no", F.struct("pathname", F.transform("p", lambda q: F.struct(q["seg_idx"].alias("pointname"), q["x"].alias("x"), F.lit(0.0).alias("y"), q["z"].alias("z"))).alias("points")).alias("doc"))
    out = path.agg(F.transform(F.array_sort(F.collect_list(F.struct("path_no", "doc"))), lambda r: r["doc"]).alias("paths"))
    parts = [
        (transitions, "src", F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "p")))), "transition_matrix"),
        (anchors, "pathname", F.transform(F.array_sort(F.collect_list(F.struct("along", "x", "z", "seg_idx", "t"))), lambda a: F.array(a["x"], a["z"], a["along"], a["seg_idx"].cast("double"), a["t"])), "internal_points"),
        *((df, "src", F.array_sort(F.collect_set("dst")), name) for df, name in ((adjacency, "adjacency"), (strict, "adjacency_strict"), (space, "adjacency_space")) if df is not None),
    ]
    own = segments.withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dz", F.col("bz") - F.col("az"))
    two = [F.array(F.bround(f"{e}x", 2), F.bround(f"{e}z", 2)) for e in "ab"]
    length, direction = F.bround(F.sqrt(F.col("dx") ** 2 + F.col("dz") ** 2), 2), F.bround(bearing360("dx", "dz"), 3)
    own = own.withColumn("idx", F.row_number().over(Window.partitionBy("pathname").orderBy("seg_idx")) - 1)
    item = F.struct("idx", two[0].alias("a"), two[1].alias("b"), length.alias("len"), direction.alias("dir"))
    parts.append((own, "pathname", F.array_sort(F.collect_list(item)), "segments"))
    if nodes is not None:
        place = F.struct(F.first("node_x").alias("x"), F.first("node_z").alias("z"), F.transform(F.array_sort(F.collect_list(F.struct("pathname", "side"))), lambda e: e["pathname"]).alias("paths"))
        parts.append((nodes.withColumn("node", F.col("node").cast("string")), "node", place, "nodes"))
        sides = F.struct(F.max(F.when(F.col("side") == 0, F.col("node"))).alias("start"), F.max(F.when(F.col("side") == 1, F.col("node"))).alias("end"))
        parts.append((nodes, "pathname", sides, "path_dict"))
    if meta is not None:
        out = out.crossJoin(meta.agg(F.first(F.struct(*meta.columns)).alias("meta")))  # one row each
    for df, key, value, name in parts:
        out = out.crossJoin(entries(df, key, value).withColumnRenamed("m", name))  # one row each
    return out.select(F.to_json(F.struct(*[F.col(c) for c in out.columns])).alias("value"))


def write_benchmark(latency: DataFrame, tracks: DataFrame, folder: str) -> None:
    """Statistics as text lines, and a CSV row a track."""
    latency.select(F.format_string("%-14s mean %.3f median %.3f p95 %.3f p99 %.3f max %.3f share %.3f", "layer", "mean", "median", "p95", "p99", "max", "share").alias("value")).write.mode("overwrite").text(f"{folder}/summary")
    tracks.write.mode("overwrite").option("header", True).csv(f"{folder}/tracks")
