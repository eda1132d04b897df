"""Building the network: segments, anchors, nodes, adjacency, transitions, components, comparison."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.angles import bearing, bearing360
from .spatial import radius_join


def _path():
    return Window.partitionBy("pathname").orderBy("seq")


def segments_of(points: DataFrame) -> DataFrame:
    """points (pathname, seq, x, z): consecutive pairs longer than 1e-6, with raw and compacted index, two decimals."""
    ends = points.withColumn("bx", F.lead("x").over(_path())).withColumn("bz", F.lead("z").over(_path())).where("bx is not null")
    length = F.sqrt((F.col("bx") - F.col("x")) ** 2 + (F.col("bz") - F.col("z")) ** 2)
    rows = ends.withColumn("length", length).where("length >= 1e-6").withColumn("dir_f", bearing360(F.col("bx") - F.col("x"), F.col("bz") - F.col("z")))
    rows = rows.withColumn("idx", F.row_number().over(_path()) - 1)
    return rows.select("pathname", F.col("seq").alias("raw_idx"), "idx", F.bround("x", 2).alias("ax"), F.bround("z", 2).alias("az"), F.bround("bx", 2).alias("bx"), F.bround("bz", 2).alias("bz"), "length", "dir_f")


def path_direction(net: DataFrame) -> DataFrame:
    """Resultant of a path's segment vectors, and bearing from its first to its last point."""
    first, last = F.min_by(F.struct("ax", "az"), "seg_idx"), F.max_by(F.struct("bx", "bz"), "seg_idx")
    sums = net.groupBy("pathname").agg(F.sum(F.col("bx") - F.col("ax")).alias("dx"), F.sum(F.col("bz") - F.col("az")).alias("dz"), first.alias("f"), last.alias("l"))
    ex, ez = F.col("l.bx") - F.col("f.ax"), F.col("l.bz") - F.col("f.az")
    net_dir = F.when(F.sqrt(ex * ex + ez * ez) > 1e-6, bearing360(ex, ez)).otherwise(0.0)
    return sums.select("pathname", bearing("dx", "dz").alias("path_dir"), net_dir.alias("net_dir"))


def with_neighbours(net: DataFrame, reach: int = 3) -> DataFrame:
    """Edge vectors of a path's neighbours (an end's own), and the course over edges within `reach`."""
    w = Window.partitionBy("path_no").orderBy("seg_idx")
    rows = net.withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dz", F.col("bz") - F.col("az")).withColumn("length", F.sqrt(F.col("dx") ** 2 + F.col("dz") ** 2))
    for c in ("x", "z"):
        rows = rows.withColumn(f"u{c}", F.col(f"d{c}") / F.col("length")).withColumn(f"prev_d{c}", F.coalesce(F.lag(f"d{c}").over(w), F.col(f"d{c}"))).withColumn(f"next_d{c}", F.coalesce(F.lead(f"d{c}").over(w), F.col(f"d{c}")))
        rows = rows.withColumn(f"course_{c}", F.avg(f"u{c}").over(w.rowsBetween(-reach, reach)))
    return rows.withColumn("course", bearing("course_x", "course_z"))


def max_turn(points: DataFrame, straight: float = 5.0) -> DataFrame:
    """The largest angle between neighbouring edges of a path, and its class: N under `straight` degrees, else R."""
    ends = points.withColumn("dx", F.lead("x").over(_path()) - F.col("x")).withColumn("dz", F.lead("z").over(_path()) - F.col("z")).where("dx is not null and (dx <> 0 or dz <> 0)")
    px, pz = F.lag("dx").over(_path()), F.lag("dz").over(_path())
    cos = (F.col("dx") * px + F.col("dz") * pz) / (F.sqrt(F.col("dx") ** 2 + F.col("dz") ** 2) * F.sqrt(px * px + pz * pz))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    out = ends.withColumn("turn", turn).groupBy("pathname").agg(F.coalesce(F.max("turn"), F.lit(0.0)).alias("max_turn"))
    return out.withColumn("kind", F.when(F.col("max_turn") < straight, "N").otherwise("R"))


def arc_lengths(net: DataFrame) -> DataFrame:
    w = Window.partitionBy("pathname").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = net.withColumn("length", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("bz") - F.col("az")) ** 2)).where("length >= 1e-6")
    return rows.withColumn("along", F.coalesce(F.sum("length").over(w), F.lit(0.0)))


def anchors(net: DataFrame, step: float = 1.0) -> DataFrame:
    """Points about every `step` metres, without each segment's end: x, z and along with two decimals, t with three."""
    n = F.greatest(F.lit(1), F.rint(F.col("length") / step).cast("int"))
    rows = arc_lengths(net).withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.col("s") / F.col("n"))
    x, z = F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), F.col("az") + F.col("t") * (F.col("bz") - F.col("az"))
    return rows.select("pathname", "seg_idx", "s", F.round(x, 2).alias("x"), F.round(z, 2).alias("z"), F.round(F.col("along") + F.col("t") * F.col("length"), 2).alias("along"), F.round("t", 3).alias("t"))


def shape_anchors(net: DataFrame, step: float = 1.0) -> DataFrame:
    """(ax, az, bx, bz, x, z): anchors() of each shape, in order, as arrays; segments with the same ends have the same anchors."""
    shapes = net.select("ax", "az", "bx", "bz").distinct()
    rows = shapes.withColumn("length", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("bz") - F.col("az")) ** 2)).where("length >= 1e-6")
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.rint(F.col("length") / step).cast("int")))

    def along(a, b):
        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.round(F.col(a) + s / F.col("n") * (F.col(b) - F.col(a)), 2))

    return rows.select("ax", "az", "bx", "bz", along("ax", "bx").alias("x"), along("az", "bz").alias("z"))


def path_ends(net: DataFrame) -> DataFrame:
    """(pathname, side, x, z): first point (0) and last point (1) of each path."""
    first, last = F.min_by(F.struct(F.col("ax").alias("x"), F.col("az").alias("z")), "seg_idx"), F.max_by(F.struct(F.col("bx").alias("x"), F.col("bz").alias("z")), "seg_idx")
    ends = net.groupBy("pathname").agg(first.alias("f"), last.alias("l"))
    return ends.select("pathname", F.posexplode(F.array("f", "l")).alias("side", "p")).select("pathname", "side", "p.x", "p.z")


def snapped_nodes(ends: DataFrame, grid: float = 1.0) -> DataFrame:
    """Order-free nodes: ends that round to one grid point are one node."""
    return ends.withColumn("node", F.concat_ws(",", F.rint(F.col("x") / grid).cast("bigint").cast("string"), F.rint(F.col("z") / grid).cast("bigint").cast("string")))


def greedy_nodes(ends: DataFrame, order: list[str], radius: float = 1.0) -> DataFrame:
    """Order-dependent nodes as the network files have them. Two ends a path, so one ordered task is enough."""

    def run(batches):
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["pathname", "side", "x", "z"])]).reset_index(drop=True)
        node, centres = kernels.clustered(rows[["x", "z"]].to_numpy(float))
        rows["node"], rows["node_x"], rows["node_z"] = node, centres[node, 0], centres[node, 1]
        yield rows[["pathname", "side", "x", "z", "node", "node_x", "node_z"]]

    one = ends.select("pathname", "side", "x", "z").repartition(1).sortWithinPartitions(*order)
    return one.mapInPandas(run, "pathname string, side int, x double, z double, node long, node_x double, node_z double")


def strict_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst) of different paths that share a node, both ways."""
    a = nodes.select("node", F.col("pathname").alias("src")).distinct()
    b = nodes.select("node", F.col("pathname").alias("dst")).distinct()
    return a.join(b, "node").where("src <> dst").select("src", "dst").distinct()


def segment_ends(net: DataFrame) -> DataFrame:
    """(pathname, x, z): both ends of every segment, with two decimals, each once a path."""
    a = net.select("pathname", F.bround("ax", 2).alias("x"), F.bround("az", 2).alias("z"))
    return a.unionByName(net.select("pathname", F.bround("bx", 2).alias("x"), F.bround("bz", 2).alias("z"))).distinct()


def space_edges(ends: DataFrame, strict: DataFrame, directions: DataFrame, radius: float = 30.0, angle: float = 20.0) -> DataFrame:
    """Pairs of paths with points at most `radius` apart that are not strict and cross at `angle` or more, both ways."""
    near = radius_join(ends.select("pathname", "x", "z"), ends.select("pathname", "x", "z"), radius).where("pathname < r_pathname")
    pairs = near.select(F.col("pathname").alias("src"), F.col("r_pathname").alias("dst")).distinct()
    pairs = pairs.join(strict, ["src", "dst"], "left_anti")
    d = directions.select("pathname", "path_dir")
    both = pairs.join(d.withColumnsRenamed({"pathname": "src", "path_dir": "a"}), "src").join(d.withColumnsRenamed({"pathname": "dst", "path_dir": "b"}), "dst")
    gap = F.abs(F.col("a") - F.col("b"))
    gap = F.when(gap > 180.0, 360.0 - gap).otherwise(gap)
    one = both.where(gap >= angle).select("src", "dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def total_edges(*edges: DataFrame) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def near_edges(ends: DataFrame, radius: float = 80.0) -> DataFrame:
    """Adjacency of network files that list paths only: ends at most `radius` apart."""
    near = radius_join(ends.select("pathname", "x", "z"), ends.select("pathname", "x", "z"), radius).where("pathname <> r_pathname")
    return near.select(F.col("pathname").alias("src"), F.col("r_pathname").alias("dst")).distinct()


def legacy_edges(ends: DataFrame, snap: float = 0.5, radius: float = 80.0) -> DataFrame:
    """Shared ends on a `snap` grid, or ends within the radius."""
    shared = strict_edges(snapped_nodes(ends, snap))
    return total_edges(shared, near_edges(ends, radius))


#: Points and paths of a network whose paths' classes go to all executors as arrays; larger ones are joined by cells.
MOST_POINTS, MOST_PATHS = 2_000_000, 100_000


@dataclass
class Alike:
    """Paths in classes: those of a class have the same points, nodes and direction, so the same neighbours but for
    themselves. A class is named by its smallest path; classes come in that order."""

    spark: SparkSession
    paths: list[list[str]]
    places: kernels.Places
    cut: np.ndarray
    xz: np.ndarray
    nodes: np.ndarray
    direction: np.ndarray
    radius: float
    angle: float

    @property
    def size(self) -> np.ndarray:
        return np.array([len(p) for p in self.paths], np.int64)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes with a strict and classes with a space edge from class k; k is among the first if it has several paths
        (its paths share their nodes)."""
        mine = self.nodes[k]
        strict = ((self.nodes[:, :1] == mine) | (self.nodes[:, 1:] == mine)).any(axis=1) if self.nodes.shape[1] else np.zeros(len(self.paths), bool)
        if len(self.paths[k]) < 2:
            strict[k] = False
        near = self.places.near(self.xz[self.cut[k] : self.cut[k + 1]], self.radius)
        gap = np.abs(self.direction[near] - self.direction[k])
        gap = np.where(gap > 180.0, 360.0 - gap, gap)
        near = near[(gap >= self.angle) & ~strict[near]]
        return np.flatnonzero(strict), near[(near != k) | (len(self.paths[k]) > 1)]

    def rows(self, made, schema: str) -> DataFrame:
        """made(classes, this) -> pandas frame, over all classes in parts; a network without paths gives no rows."""
        shared, n = self.spark.sparkContext.broadcast(self), len(self.paths)
        parts = max(1, min(n // 64, 8 * self.spark.sparkContext.defaultParallelism))

        def run(batches):
            own = [b["id"].to_numpy() for b in batches]
            if own and len(own := np.concatenate(own)):
                yield from made(own, shared.value)

        return self.spark.range(0, n, 1, parts).mapInPandas(run, schema)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "spark"}

    def lists(self) -> DataFrame:
        """(cls, strict, space, degree): the neighbouring classes, and the edges of one of the class's paths."""

        def made(own, this):
            size = this.size
            for at in range(0, len(own), 64):
                found = [(k, *this.row(k)) for k in own[at : at + 64]]
                degree = [int(size[a].sum() - (len(a) and (a == k).any()) + size[b].sum() - (b == k).any()) for k, a, b in found]
                yield pd.DataFrame({"cls": [k for k, *_ in found], "strict": [a for _, a, _ in found], "space": [b for *_, b in found], "degree": degree})

        return self.rows(made, "cls long, strict array<long>, space array<long>, degree long")

    def links(self, names: list[str], stay: float = 0.7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """transitions() as Network.links: a bit for each pair of classes."""

        def made(own, this):
            size = this.size
            for k in own:
                a, b = this.row(k)
                flags = np.zeros(len(size), bool)
                flags[a] = flags[b] = True
                yield pd.DataFrame({"cls": [k], "bits": [np.packbits(flags, bitorder="little").tobytes()], "degree": [int(size[flags].sum() - flags[k])]})

        rows = self.rows(made, "cls long, bits binary, degree long").orderBy("cls").toArrow()
        bits = np.stack([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()]) if rows.num_rows else np.zeros((0, 0), np.uint8)
        kind = {p: k for k, paths in enumerate(self.paths) for p in paths}
        return np.array([kind[n] for n in names], int), bits, (1.0 - stay) / np.maximum(1, rows.column("degree").to_numpy()), stay

    def members(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(enumerate(self.paths)), "cls long, paths array<string>"))

    def edges(self, kinds: tuple[str, ...] = ("strict", "space"), value: Column | None = None) -> DataFrame:
        """(src, dst, value) of all paths, each pair once and both ways; value is worked out for each class."""
        others = F.col(kinds[0]) if len(kinds) == 1 else F.concat(*kinds)
        members = self.members()
        pairs = self.lists().select("cls", (F.col("degree") if value is None else value).alias("value"), F.explode(others).alias("other"))
        pairs = pairs.join(members.withColumnsRenamed({"cls": "other", "paths": "to"}), "other").join(members, "cls")
        rows = pairs.select((F.col("cls") == F.col("other")).alias("own"), "value", "paths", F.explode("to").alias("dst"))
        return rows.select(F.explode("paths").alias("src"), "dst", "own", "value").where("not own or src <> dst").select("src", "dst", "value")

    def transitions(self, stay: float = 0.7, digits: int | None = None) -> DataFrame:
        """transitions() of all edges, rounded to so many digits for each class."""

        def shown(p):
            return p if digits is None else F.round(p, digits)

        moves = self.edges(value=shown(F.lit(1.0 - stay) / F.col("degree"))).withColumnRenamed("value", "p")
        own = self.members().select(F.explode("paths").alias("src"))
        return moves.unionByName(own.select("src", F.col("src").alias("dst"), shown(F.lit(stay)).alias("p")))

    def neighbour_lists(self) -> DataFrame:
        """neighbour_lists() of all edges: a class's list is sorted once, its paths leave themselves out of it."""
        members = self.members()
        pairs = self.lists().select("cls", F.explode(F.concat("strict", "space")).alias("cls_to"))
        lists = pairs.join(members.withColumnsRenamed({"cls": "cls_to", "paths": "to"}), "cls_to").groupBy("cls").agg(F.array_sort(F.flatten(F.collect_list("to"))).alias("to"))
        none = F.array().cast("array<string>")
        rows = members.join(lists, "cls", "left").select(F.explode("paths").alias("pathname"), F.coalesce("to", none).alias("to"))
        return rows.select("pathname", F.array_remove("to", F.col("pathname")).alias("neighbours"))

    def components(self) -> DataFrame:
        """components() of all edges. Each task gives links that connect what its classes' edges connect; paths of one
        class share their nodes."""
        names = [p[0] for p in self.paths]

        def made(own, this):
            label = np.arange(len(this.paths))
            for k in own:
                a, b = this.row(k)
                met = np.unique(np.concatenate((label[a], label[b], label[k : k + 1])))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pd.DataFrame({"a": label[moved], "b": moved})

        reps = self.spark.createDataFrame(list(enumerate(names)), "cls long, pathname string")
        links = self.rows(made, "a long, b long").distinct()
        links = links.join(reps.withColumnsRenamed({"cls": "a", "pathname": "src"}), "a").join(reps.withColumnsRenamed({"cls": "b", "pathname": "dst"}), "b").select("src", "dst").checkpoint()
        found = components(reps.select("pathname"), links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        members = self.spark.createDataFrame([(p[0], p) for p in self.paths], "pathname string, paths array<string>")
        return found.join(members, "pathname").select(F.explode("paths").alias("pathname"), "component")

    def counts(self) -> DataFrame:
        """One row with the numbers of strict and space edges."""

        def made(own, this):
            size, strict, space = this.size, 0, 0
            for k in own:
                a, b = this.row(k)
                strict += int(size[k] * (size[a].sum() - (a == k).any()))
                space += int(size[k] * (size[b].sum() - (b == k).any()))
            yield pd.DataFrame({"strict": [strict], "space": [space]})

        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("strict", "space")]
        return self.rows(made, "strict long, space long").agg(*sums)


def alike(points: DataFrame, nodes: DataFrame | None, directions: DataFrame | None, radius: float, angle: float = 0.0, most_points: int = MOST_POINTS, most_paths: int = MOST_PATHS) -> Alike | None:
    """Classes of the paths of points (pathname, x, z), nodes (pathname, side, node) and directions (pathname, path_dir);
    None beyond the bounds, where the edge tables are joined instead. Without nodes there are no strict edges, without
    directions any two paths cross."""
    shape = points.groupBy("pathname").agg(F.array_sort(F.collect_set(F.struct("x", "z"))).alias("p"))
    if nodes is not None:
        shape = shape.join(nodes.groupBy("pathname").agg(F.min(F.when(F.col("side") == 0, F.col("node"))).alias("n0"), F.min(F.when(F.col("side") == 1, F.col("node"))).alias("n1")), "pathname")
    if directions is not None:
        shape = shape.join(directions.select("pathname", "path_dir"), "pathname")
    keys = [c for c in shape.columns if c != "pathname"]
    classes = shape.groupBy(*keys).agg(F.array_sort(F.collect_list("pathname")).alias("paths")).checkpoint()
    n, total = classes.agg(F.sum(F.size("paths")), F.sum(F.size("p"))).first()
    if (total or 0) > most_points or (n or 0) > most_paths:
        return None
    rows = classes.select("paths", F.transform("p", lambda p: p["x"]).alias("x"), F.transform("p", lambda p: p["z"]).alias("z"), *keys[1:]).toArrow().combine_chunks()
    names = rows.column("paths").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i][0])
    rows = rows.take(order).combine_chunks()
    x, z = (np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in rows.column(k).chunks)]) for k in ("x", "z"))
    cut = np.concatenate(([0], np.cumsum([len(v) for v in rows.column("x").to_pylist()]))).astype(int)
    xz, count = np.stack((x, z), axis=1), len(names)
    ends = np.empty((count, 0), int)
    if nodes is not None:
        ends = np.unique(np.array([rows.column(c).to_pylist() for c in ("n0", "n1")], str), return_inverse=True)[1].reshape(2, -1).T
    direction = rows.column("path_dir").to_numpy() if directions is not None else np.zeros(count)
    places = kernels.Places(np.repeat(np.arange(count), np.diff(cut)), xz, count)
    return Alike(points.sparkSession, [names[i] for i in order], places, cut, xz, ends, direction, radius, angle)


def transitions(paths: DataFrame, edges: DataFrame, stay: float = 0.7) -> DataFrame:
    """(src, dst, p): `stay` to itself, the rest in equal parts to the neighbours. Isolated paths keep a sum of `stay`."""
    degree = F.count("*").over(Window.partitionBy("src"))
    moves = edges.select("src", "dst", (F.lit(1.0 - stay) / degree).alias("p"))
    return moves.unionByName(paths.select(F.col("pathname").alias("src"), F.col("pathname").alias("dst"), F.lit(stay).alias("p")))


def components(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(pathname, component): the smallest path name that can be reached. Minimum labels with pointer jumping; every
    round is cut by checkpoint()."""
    links = edges.unionByName(paths.select(F.col("pathname").alias("src"), F.col("pathname").alias("dst"))).distinct().checkpoint()
    labels = paths.select("pathname", F.col("pathname").alias("component")).checkpoint()
    while True:
        best = links.join(labels, links.dst == labels.pathname).groupBy("src").agg(F.min("component").alias("m"))
        jump = best.join(labels.withColumnsRenamed({"pathname": "m", "component": "further"}), "m")
        new = jump.select(F.col("src").alias("pathname"), F.least("m", "further").alias("component")).checkpoint()
        if new.join(labels.withColumnRenamed("component", "old"), "pathname").where("component <> old").isEmpty():
            return new
        labels = new


def largest_components(comps: DataFrame, k: int = 8) -> DataFrame:
    """(rank, component, paths) of the k components with the most paths, ties to the smaller name: a report."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("paths")).orderBy(F.desc("paths"), "component").limit(k)
    return sizes.select(F.row_number().over(Window.orderBy(F.desc("paths"), "component")).alias("rank"), "component", "paths")


def neighbour_lists(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(pathname, neighbours sorted), isolated paths with none."""
    lists = edges.groupBy(F.col("src").alias("pathname")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return paths.select("pathname").join(lists, "pathname", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ: keys, status (missing, extra, changed) and the differing columns. Keys are compared as text, as
    documents have them, so that numbers and their texts are one key."""
    values = [c for c in old.columns if c not in keys]
    old, new = (df.withColumns({k: F.col(k).cast("string") for k in keys if dict(old.dtypes)[k] != dict(new.dtypes)[k]}) for df in (old, new))
    a = old.select(*keys, F.struct(*values).alias("a"))
    b = new.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, keys, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in values]), lambda x: x.isNotNull())
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.size(changed) > 0, "changed")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", F.concat_ws(",", changed)).otherwise("").alias("columns")).where("status is not null")


def split_at_junctions(way_nodes: DataFrame) -> DataFrame:
    """way_nodes (way, pos, node): pieces between junctions, which are nodes of two ways or more and way ends; a
    junction inside a way belongs to both pieces. (way, piece, pos, node)"""
    w = Window.partitionBy("way").orderBy("pos")
    whole = Window.partitionBy("way")
    shared = way_nodes.groupBy("node").agg(F.countDistinct("way").alias("ways"))
    rows = way_nodes.join(shared, "node").withColumn("first", F.min("pos").over(whole)).withColumn("last", F.max("pos").over(whole))
    inner = (F.col("ways") >= 2) & (F.col("pos") > F.col("first")) & (F.col("pos") < F.col("last"))
    rows = rows.withColumn("cut", inner).withColumn("piece", F.sum(F.when(inner, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.when(F.col("cut"), F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece"))
    return rows.select("way", F.explode(pieces).alias("piece"), "pos", "node")


def keep_closure(ways: DataFrame, way_nodes: DataFrame, members: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, id) that stay: tagged ways and relations, members' ways, nodes that these use, tagged nodes."""
    rel = relations.where("kept").select("relation")
    kept_ways = ways.where("kept").select("way").unionByName(members.join(rel, "relation", "left_semi").select("way").join(ways, "way", "left_semi")).distinct()
    kept_nodes = way_nodes.join(kept_ways, "way", "left_semi").select("node").unionByName(nodes.where("kept").select("node")).distinct()
    out = rel.select(F.lit("relation").alias("kind"), F.col("relation").alias("id"))
    return out.unionByName(kept_ways.select(F.lit("way").alias("kind"), F.col("way").alias("id"))).unionByName(kept_nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id")))


def dangling(way_nodes: DataFrame, source_nodes: DataFrame) -> DataFrame:
    """References of kept ways to nodes that the source lacks."""
    return way_nodes.join(source_nodes.select("node"), "node", "left_anti").select("way", "node").distinct()


def named_paths(pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    """pieces (way, piece), kinds (way, piece, kind): N-1, N-2, ... and R-1, R-2, ... in source order within a class."""
    n = F.row_number().over(Window.partitionBy("kind").orderBy("way", "piece"))
    return pieces.select("way", "piece").distinct().join(kinds, ["way", "piece"]).withColumn("pathname", F.concat_ws("-", "kind", n.cast("string")))


def numbered_points(pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    """pieces (way, piece, pos, node): adds pathname and pointname, which counts the points of all paths from 0, straight
    paths first. Only the paths' sizes are summed in order; points are counted within their path."""
    sizes = pieces.groupBy("way", "piece").agg(F.count("*").alias("points"))
    named = named_paths(pieces, kinds).join(sizes, ["way", "piece"])
    before = Window.orderBy("kind", "way", "piece").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("base", F.coalesce(F.sum("points").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("way", "piece").orderBy("pos")) - 1
    rows = pieces.select("way", "piece", "pos", "node").withColumn("own", own).join(named, ["way", "piece"])
    return rows.select("way", "piece", "pos", "node", "pathname", (F.col("base") + F.col("own")).alias("pointname"))


def junction_numbers(nodes: DataFrame) -> DataFrame:
    """Labels J0, J1, ... from north to south, then west to east, then by node; junctions of one map only."""
    n = F.row_number().over(Window.orderBy(F.desc("lat"), "lon", "node")) - 1
    return nodes.withColumn("label", F.concat(F.lit("J"), n.cast("string")))


def meta(paths: DataFrame, nodes: DataFrame, segments: DataFrame, anchor_points: DataFrame, strict: DataFrame | None, space: DataFrame | None, total: DataFrame | None, comps: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row of counts; neighbours count once for each path that has them, so a pair counts twice. counts (strict,
    space) takes the place of the edge tables."""

    def one(df, e, name):
        return df.agg(e.alias(name))

    sizes = comps.groupBy("component").count()
    parts = [one(paths, F.count("*"), "n_paths"), one(nodes, F.countDistinct("node"), "n_nodes"), one(segments, F.count("*"), "n_segments"), one(anchor_points, F.count("*"), "n_internal_points")]
    if counts is None:
        parts += [one(e, F.count("*"), n) for e, n in ((strict, "adjacency_strict"), (space, "adjacency_space"), (total, "adjacency_total"))]
    else:
        parts.append(counts.select(F.col("strict").alias("adjacency_strict"), F.col("space").alias("adjacency_space"), (F.col("strict") + F.col("space")).alias("adjacency_total")))
    parts += [sizes.agg(F.count("*").alias("n_components"), F.max("count").alias("max_component"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
