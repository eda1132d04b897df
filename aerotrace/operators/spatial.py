"""Spatial joins as equi-joins on grid cells, and distances to features.

Catalyst turns a distance predicate into a nested loop; here each left row looks into the cells that its radius
touches and the exact distance is checked after the equi-join, so both sides are shuffled by cell and never crossed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.geometry import distance_to_segment


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_xz=("x", "z"), right_xz=("x", "z"), prefix: str = "r_") -> DataFrame:
    """Pairs of points at most `radius` apart, with their distance. Columns of the right side get the prefix."""
    r = right.select([F.col(c).alias(prefix + c) for c in right.columns])
    rx, rz = (F.col(prefix + c) for c in right_xz)
    r = r.withColumn("__cx", F.floor(rx / radius)).withColumn("__cz", F.floor(rz / radius))
    x, z = (F.col(c) for c in left_xz)
    near = left.withColumn("__cx", F.explode(_cells(x - radius, x + radius, radius))).withColumn("__cz", F.explode(_cells(z - radius, z + radius, radius)))
    d = F.sqrt((x - rx) ** 2 + (z - rz) ** 2)
    return near.join(r, ["__cx", "__cz"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("__cx", "__cz")


def segment_radius_join(points: DataFrame, segments: DataFrame, radius: float, strict: bool = True) -> DataFrame:
    """Pairs of points (x, z) and segments (ax, az, bx, bz) nearer than radius, each once, with their distance."""
    cells = segments.withColumn("__cx", F.explode(_cells(F.least("ax", "bx") - radius, F.greatest("ax", "bx") + radius, radius)))
    cells = cells.withColumn("__cz", F.explode(_cells(F.least("az", "bz") - radius, F.greatest("az", "bz") + radius, radius)))
    own = points.withColumn("__cx", F.floor(F.col("x") / radius)).withColumn("__cz", F.floor(F.col("z") / radius))
    pairs = own.join(cells, ["__cx", "__cz"]).withColumn("distance", distance_to_segment("x", "z", "ax", "az", "bx", "bz"))
    return pairs.where(F.col("distance") < radius if strict else F.col("distance") <= radius).drop("__cx", "__cz")


def top_k(pairs: DataFrame, by: list[str], order: list[Column | str], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; Spark limits groups before the shuffle."""
    return pairs.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def knn_join(points: DataFrame, items: DataFrame, k: int, by: list[str], tie: list[str], cell: float, reach: float) -> DataFrame:
    """The k nearest items (x, z) of each point, by doubling the radius until the k-th neighbour is inside it.

    For networks too large to broadcast. Points without k items within `reach` keep those they have there. Ties at nine
    places go by `tie`."""
    todo, out, r = points, None, cell
    while True:
        last = r >= reach
        ranked = top_k(radius_join(todo, items, min(r, reach)), by, [F.round("distance", 9), *(f"r_{t}" for t in tie)], k)
        done = ranked.groupBy(*by).agg(F.count("*").alias("__n")).where(F.lit(last) | (F.col("__n") >= k)).select(*by)
        found = ranked.join(done, by)
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        todo, r = todo.join(done, by, "left_anti").checkpoint(), r * 2


#: Feature segments that all executors may get as arrays; more are compared as a join.
MOST_FEATURES = 100_000


def _joined_feature_distance(points: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """feature_distance() by cells: the radius doubles until every kind is found within it, which makes it the nearest."""
    features = features.select("kind", "ax", "az", "bx", "bz")
    box = [f(e) for e in (F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("az", "bz"), F.greatest("az", "bz")) for f in (F.min, F.max)]
    wide = F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("bz") - F.col("az"))))
    kinds, r, x0, _, _, x1, z0, _, _, z1 = features.agg(F.countDistinct("kind"), wide, *box).first()
    ends = points.agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    if not kinds or ends[0] is None:
        return points.select(*by, F.lit("").alias("kind"), F.lit(0.0).alias("distance")).limit(0)
    reach = float(np.hypot(max(x1, ends[1]) - min(x0, ends[0]), max(z1, ends[3]) - min(z0, ends[2]))) + 1.0
    todo, out, r = points.select(*by, "x", "z"), None, max(1.0, float(r))
    while True:
        last = r >= reach
        near = segment_radius_join(todo, features, min(r, reach), strict=False).groupBy(*by, "kind").agg(F.min("distance").alias("distance"))
        near = near if last else near.checkpoint()
        done = near.groupBy(*by).agg(F.count("*").alias("__n")).where(F.lit(last) | (F.col("__n") == kinds)).select(*by)
        found = near.join(done, by)
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        todo, r = todo.join(done, by, "left_anti").checkpoint(), r * 2


class _Nearest:
    """The nearest segment of each point (number, distance), ties to the smaller number; what was found is kept for SEEN points."""

    SEEN = 200_000

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.net = kernels.Network(np.zeros(len(a), int), np.arange(len(a)), a, b, [""], {})
        low, high = np.minimum(a, b), np.maximum(a, b)
        self.grid, self.seen = kernels.Grid(low, high, max(1.0, float(np.median((high - low).max(axis=1))))), {}

    def of(self, p: np.ndarray) -> list[tuple[int, float]]:
        if len(self.seen) > self.SEEN:
            self.seen.clear()
        keys = list(map(tuple, p.tolist()))
        new = list(dict.fromkeys(k for k in keys if k not in self.seen))
        found = self.grid.nearest(np.array(new, float).reshape(-1, 2), 1, lambda q, items: self.net.project(q, np.broadcast_to(items, (len(q), len(items))))[1])
        self.seen.update((k, (int(i[0]), float(d[0]))) for k, (i, d) in zip(new, found, strict=True))
        return [self.seen[k] for k in keys]


def nearest_feature_name(points: DataFrame, features: DataFrame, by: list[str], most: int = MOST_FEATURES) -> DataFrame:
    """features (kind, ax, az, bx, bz): (by, kind, distance) of the nearest one to each point, ties to the smaller kind; over
    `most` distinct features the distances to all kinds."""
    rows = features.groupBy("ax", "az", "bx", "bz").agg(F.min("kind").alias("kind")).limit(most + 1).toPandas()
    if len(rows) > most:
        return feature_distance(points, features, by, most)
    types = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", kind string, distance double"
    if not len(rows):
        return points.select(*by, F.lit("").alias("kind"), F.lit(0.0).alias("distance")).limit(0)
    rows = rows.sort_values("kind", kind="stable")
    names = rows["kind"].to_numpy(object)
    shared = points.sparkSession.sparkContext.broadcast((names, _Nearest(rows[["ax", "az"]].to_numpy(float), rows[["bx", "bz"]].to_numpy(float))))

    def run(batches):
        names, nearest = shared.value
        for batch in batches:
            found = nearest.of(batch[["x", "z"]].to_numpy(float))
            yield batch[by].assign(kind=names[[i for i, _ in found]], distance=[d for _, d in found])

    return points.select(*by, "x", "z").mapInPandas(run, schema)


def feature_distance(points: DataFrame, features: DataFrame, by: list[str], most: int = MOST_FEATURES) -> DataFrame:
    """(by, kind, distance): for each point the exact distance to the nearest segment of each kind of feature.

    Up to `most` features go to all executors as arrays; more are joined by cells, with the same result."""
    rows = features.select("kind", "ax", "az", "bx", "bz").distinct().limit(most + 1).toPandas()
    if len(rows) > most:
        return _joined_feature_distance(points, features, by)
    kinds = {k: (g[["ax", "az"]].to_numpy(float), g[["bx", "bz"]].to_numpy(float)) for k, g in rows.groupby("kind")}
    shared = points.sparkSession.sparkContext.broadcast({kind: _Nearest(a, b) for kind, (a, b) in kinds.items()})

    def run(batches):
        for batch in batches:
            p = batch[["x", "z"]].to_numpy(float)
            for kind, nearest in shared.value.items():
                yield batch[by].assign(kind=kind, distance=[d for _, d in nearest.of(p)])

    types = dict(points.dtypes)
    return points.select(*by, "x", "z").mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in by) + ", kind string, distance double")


def inside(points: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, ring: the rings (ring, ax, az, bx, bz) that hold a point, by crossing parity. A ring's edge counts when it
    spans the point's z half-open and crosses to its right."""
    spans = (F.col("az") > F.col("z")) != (F.col("bz") > F.col("z"))
    crosses = F.col("x") < F.col("ax") + (F.col("z") - F.col("az")) * (F.col("bx") - F.col("ax")) / (F.col("bz") - F.col("az"))
    edges = edges.select("ring", "ax", "az", "bx", "bz").where("az <> bz")
    # an edge spans only points of the bands of z that it runs through
    band = max(1e-6, edges.agg(F.avg(F.abs(F.col("bz") - F.col("az")))).first()[0] or 1.0)
    edges = edges.withColumn("__band", F.explode(_cells(F.least("az", "bz"), F.greatest("az", "bz"), band)))
    pairs = points.withColumn("__band", F.floor(F.col("z") / band)).join(edges, "__band").where(spans & crosses)
    return pairs.groupBy(*by, "ring").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(*by, "ring")


def nearest_name(distances: DataFrame, by: list[str], name: str, limit: float) -> DataFrame:
    """The nearest feature's name, ties to the smaller name; '' beyond the limit."""
    best = distances.groupBy(*by).agg(F.min(F.struct("distance", name)).alias("__b"))
    return best.select(*by, F.when(F.col("__b.distance") <= limit, F.col(f"__b.{name}")).otherwise("").alias(name))
