"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two shuffles with map-side minima; a hub of any degree is only a skewed join key, which
adaptive execution splits. Nothing but two numbers a round reaches the driver. Rounds cost the driver plans, broadcasts
and threads whatever the edges' number, so callers with several graphs may have the last few edges finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

#: Edges that one task finishes: 16 MB, and some times that while it works.
FEW = 1_000_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(least, "b").where("a <> m").select(F.col("m"), F.col("a").alias("v"))
    return moved.unionByName(least.select("m", F.col("b").alias("v"))).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task: roots are hooked to smaller ones, and paths cut short, until no edge is left."""
    ends = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    if not ends:
        return
    names, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(names))
    while ((x := label[a]) != (y := label[b])).any():
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(names)))
    for part in np.array_split(rest, -(-len(rest) // 100_000)):
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[label[part]])], ["node", "component"])
    release()


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """edges: long columns a and b. Returns (node, component) for every node but the least of its component.

    Nulls and loops are ignored, order and repeats don't matter; an empty table gives an empty one. Once the rounds have
    left `few` edges at most, one task does the rest; with none, the rounds go on until nothing changes."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0] > few:
        e = written(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component"))
        mark = now
    return e.coalesce(1).mapInArrow(_finished, "node bigint, component bigint")
