"""The offline map matcher: reference directions from matched segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import windows
from .estimator import Loaded, grouped, load_network
from .network import with_neighbours

MATCHED = "angle_self_new double, angle_graph_new double, graph_match_dist double, graph_seg_idx int"


def nearest_segments(rows: DataFrame, loaded: Loaded, k: int, limit: float) -> DataFrame:
    """(traj_id, seq, gid, distance, rank) of the k nearest segments under the limit, ties to the smaller number."""
    shared = rows.sparkSession.sparkContext.broadcast(loaded)

    def run(batches):
        for b in batches:
            found = shared.value.nearest_segments(b[["x", "z"]].to_numpy(float), k, limit)
            n = [len(i) for i, _ in found]
            at = np.repeat(np.arange(len(b)), n)
            if len(at):
                yield pd.DataFrame({"traj_id": b["traj_id"].to_numpy()[at], "seq": b["seq"].to_numpy()[at], "gid": np.concatenate([i for i, _ in found]), "distance": np.concatenate([d for _, d in found]), "rank": np.concatenate([np.arange(1, m + 1) for m in n])})

    kind = dict(rows.dtypes)
    return rows.select("traj_id", "seq", "x", "z").mapInPandas(run, f"traj_id {kind['traj_id']}, seq {kind['seq']}, gid bigint, distance double, rank int")


def end_clusters(a: np.ndarray, b: np.ndarray, radius: float = 20.0, literal: bool = False) -> np.ndarray:
    """The clusters of each segment's two ends: ends at most `radius` apart are joined, transitively.

    `literal` reads the stacked ends as if they were interleaved, which scrambles the adjacency."""
    label = kernels.clusters(np.concatenate([a, b]), radius)
    return label.reshape(-1, 2) if literal else label.reshape(2, -1).T


def map_match(rows: DataFrame, net: DataFrame, literal: bool = False) -> DataFrame:
    """Adds the matched segment and its distance, the smoothed own direction and the direction along the map.

    Missing positions count as (0, 0); tracks under three samples get nulls."""
    n = with_neighbours(net).select("path_no", "seg_idx", "course", "prev_dx", "prev_dz", "next_dx", "next_dz").toArrow().to_pandas().sort_values(["path_no", "seg_idx"])
    loaded = load_network(net)
    shared = rows.sparkSession.sparkContext.broadcast((loaded, n["course"].to_numpy(float), n[["prev_dx", "prev_dz"]].to_numpy(float), n[["next_dx", "next_dz"]].to_numpy(float), end_clusters(loaded.net.a, loaded.net.b, literal=literal)))
    rows = rows.withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("z", F.coalesce("z", F.lit(0.0)))
    rows = windows.central_direction(windows.window_direction(rows, 20, signed=True, out="win20"))

    def kernel(track: pd.DataFrame) -> pd.DataFrame:
        if len(track) < 3:
            return track.assign(angle_self_new=None, angle_graph_new=None, graph_match_dist=None, graph_seg_idx=None)
        loaded, course, before, after, cluster = shared.value
        net = loaded.net
        p = track[["x", "z"]].to_numpy(float)
        window, clean = track["win20"].to_numpy(float), track["clean_dir"].to_numpy(float)
        found = loaded.nearest_segments(p, kernels.TOP_K, kernels.CANDIDATE_LIMIT)
        seg = kernels.matcher_viterbi([f[0] for f in found], [f[1] for f in found], window, course, cluster)
        dist = np.array([f[1][f[0] == s][0] if s >= 0 else np.inf for f, s in zip(found, seg, strict=True)])
        at = np.maximum(seg, 0)
        t = np.clip(((p - net.a[at]) * net.d[at]).sum(axis=1) / net.d2[at], 0.0, 1.0)

        def unit(v):
            return v / np.maximum(np.hypot(v[:, 0], v[:, 1]), 1e-9)[:, None]

        wp, wn = np.maximum(0.0, 0.5 - t)[:, None], np.maximum(0.0, t - 0.5)[:, None]
        tangent = unit((1 - wp - wn) * unit(net.d[at]) + wp * unit(before[at]) + wn * unit(after[at]))
        sign = kernels.filled_signs(kernels.travel_signs(seg, dist, p, tangent, window), seg >= 0)
        v = tangent * sign[:, None]
        angle = kernels.half_open(np.degrees(np.arctan2(v[:, 1], v[:, 0])))
        angle = np.where((seg < 0) | (dist > kernels.MATCH_LIMIT) | (sign == 0), np.nan, angle)
        angle = kernels.aligned_runs(kernels.corrected_flips(angle, clean), seg, window)
        shown = seg >= 0
        return track.assign(
            angle_self_new=track["self_dir"].round(4), angle_graph_new=pd.Series([None if np.isnan(x) else round(float(x), 4) for x in angle], dtype=object),
            graph_match_dist=pd.Series([round(float(x), 2) if s else None for x, s in zip(dist, shown, strict=True)], dtype=object),
            graph_seg_idx=pd.Series([int(x) if s else None for x, s in zip(seg, shown, strict=True)], dtype=object),
        )

    return grouped(rows, kernel, MATCHED)
