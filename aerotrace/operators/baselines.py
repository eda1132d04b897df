"""Baseline estimators; each adds est_x, est_z and est_dir (null where it has no answer)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import scoring, windows
from .estimator import KNN, Loaded, grouped, ranked_emissions, run, together, with_columns

EST = "est_x double, est_z double, est_dir double"


def _out(track: pd.DataFrame, place: np.ndarray, heading: np.ndarray) -> pd.DataFrame:
    def nulls(v):
        return pd.arrays.FloatingArray(np.where(np.isnan(v), 0.0, v), np.isnan(v))

    return track.assign(est_x=nulls(place[:, 0]), est_z=nulls(place[:, 1]), est_dir=nulls(heading))


def _points(track: pd.DataFrame) -> np.ndarray:
    return track[["x", "z"]].to_numpy(float)


def _facing(direction: np.ndarray, window: np.ndarray) -> np.ndarray:
    turn = ~np.isnan(window) & (kernels.error(direction, np.nan_to_num(window)) > 90.0)
    return np.where(turn, (direction + 180.0) % 360.0, direction)


def cvm(rows: DataFrame, loaded: Loaded | None = None) -> DataFrame:
    return windows.extrapolated(rows).withColumnsRenamed({"cvm_x": "est_x", "cvm_z": "est_z", "cvm_dir": "est_dir"})


def flight2vec(rows: DataFrame, loaded: Loaded | None = None) -> DataFrame:
    return windows.trailing_motion(rows).withColumnsRenamed({"f2v_x": "est_x", "f2v_z": "est_z", "f2v_dir": "est_dir"})


def ekf(rows: DataFrame, loaded: Loaded | None = None) -> DataFrame:
    return grouped(rows, lambda track: _out(track, *kernels.turning_filter(_points(track))), EST)


def _feet(net: kernels.Network, p: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point and its path the nearest segment, the first of those as near, its foot there, and the squared distance."""
    start = np.searchsorted(net.path, np.arange(len(net.names) + 1))
    size = start[path + 1] - start[path]
    own, row = kernels.spread(start[path], size), np.repeat(np.arange(len(p)), size)
    foot, d = net.project(p[row], own[:, None])
    foot, d = foot[:, 0], d[:, 0]
    near = np.flatnonzero(d == np.minimum.reduceat(d, np.cumsum(size) - size)[row])
    first = near[np.unique(row[near], return_index=True)[1]]
    return own[first], foot[first], d[first] ** 2


def sticky(loaded: Loaded, p: np.ndarray, window: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """kernels.sticky_paths() of tracks that start at cut, the end included: only the nearest paths of each direction and the path
    before can be picked."""
    paths, squared = loaded.near_paths(p)

    def weight(squared, path, window):
        return -0.05 * squared - 0.2 * np.where(np.isnan(window), 0.0, kernels.error(loaded.net_dir[path], np.nan_to_num(window)))

    emission = weight(squared, paths, window[:, None])
    picks, (start, _, alive) = np.empty(len(p), int), kernels.in_step(cut)
    for t in range(len(alive)):
        now = start[: alive[t]] + t
        values = emission[now] - 5.0 if t else emission[now]
        best = values.argmax(axis=1)
        value, pick = values[np.arange(len(now)), best], paths[now, best]
        if t:
            before = picks[now - 1]
            stay = weight(_feet(loaded.net, p[now], before)[2], before, window[now]) - 5.0 + 20.0
            pick = np.where((stay > value) | ((stay == value) & (before < pick)), before, pick)
        picks[now] = pick
    return picks


def thmm(rows: DataFrame, loaded: Loaded) -> DataFrame:
    """Greedy sticky paths; the place is the nearest point of the chosen path."""
    shared = rows.sparkSession.sparkContext.broadcast(loaded)

    def kernel(tracks, cut):
        net, p, window = shared.value.net, _points(tracks), tracks["win_dir"].to_numpy(float)
        seg, place, _ = _feet(net, p, sticky(shared.value, p, window, cut))
        return _out(tracks, place, _facing(net.dir[seg], window))

    rows = windows.window_direction(rows)
    return together(rows, kernel, with_columns(rows, EST))


def _guarded(net: kernels.Network, p: np.ndarray, seg: np.ndarray) -> np.ndarray:
    foot = net.project(p, seg[:, None])[0][:, 0]
    return np.where(((net.b[seg] - net.a[seg]) ** 2).sum(axis=1)[:, None] < 1e-9, net.a[seg], foot)


def hmm_mm(rows: DataFrame, loaded: Loaded, literal: bool = False) -> DataFrame:
    """Offline Viterbi over 16 candidates by anchors. `literal` only ever stays on a segment, as names were compared
    with numbers there."""
    shared = rows.sparkSession.sparkContext.broadcast(loaded)
    stay, go = np.log(0.7 + kernels.EPS), np.log(0.3 * np.exp(-30.0 / 300.0) + kernels.EPS)

    def kernel(tracks, cut):
        net, p = shared.value.net, _points(tracks)
        cands, d = shared.value.near_owners(p, KNN, 16)
        emission = np.where(cands >= 0, np.log(np.exp(-(d**2) / (2 * kernels.SIGMA_DIST**2)) + kernels.EPS), -np.inf)
        path = net.path[cands]

        def step(before, now):
            a, b = path[before][:, :, None], path[now][:, None, :]
            joined = np.zeros(1, bool) if literal else (a != b) & (net.chances(a, b, -1.0) >= 0)
            return np.where(cands[before][:, :, None] == cands[now][:, None, :], stay, np.where(joined, go, -np.inf))

        seg = cands[np.arange(len(p)), kernels.lattices(cut, emission, step)]
        return _out(tracks, _guarded(net, p, seg), _facing(net.dir[seg], tracks["win_dir"].to_numpy(float)))

    rows = windows.window_direction(rows)
    return together(rows, kernel, with_columns(rows, EST))


def kf_hmm(rows: DataFrame, loaded: Loaded) -> DataFrame:
    """Motion filter and graph-free Viterbi, fused with equal weights."""
    bare = Loaded(loaded.net, loaded.gid, None, None, loaded.net_dir)
    shared = rows.sparkSession.sparkContext.broadcast(bare)
    grids: dict = {}

    def kernel(track):
        loaded, net = shared.value, shared.value.net
        state, window = kernels.kalman(track["x"].to_numpy(float), track["z"].to_numpy(float)), track["win_dir"].to_numpy(float)
        p = np.stack([state["kf_x"], state["kf_z"]], axis=1)
        cut, segs, e, *_ = ranked_emissions(loaded, p, window, grids)
        cands, emis = np.split(segs, cut[1:-1]), np.split(np.log(e + kernels.EPS), cut[1:-1])

        def step(t, before, now):
            other = np.log(0.2 / max(len(before) - 1, 1) + kernels.EPS)
            return np.where(before[:, None] == now[None, :], np.log(0.8 + kernels.EPS), other)

        seg = np.array([c[r] for c, r in zip(cands, kernels.lattice(cands, emis, step), strict=True)])
        a, b = np.radians(state["kf_dir"]), np.radians(_facing(net.dir[seg], window))
        heading = np.degrees(np.arctan2(np.sin(a) + np.sin(b), np.cos(a) + np.cos(b))) % 360.0
        return _out(track, 0.5 * p + 0.5 * _guarded(net, p, seg), heading)

    return grouped(windows.window_direction(windows.drop_missing(rows)), kernel, EST)


def proposed(rows: DataFrame, loaded: Loaded) -> DataFrame:
    return run(rows, loaded).withColumnsRenamed({"fusion_x": "est_x", "fusion_z": "est_z", "fusion_dir": "est_dir"})


METHODS = {"cvm": cvm, "ekf": ekf, "thmm": thmm, "flight2vec": flight2vec, "hmm_mm": hmm_mm, "kf_hmm": kf_hmm, "proposed": proposed}


#: Methods whose errors count only where position and heading are all there.
JOINT = ("hmm_mm", "kf_hmm")


def comparison_errors(estimates: DataFrame, truth: DataFrame, joint: tuple[str, ...] = JOINT) -> DataFrame:
    """estimates (method, traj_id, seq, est_x, est_z, est_dir), truth (traj_id, seq, flio, x, z, kf_speed, refdir): the
    errors of tracks that every method answered and that are arrivals or departures, for scoring.table().

    Where the speed is physical and there is a reference; of the joint methods only samples with all three errors."""
    methods = estimates.select("method").distinct()
    whole = estimates.groupBy("traj_id").agg(F.countDistinct("method").alias("__m")).join(methods.agg(F.count("*").alias("__all")), F.col("__m") == F.col("__all"), "left_semi").select("traj_id")
    rows = estimates.join(whole, "traj_id", "left_semi").join(truth.where(F.col("flio").isin("A", "D")), ["traj_id", "seq"])
    errs = scoring.errors(rows, "est_x", "est_z", "est_dir")
    counts = ~F.col("method").isin(*joint) | (F.col("ex").isNotNull() & F.col("ez").isNotNull() & F.col("eh").isNotNull())
    return errs.select("method", "traj_id", "seq", "flio", *(F.when(counts, F.col(e)).alias(e) for e in ("ex", "ez", "eh")))


def all_methods(rows: DataFrame, loaded: Loaded, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """(method, traj_id, seq, est_x, est_z, est_dir) of the chosen methods."""
    out = None
    for m in methods:
        one = METHODS[m](rows, loaded).select(F.lit(m).alias("method"), "traj_id", F.col("seq").cast("bigint").alias("seq"), "est_x", "est_z", "est_dir")
        out = one if out is None else out.unionByName(one)
    return out
