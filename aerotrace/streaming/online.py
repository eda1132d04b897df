"""Streaming forms: the motion filter with state for each trajectory, and gap sessions.

The batch estimator looks ten samples ahead and decodes from the end; a stream filters causally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "traj_id bigint, seq bigint, kf_x double, kf_z double, kf_vx double, kf_vz double, kf_speed double"
STATE = "n int, x double, z double, vx double, vz double, p11 double, p12 double, p22 double"


def _advance(state: tuple, x: float, z: float) -> tuple:
    """One predict and update; the state has the step count, position, velocity and the shared covariance."""
    n, px, pz, vx, vz, p11, p12, p22 = state if state else (0, x, z, 0.0, 0.0, 500.0, 0.0, 500.0)
    a, b, d = p11 + 2 * p12 + p22 + 0.1, p12 + p22, p22 + 1.0
    kp, kv = a / (a + 5.0), b / (a + 5.0)
    ex, ez = x - px - vx, z - pz - vz
    return n + 1, px + vx + kp * ex, pz + vz + kp * ez, vx + kv * ex, vz + kv * ez, (1 - kp) * a, (1 - kp) * b, d - kv * b


def filtered(stream: DataFrame) -> DataFrame:
    """stream (traj_id, seq, x, z), in order of seq for each trajectory: its causal filtered state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ()
        for frame in frames:
            rows = []
            for r in frame.sort_values("seq").itertuples():
                now = _advance(now, r.x, r.z)
                rows.append((key[0], r.seq, now[1], now[2], now[3], now[4], float(np.hypot(now[3], now[4]))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        if now:
            state.update(now)

    return stream.groupBy("traj_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, time: str = "ts", gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """Session windows that end after `gap` without a sample; samples later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy("traj_id", F.session_window(time, gap)).agg(F.count("*").alias("samples"))
