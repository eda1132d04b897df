"""Plane geometry, projections, rounding, labels and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import col


def along_clamped(px, pz, ax, az, bx, bz) -> Column:
    """Position of the foot of p on the segment a-b, from 0 to 1. A point-like segment has 0."""
    dx, dz = col(bx) - col(ax), col(bz) - col(az)
    dot = (col(px) - col(ax)) * dx + (col(pz) - col(az)) * dz
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.greatest(dx * dx + dz * dz, F.lit(1e-12))))


def distance_to_segment(px, pz, ax, az, bx, bz) -> Column:
    t = along_clamped(px, pz, ax, az, bx, bz)
    ex = col(px) - (col(ax) + t * (col(bx) - col(ax)))
    ez = col(pz) - (col(az) + t * (col(bz) - col(az)))
    return F.sqrt(ex * ex + ez * ez)


def project_soft(px, pz, ax, az, bx, bz) -> tuple[Column, Column]:
    """Foot with 1e-6 added to the squared length, as the refinement uses it."""
    dx, dz = col(bx) - col(ax), col(bz) - col(az)
    t = ((col(px) - col(ax)) * dx + (col(pz) - col(az)) * dz) / (dx * dx + dz * dz + 1e-6)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return col(ax) + t * dx, col(az) + t * dz


def project_guarded(px, pz, ax, az, bx, bz) -> tuple[Column, Column]:
    """Foot; the start for segments with a squared length under 1e-9."""
    dx, dz = col(bx) - col(ax), col(bz) - col(az)
    d2 = dx * dx + dz * dz
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((col(px) - col(ax)) * dx + (col(pz) - col(az)) * dz) / d2))
    return F.when(d2 < 1e-9, col(ax)).otherwise(col(ax) + t * dx), F.when(d2 < 1e-9, col(az)).otherwise(col(az) + t * dz)


def tangent_blend(t, own_x, own_z, prev_x, prev_z, next_x, next_z) -> tuple[Column, Column]:
    """Unit edge vectors blended towards the neighbour that is nearer: weights max(0, .5 - t) and max(0, t - .5)."""
    wp, wn = F.greatest(F.lit(0.0), 0.5 - col(t)), F.greatest(F.lit(0.0), col(t) - 0.5)
    own = 1.0 - wp - wn
    return own * col(own_x) + wp * col(prev_x) + wn * col(next_x), own * col(own_z) + wp * col(prev_z) + wn * col(next_z)


def affine(lon, lat, c: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """x = a lon + b lat + c, z = d lon + e lat + f."""
    return c[0] * col(lon) + c[1] * col(lat) + c[2], c[3] * col(lon) + c[4] * col(lat) + c[5]


def equidistant(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """Metres east and north of (lon0, lat0)."""
    return (col(lon) - col(lon0)) * 111320.0 * F.cos(F.radians(col(lat0))), (col(lat) - col(lat0)) * 110540.0


def float32(x) -> Column:
    return col(x).cast("float").cast("double")


def round_even(x, digits: int) -> Column:
    return F.bround(col(x), digits)


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def local_time(epoch) -> Column:
    """Epoch seconds as YYYY-MM-DD HH:MM:SS at UTC+8."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(col(epoch)), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")


def day_range(start: str, end: str | None = None) -> list[str]:
    """Days as YYYYMMDD, both ends included."""
    from datetime import date, timedelta

    a = date(int(start[:4]), int(start[4:6]), int(start[6:8]))
    b = date(int((end or start)[:4]), int((end or start)[4:6]), int((end or start)[6:8]))
    return [(a + timedelta(days=i)).strftime("%Y%m%d") for i in range((b - a).days + 1)]


def content_digest(data) -> tuple[Column, Column]:
    """Byte length and the first 12 digits of the SHA-1 of a string."""
    return F.octet_length(col(data)), F.substring(F.sha1(col(data)), 1, 12)
