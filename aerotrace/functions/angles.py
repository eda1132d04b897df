"""Angles in degrees, as Column expressions. East is 0, counter-clockwise is positive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def wrap360(a) -> Column:
    """Into [0, 360); null counts as 0 only where the caller coalesces."""
    return F.pmod(col(a), F.lit(360.0))


def angle_error(a, b) -> Column:
    """Unsigned difference of two angles in [0, 360)."""
    d = F.abs(col(a) - col(b))
    return F.least(d, F.lit(360.0) - d)


def angle_error_any(a, b) -> Column:
    """Unsigned difference of any two angles."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def signed_difference(a, b) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0


def axis_difference(a, b) -> Column:
    """Difference of two undirected axes, from 0 to 90."""
    d = angle_error_any(a, b)
    return F.when(d > 90.0, 180.0 - d).otherwise(d)


def gaussian(x, sigma: float) -> Column:
    """exp(-x^2 / 2 sigma^2), not normalised."""
    return F.exp(-col(x) * col(x) / F.lit(2.0 * sigma * sigma))


def log_gaussian(x, sigma: float) -> Column:
    return -(col(x) * col(x)) / F.lit(2.0 * sigma * sigma + EPS)


def bearing(dx, dz) -> Column:
    """(-180, 180]; 0 for no displacement."""
    return F.degrees(F.atan2(col(dz), col(dx)))


def bearing360(dx, dz) -> Column:
    """[0, 360), rounded once for every sign of dz, as the networks and the SQL have it: means of such bearings then agree
    to the last bit, which decides at the bound of reversed headings."""
    return (bearing(dx, dz) + 360.0) % F.lit(360.0)


def axis_error(direction, observed) -> tuple[Column, Column]:
    """Of an undirected axis: the smaller error against observed, and the orientation that has it (forward on ties)."""
    back = wrap360(col(direction) + 180.0)
    forward, backward = angle_error(direction, observed), angle_error(back, observed)
    return F.least(forward, backward), F.when(forward <= backward, col(direction)).otherwise(back)


def facing(a, reference) -> Column:
    """a or its opposite, whichever is within 90 degrees of the reference; null references leave it."""
    return F.when(angle_error(a, reference) > 90.0, wrap360(col(a) + 180.0)).otherwise(col(a))


def circular_mean(pairs: list[tuple]) -> Column:
    """Weighted mean direction in [0, 360) of (angle, weight) columns."""
    s = sum((col(w) * F.sin(F.radians(col(a))) for a, w in pairs), F.lit(0.0))
    c = sum((col(w) * F.cos(F.radians(col(a))) for a, w in pairs), F.lit(0.0))
    return wrap360(F.degrees(F.atan2(s, c)))


def circular_mean_agg(angle, weight) -> Column:
    """The same as an aggregate over rows."""
    s, c = F.sum(col(weight) * F.sin(F.radians(col(angle)))), F.sum(col(weight) * F.cos(F.radians(col(angle))))
    return wrap360(F.degrees(F.atan2(s, c)))
