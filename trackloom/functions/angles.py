"""Directions in degrees clockwise from north, and differences of angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen winds, clockwise from north.
WINDS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def heading_of(vx: Column, vy: Column) -> Column:
    """Direction of (vx, vy) in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(vx, vy)) + 360.0, F.lit(360.0))


def wrap180(d: Column) -> Column:
    """A difference of angles in [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def unwrap_step(before: Column, now: Column) -> Column:
    """What to add to an unwrapped angle: the difference in radians by the shorter way."""
    pi = 3.141592653589793
    return F.pmod(now - before + pi, F.lit(2 * pi)) - pi


def compass(heading: Column) -> Column:
    """Name of the wind."""
    k = F.floor((F.pmod(heading, F.lit(360.0)) + 11.25) / 22.5).cast("int") % 16
    return F.get(F.array(*[F.lit(w) for w in WINDS]), k)
