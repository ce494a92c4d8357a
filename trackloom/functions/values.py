"""Rounding, clipping and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 4) -> Column:
    """Half up on the scaled number, the same in every engine: what lies a millionth below a half counts as one."""
    scale = 10.0**places
    return F.floor(c * scale + 0.500001) / scale


def clip_to(c: Column, lo: Column | float, hi: Column | float) -> Column:
    """c within lo .. hi; null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def lenient_bool(c: Column) -> Column:
    """True for the texts true and 1 whatever their case and blanks, also for booleans and numbers; else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "t", "1.0"), F.lit(False))


def nan_to_null(c: Column) -> Column:
    """NaN means missing."""
    return F.when(~F.isnan(c), c)


def ramp(c: Column, lo: float, hi: float, stops: list[tuple[float, float, float]]) -> Column:
    """Colour of a value between evenly spaced stops, linear between them: an array of three."""
    n = len(stops) - 1
    place = clip_to((c - lo) / max(hi - lo, 1e-9), 0.0, 1.0) * n
    k = F.least(F.floor(place), F.lit(n - 1)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in stops])
    a, b = F.get(table, k), F.get(table, k + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(a, i) + (place - k) * (F.get(b, i) - F.get(a, i)))
