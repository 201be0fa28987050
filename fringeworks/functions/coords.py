"""Column expressions for baseline coordinates and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299792458.0


def in_wavelengths(metres: Column, freq: Column) -> Column:
    return metres * (freq / F.lit(SPEED_OF_LIGHT))


def fold(v: Column, x: Column) -> Column:
    """``x`` as it is in the half plane v >= 0; v = 0 stays unfolded."""
    return F.when(v < 0, F.lit(0.0) - x).otherwise(x)


def cell_u(u: Column, cell_size: float, n: int) -> Column:
    return F.rint(u / F.lit(float(cell_size))).cast("int") + F.lit(n)


def cell_v(v: Column, cell_size: float) -> Column:
    return F.rint(v / F.lit(float(cell_size))).cast("int")


def flat_cell(cu: Column, cv: Column, n: int) -> Column:
    return cu.cast("bigint") * F.lit(n + 1) + cv


def grid_shape(n: int) -> tuple[int, int]:
    return 2 * n + 1, n + 1


def half_size(extent: float, cell_size: float) -> int:
    """Cells from the centre to ``extent``."""
    return math.ceil(extent / cell_size)


def half_size_of(u: Column, v: Column, cell_size: float) -> Column:
    """The same as an aggregate over the data."""
    return F.ceil(F.greatest(F.max(F.abs(u)), F.max(F.abs(v))) / F.lit(float(cell_size)))


def cell_radius(cu: Column, cv: Column, cell_size: float, n: int) -> Column:
    x, y = (cu - F.lit(n)) * F.lit(float(cell_size)), cv * F.lit(float(cell_size))
    return F.sqrt(x * x + y * y)


def ring_index(radius: Column, widths: tuple[float, ...]) -> Column:
    """Number of ring ends at or within ``radius``; the last ring is open."""
    ends, at = [], 0.0
    for w in widths:
        at += w
        ends.append(at)
    return sum(((radius >= F.lit(float(e))).cast("int") for e in ends), F.lit(0))


def within_uvrange(u: Column, v: Column, uvrange: tuple[float, float]) -> Column:
    """Both ends belong to the range."""
    low, high = map(float, uvrange)
    return (u * u + v * v).between(F.lit(low * low), F.lit(high * high))
