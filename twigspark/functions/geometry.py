"""Column expressions on points and small vectors. +y points down, as in images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance2(ax, ay, bx, by) -> Column:
    """Squared Euclidean distance; compare these and take one root at the end."""
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return dx * dx + dy * dy


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def cell(value, size: float) -> Column:
    return F.floor(col(value) / F.lit(float(size)))


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    r = F.radians(degrees)
    return F.cos(r) * x - F.sin(r) * y, F.sin(r) * x + F.cos(r) * y


def principal_angle(sxx: Column, sxy: Column, syy: Column) -> Column:
    """Angle of the larger eigenvector of a 2x2 covariance."""
    return F.lit(0.5) * F.atan2(2 * sxy, sxx - syy)


def axis_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two axes, whatever their signs."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(ux * vx + uy * vy))))


def vector_distance2(a, b) -> Column:
    """Squared distance of two array columns, in double precision."""
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def bezier(p0: Column, p1: Column, p2: Column, t: Column) -> Column:
    """One coordinate of a quadratic curve."""
    return (1 - t) * (1 - t) * p0 + 2 * (1 - t) * t * p1 + t * t * p2


def frame_number(name) -> Column:
    """The number after `frame` in a file name, null without one."""
    return F.regexp_extract(col(name), r"frame(\d+)", 1).try_cast("int")


def natural_key(name) -> Column:
    """Sort key of file names: frame number, those without one last, then the name."""
    return F.struct(F.coalesce(frame_number(name), F.lit(1 << 30)).alias("frame"), col(name).alias("name"))
