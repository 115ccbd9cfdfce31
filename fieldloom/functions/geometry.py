"""Rings and polylines as array<struct<x: double, y: double>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.scalar import col


def ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def _edges(r: Column) -> Column:
    """Pairs of consecutive vertices of the closed ring."""
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + value(e))


def signed_area(r: Column | str) -> Column:
    """Shoelace; positive for counter-clockwise rings, 0 for fewer than three vertices."""
    return _sum(_edges(col(r)), lambda e: (e.p.x * e.q.y - e.q.x * e.p.y) / 2)


def area(r: Column | str) -> Column:
    return F.abs(signed_area(r))


def perimeter(r: Column | str) -> Column:
    return _sum(_edges(col(r)), lambda e: F.hypot(e.q.x - e.p.x, e.q.y - e.p.y))


def length(line: Column | str) -> Column:
    """Of an open polyline."""
    p = col(line)
    steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.hypot(b.x - a.x, b.y - a.y))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def centroid(r: Column | str) -> Column:
    """Of the area; the mean vertex where the area is 0."""
    r = col(r)
    a = signed_area(r)
    part = lambda axis: _sum(_edges(r), lambda e: (e.p[axis] + e.q[axis]) * (e.p.x * e.q.y - e.q.x * e.p.y)) / (6 * a)
    mean = lambda axis: F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(r)
    return F.struct(*(F.when(a != 0, part(k)).otherwise(mean(k)).alias(k) for k in ("x", "y")))


def contains(r: Column, x: Column | str, y: Column | str) -> Column:
    """Even-odd test of a point against a ring, behind a test of the ring's box."""
    x, y = col(x), col(y)
    crossings = F.aggregate(_edges(r), F.lit(0), lambda acc, e: acc + F.when(((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * (y - e.p.y) / (e.q.y - e.p.y) + e.p.x), 1).otherwise(0))
    return in_box(r, x, y) & (F.pmod(crossings, F.lit(2)) == 1)


def in_box(r: Column, x: Column, y: Column) -> Column:
    side = lambda k: F.transform(r, lambda p: p[k])
    return x.between(F.array_min(side("x")), F.array_max(side("x"))) & y.between(F.array_min(side("y")), F.array_max(side("y")))


def rectangle(x: Column | str, y: Column | str, x0: float, y0: float, x1: float, y1: float) -> Column:
    return col(x).between(min(x0, x1), max(x0, x1)) & col(y).between(min(y0, y1), max(y0, y1))


def local_metres(lon: Column | str, lat: Column | str, lon0: Column | float, lat0: Column | float) -> tuple[Column, Column]:
    """Offsets in metres from an origin, on a sphere."""
    degree = 111_194.92664455873
    return (col(lon) - lon0) * degree * F.cos(F.radians(lat0 if isinstance(lat0, Column) else F.lit(float(lat0)))), (col(lat) - lat0) * degree


def geodesic_area(r: Column | str) -> Column:
    """Approximate square metres of a ring in degrees (x: longitude, y: latitude)."""
    r = col(r)
    first = F.get(r, F.lit(0))
    flat = F.transform(r, lambda p: F.struct(*(v.alias(k) for k, v in zip("xy", local_metres(p.x, p.y, first.x, first.y), strict=True))))
    return area(flat)


def interpolate(xs: Column | str, ys: Column | str, x: Column | str) -> Column:
    """Piecewise linear on sorted knots by the slope between two of them, constant beyond the ends."""
    xs, ys, x = col(xs), col(ys), col(x)
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda v: v <= x))
    at = lambda a, i: F.element_at(a, i)
    x0, x1, y0, y1 = at(xs, k), at(xs, k + 1), at(ys, k), at(ys, k + 1)
    return F.when(n == 0, None).when(k == 0, F.get(ys, F.lit(0))).when(k == n, at(ys, -1)).otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))


def second_moments(sxx: Column, syy: Column, sxy: Column) -> dict[str, Column]:
    """Angle of the main axis and ratio of the axes from a 2 by 2 covariance."""
    mean, root = (sxx + syy) / 2, F.sqrt(F.pow((sxx - syy) / 2, F.lit(2.0)) + sxy * sxy)
    return {"angle": F.atan2(2 * sxy, sxx - syy) / 2, "elongation": F.when(mean - root > 0, F.sqrt((mean + root) / (mean - root)))}
