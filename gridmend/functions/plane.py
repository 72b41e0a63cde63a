"""Points and rings: an equal-area projection, areas, clipping to a box, points for labels."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, log, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the conic equal-area projection for the conterminous states (EPSG 5070): the ellipsoid's axis and
#: flattening, and the origin and standard parallels in degrees.
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257222101
ORIGIN_LAT, ORIGIN_LON, PARALLELS = 23.0, -96.0, (29.5, 45.5)
_E2 = FLATTENING * (2 - FLATTENING)
_E = sqrt(_E2)


def _q(s: float) -> float:
    return (1 - _E2) * (s / (1 - _E2 * s * s) - log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m2(lat: float) -> float:
    return cos(radians(lat)) ** 2 / (1 - _E2 * sin(radians(lat)) ** 2)


_Q1, _Q2 = (_q(sin(radians(p))) for p in PARALLELS)
_N = (_m2(PARALLELS[0]) - _m2(PARALLELS[1])) / (_Q2 - _Q1)
_C = _m2(PARALLELS[0]) + _N * _Q1
_R0 = AXIS_M * sqrt(_C - _N * _q(sin(radians(ORIGIN_LAT)))) / _N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of the origin."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    r = AXIS_M * F.sqrt(_C - _N * q) / _N
    turn = _N * F.radians(lon - ORIGIN_LON)
    return r * F.sin(turn), _R0 - r * F.cos(turn)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and not wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def sides(ring: Column) -> Column:
    """Each point of a ring with the next one, the last with the first."""
    return bound(ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("p"), F.get(r, F.pmod(i + 1, F.size(r)).cast("int")).alias("q"))))


def area(ring: Column) -> Column:
    """The area of a ring, positive where it runs counter-clockwise."""
    cross = F.transform(sides(ring), lambda e: e["p"][0] * e["q"][1] - e["q"][0] * e["p"][1])
    return F.aggregate(cross, F.lit(0.0), lambda a, x: a + x) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    """The centre of a ring's area; null where it has none."""
    size = F.nullif(area(ring), F.lit(0.0))

    def along(k: int) -> Column:
        parts = F.transform(sides(ring), lambda e: (e["p"][k] + e["q"][k]) * (e["p"][0] * e["q"][1] - e["q"][0] * e["p"][1]))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / (6 * size)

    return along(0), along(1)


def clipped(ring: Column, box: tuple) -> Column:
    """What of a ring lies in a box (least x, least y, largest x, largest y; numbers or columns): one side after another. Of a ring that
    falls apart the parts stay joined along the box, which changes neither area nor winding."""
    for axis, bound, sign in ((0, box[0], 1.0), (1, box[1], 1.0), (0, box[2], -1.0), (1, box[3], -1.0)):
        ring = _half(ring, axis, bound, sign)
    return ring


def _half(ring: Column, axis: int, bound: Column | float, sign: float) -> Column:
    depth = lambda p: (p[axis] - bound) * sign

    def cut(e: Column) -> Column:
        p, q = e["p"], e["q"]
        t = depth(p) / (depth(p) - depth(q))
        at = F.array(p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)
        leaves, enters = (depth(p) >= 0) & (depth(q) < 0), (depth(p) < 0) & (depth(q) >= 0)
        none = F.array().cast("array<array<double>>")
        return F.when(leaves, F.array(p, at)).when(enters, F.array(at)).when(depth(p) >= 0, F.array(p)).otherwise(none)

    return F.flatten(F.transform(sides(ring), cut))
