"""Scalar functions as Column expressions: geography, finance, statistics, bands and coercions.

Numbers named in capitals are fixed values of the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two Earth radii are in use, one for each form of the great-circle distance.
RADIUS_ASIN_KM, RADIUS_ATAN_KM = 6371.0088, 6371.0
KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.321, 111.0
KNOT_MPS = 0.514444
#: Lower limits in knots of the hurricane categories.
SAFFIR_SIMPSON = ((137, "category_5"), (113, "category_4"), (96, "category_3"), (83, "category_2"), (64, "category_1"), (34, "tropical_storm"))
LENGTH_KM = {"km": 1.0, "kft": 0.3048, "m": 0.001, "mi": 1.60934, "ft": 0.0003048}


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, form: str = "asin") -> Column:
    """Great-circle distance; ``form`` asin or atan decides the radius too."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    if form == "asin":
        return 2 * RADIUS_ASIN_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    return 2 * RADIUS_ATAN_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def flat_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane whose degrees of longitude shrink with the middle latitude."""
    x = (lon2 - lon1) * KM_PER_DEGREE_LON * F.cos(F.radians((lat1 + lat2) / 2))
    y = (lat2 - lat1) * KM_PER_DEGREE_LAT
    return F.sqrt(x * x + y * y)


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def length_km(value: Column, unit: Column) -> Column:
    """Unknown units count as kilometres; a missing length is 0."""
    table = F.create_map(*(F.lit(x) for pair in LENGTH_KM.items() for x in pair))
    return F.coalesce(value, F.lit(0.0)) * F.coalesce(F.element_at(table, F.lower(F.trim(unit))), F.lit(1.0))


def rebased(value: Column, index_then: float, index_now: float) -> Column:
    return value * (index_now / index_then)


def loglog_multiplier(duration: Column, knots: Sequence[float], shape: Sequence[float]) -> Column:
    """1 up to the first knot, then piecewise linear in logarithms, the last slope going on."""
    logs = F.ln(F.greatest(duration, F.lit(knots[0])))
    import math

    out = None
    for k in range(len(knots) - 1):
        x0, x1, y0, y1 = (math.log(v) for v in (knots[k], knots[k + 1], shape[k], shape[k + 1]))
        piece = F.exp(F.lit(y0) + (logs - x0) * ((y1 - y0) / (x1 - x0)))
        here = duration <= knots[k + 1]
        last = k == len(knots) - 2
        out = F.when(duration <= knots[0], 1.0) if out is None else out
        out = out.otherwise(piece) if last else out.when(here, piece)
    return out


def interrupted_kw_cost(duration: Column, value: Column | float, knots: Sequence[float], shape: Sequence[float]) -> Column:
    """Dollars for each kW that is interrupted for ``duration`` hours."""
    return F.when(duration <= 24, lit(value) * F.greatest(duration, F.lit(0.0))).otherwise(lit(value) * 24 * loglog_multiplier(duration, knots, shape))


def capital_recovery_factor(rate: Column, years: Column | int) -> Column:
    growth = F.pow(1 + rate, lit(years))
    return F.when(rate == 0, 1.0 / lit(years)).otherwise(rate * growth / (growth - 1))


def annuity_factor(rate: Column, years: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda total, t: total + F.pow(1 + rate, -t.cast("double")))


def investment_ceiling(benefit: Column, cost: Column, interval: Column, fixed: Column, annuity: Column) -> Column:
    return ((benefit - cost) / interval - fixed) * annuity


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval in percent."""
    p = successes / n
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return 100 * (centre - half), 100 * (centre + half)


def normal_cdf(x: Column) -> Column:
    """Within 7.5e-8, by a rational approximation with fixed coefficients."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def lognormal_cdf(x: Column, mu: float | Column, sigma: float | Column) -> Column:
    return F.when(x > 0, normal_cdf((F.ln(x) - lit(mu)) / lit(sigma))).otherwise(0.0)


def interpolate(x: Column, knots: Sequence[float], values: Sequence[float]) -> Column:
    """Linear between knots, constant outside them."""
    out = F.when(x <= knots[0], float(values[0]))
    for k in range(len(knots) - 1):
        slope = (values[k + 1] - values[k]) / (knots[k + 1] - knots[k])
        out = out.when(x <= knots[k + 1], F.lit(float(values[k])) + (x - knots[k]) * slope)
    return out.otherwise(float(values[-1]))


def category(knots: Column) -> Column:
    out = F.when(knots.isNull() | F.isnan(knots), "unknown")
    for least, name in SAFFIR_SIMPSON:
        out = out.when(knots >= least, name)
    return out.otherwise("tropical_depression")


def rmax_km(knots: Column) -> Column:
    return 46.3 * F.exp(-0.0153 * knots)


def decayed(speed: Column, rate: float, km: Column) -> Column:
    return speed * F.exp(-rate * km)


def holland_wind(speed: Column, first_speed: Column, rmax: Column, km: Column) -> Column:
    """Wind at a distance from the eye; the shape comes from the track's first speed."""
    b = 1.05 * F.ln(first_speed) - 2.32
    t = F.pow(rmax / km, b)
    return F.when(km < 1e-9, speed).otherwise(speed * t * F.exp(1 - t))


def attack_angle(eye_dx: Column, eye_dy: Column, dx: Column, dy: Column) -> Column:
    """Degrees, modulo 90, between a line (dx, dy) and the wind at its middle, which lies (eye_dx, eye_dy) off the eye."""
    return F.abs(F.degrees(F.atan2(eye_dx, -eye_dy)) - F.degrees(F.atan2(dy, dx))) % 90


def strict_boolean(x: Column) -> Column:
    """true/false/1/0; anything else raises."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


def lenient_boolean(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def extended_boolean(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.coalesce(t.isin("true", "1", "yes", "y", "t"), F.lit(False)) | F.coalesce(t.try_cast("double") != 0, F.lit(False))


def boolean_token(x: Column) -> Column:
    """True, false or null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "yes", "y"), True).when(t.isin("false", "no", "n"), False)


def size_band(annual_mwh: Column, load_type: Column, small: float = 50.0, medium: float = 1000.0) -> Column:
    """Customer size by annual energy; homes are a class of their own."""
    return F.when(load_type == "residential", "residential").when(annual_mwh <= small, "small_commercial").when(annual_mwh <= medium, "medium_commercial").otherwise("large_commercial")


def valuation_group(load_type: Column, critical: Column) -> Column:
    return F.concat(load_type, F.when(critical, "_critical").otherwise("_noncritical"))


def bus_name(ref: Column) -> Column:
    return F.split_part(F.trim(F.regexp_replace(ref, "[\"']", "")), F.lit("."), F.lit(1))


def bus_phases(ref: Column) -> Column:
    return F.filter(F.slice(F.split(F.trim(ref), r"\."), 2, 9), lambda p: p.rlike("^[0-9]+$"))


def numeric_or_null(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def identifier(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]+", "_")


def json_list(x: Column) -> Column:
    """The strings of a JSON array; anything else is an empty list."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def json_sorted(x: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(x)))


def cell(value: Column, low: Column | float, high: Column | float, size: int) -> Column:
    """The grid cell of a value within its range."""
    norm = (value - lit(low)) / F.greatest(lit(high) - lit(low), F.lit(1e-9))
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(norm * size))).cast("int")


def wrapped(i: Column, offset: Column | int, n: int) -> Column:
    return F.pmod(i + lit(offset), F.lit(n))


def letter_angle(s: Column) -> Column:
    """The sum of a string's code points modulo 360."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c)) % 360


def binomial_weights(n: int, p: Column) -> list[Column]:
    from math import comb

    return [F.lit(float(comb(n, k))) * F.pow(p, F.lit(float(k))) * F.pow(1 - p, F.lit(float(n - k))) for k in range(n + 1)]
