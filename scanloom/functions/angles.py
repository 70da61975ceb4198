"""Angle functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it: plans that repeat large expressions grow
    with each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rewind(a: Column, period: float, ref: float = 0.0) -> Column:
    """The angle's equivalent in [ref - period/2, ref + period/2)."""
    return F.pmod(a - ref + period / 2, F.lit(float(period))) + ref - period / 2


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in radians, by the half-angle form that is exact for small angles."""
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def fix_overpole(az: Column, el: Column, half: float = 180.0) -> tuple[Column, Column]:
    """(az, el) with elevations beyond the zenith folded back, in units of which `half` is half a turn."""
    over = el > half / 2
    return F.when(over, az + half).otherwise(az), F.when(over, half - el).otherwise(el)


def horizon_to_equatorial(az: Column, el: Column, t: Column, latitude: float, longitude: float) -> tuple[Column, Column]:
    """(ra, dec) in radians of a direction at unix time t: a plain rotation with the mean sidereal time, without
    refraction, precession and nutation (about half a degree over decades)."""
    lat = F.lit(latitude)
    sin_dec = F.sin(el) * F.sin(lat) + F.cos(el) * F.cos(lat) * F.cos(az)
    dec = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_dec)))
    hour = F.atan2(-F.sin(az) * F.cos(el), F.sin(el) * F.cos(lat) - F.cos(el) * F.sin(lat) * F.cos(az))
    turns = F.lit(0.7790572732640) + F.lit(1.00273781191135448) * (t - F.lit(946728000.0)) / 86400
    sidereal = (turns - F.floor(turns)) * F.lit(6.283185307179586) + F.lit(longitude)
    return F.pmod(sidereal - hour, F.lit(6.283185307179586)), dec


def equatorial_to_horizon(ra: Column, dec: Column, t: Column, latitude: float, longitude: float) -> tuple[Column, Column]:
    """(az, el) in radians of a place on the sky at unix time t: the inverse of horizon_to_equatorial()."""
    lat = F.lit(latitude)
    turns = F.lit(0.7790572732640) + F.lit(1.00273781191135448) * (t - F.lit(946728000.0)) / 86400
    hour = (turns - F.floor(turns)) * F.lit(6.283185307179586) + F.lit(longitude) - ra
    sin_el = F.sin(dec) * F.sin(lat) + F.cos(dec) * F.cos(lat) * F.cos(hour)
    el = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_el)))
    az = F.atan2(-F.sin(hour) * F.cos(dec), F.sin(dec) * F.cos(lat) - F.cos(dec) * F.sin(lat) * F.cos(hour))
    return F.pmod(az, F.lit(6.283185307179586)), el
