"""Which observations meet a place of the sky: sweeps in right ascension and declination (rad), drifting with time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.angles import equatorial_to_horizon, let, rewind
from scanloom.operators.joins import bucketed_range_join

#: rad of sky that drift over a place in a second
DRIFT = math.radians(15) / 3600
#: Right ascension and declination of the galactic pole (J2000, rad; fixed values)
POLE_RA, POLE_DEC = math.radians(192.859508), math.radians(27.12825)
#: Latitude and longitude of the site (rad; fixed values)
LATITUDE, LONGITUDE = math.radians(-22.9585), math.radians(-67.7876)
#: Centres (xi, eta) of wafers in degrees, by slot on small telescopes and by tube and slot on the large one, and the radius
#: of a wafer there (fixed values)
SMALL_WAFERS = {
    "st0": (0.0, 0.0), "st1": (0.0, -12.6340), "st2": (-10.9624, -6.4636), "st3": (-10.9624, 6.4636),
    "st4": (0.0, 12.6340), "st5": (10.9624, 6.4636), "st6": (10.9624, -6.4636),
}
LARGE_WAFERS = {
    "c1": {"ws0": (-0.3710, 0.0000), "ws1": (0.1815, 0.3211), "ws2": (0.1815, -0.3211)},
    "i1": {"ws0": (-1.9112, -0.9052), "ws1": (-1.3584, -0.5704), "ws2": (-1.3587, -1.2133)},
    "i2": {"ws0": (-0.3642, -1.7832), "ws1": (0.1888, -1.4631), "ws2": (0.1927, -2.1035)},
    "i3": {"ws0": (1.1865, -0.8919), "ws1": (1.7326, -0.5705), "ws2": (1.7333, -1.2135)},
    "i4": {"ws0": (1.1732, 0.9052), "ws1": (1.7332, 1.2135), "ws2": (1.7326, 0.5705)},
    "i5": {"ws0": (-0.3655, 1.7833), "ws1": (0.1879, 2.1045), "ws2": (0.1867, 1.4620)},
    "i6": {"ws0": (-1.9082, 0.8920), "ws1": (-1.3577, 1.2133), "ws2": (-1.3584, 0.5854)},
    "o1": {"ws0": (-1.8959, -2.6746), "ws1": (-1.3455, -2.3530), "ws2": (-1.3392, -2.9954)},
    "o2": {"ws0": (1.1876, -2.6747), "ws1": (1.7447, -2.3537), "ws2": (1.7505, -2.9965)},
    "o3": {"ws0": (2.7302, 0.0000), "ws1": (3.2929, 0.3220), "ws2": (3.2929, -0.3219)},
    "o4": {"ws0": (1.1876, 2.6747), "ws1": (1.7505, 2.9965), "ws2": (1.7447, 2.3537)},
    "o5": {"ws0": (-1.8959, 2.6747), "ws1": (-1.3392, 2.9955), "ws2": (-1.3455, 2.3530)},
    "o6": {"ws0": (-3.4369, 0.0000), "ws1": (-2.8869, 0.3218), "ws2": (-2.8869, -0.3218), "ws.": (-3.0702, 0.0000)},
}
SMALL_RADIUS, LARGE_RADIUS = 6.0, 0.3
#: Points of a sweep.
POINTS = 6


def one_side(az1: Column, az2: Column) -> tuple[Column, Column]:
    """An azimuth range cut to the half of the sky, east or west, that its middle is in."""
    mid = 0.5 * (az1 + az2) / math.pi
    return F.greatest(az1, F.floor(mid) * F.lit(math.pi)), F.least(az2, F.ceil(mid) * F.lit(math.pi))


def on_curve(x: Column, xs: Column, ys: Column) -> Column:
    """Value at x of the polynomial through the points of two arrays; null where two of xs are equal."""
    k = F.sequence(F.lit(0), F.size(xs) - 1)

    def term(i: Column) -> Column:
        share = lambda acc, j: acc * F.when(i == j, 1.0).otherwise(F.try_divide(x - xs[j], xs[i] - xs[j]))
        return ys[i] * F.aggregate(k, F.lit(1.0), share)

    return F.aggregate(k, F.lit(0.0), lambda acc, i: acc + term(i))


def point_hit(ra: Column, dec: Column, ras: Column, decs: Column, dur: Column, radius: Column, pad: float = math.radians(1)) -> Column:
    """Whether a sweep through (ras, decs), drifting for `dur` seconds, comes within radius and pad of a point. Sweeps that
    cover less than a tenth of a degree of declination hit nothing, nor do those that have two points of one declination
    (no curve goes through them), or a null anywhere: the result is never null."""

    def on_side(at: Column) -> Column:
        middle = at + DRIFT / 2 * dur
        turn = 2 * math.pi
        wound = ra - F.floor((ra - middle) / turn + 0.5) * turn
        wide = radius / F.cos(dec) + pad
        return (wound > at - wide) & (wound < at + DRIFT * dur + wide)

    def seen(p: Column) -> Column:
        def judged(s: Column) -> Column:  # the curve comes last: most places are beyond a sweep's declinations
            in_dec = (dec > s["low"] - radius - pad) & (dec < s["high"] + radius + pad)
            return (s["high"] - s["low"] > math.radians(0.1)) & in_dec & let(on_curve(dec, p["decs"], p["ras"]), on_side)

        return let(F.struct(F.array_min(p["decs"]).alias("low"), F.array_max(p["decs"]).alias("high")), judged)

    return F.coalesce(let(F.struct(ras.alias("ras"), decs.alias("decs")), seen), F.lit(False))


def galactic_latitude(ra: Column, dec: Column) -> Column:
    return F.asin(F.sin(dec) * math.sin(POLE_DEC) + F.cos(dec) * math.cos(POLE_DEC) * F.cos(ra - POLE_RA))


def galaxy_hit(ras: Column, decs: Column, dur: Column, radius: Column, least: float = math.radians(5), pad: float = math.radians(1)) -> Column:
    """Whether a sweep, at its start or after `dur` seconds, crosses the galactic plane or stays within `least` of it."""
    points = F.arrays_zip(ras.alias("a"), decs.alias("d"))

    def seen(p: Column, shift: Column) -> Column:
        return F.transform(p, lambda x: galactic_latitude(x["a"] + shift, x["d"]))

    def lats(p: Column) -> Column:
        return F.concat(seen(p, F.lit(0.0)), seen(p, dur * DRIFT))

    def judged(b: Column) -> Column:
        nearest = F.array_min(F.transform(b, lambda x: F.abs(x)))
        return (F.array_min(b) * F.array_max(b) < 0) | (nearest + radius + pad < least)

    return let(points, lambda p: let(lats(p), judged))


def sidereal_time(t: np.ndarray, longitude: float) -> np.ndarray:
    """Mean sidereal time (rad) at unix times t, as in horizon_to_equatorial()."""
    turns = 0.7790572732640 + 1.00273781191135448 * (t - 946728000.0) / 86400
    return (turns - np.floor(turns)) * 2 * math.pi + longitude


def elevation(ra: Column, dec: Column, t: Column) -> Column:
    """Elevation (rad) at the site of a place on the sky at unix time t."""
    return equatorial_to_horizon(ra, dec, t, LATITUDE, LONGITUDE)[1]


def wafer_centre(tube: Column, slot: Column) -> tuple[Column, Column, Column]:
    """(xi, eta, radius) of a wafer in radians; those of unknown wafers are 0."""
    place = lambda at, radius: F.array(*(F.lit(math.radians(x)) for x in (*at, radius)))
    small = F.create_map(*(c for w, at in SMALL_WAFERS.items() for c in (F.lit(w), place(at, SMALL_RADIUS))))
    large = F.create_map(*(c for t, wafers in LARGE_WAFERS.items() for w, at in wafers.items() for c in (F.lit(f"{t} {w}"), place(at, LARGE_RADIUS))))
    found = F.coalesce(small[slot], large[F.concat(tube, F.lit(" "), slot)], place((0.0, 0.0), 0.0))
    return found[0], found[1], found[2]


def off_centre(el: Column, xi: Column, eta: Column) -> tuple[Column, Column]:
    """(shift in azimuth, elevation) of what lies (xi, eta) from the centre of a telescope at elevation el."""
    along = F.sqrt(1 - xi * xi - eta * eta)
    up = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), eta * F.cos(el) + along * F.sin(el)))
    return F.atan2(xi, along * F.cos(el) - eta * F.sin(el)), F.asin(up)


def _paths(xi: np.ndarray, eta: np.ndarray, baz: np.ndarray, waz: np.ndarray, bel: np.ndarray, ctime: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, point] of right ascensions and declinations: off_centre(), one_side() and horizon_to_equatorial() of arrays."""
    along = np.sqrt(1 - xi * xi - eta * eta)
    el = np.arcsin(np.clip(eta * np.cos(bel) + along * np.sin(bel), -1.0, 1.0))
    mid = baz + np.arctan2(xi, along * np.cos(bel) - eta * np.sin(bel))
    side = mid / math.pi
    az1 = np.maximum(mid - waz / 2, np.floor(side) * math.pi)
    az2 = np.minimum(mid + waz / 2, np.ceil(side) * math.pi)
    az = az1[:, None] + (az2 - az1)[:, None] * (np.arange(POINTS) / (POINTS - 1))
    sin_el, cos_el, sin_lat, cos_lat = np.sin(el)[:, None], np.cos(el)[:, None], math.sin(LATITUDE), math.cos(LATITUDE)
    dec = np.arcsin(np.clip(sin_el * sin_lat + cos_el * cos_lat * np.cos(az), -1.0, 1.0))
    hour = np.arctan2(-np.sin(az) * cos_el, sin_el * cos_lat - cos_el * sin_lat * np.cos(az))
    ra = np.mod(sidereal_time(ctime, LONGITUDE)[:, None] - hour, 2 * math.pi)
    return ra[:, :1] + np.mod(ra - ra[:, :1] + math.pi, 2 * math.pi) - math.pi, dec


def with_sweep(rows: DataFrame, tube: str = "tube", slot: str = "slot") -> DataFrame:
    """rows with ras, decs and radius: the path over the sky of each wafer's centre in one sweep, at the observation's start.

    Needs ctime, and baz, waz, bel in degrees (waz from edge to edge). Sweeps stop where they would cross from the
    eastern to the western sky; right ascensions go on from the first one's turn. A null gives nulls."""

    @F.arrow_udf("struct<ras array<double>, decs array<double>>")
    def path(place: pa.Array, baz: pa.Array, waz: pa.Array, bel: pa.Array, ctime: pa.Array) -> pa.Array:
        cols = [c.cast(pa.float64()) for c in (baz, waz, bel, ctime)]
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in cols])
        at = place.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        baz, waz, bel, ctime = (c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols)
        both = _paths(at[:, 0], at[:, 1], np.radians(baz), np.radians(waz), np.radians(bel), ctime)
        ends = pa.array(np.arange(len(known) + 1) * POINTS, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), mask=np.repeat(~known, POINTS))) for x in both]
        return pa.StructArray.from_arrays(lists, ["ras", "decs"])

    placed = rows.withColumn("__place", F.array(*wafer_centre(F.col(tube), F.col(slot))))
    out = placed.withColumn("__path", path("__place", "baz", "waz", "bel", "ctime"))
    return out.select(*rows.columns, F.col("__path.ras").alias("ras"), F.col("__path.decs").alias("decs"), F.col("__place")[2].alias("radius"))


def positions_at(points: DataFrame, tracks: DataFrame, key: str, at: str, width: float = 86400.0) -> DataFrame:
    """(key, name, ra, dec): where each object of tracks (name, t, ra, dec; irregular in time) is at each point's time, on
    the line between its neighbours, over the shorter way around.

    Times outside of an object's track, and at its last moment, give no row; of rows of one object and time one counts.
    Each stretch of a track is one row of an equi join on buckets of `width` seconds, so nothing is sorted but tracks."""
    w = Window.partitionBy("name").orderBy("t")
    known = tracks.dropDuplicates(["name", "t"])
    ahead = {c: F.lead(c).over(w).alias(f"__{c}") for c in ("t", "ra", "dec")}
    stretch = known.select("name", "t", "ra", "dec", *ahead.values()).where("__t is not null")
    met = bucketed_range_join(points.select(key, at), stretch, at, "t", "__t", width)
    share = (F.col(at) - F.col("t")) / (F.col("__t") - F.col("t"))
    ra = F.col("ra") + share * rewind(F.col("__ra") - F.col("ra"), 2 * math.pi)
    return met.select(key, "name", ra.alias("ra"), (F.col("dec") + share * (F.col("__dec") - F.col("dec"))).alias("dec"))
