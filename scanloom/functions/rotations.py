"""Rotations as unit quaternions: structs (w, x, y, z) of native columns.

Axes are 0, 1, 2 for x, y, z. A direction is where a rotation takes the z axis; longitude and latitude are those of that
direction, psi the turn about it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.angles import let

KIND = "struct<w:double,x:double,y:double,z:double>"


def quaternion(w: Column | float, x: Column | float, y: Column | float, z: Column | float) -> Column:
    parts = {"w": w, "x": x, "y": y, "z": z}
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in parts.items()))


def euler(axis: int, angle: Column) -> Column:
    """The rotation about an axis."""
    parts = [F.cos(angle / 2), 0.0, 0.0, 0.0]
    parts[axis + 1] = F.sin(angle / 2)
    return quaternion(*parts)


def inverse(q: Column) -> Column:
    return let(q, lambda a: quaternion(a["w"], -a["x"], -a["y"], -a["z"]))


def _product(a: Column, b: Column) -> Column:
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def product(*qs: Column) -> Column:
    """The rotations one after the other, the last one first; each is worked out once."""
    return F.aggregate(F.array(*qs), quaternion(1, 0, 0, 0), _product)


def to_direction(lon: Column, lat: Column, psi: Column | None = None) -> Column:
    """The rotation that takes the z axis to (lon, lat) after a turn psi about it."""
    return product(euler(2, lon), euler(1, math.pi / 2 - lat), euler(2, F.lit(0.0) if psi is None else psi))


def to_offset(xi: Column, eta: Column, gamma: Column | None = None) -> Column:
    """The rotation to a place of the focal plane: it takes the z axis to (-eta, -xi, .), with gamma the turn there."""
    def at(o: Column) -> Column:
        phi = F.atan2(-o["xi"], -o["eta"])
        theta = F.asin(F.least(F.lit(1.0), F.sqrt(o["xi"] * o["xi"] + o["eta"] * o["eta"])))
        return product(euler(2, phi), euler(1, theta), euler(2, o["gamma"] - phi))

    turn = F.lit(0.0) if gamma is None else gamma
    return let(F.struct(xi.cast("double").alias("xi"), eta.cast("double").alias("eta"), turn.cast("double").alias("gamma")), at)


def direction(q: Column) -> Column:
    """struct(lon, lat, psi) of a rotation; lon in [-pi, pi]."""
    def parts(a: Column) -> Column:
        half, other = F.atan2(a["z"], a["w"]), F.atan2(-a["x"], a["y"])
        theta = 2 * F.atan2(F.sqrt(a["x"] * a["x"] + a["y"] * a["y"]), F.sqrt(a["w"] * a["w"] + a["z"] * a["z"]))
        turn = 2 * math.pi
        wound = lambda x: x - F.floor(x / turn + 0.5) * turn
        return F.struct(wound(half + other).alias("lon"), (math.pi / 2 - theta).alias("lat"), wound(half - other).alias("psi"))

    return let(q, parts)
