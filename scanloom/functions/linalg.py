"""Small linear algebra as columns: symmetric 3x3 matrices of pixel weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the upper triangle, by row.
SYM3 = ("tt", "tq", "tu", "qq", "qu", "uu")


def det3(m: dict[str, Column]) -> Column:
    tt, tq, tu, qq, qu, uu = (m[k] for k in SYM3)
    return tt * (qq * uu - qu * qu) - tq * (tq * uu - qu * tu) + tu * (tq * qu - qq * tu)


def inv3(m: dict[str, Column], least: float = 0.0) -> dict[str, Column]:
    """Inverse of a symmetric 3x3 matrix; where |det| is at most `least`, all elements are 0."""
    tt, tq, tu, qq, qu, uu = (m[k] for k in SYM3)
    det = det3(m)
    parts = {
        "tt": qq * uu - qu * qu,
        "tq": tu * qu - tq * uu,
        "tu": tq * qu - tu * qq,
        "qq": tt * uu - tu * tu,
        "qu": tq * tu - tt * qu,
        "uu": tt * qq - tq * tq,
    }
    return {k: F.when(F.abs(det) > least, v / F.when(F.abs(det) > least, det)).otherwise(0.0) for k, v in parts.items()}


def safe_inv3(m: dict[str, Column], tol: float = 1e-3) -> dict[str, Column]:
    """Inverse of weights normalised by tt; where the normalised determinant is below tol / 4 only 1/tt stays."""
    tt = F.when(m["tt"] > 0, m["tt"])
    scaled = {k: v / tt for k, v in m.items()}
    good = F.coalesce(det3(scaled) >= tol / 4, F.lit(False))
    inverse = inv3(scaled)
    alone = {"tt": F.coalesce(1 / tt, F.lit(0.0))}
    return {k: F.when(good, v / tt).otherwise(alone.get(k, F.lit(0.0))) for k, v in inverse.items()}


def times_vector(m: dict[str, Column], t: Column, q: Column, u: Column) -> tuple[Column, Column, Column]:
    return m["tt"] * t + m["tq"] * q + m["tu"] * u, m["tq"] * t + m["qq"] * q + m["qu"] * u, m["tu"] * t + m["qu"] * q + m["uu"] * u


def safe_inverse(x: Column) -> Column:
    return F.when((x != 0) & ~F.isnan(x), 1 / F.when(x != 0, x)).otherwise(0.0)
