"""Where detectors look: pointing models, directions on the sky, and polynomials that stand for them.

Angles are radians. A boresight is (az, el, roll), as the rotation to longitude -az, latitude el and turn roll.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.angles import fix_overpole, let, rewind
from scanloom.functions.rotations import direction, euler, inverse, product, to_direction, to_offset
from scanloom.operators.sky import LATITUDE, LONGITUDE

#: Elevation at which the large telescope's receiver does not turn against the sky (fixed value)
LEVEL = math.radians(60)
VERSIONS = ("sat_naive", "sat_v1", "lat_naive", "lat_v0", "lat_v1", "lat_v2", "arc")


def _angle(model: Mapping[str, Column | float], name: str) -> Column:
    """A parameter of a model; one that is not given is 0."""
    x = model.get(name, 0.0)
    return x if isinstance(x, Column) else F.lit(float(x))


def _tilt(model: Mapping[str, Column | float]) -> list[Column]:
    """The tilt of the base: by its amplitude, about the axis that its two components give."""
    c, s = _angle(model, "base_tilt_cos"), _angle(model, "base_tilt_sin")
    phi = F.atan2(s, c)
    return [euler(2, phi), euler(1, F.sqrt(c * c + s * s)), euler(2, -phi)]


def _at(model: Mapping[str, Column | float], name: str, xi: str, eta: str, scale: float = 1.0) -> Column:
    return to_offset(_angle(model, name + xi) * scale, _angle(model, name + eta) * scale)


def _boresight(q: Column) -> Column:
    return let(direction(q), lambda d: F.struct((-d["lon"]).alias("az"), d["lat"].alias("el"), d["psi"].alias("roll")))


def _named(az: Column, el: Column, roll: Column) -> Column:
    return F.struct(az.cast("double").alias("az"), el.cast("double").alias("el"), roll.cast("double").alias("roll"))


def _sagged(el: Column, model: Mapping[str, Column | float]) -> Column:
    """An elevation bent by the telescope's weight: linearly and with the square of the distance to a pivot."""
    off = el - _angle(model, "el_sag_pivot")
    return el + off * _angle(model, "el_sag_lin") + off * off * _angle(model, "el_sag_quad")


def _large(b: Column, model: Mapping[str, Column | float], sag_first: bool) -> Column:
    """The large telescope: encoder offsets, then the centres of mirror, elevation axis and receiver, each against its own
    turn, and the tilt of the base; the sag comes before all that, or between the centres and the tilt."""
    shifted = F.struct(
        (b["az"] + _angle(model, "enc_offset_az")).alias("az"),
        (b["el"] + _angle(model, "enc_offset_el")).alias("el"),
        (b["el"] - b["roll"] - LEVEL + _angle(model, "enc_offset_cr")).alias("turn"),
    )

    def chain(s: Column) -> list[Column]:
        el = _sagged(s["el"], model) if sag_first else s["el"]
        return [
            to_direction(-s["az"], el),
            inverse(_at(model, "mir_center_", "xi0", "eta0")),
            euler(2, el - LEVEL),
            inverse(_at(model, "el_axis_center_", "xi0", "eta0")),
            euler(2, -s["turn"]),
            inverse(_at(model, "cr_center_", "xi0", "eta0")),
        ]

    if sag_first:
        return let(shifted, lambda s: _boresight(product(*_tilt(model), *chain(s))))
    bent = let(shifted, lambda s: let(direction(product(*chain(s))), lambda d: to_direction(d["lon"], _sagged(d["lat"], model), d["psi"])))
    return _boresight(product(*_tilt(model), bent))


def corrected(az: Column, el: Column, roll: Column, version: str, model: Mapping[str, Column | float], over: Column | None = None) -> Column:
    """struct(az, el, roll) of an encoder's reading under a pointing model; parameters are numbers or columns.

    `over` says of sat_naive whether the observation begins beyond the zenith (by default, whether this reading is)."""
    m = model
    if version not in VERSIONS:
        raise ValueError(f"unknown pointing model {version!r}")
    if version == "lat_naive":
        return _named(az, el, roll)
    if version == "sat_naive":
        beyond = el > math.pi / 2 if over is None else over
        az2, el2 = fix_overpole(az, el, math.pi)
        turned = F.when(el > math.pi / 2, roll + math.pi).otherwise(roll)
        return _named(F.when(beyond, az2).otherwise(az), F.when(beyond, el2).otherwise(el), F.when(beyond, turned).otherwise(roll))
    if version == "sat_v1":
        lifted = el + _angle(m, "enc_offset_el")
        turned = az + _angle(m, "enc_offset_az") + _angle(m, "az_rot") * lifted
        about = lambda q: [inverse(q), euler(2, roll - _angle(m, "enc_offset_boresight")), q]
        axis = inverse(_at(m, "fp_rot_", "xi0", "eta0"))
        return _boresight(product(*_tilt(m), to_direction(-turned, lifted), _at(m, "fp_offset_", "xi0", "eta0"), *about(axis)))
    if version == "lat_v0":  # in degrees
        unit = math.radians(1)
        lifted = el + _angle(m, "el_offset") * unit
        turn = el - roll - LEVEL + _angle(m, "cr_offset") * unit
        parts = [to_direction(-(az + _angle(m, "az_offset") * unit), lifted), _at(m, "mir_", "xi_offset", "eta_offset", unit), euler(2, lifted - LEVEL)]
        parts += [_at(m, "el_", "xi_offset", "eta_offset", unit), euler(2, -turn), _at(m, "rx_", "xi_offset", "eta_offset", unit)]
        return _boresight(product(*parts))
    return let(_named(az, el, roll), lambda b: _large(b, m, version != "lat_v1"))


def arc_offsets(xi: Column, eta: Column, mean_roll: Column, model: Mapping[str, Column | float]) -> tuple[Column, Column]:
    """Focal plane offsets of the model "arc": they move on an arc with the roll, less so toward the edge."""
    size = _angle(model, "arc_amp") * (1 - (xi * xi + eta * eta) / (_angle(model, "arc_r0") * _angle(model, "arc_r0")))
    ang = mean_roll - _angle(model, "arc_roll0")
    return xi + size * (F.cos(ang) - 1) + _angle(model, "waf_off_xi"), eta + size * F.sin(ang) + _angle(model, "waf_off_eta")


def on_sky(az: Column, el: Column, roll: Column, t: Column, xi: Column, eta: Column, gamma: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> Column:
    """struct(lon, lat, psi): right ascension in [-pi, pi], declination and turn of a detector at (xi, eta, gamma), by a
    plain rotation of the sky as in functions.angles. It is asked for at every sample of every detector, so the rotations
    are multiplied for whole batches."""

    @F.pandas_udf("lon double, lat double, psi double")
    def run(az: pd.Series, el: pd.Series, roll: pd.Series, t: pd.Series, xi: pd.Series, eta: pd.Series, gamma: pd.Series) -> pd.DataFrame:
        lon, lat, psi = _seen(*(x.to_numpy(float) for x in (az, el, roll, t, xi, eta, gamma)), latitude, longitude)
        return pd.DataFrame({"lon": lon, "lat": lat, "psi": psi})

    return run(*(c.cast("double") for c in (az, el, roll, t, xi, eta, gamma)))


def _seen(az: np.ndarray, el: np.ndarray, roll: np.ndarray | float, t: np.ndarray, xi: np.ndarray | float, eta: np.ndarray | float, gamma: np.ndarray | float, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """on_sky() of arrays."""
    turns = 0.7790572732640 + 1.00273781191135448 * (t - 946728000.0) / 86400
    phi, theta = np.arctan2(-xi, -eta), np.arcsin(np.minimum(1.0, np.sqrt(xi * xi + eta * eta)))
    q = _turned(2, (turns - np.floor(turns)) * (2 * math.pi) + longitude)
    # the site, the boresight, the place on the focal plane
    for axis, angle in ((1, math.pi / 2 - latitude), (2, math.pi), (2, -az), (1, math.pi / 2 - el), (2, roll), (2, phi), (1, theta), (2, gamma - phi)):
        q = _after(q, axis, angle)
    w, x, y, z = q
    half, other = np.arctan2(z, w), np.arctan2(-x, y)
    wound = lambda a: a - np.floor(a / (2 * math.pi) + 0.5) * (2 * math.pi)
    lat = math.pi / 2 - 2 * np.arctan2(np.sqrt(x * x + y * y), np.sqrt(w * w + z * z))
    return wound(half + other), lat, wound(half - other)


def _turned(axis: int, angle: np.ndarray) -> list[np.ndarray]:
    """The quaternions (w, x, y, z) of rotations about an axis."""
    q = [np.cos(angle / 2), *(np.zeros_like(angle) for _ in range(3))]
    q[axis + 1] = np.sin(angle / 2)
    return q


def _after(q: list[np.ndarray], axis: int, angle: np.ndarray | float) -> list[np.ndarray]:
    """Rotations q after one about y (1) or z (2)."""
    (w, x, y, z), c, s = q, np.cos(angle / 2), np.sin(angle / 2)
    if axis == 1:
        return [w * c - y * s, x * c - z * s, y * c + w * s, z * c + x * s]
    return [w * c - z * s, x * c + y * s, y * c - x * s, z * c + w * s]


BASIS = 11
_PIXELS = ("y", "x", "psi")


def basis(reference: DataFrame, by: str) -> DataFrame:
    """(by, samp, b): the fit's functions at each sample of a reference path (by, samp, y, x): 1, t, x to x^3, y to y^3,
    t x, t y and x y, where t goes from -1 to 1 and x and y from 0 to 1 (or stay as they are if they never change)."""
    ends = reference.groupBy(by).agg(*(f(c).alias(f"__{c}{k}") for c in ("y", "x", "samp") for f, k in ((F.min, 0), (F.max, 1))))
    d = reference.join(ends, by)
    unit = lambda c: F.when(F.col(f"__{c}1") == F.col(f"__{c}0"), F.col(c)).otherwise((F.col(c) - F.col(f"__{c}0")) / (F.col(f"__{c}1") - F.col(f"__{c}0")))
    t = F.when(F.col("__samp1") == F.col("__samp0"), -1.0).otherwise(2 * (F.col("samp") - F.col("__samp0")) / (F.col("__samp1") - F.col("__samp0")) - 1)
    d = d.withColumns({"__t": t, "__u": unit("x"), "__v": unit("y")})
    t, x, y = F.col("__t"), F.col("__u"), F.col("__v")
    return d.select(by, "samp", F.array(F.lit(1.0), t, x, x * x, x * x * x, y, y * y, y * y * y, t * x, t * y, x * y).alias("b"))


def fitted(path: DataFrame, exact: DataFrame, by: str, det: str = "det") -> DataFrame:
    """(by, det, y, x, psi): coefficients of BASIS functions (basis(), here `path`) that come nearest to exact pointing.

    exact: rows (by, det, samp, y, x, psi) at some of the samples, each of them for every detector. The normal equations
    of a group are summed over its samples, and right sides over each detector's, with partial sums; what is solved is one
    BASIS x BASIS matrix a group, where its row lies. Functions that the samples cannot tell apart get the smallest
    coefficients. Matrices join by a merge: Catalyst counts an array as one element and would broadcast all of them."""
    known = exact.select(by, "samp")
    pairs = [(i, j) for i in range(BASIS) for j in range(i, BASIS)]
    sums = [F.sum(F.col("b")[i] * F.col("b")[j]) for i, j in pairs]
    gram = path.join(known, [by, "samp"], "left_semi").groupBy(by).agg(F.array(*sums).alias("gram"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[by]].copy()
            full = []
            for g in pdf["gram"]:
                m = np.zeros((BASIS, BASIS))
                for (i, j), v in zip(pairs, g):
                    m[i, j] = m[j, i] = v
                full.append(np.linalg.pinv(m, rcond=1e-13, hermitian=True).ravel())
            out["inv"] = full
            yield out

    kind = path.select(by).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1) + ", inv array<double>"
    inverses = gram.mapInPandas(solve, kind)
    right = [F.array(*(F.sum(F.col("b")[i] * F.col(c)) for i in range(BASIS))).alias(c) for c in _PIXELS]
    sides = exact.join(path, [by, "samp"]).groupBy(by, det).agg(*right)
    row = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BASIS - 1)), lambda i: _dot(F.slice("inv", i * BASIS + 1, BASIS), F.col(c)))
    return sides.join(inverses.hint("merge"), by).select(by, det, *(row(c).alias(c) for c in _PIXELS))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def evaluated(path: DataFrame, coefficients: DataFrame, by: str, det: str = "det") -> DataFrame:
    """(by, det, samp, y, x, psi) of every detector at every sample of its group's basis()."""
    c = coefficients.select(by, det, *(F.col(p).alias(f"__{p}") for p in _PIXELS))
    return path.join(c.hint("merge"), by).select(by, det, "samp", *(_dot(F.col("b"), F.col(f"__{p}")).alias(p) for p in _PIXELS))


def pixels(rows: DataFrame, at: str, by: str, samp: str, y0: float, x0: float, dy: float, dx: float) -> DataFrame:
    """rows with y, x, psi for a direction struct `at`, in pixels of a plain map whose first pixel is (y0, x0) rad and whose
    steps are dy and dx; right ascension and psi go on from those of the group's first sample, half a turn at most."""
    first = rows.groupBy(by).agg(F.min_by(F.struct(f"{at}.lon", f"{at}.psi"), samp).alias("__first"))
    d, turn = rows.join(first, by), 2 * math.pi
    lon = F.col("__first.lon") + rewind(F.col(f"{at}.lon") - F.col("__first.lon"), turn)
    psi = F.col("__first.psi") + rewind(F.col(f"{at}.psi") - F.col("__first.psi"), turn)
    return d.withColumns({"y": (F.col(f"{at}.lat") - y0) / dy, "x": (lon - x0) / dx, "psi": psi}).drop("__first")


#: Samples whose scans are fitted abreast.
_ABREAST = 1 << 15


def fit_errors(scans: DataFrame, by: str, dets: Sequence[tuple[int, float, float]], dy: float, dx: float) -> DataFrame:
    """(by, det, n, y, x): for each scan and detector (det, xi, eta) the samples, and how near (rms, in pixels of dy and dx)
    pixels() of the fit come to those of exact pointing, with the fit made at all samples of the scan.

    scans (by, t, az, el): a row for each, whose arrays are of one length. This is what on_sky(), pixels(), basis(),
    fitted() and evaluated() are for one after another, but for scans of few samples: such a scan stays in its row, so that
    nothing is shuffled, sorted or written, where those steps join each sample with its group several times. The fit is of
    full precision here; the normal equations of fitted() keep half of the digits, too few for the scans of one elevation.
    Scans without samples drop out; where an angle or a time is missing or not finite, or arrays differ in length, y and x
    are null."""
    source = scans.select(by, *(F.col(c).cast("array<double>").alias(c) for c in ("t", "az", "el"))).where(f"{by} is not null and size(t) > 0")
    schema = source.select(by, F.lit(0).alias("det"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x")).schema
    for c in ("y", "x"):
        schema[c].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            sizes = [pc.fill_null(pc.list_value_length(batch.column(i)), -1).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            even = (sizes[0] == sizes[1]) & (sizes[0] == sizes[2])
            off = np.full((len(keys), len(dets), 2), np.nan)
            for n in np.unique(sizes[0][even]):
                alike, step = np.flatnonzero(even & (sizes[0] == n)), max(1, _ABREAST // int(n))
                for rows in (alike[i : i + step] for i in range(0, len(alike), step)):
                    t, az, el = (pc.list_flatten(batch.column(i).take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), n) for i in (1, 2, 3))
                    whole = np.isfinite(t).all(axis=1) & np.isfinite(az).all(axis=1) & np.isfinite(el).all(axis=1)
                    off[rows[whole]] = _scan_errors(t[whole], az[whole], el[whole], dets, dy, dx)
            each, k = np.repeat(np.arange(len(keys)), len(dets)), len(dets)
            flat = off.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(each)), pa.array(np.tile([d for d, _, _ in dets], len(keys)).astype(np.int32)), pa.array(np.repeat(sizes[0], k).astype(np.int64))]
                + [pa.array(flat[:, i], mask=np.isnan(flat[:, i])) for i in (0, 1)],
                [by, "det", "n", "y", "x"],
            )

    return source.mapInArrow(run, schema)


def _scan_errors(t: np.ndarray, az: np.ndarray, el: np.ndarray, dets: Sequence[tuple[int, float, float]], dy: float, dx: float) -> np.ndarray:
    """(scan, detector, y and x): rms between fit and exact pointing, of scans whose samples are the columns."""
    lon, lat, psi = _seen(az, el, 0.0, t, 0.0, 0.0, 0.0)
    turn, start = 2 * math.pi, lon[:, :1]

    def placed(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lat / dy, (start + np.mod(lon - start + turn / 2, turn) - turn / 2) / dx

    def unit(c: np.ndarray) -> np.ndarray:
        lo, hi = c.min(axis=1, keepdims=True), c.max(axis=1, keepdims=True)
        return np.where(hi == lo, c, (c - lo) / np.where(hi == lo, 1.0, hi - lo))

    y, x = (unit(c) for c in placed(lon, lat))
    u = np.broadcast_to(np.linspace(-1.0, 1.0, t.shape[1]), t.shape)
    b = np.stack([np.ones_like(u), u, x, x * x, x * x * x, y, y * y, y * y * y, u * x, u * y, x * y], axis=-1)
    # the fit at the samples is a projection; the matrix itself is taken apart, as its square would lose half of the digits
    side, size, _ = np.linalg.svd(b, full_matrices=False)
    side = side * (size > 1e-12 * size[:, :1])[:, None, :]
    out = np.empty((len(t), len(dets), 2))
    for k, (_, xi, eta) in enumerate(dets):
        lon, lat, _ = _seen(az, el, 0.0, t, xi, eta, 0.0)
        exact = np.stack(placed(lon, lat), axis=-1)
        fit = side @ (np.swapaxes(side, 1, 2) @ exact)
        out[:, k] = np.sqrt(np.mean((exact - fit) ** 2, axis=1))
    return out
