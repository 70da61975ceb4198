"""Rotations, pointing models and their fit against NumPy rotation matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import rotations
from scanloom.functions.angles import horizon_to_equatorial
from scanloom.operators import pointing
from scanloom.plans import registry

LEVEL = math.radians(60)


def turn(axis, a):
    c, s = math.cos(a), math.sin(a)
    return {0: np.array([[1, 0, 0], [0, c, -s], [0, s, c]]), 1: np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), 2: np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])}[axis]


def to(lon, lat, psi=0.0):
    return turn(2, lon) @ turn(1, math.pi / 2 - lat) @ turn(2, psi)


def offset(xi, eta, gamma=0.0):
    phi = math.atan2(-xi, -eta)
    return turn(2, phi) @ turn(1, math.asin(math.hypot(xi, eta))) @ turn(2, gamma - phi)


def angles(m):
    return math.atan2(m[1, 2], m[0, 2]), math.atan2(m[2, 2], math.hypot(m[0, 2], m[1, 2])), math.atan2(m[2, 1], -m[2, 0])


def same(a, b, tol=1e-9):
    return all(abs((x - y + math.pi) % (2 * math.pi) - math.pi) < tol for x, y in zip(a, b))


def tilt(m):
    phi, amp = math.atan2(m["base_tilt_sin"], m["base_tilt_cos"]), math.hypot(m["base_tilt_sin"], m["base_tilt_cos"])
    return turn(2, phi) @ turn(1, amp) @ turn(2, -phi)


def expected(version, az, el, roll, m):
    if version == "lat_naive":
        return az, el, roll
    if version == "sat_naive":
        return (az + math.pi, math.pi - el, roll + math.pi) if el > math.pi / 2 else (az, el, roll)
    if version == "sat_v1":
        az, el, roll = az + m["enc_offset_az"], el + m["enc_offset_el"], roll - m["enc_offset_boresight"]
        az += m["az_rot"] * el
        rot = offset(m["fp_rot_xi0"], m["fp_rot_eta0"]).T
        q = tilt(m) @ to(-az, el) @ offset(m["fp_offset_xi0"], m["fp_offset_eta0"]) @ rot.T @ turn(2, roll) @ rot
    elif version == "lat_v0":
        d = math.radians
        cr = -roll + el - LEVEL + d(m["cr_offset"])
        az, el = az + d(m["az_offset"]), el + d(m["el_offset"])
        at = lambda k: offset(d(m[k + "xi_offset"]), d(m[k + "eta_offset"]))
        q = to(-az, el) @ at("mir_") @ turn(2, el - LEVEL) @ at("el_") @ turn(2, -cr) @ at("rx_")
    else:
        cr = el - roll - LEVEL + m["enc_offset_cr"]
        az, el = az + m["enc_offset_az"], el + m["enc_offset_el"]
        sag = lambda e: e + (e - m["el_sag_pivot"]) * m["el_sag_lin"] + (e - m["el_sag_pivot"]) ** 2 * m["el_sag_quad"]
        if version != "lat_v1":
            el = sag(el)
        at = lambda k: offset(m[k + "_xi0"], m[k + "_eta0"]).T
        q = to(-az, el) @ at("mir_center") @ turn(2, el - LEVEL) @ at("el_axis_center") @ turn(2, -cr) @ at("cr_center")
        if version == "lat_v1":
            lon, lat, psi = angles(q)
            q = to(lon, sag(lat), psi)
        q = tilt(m) @ q
    lon, lat, psi = angles(q)
    return -lon, lat, psi


NAMES = """enc_offset_az enc_offset_el enc_offset_boresight enc_offset_cr az_rot base_tilt_cos base_tilt_sin fp_rot_xi0 fp_rot_eta0 fp_offset_xi0
fp_offset_eta0 az_offset el_offset cr_offset mir_xi_offset mir_eta_offset el_xi_offset el_eta_offset rx_xi_offset rx_eta_offset mir_center_xi0
mir_center_eta0 el_axis_center_xi0 el_axis_center_eta0 cr_center_xi0 cr_center_eta0 el_sag_pivot el_sag_lin el_sag_quad""".split()


@pytest.mark.parametrize("version", pointing.VERSIONS)
def test_models(spark, version):
    r = np.random.default_rng(len(version))
    model = {n: float(r.uniform(-0.05, 0.05)) for n in NAMES}
    rows = [tuple(map(float, x)) for x in zip(r.uniform(-4, 9, 30), r.uniform(0.2, 2.6 if version == "sat_naive" else 1.5, 30), r.uniform(-3, 3, 30))]
    df = spark.createDataFrame(rows, "az double, el double, roll double")
    given = {k: F.lit(v) if i % 2 else v for i, (k, v) in enumerate(model.items())}  # numbers or columns
    got = df.select("az", "el", "roll", pointing.corrected(F.col("az"), F.col("el"), F.col("roll"), version, given).alias("p")).collect()
    assert len(got) == 30 and all(same(x["p"], expected(version, x["az"], x["el"], x["roll"], model)) for x in got)


def test_unknown_model_and_missing_parameters(spark):
    a = [F.lit(0.3), F.lit(0.8), F.lit(0.1)]
    with pytest.raises(ValueError, match="lat_v9"):
        pointing.corrected(*a, "lat_v9", {})
    got = spark.range(1).select(pointing.corrected(*a, "lat_v2", {}).alias("p")).first()["p"]
    assert same(got, (0.3, 0.8, 0.1))  # a model without parameters changes nothing


def test_arc(spark):
    m = {"arc_amp": 0.02, "arc_r0": 0.3, "arc_roll0": 0.4, "waf_off_xi": 0.001, "waf_off_eta": -0.002}
    xi, eta = pointing.arc_offsets(F.lit(0.1), F.lit(0.05), F.lit(1.0), m)
    got = spark.range(1).select(xi, eta).first()
    s = 0.02 * (1 - (0.1**2 + 0.05**2) / 0.09)
    assert tuple(got) == pytest.approx((0.1 + s * (math.cos(0.6) - 1) + 0.001, 0.05 + s * math.sin(0.6) - 0.002))


def test_sky(spark):
    r = np.random.default_rng(8)
    rows = [tuple(map(float, x)) for x in zip(r.uniform(0, 6, 25), r.uniform(0.3, 1.5, 25), r.uniform(-3, 3, 25), r.uniform(1e9, 2e9, 25), r.uniform(-0.2, 0.2, 25), r.uniform(-0.2, 0.2, 25), r.uniform(-3, 3, 25))]
    df = spark.createDataFrame(rows, "az double, el double, roll double, t double, xi double, eta double, gamma double")
    got = df.select("*", pointing.on_sky(*(F.col(c) for c in df.columns)).alias("p")).collect()
    for x in got:
        turns = 0.7790572732640 + 1.00273781191135448 * (x["t"] - 946728000) / 86400
        site = turn(2, turns % 1 * 2 * math.pi + pointing.LONGITUDE) @ turn(1, math.pi / 2 - pointing.LATITUDE) @ turn(2, math.pi)
        assert same(x["p"], angles(site @ to(-x["az"], x["el"], x["roll"]) @ offset(x["xi"], x["eta"], x["gamma"])), 1e-6)
    ra, dec = horizon_to_equatorial(F.col("az"), F.col("el"), F.col("t"), pointing.LATITUDE, pointing.LONGITUDE)
    centre = df.select(ra.alias("a"), dec.alias("d"), pointing.on_sky(F.col("az"), F.col("el"), F.col("roll"), F.col("t"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("p"))
    assert all(same((x["a"], x["d"]), x["p"][:2], 1e-6) for x in centre.collect())


def test_inverse_and_poles(spark):
    q = rotations.to_direction(F.lit(0.4), F.lit(math.pi / 2), F.lit(0.3))
    d = spark.range(1).select(rotations.direction(q).alias("d"), rotations.product(q, rotations.inverse(q)).alias("one")).first()
    assert d["d"]["lat"] == pytest.approx(math.pi / 2) and tuple(d["one"]) == pytest.approx((1, 0, 0, 0))


@pytest.fixture(scope="module")
def scans(spark):
    """Two observations: 900 samples of a scan in azimuth, the second also in elevation; 12 detectors."""
    obs = spark.createDataFrame([(1, 1.6e9, 1.0, 0.9, 0.0), (2, 1.7e9, 3.1, 0.8, 0.02)], "obs long, t0 double, az0 double, el0 double, nod double")
    s = obs.withColumn("samp", F.explode(F.sequence(F.lit(0), F.lit(899)))).withColumn("t", F.col("t0") + F.col("samp") * 0.2)
    s = s.select("obs", "samp", "t", (F.col("az0") + 0.15 * F.sin(F.col("samp") * 0.05)).alias("az"), (F.col("el0") + F.col("nod") * F.sin(F.col("samp") * 0.02)).alias("el"))
    dets = spark.range(12).select(F.col("id").alias("det"), ((F.col("id") % 4 - 1.5) * 0.005).alias("xi"), (F.floor(F.col("id") / 4) * 0.004 - 0.004).alias("eta"))
    step = math.radians(0.5 / 60)
    place = lambda rows, xi, eta: pointing.pixels(rows.withColumn("p", pointing.on_sky(F.col("az"), F.col("el"), F.lit(0.0), F.col("t"), xi, eta, F.lit(0.0))), "p", "obs", "samp", 0.0, 0.0, step, step)
    path = pointing.basis(place(s, F.lit(0.0), F.lit(0.0)), "obs").cache()
    exact = place(s.crossJoin(F.broadcast(dets)), F.col("xi"), F.col("eta")).select("obs", "det", "samp", "y", "x", "psi").cache()
    return path, exact


def test_fit_is_the_least_squares_one_and_near(scans):
    path, exact = scans
    got = {(r["obs"], r["det"]): r for r in pointing.fitted(path, exact.where("samp % 30 = 0"), "obs").collect()}
    assert len(got) == 24
    b = {}
    for r in path.collect():
        b.setdefault(r["obs"], {})[r["samp"]] = r["b"]
    true = exact.toPandas().sort_values("samp")
    for (obs, det), r in got.items():
        v = true[(true["obs"] == obs) & (true["det"] == det)]
        full = np.array([b[obs][k] for k in v["samp"]])
        thin = full[::30]
        for c in ("y", "x", "psi"):
            want = np.linalg.lstsq(thin, v[c].to_numpy()[::30], rcond=1e-13**0.5)[0]
            assert np.abs(thin @ (np.array(r[c]) - want)).max() < 1e-3  # pixels; normal equations keep half of the digits
        for c in ("y", "x"):  # pixels of half a minute
            assert np.sqrt(np.mean((full @ np.array(r[c]) - v[c].to_numpy()) ** 2)) < 0.1


def test_evaluation_from_coefficients(scans):
    path, exact = scans
    c = pointing.fitted(path, exact.where("samp % 30 = 0"), "obs")
    off = pointing.evaluated(path, c, "obs").join(exact.withColumnsRenamed({p: f"t{p}" for p in ("y", "x", "psi")}), ["obs", "det", "samp"])
    row = off.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("y") - F.col("ty")) ** 2)).alias("y"), F.sqrt(F.avg((F.col("x") - F.col("tx")) ** 2)).alias("x")).first()
    assert row["n"] == 24 * 900 and row["y"] < 0.1 and row["x"] < 0.1


def test_fit_broadcasts_no_matrices_and_works_directions_out_once(spark, small, scans):
    path, exact = scans
    plan = pointing.fitted(path, exact, "obs")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan.split("MapInPandas")[0] and "BroadcastHashJoin" not in plan.split("MapInPandas")[0].split("HashAggregate")[0]
    whole = registry.QUERIES["pointing_fit"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "atan2" not in whole.lower() and "pythonUDF" not in whole  # the written pixels are read, not made again
