"""Queries of pointing, with SQL where a rotation can be written out; tests/test_pointing.py has the others in NumPy."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scanloom.operators import pointing, sky
from scanloom.plans.language_queries import DESCRIBED, described
from scanloom.plans.sql_parts import q

#: Small corrections, for all models; the pivot is an elevation.
MODEL = {
    "enc_offset_az": 0.002, "enc_offset_el": -0.001, "enc_offset_boresight": 0.003, "enc_offset_cr": 0.004, "az_rot": 0.0005, "base_tilt_cos": 0.0003, "base_tilt_sin": -0.0002,
    "fp_rot_xi0": 0.001, "fp_rot_eta0": -0.002, "fp_offset_xi0": 0.003, "fp_offset_eta0": 0.001, "az_offset": 0.1, "el_offset": -0.05, "cr_offset": 0.2,
    "mir_xi_offset": 0.03, "mir_eta_offset": -0.02, "el_xi_offset": 0.01, "el_eta_offset": 0.04, "rx_xi_offset": -0.03, "rx_eta_offset": 0.02,
    "mir_center_xi0": 0.0011, "mir_center_eta0": -0.0007, "el_axis_center_xi0": 0.0005, "el_axis_center_eta0": 0.0009, "cr_center_xi0": -0.0004, "cr_center_eta0": 0.0006,
    "el_sag_pivot": 0.9, "el_sag_lin": 0.001, "el_sag_quad": -0.002,
}


def pointing_models(spark, d):
    """Boresights under each model, every seventh of them beyond the zenith."""
    el = F.when(F.col("obs_key") % 7 == 0, math.pi - F.radians("bel")).otherwise(F.radians("bel"))
    out = described(spark, d).select("obs_key", F.radians("baz").alias("az"), el.alias("el"), F.radians("roll").alias("roll"))
    args = F.col("az"), F.col("el"), F.col("roll")
    each = F.array(*(F.struct(F.lit(v).alias("version"), pointing.corrected(*args, v, MODEL).alias("p")) for v in pointing.VERSIONS))
    return out.select("obs_key", F.explode(each).alias("x")).select("obs_key", "x.version", *(F.round(f"x.p.{c}", 7).alias(c) for c in ("az", "el", "roll")))


def detector_directions(spark, d):
    """Where the centre of each wafer looks at the start of its observation."""
    slots = described(spark, d).withColumn("slot", F.explode(F.split("slots", ",")))
    xi, eta, _ = sky.wafer_centre(F.col("tube"), F.col("slot"))
    at = pointing.on_sky(F.radians("baz"), F.radians("bel"), F.radians("roll"), F.col("ctime"), xi, eta, F.lit(0.0))
    out = slots.select("obs_key", "slot", at.alias("p"))
    return out.select("obs_key", "slot", F.round(F.sin("p.lon"), 6).alias("sin_ra"), F.round(F.cos("p.lon"), 6).alias("cos_ra"), F.round("p.lat", 6).alias("dec"))


def pointing_fit(spark, d):
    """How near the fit of each observation's scan comes to exact pointing at all its samples, in pixels of half a minute:
    16 moments of a scan, two detectors."""
    # a scan is much work for one row, so that a file's single split would hold most of it
    obs = described(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "obs_key")
    at = lambda f: F.array(*(f(k) for k in range(16)))
    t, az = at(lambda k: F.col("ctime") + k * 20.0), at(lambda k: F.radians("baz") + F.radians("waz") / 2 * F.sin(F.lit(k * 0.4)))
    scans = obs.select("obs_key", t.alias("t"), az.alias("az"), at(lambda k: F.radians("bel")).alias("el"))
    step = math.radians(0.5 / 60)
    off = pointing.fit_errors(scans, "obs_key", ((0, 0.004, -0.003), (1, -0.006, 0.005)), step, step)
    return off.select("obs_key", "det", "n", *(F.round(c, 2).alias(c) for c in ("y", "x")))


QUERIES = {f.__name__: f for f in (pointing_models, detector_directions, pointing_fit)}
_LAT, _LON = f"{sky.LATITUDE!r}::double", f"{sky.LONGITUDE!r}::double"
_WAFERS = ", ".join(f"('{t}', '{w}', {x}::double, {y}::double)" for t, wafers in sky.LARGE_WAFERS.items() for w, (x, y) in wafers.items())
ORACLE_SQL = {
    "detector_directions": q(*DESCRIBED, f"""wf as (select tube, slot, radians(x) as xi0, radians(y) as eta0 from (values {_WAFERS}) as w(tube, slot, x, y)),
        sl as (select *, unnest(string_split(slots, ',')) as slot from obs),
        tu as (select *, eta0 * sin(radians(roll)) + xi0 * cos(radians(roll)) as xi, eta0 * cos(radians(roll)) - xi0 * sin(radians(roll)) as eta,
            sqrt(1 - xi0 * xi0 - eta0 * eta0) as c, radians(bel) as e from sl join wf using (tube, slot)),
        ho as (select *, radians(baz) + atan2(xi, c * cos(e) - eta * sin(e)) as az, asin(eta * cos(e) + c * sin(e)) as el from tu),
        eq as (select *, asin(sin(el) * sin({_LAT}) + cos(el) * cos({_LAT}) * cos(az)) as dec, 0.7790572732640::double + 1.00273781191135448::double * (ctime - 946728000.0::double) / 86400 as turns,
            atan2(-sin(az) * cos(el), sin(el) * cos({_LAT}) - cos(el) * sin({_LAT}) * cos(az)) as hour from ho),
        ra_ as (select *, (turns - floor(turns)) * 2 * pi() + {_LON} - hour as ra from eq)""",
        select="select obs_key, slot, round(sin(ra), 6) as sin_ra, round(cos(ra), 6) as cos_ra, round(dec, 6) as dec from ra_"),
}
