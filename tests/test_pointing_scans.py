"""The pointing fit of whole scans, a row each, against least squares scan by scan."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import pointing
from scanloom.plans import registry
from scanloom.plans.language_queries import described
from scanloom.sources.shared import shared_dir

STEP = math.radians(0.5 / 60)
DETS = (0, 0.004, -0.003), (1, -0.006, 0.005)


def wanted(t, az, el, xi, eta):
    """rms of y and x; one scan, and NumPy's own solver."""
    lon0, lat0, _ = pointing._seen(az, el, 0.0, t, 0.0, 0.0, 0.0)
    lon, lat, _ = pointing._seen(az, el, 0.0, t, xi, eta, 0.0)
    near = lambda a: lon0[0] + (a - lon0[0] + math.pi) % (2 * math.pi) - math.pi
    unit = lambda c: c if c.max() == c.min() else (c - c.min()) / (c.max() - c.min())
    x, y, u = unit(near(lon0)), unit(lat0), np.linspace(-1, 1, len(t))
    b = np.stack([u**0, u, x, x**2, x**3, y, y**2, y**3, u * x, u * y, x * y], axis=1)
    return [np.sqrt(np.mean((v - b @ np.linalg.lstsq(b, v, rcond=1e-12)[0]) ** 2)) for v in (lat / STEP, near(lon) / STEP)]


def test_query_gives_the_least_squares_fit_of_each_scan(spark, small):
    got = {(r["obs_key"], r["det"]): r for r in registry.QUERIES["pointing_fit"](spark, small).collect()}
    obs, k = described(spark, small).select("obs_key", "ctime", "baz", "waz", "bel").collect(), np.arange(16)
    assert len(got) == 2 * len(obs)
    for o in obs:
        az = math.radians(o["baz"]) + math.radians(o["waz"]) / 2 * np.sin(k * 0.4)
        for det, xi, eta in DETS:
            r = got[o["obs_key"], det]
            want = wanted(o["ctime"] + k * 20.0, az, np.full(16, math.radians(o["bel"])), xi, eta)
            assert r["n"] == 16 and (r["y"], r["x"]) == pytest.approx(want, abs=0.0051)


def test_query_shuffles_observations_only_and_writes_nothing(spark, small):
    folder = shared_dir(spark).removeprefix("file://") + "/scanloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = registry.QUERIES["pointing_fit"](spark, small)
    df.collect()
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_many_scans_of_one_batch_and_of_several_lengths(spark):
    k = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    ids = spark.range(0, 2500, 1, 1)
    n = {0: 16, 1: 20, 2: 1}
    rows = None
    for m, size in n.items():
        some = ids.where(F.col("id") % 3 == m)
        col = lambda f, size=size: F.transform(k(size), f)
        t, az = col(lambda i: 1.6e9 + F.col("id") * 977.0 + i * 20.0), col(lambda i: F.col("id") * 0.01 + 0.2 * F.sin(i * 0.4))
        rows_m = some.select("id", t.alias("t"), az.alias("az"), col(lambda i: F.lit(0.8) + i * 0.002 * (F.col("id") % 2)).alias("el"))
        rows = rows_m if rows is None else rows.unionAll(rows_m)
    rows = rows.coalesce(1).sort("id").cache()
    got = {(r["id"], r["det"]): r for r in pointing.fit_errors(rows, "id", DETS, STEP, STEP).collect()}
    assert len(got) == 5000
    for s in rows.collect():
        for det, xi, eta in DETS:
            r = got[s["id"], det]
            assert r["n"] == n[s["id"] % 3]
            assert (r["y"], r["x"]) == pytest.approx(wanted(*(np.array(s[c]) for c in ("t", "az", "el")), xi, eta), abs=1e-5)


def test_scans_with_something_missing(spark):
    whole = [1.6e9 + 20.0 * i for i in range(16)], [0.2 * math.sin(0.4 * i) for i in range(16)], [0.8] * 16
    t, az, el = whole
    rows = [
        (1, t, az, el), (2, t[:-1] + [None], az, el), (3, t, az[:-1] + [float("nan")], el), (4, t, az, el[:-1]),
        (5, t, None, el), (6, [], [], []), (7, None, None, None), (None, t, az, el), (8, t, az, el[:-1] + [float("inf")]),
    ]
    df = spark.createDataFrame(rows, "obs long, t array<double>, az array<double>, el array<double>")
    got = {(r["obs"], r["det"]): (r["n"], r["y"], r["x"]) for r in pointing.fit_errors(df, "obs", DETS, STEP, STEP).collect()}
    assert set(got) == {(o, d) for o in (1, 2, 3, 4, 5, 8) for d in (0, 1)}
    assert all(v == (16, None, None) for (o, _), v in got.items() if o > 1)
    assert got[1, 0][1:] == pytest.approx(wanted(*map(np.array, whole), 0.004, -0.003), abs=1e-6)
    assert pointing.fit_errors(df.where("obs > 9"), "obs", DETS, STEP, STEP).count() == 0
