"""Sweeps and tracks against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import sky, spectra


def turn(axis, a):
    """Rotation matrix about y (1) or z (2)."""
    c, s = math.cos(a), math.sin(a)
    return np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]) if axis == 1 else np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def test_off_centre(spark):
    r = np.random.default_rng(3)
    rows = [(float(e), float(x), float(y)) for e, x, y in zip(r.uniform(0.3, 1.4, 40), r.uniform(-0.2, 0.2, 40), r.uniform(-0.2, 0.2, 40))]
    az, el = sky.off_centre(F.col("el"), F.col("xi"), F.col("eta"))
    got = spark.createDataFrame(rows, "el double, xi double, eta double").select("el", "xi", "eta", az.alias("a"), el.alias("e")).collect()
    for g in got:
        v = turn(1, math.pi / 2 - g["el"]) @ np.array([-g["eta"], -g["xi"], math.sqrt(1 - g["xi"] ** 2 - g["eta"] ** 2)])
        assert (g["a"], g["e"]) == pytest.approx((-math.atan2(v[1], v[0]), math.asin(v[2])), abs=1e-12)


def test_horizon_and_back(spark):
    from scanloom.functions.angles import equatorial_to_horizon, horizon_to_equatorial

    df = spark.range(200).select((F.col("id") * 0.031).alias("az"), (F.col("id") % 90 * 0.017 + 0.01).alias("el"), (F.col("id") * 7e6).alias("t"))
    ra, dec = horizon_to_equatorial(F.col("az"), F.col("el"), F.col("t"), -0.4, -1.18)
    df = df.withColumns({"ra": ra, "dec": dec})
    az, el = equatorial_to_horizon(F.col("ra"), F.col("dec"), F.col("t"), -0.4, -1.18)
    for r in df.select("az", "el", az.alias("a2"), el.alias("e2")).collect():
        assert abs((r["a2"] - r["az"] + math.pi) % (2 * math.pi) - math.pi) < 1e-7 and r["e2"] == pytest.approx(r["el"], abs=1e-7)


def test_positions_between_irregular_neighbours(spark):
    tracks = spark.createDataFrame(
        [("a", 0.0, 6.2, 0.0), ("a", 100.0, 0.1, 0.2), ("a", 100.0, 0.1, 0.2), ("a", 250.0, 0.3, 0.2), ("b", 240.0, 1.0, 1.0), ("c", 5.0, 1.0, 1.0)],
        "name string, t double, ra double, dec double",
    )
    points = spark.createDataFrame([(1, 50.0), (2, 100.0), (3, 249.0), (4, 250.0), (5, -1.0), (6, None)], "k long, at double")
    got = {r["k"]: r for r in sky.positions_at(points, tracks, "k", "at", 30.0).collect()}
    assert sorted(got) == [1, 2, 3]  # neither before, nor at the end, nor at no time
    assert got[1]["ra"] == pytest.approx((6.2 + (0.1 + 2 * math.pi - 6.2) / 2)) and got[1]["dec"] == pytest.approx(0.1)
    assert got[2]["ra"] == pytest.approx(0.1) and got[3]["ra"] == pytest.approx(0.1 + 0.2 * 149 / 150)
    assert sky.positions_at(points, tracks.limit(0), "k", "at").count() == 0


def test_equal_declinations_hit_nothing(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], [0.0, 0.5, 0.5]), ([0.1, 0.2, 0.3], [0.0, 0.25, 0.5]), (None, None)], "ras array<double>, decs array<double>")
    hit = sky.point_hit(F.lit(0.2), F.lit(0.25), F.col("ras"), F.col("decs"), F.lit(100.0), F.lit(0.05))
    assert [r[0] for r in df.select(hit).collect()] == [False, True, False]


def test_all_edges_of_many_bins(spark):
    edges = spark.range(1).select(spectra.log_edges(F.lit(1_000_000), step=1.1).alias("e")).first()["e"]
    want = [0] + sorted(math.floor(500_000 / 1.1**k) for k in range(200) if 500_000 / 1.1**k >= 10)
    assert edges == want and len(edges) > 100
    assert spark.range(1).select(spectra.log_edges(F.lit(3)).alias("e")).first()["e"] == [0]


def test_sweeps_in_batches_follow_the_columns(spark):
    """Paths are those of the column functions point by point, unknown wafers and nulls included, and no expression walks
    over the points of each row."""
    from scanloom.functions.angles import horizon_to_equatorial

    rows = [("c1", "ws1", 8e8, 10.0, 20.0, 50.0), ("o6", "ws.", 8.1e8, 355.0, 40.0, 35.0), (None, "st3", 9e8, 100.0, 30.0, 60.0), ("x", "ws0", 8e8, 181.0, 10.0, 45.0), ("i1", "ws0", 8e8, None, 10.0, 45.0), ("i1", None, 8e8, 1.0, 10.0, 45.0)]
    df = spark.createDataFrame(rows, "tube string, slot string, ctime double, baz double, waz double, bel double")
    swept = sky.with_sweep(df)
    assert "lambda" not in swept._jdf.queryExecution().optimizedPlan().toString()
    xi, eta, radius = sky.wafer_centre(F.col("tube"), F.col("slot"))
    df = swept.withColumns({"xi": xi, "eta": eta, "r2": radius})
    shift, el = sky.off_centre(F.radians("bel"), F.col("xi"), F.col("eta"))
    df = df.withColumns({"el": el, "mid": F.radians("baz") + shift})
    az1, az2 = sky.one_side(F.col("mid") - F.radians("waz") / 2, F.col("mid") + F.radians("waz") / 2)
    df = df.withColumns({"az1": az1, "az2": az2})
    points = [horizon_to_equatorial(F.col("az1") + (F.col("az2") - F.col("az1")) * (k / 5), F.col("el"), F.col("ctime"), sky.LATITUDE, sky.LONGITUDE) for k in range(6)]
    got = df.select("ras", "decs", "radius", "r2", "baz", F.array(*(p[0] for p in points)).alias("a"), F.array(*(p[1] for p in points)).alias("d")).collect()
    assert [r["radius"] for r in got] == [r["r2"] for r in got] == pytest.approx([math.radians(x) for x in (0.3, 0.3, 6.0, 0.0, 0.3, 0.0)])
    for r in got:
        if r["baz"] is None:
            assert r["ras"] == r["decs"] == [None] * 6
            continue
        assert r["decs"] == pytest.approx(r["d"], abs=1e-9)
        assert np.allclose(np.exp(1j * np.array(r["ras"])), np.exp(1j * np.array(r["a"])), atol=1e-9)
        assert np.ptp(r["ras"]) < math.pi
