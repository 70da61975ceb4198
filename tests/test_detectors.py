"""Detector metadata, sky predicates and spectra on small tables with odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import detectors, sky, spectra


def test_shared_samples_as_by_hand(spark):
    rows = [(1, 0, 0.0, 99.0, 100, 2, 90), (1, 1, 0.0, 99.0, 100, 5, 95), (2, 0, 0.0, 9.0, 10, 0, 3), (2, 1, 0.0, 9.0, 10, 5, 3), (3, 0, 0.0, 9.0, 10, 0, 9), (3, 1, 0.5, 9.5, 10, 0, 9)]
    parts = spark.createDataFrame(rows, "obs int, part int, start double, stop double, n_raw int, offset int, count int")
    got = {(r["obs"], r["part"]): (r["i1"], r["i2"], r["fits"]) for r in detectors.shared_samples(parts, "obs").collect()}
    assert got[1, 0] == got[1, 1] == (5, 92, True)
    assert not got[2, 0][2] and not got[3, 0][2]  # no common time; phases half a sample apart


def test_stored_cuts_skip_detectors_without(spark):
    ends = spark.createDataFrame([("f", 0, "a", 0), ("f", 1, "b", 4), ("f", 2, "c", 4), ("f", 3, "d", 6)], "file string, pos int, det string, end int")
    ranges = spark.createDataFrame([("f", 0, 1, 2), ("f", 1, 5, 9), ("f", 2, 3, 4)], "file string, k long, lo int, hi int")
    assert sorted(map(tuple, detectors.stored_cuts(ends, ranges, "file").collect())) == [("f", "b", 1, 2), ("f", "b", 5, 9), ("f", "d", 3, 4)]


def test_focal_plane_without_finite_places(spark):
    rows = [("a", 0.0, 0.0, 0.0), ("a", 0.2, 0.0, 0.0), ("a", math.nan, 0.0, 0.0), ("a", None, 0.0, 0.0), ("b", math.inf, 0.0, 0.0)]
    got = detectors.focal_plane_extent(spark.createDataFrame(rows, "g string, xi double, eta double, gamma double"), "g").collect()
    assert [r["g"] for r in got] == ["a"] and got[0]["radius"] == pytest.approx(0.1)


def test_curve_goes_through_its_points(spark):
    rng = np.random.default_rng(3)
    xs = np.cumsum(rng.uniform(0.1, 0.5, 6)).tolist()
    poly = rng.normal(size=6)
    rows = [(float(x), xs, np.polyval(poly, xs).tolist()) for x in rng.uniform(xs[0], xs[-1], 20)]
    df = spark.createDataFrame([*rows, (0.0, [1.0, 1.0], [2.0, 3.0])], "x double, xs array<double>, ys array<double>")
    got = [r[0] for r in df.select(sky.on_curve(F.col("x"), F.col("xs"), F.col("ys"))).collect()]
    assert got[-1] is None and np.allclose(got[:-1], [np.polyval(poly, r[0]) for r in rows])


def test_spikes_and_floors(spark):
    power = [100.0, 80.0, 40.0, 20.0, 9.0, 2.0, 1.0, 1.0, 50.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("g", k, p) for k, p in enumerate(power)] + [("flat", 0, 1.0)], "grp string, bin long, power double")
    assert sorted(map(tuple, spectra.spikes(df.where("bin > 3").withColumn("bin", F.col("bin") - 4), "grp", tol=10, pad=1).collect())) == [("g", 3, 6)]
    got = {r["grp"]: (r["start"], r["level"]) for r in spectra.floors(df, "grp").collect()}
    assert got == {"g": (7, pytest.approx(np.mean(power[7:])))}
