"""Queries read whole tables: fixtures whose rows lie where prefixes and modulo filters would not look."""

import collections

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.operators import noise
from scanloom.plans import registry

N = 70


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Detectors 1 to 3, 26 and 51, of 70 samples each: (folder, values as [detector, sample])."""
    d, dets = tmp_path_factory.mktemp("events"), [1, 2, 3, 26, 51]
    value = np.random.default_rng(5).normal(10, 2, (len(dets), N))
    start = pd.Timestamp("2024-01-01")
    rows = [(a * N + k, start + pd.Timedelta(minutes=k), det, "view", value[a, k], "{}") for a, det in enumerate(dets) for k in range(N)]
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    df.to_parquet(f"{d}/events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(d), dict(zip(dets, value))


def mode(value):
    return np.median([np.median([value[1], value[2], value[3]], 0), value[26], value[51]], 0)


def test_common_mode_of_all_samples(spark, events):
    d, value = events
    got = {r["samp"]: r["value"] for r in registry.QUERIES["common_mode"](spark, d).collect()}
    assert sorted(got) == list(range(N))
    assert np.allclose([got[k] for k in range(N)], mode(value), atol=1e-6)


def test_common_mode_gains_of_all_samples(spark, events):
    d, value = events
    m = mode(value)
    got = {r["det"]: r["response"] for r in registry.QUERIES["common_mode_gains"](spark, d).collect()}
    assert got == pytest.approx({det: (v @ m) / (m @ m) for det, v in value.items()}, abs=2e-6)


def test_covariance_of_all_samples(spark, events):
    d, value = events
    got = {(r["d1"], r["d2"]): (r["n"], r["cov"]) for r in registry.QUERIES["measure_cov"](spark, d).collect()}
    want = {(a, b): (N, value[a] @ value[b]) for a in value for b in value if a <= b and a % 25 == b % 25}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert {k: c for k, (_, c) in got.items()} == pytest.approx({k: c for k, (_, c) in want.items()}, abs=0.006)


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Observations whose keys no modulo filter keeps: (folder, rows of azimuth, elevation, samples)."""
    d = tmp_path_factory.mktemp("orders")
    rows = [(1, 300), (3, 355), (7, 20), (9, 120), (11, 44)]
    df = pd.DataFrame([(k, c, "O", 1.0, pd.Timestamp("2024-01-02"), "1-URGENT") for k, c in rows], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    df.to_parquet(f"{d}/orders.parquet", coerce_timestamps="us")
    return str(d), [(c % 360, 30 + c % 6 * 5, 1000 + k % 11 * 100) for k, c in rows]


def test_hits_of_all_observations(spark, orders):
    d, rows = orders
    want = collections.Counter()
    for az, el, n in rows:
        for y in range((el - 30) // 5, (el - 30) // 5 + 2):
            for x in range(az // 10, az // 10 + 5):
                want["lf", y, x % 36] += n
    assert {(r["flavor"], r["y"], r["x"]): r["hits"] for r in registry.QUERIES["hitmap_wrap"](spark, d).collect()} == want


def test_tiles_of_all_observations(spark, orders):
    d, rows = orders
    want = {("lf", y // 16, x // 16 % 22) for az, el, _ in rows for y in range(max(0, el - 35), min(24, el - 29)) for x in range(az, az + 20)}
    assert {(r["flavor"], r["ty"], r["tx"]) for r in registry.QUERIES["box_tiles"](spark, d).collect()} == want


def test_bounds_of_all_observations(spark, orders):
    d, rows = orders
    y = [(el - 30) // 5 for az, el, _ in rows if az >= 290 or az < 45]
    (got,) = registry.QUERIES["pixel_bounds"](spark, d).collect()
    assert (got["y0"], got["y1"], got["x0"], got["width"]) == (min(y), max(y) + 1, 60, 72 - 60 + 9)


def test_covariance_of_tiles_and_chunks(spark):
    """Repeated, missing, null and infinite samples, against all products one by one; nothing is summed by a shuffle."""
    r = np.random.default_rng(4)
    rows = [(g, d, int(k), float(r.normal())) for g in (0, 1) for d in range(7) for k in r.choice(40, 25, replace=False)]
    rows += rows[:9] + [(0, 8, k, None) for k in range(5)] + [(1, 9, 3, float("inf")), (1, 9, 4, 2.0), (1, 10, 3, float("nan"))]
    rows += [(0, None, 1, 1.0)]
    got = noise.covariance(spark.createDataFrame(rows, "grp int, det long, samp long, value double"), "det", "samp", "value", ["grp"], tile=3, chunk=7)
    want = collections.defaultdict(list)
    for g, d, k, v in rows:
        for g2, d2, k2, v2 in rows:
            if d is not None and d2 is not None and g == g2 and k == k2 and d <= d2:
                want[g, d, d2].append(None if v is None or v2 is None else v * v2)
    found = {(x["grp"], x["d1"], x["d2"]): (x["n"], x["cov"]) for x in got.collect()}
    assert {k: n for k, (n, _) in found.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        v = [x for x in v if x is not None]
        assert found[k][1] == (pytest.approx(sum(v), nan_ok=True) if v else None), k
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Aggregate" not in plan


def test_pairs_of_tiles_use_all_partitions(spark):
    """Little is read for many sums, so the number of tasks must not follow the bytes that they read."""
    rows = spark.range(240).select((F.col("id") % 12).cast("int").alias("grp"), F.col("id").alias("det"), F.lit(0).cast("long").alias("samp"), F.lit(1.0).alias("value"))
    got = noise.covariance(rows, "det", "samp", "value", ["grp"])
    assert got.count() == 12 * 20 * 21 // 2
    assert got.select(F.spark_partition_id()).distinct().count() > 1
