"""Compact distribution, extreme values, leakage and masks against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import balance, intervals, leakage, masks


def brute(state, weight, n, passes=2, rounds=10):
    far = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
    refs = [int(np.argmin(state.sum(1)))]
    while len(refs) < n:
        refs.append(int(np.argmax(np.min([far(state, state[r]) for r in refs], 0))))
    refs = sorted((state[r] for r in refs), key=lambda r: r.mean())
    for p in range(passes):
        scales, even = np.ones(n), weight.sum() / n
        for k in range(rounds):
            owner = np.argmin([far(state, r) * s for r, s in zip(refs, scales)], 0)
            scales *= np.maximum(np.bincount(owner, weight, minlength=n) / even, 1e-3) ** (1 / (k + 1))
        if p < passes - 1:
            ids = [np.flatnonzero(owner == g) for g in range(n) if (owner == g).any()]
            refs = [state[i[np.argmin(far(state[i], state[i].mean(0)))]] for i in ids]
    return owner


@pytest.fixture(scope="module")
def items(spark):
    r = np.random.default_rng(17)
    state = np.concatenate([r.normal(c, 0.4, (n, 4)) for c, n in ((0, 60), (3, 25), (7, 15))])
    weight = r.uniform(1, 4, len(state))
    df = spark.createDataFrame([(k, float(w), [float(x) for x in s]) for k, (s, w) in enumerate(zip(state, weight))], "id long, w double, state array<double>")
    return df.cache(), state, weight


@pytest.mark.parametrize("n, passes", [(1, 1), (5, 1), (5, 2)])
def test_compact_groups(items, n, passes):
    df, state, weight = items
    got = {r["id"]: r["owner"] for r in balance.distribute_compact(df, n, "id", "w", passes).collect()}
    owner = np.array([got[k] for k in range(len(state))])
    assert (owner == brute(state, weight, n, passes)).all()
    if n > 1:  # about even, and nearer together than items dealt out in turn
        spread = lambda o: np.mean([state[o == g].std(0).mean() for g in range(n)])
        assert np.bincount(owner, weight, minlength=n).max() < 1.7 * weight.sum() / n
        assert spread(owner) < 0.7 * spread(np.arange(len(state)) % n)
        told = {(r["owner"], r["p"]): r["spread"] for r in balance.compactness(balance.distribute_compact(df, n, "id", "w", passes)).collect()}
        assert told[0, 1] == pytest.approx(state[owner == 0].std(0)[1])


def test_few_items(items):
    df, _, _ = items
    assert sorted(r["owner"] for r in balance.distribute_compact(df.where("id < 4"), 9, "id", "w").collect()) == [0, 1, 2, 3]


def test_extremes(spark):
    r = np.random.default_rng(2)
    rows = [(d, k, float(r.normal() + (300 if d == 1 and k == 41 else 0))) for d in range(3) for k in range(120)]
    s = spark.createDataFrame(rows, "det long, samp long, value double")
    cuts = spark.createDataFrame([(1, 40, 44), (2, 10, 12)], "det long, lo int, hi int")
    nsamp = spark.createDataFrame([(d, 120) for d in range(3)], "det long, nsamp int")
    out = {(x["det"], x["samp"]): x["value"] for x in intervals.extremes_clipped(s, cuts, 5, nsamp, tol=6, det_step=2, step=3).collect()}
    filled = {(x["det"], x["samp"]): x["value"] for x in intervals.gap_filled(s, cuts, 5, nsamp).collect()}
    diffs = [filled[d, k + 3] - filled[d, k] for d in (0, 2) for k in range(0, 117, 3)]
    most = 6 * np.median(np.square(diffs)) ** 0.5
    assert len(out) == len(rows)
    for d, k, v in rows:
        inside = (d, k) in {(1, 40), (1, 41), (1, 42), (1, 43), (2, 10), (2, 11)}
        assert out[d, k] == pytest.approx(filled[d, k] + np.clip(v - filled[d, k], -most, most) if inside else v)
    assert abs(out[1, 41] - filled[1, 41]) == pytest.approx(most)


def test_leakage_lines(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for d, a in ((1, 0.02), (2, -0.4), (3, 1.7)):
        x = r.normal(size=1500).cumsum() * 0.1
        y = a * x + 0.3 + r.normal(size=1500) * 0.01
        rows += [(d, k, float(p), float(q)) for k, (p, q) in enumerate(zip(x, y))]
        fits = []
        for b in range(1500 // 10 // 20):
            u, v = (z[: 1500].reshape(-1, 10).mean(1)[b * 20 : (b + 1) * 20] for z in (x, y))
            axis = np.linalg.svd(np.stack((u - u.mean(), v - v.mean()), 1))[2][0]
            fits.append((axis[1] / axis[0], v.mean() - axis[1] / axis[0] * u.mean()))
        want[d] = np.median(fits, 0)
    df = spark.createDataFrame(rows, "det long, samp long, x double, y double")
    got = {r["det"]: r for r in leakage.leakage(df, down=10, block=200).collect()}
    for d, (a, b) in want.items():
        assert got[d]["slope"] == pytest.approx(a, rel=1e-6) and got[d]["offset"] == pytest.approx(b, rel=1e-5) and got[d]["blocks"] == 7
    assert got[3]["slope"] == pytest.approx(1.7, abs=0.02)


def test_sampled_leakage(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=2000)
    y = 0.25 * x + r.normal(size=2000) * 0.5
    rows = [(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 0.0, 1.0)] * 5 + [(3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "det long, x double, y double")
    got = {r["det"]: r for r in leakage.sampled_leakage(df.repartition(4)).collect()}
    best, sd = (x @ y) / (x @ x), (((y - (x @ y) / (x @ x) * x) ** 2).sum() / 2000 / (x @ x)) ** 0.5
    assert abs(got[1]["slope"] - best) < 4 * sd / 400**0.5 and got[1]["slope_sd"] == pytest.approx(sd, rel=0.15)
    assert got[1]["noise"] == pytest.approx(0.25, rel=0.1)
    assert got[2]["slope"] is None or np.isnan(got[2]["slope"])
    again = {r["det"]: r for r in leakage.sampled_leakage(df.repartition(1)).collect()}
    assert again[1]["slope"] == pytest.approx(got[1]["slope"], rel=1e-9)


def test_mask_pyramid_is_the_join(spark):
    r = np.random.default_rng(6)
    mask = spark.createDataFrame([(int(y), int(x)) for y, x in zip(r.integers(-40, 60, 900), r.integers(0, 900, 900))], "y long, x long")
    rows = [(int(k), int(k % 25 * 9 - 60 + r.integers(0, 12)), int((k % 25) * 40 + r.integers(0, 60))) for k in r.integers(0, 300, 6000)]
    s = spark.createDataFrame([*rows, (1, None, 3), (999, None, None)], "obs long, y long, x long")
    held = {(m["y"], m["x"]) for m in mask.collect()}
    want = sorted(t for t in rows if t[1:] in held)
    assert want and sorted(tuple(t) for t in masks.masked_samples(s, mask, "obs", 4, 2).collect()) == want
    assert sorted(tuple(t) for t in masks.masked_samples(s, mask, "obs", 8, 1).collect()) == want
    box = s.groupBy("obs").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).where("y0 is not null")
    near = {n["obs"] for n in masks.boxes_near(box, mask, "obs", 16, F.lit(0)).collect()}
    assert {w[0] for w in want} <= near and len(near) < 0.9 * box.count()  # some are pruned as a whole
    top = {(p["level"], p["y"], p["x"]) for p in masks.pyramid(mask, 2, 8).collect()}
    assert {(2, y // 64, x // 64) for y, x in held} == {t for t in top if t[0] == 2}
    assert masks.masked_samples(s, mask.limit(0), "obs").count() == 0
