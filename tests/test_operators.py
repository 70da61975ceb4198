"""Hand-checked fixtures and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import angles, linalg
from scanloom.operators import balance, blocks, grouping, intervals, joins, mapping, noise, selection, solver
from scanloom.sources import catalog, shared


def cuts(spark, rows):
    return spark.createDataFrame(rows, "det long, lo int, hi int")


def out(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


RANGES = [(0, 5, 8), (0, 1, 3), (0, 7, 10), (1, 0, 2), (0, 3, 4), (1, 6, 6)]


def test_union_touches_and_is_idempotent(spark):
    once = intervals.united(cuts(spark, RANGES))
    assert out(once, "det", "lo", "hi") == [(0, 1, 4), (0, 5, 10), (1, 0, 2)]
    assert out(intervals.united(once), "det", "lo", "hi") == out(once, "det", "lo", "hi")


def test_invert_twice(spark):
    dets = spark.createDataFrame([(0, 12), (1, 12), (2, 12)], "det long, nsamp long")
    once = intervals.united(cuts(spark, RANGES))
    inverse = intervals.inverted(once, dets)
    assert out(inverse, "det", "lo", "hi") == [(0, 0, 1), (0, 4, 5), (0, 10, 12), (1, 2, 12), (2, 0, 12)]
    assert out(intervals.inverted(inverse, dets), "det", "lo", "hi") == out(once, "det", "lo", "hi")


def test_runs_split_resample_borders(spark):
    samples = spark.createDataFrame([(0, k, bool(v)) for k, v in enumerate((1, 1, 0, 1))], "det long, samp long, cut boolean")
    assert out(intervals.runs(samples, "cut"), "lo", "hi") == [(0, 2), (3, 4)]
    parts = intervals.split_ranges(cuts(spark, [(0, 5, 15), (1, 0, 3)]), 4)
    assert out(parts, "det", "lo", "hi") == [(0, 5, 8), (0, 8, 11), (0, 11, 15), (1, 0, 3)]
    assert out(intervals.resampled(cuts(spark, [(0, 3, 7)]), 10, 5), "lo", "hi") == [(1, 4)]
    borders = intervals.with_borders(cuts(spark, [(0, 2, 4), (0, 6, 8)]), 3, nsamp=F.lit(9))
    assert out(borders, "l0", "lo", "hi", "r1") == [(0, 2, 4, 6), (4, 6, 8, 9)]


def test_empty_inputs(spark):
    none = cuts(spark, [])
    dets = spark.createDataFrame([(3, 5)], "det long, nsamp long")
    assert out(intervals.inverted(none, dets), "det", "lo", "hi") == [(3, 0, 5)]
    assert intervals.united(none).count() == intervals.split_ranges(none, 3).count() == 0
    assert out(intervals.cut_sums(none, dets), "ncut", "nrange") == [(0, 0)]


def test_jumps_and_gaps_of_a_step(spark):
    rows = [(0, k, 1.0 if k < 10 else 6.0) for k in range(30)] + [(1, k, 2.0) for k in range(30)]
    samples = spark.createDataFrame(rows, "det long, samp long, value double")
    n = spark.createDataFrame([(0, 30), (1, 30)], "det long, nsamp long")
    step = cuts(spark, [(0, 9, 11), (1, 0, 3)])
    flat = intervals.dejumped(intervals.cleared(samples, step), step, 5, n)
    assert out(flat.where("det = 0 and (samp < 9 or samp > 10)"), "value") == [(1.0,)] * 28
    filled = intervals.gap_filled(samples, step, 5, n)
    assert out(filled.where("det = 1"), "value") == [(2.0,)] * 30


def test_epochs_fall_back_to_the_last(spark):
    epochs = spark.createDataFrame([(0, 0.0, 100.0), (1, 100.0, 200.0)], "epoch_no int, lo double, hi double")
    points = spark.createDataFrame([(k, t) for k, t in enumerate((50.0, 100.0, 250.0, -5.0))], "k int, t double")
    assert out(joins.epoch_join(points, epochs, "t", "k", 100.0), "k", "epoch_no") == [(0, 0), (1, 1), (2, 1), (3, 1)]


def test_sessions(spark):
    obs = spark.createDataFrame([(k, t, d, 0.0, 1) for k, (t, d) in enumerate(((0.0, 100.0), (110.0, 100.0), (10000.0, 100.0)))], "obs_key int, ctime double, dur double, baz double, bel int")
    periods = grouping.scan_periods(obs, ["bel"], 7200.0, 2.0, ["baz"], ["obs_key"])
    assert out(periods, "t0", "t1") == [(0.0, 210.0), (10000.0, 10100.0)]
    assert out(grouping.period_gaps(periods, ["bel"], 60.0), "g0", "g1") == [(210.0, 10000.0)]
    assert out(grouping.split_periods(periods.where("t0 = 0"), 100.0), "part", "p0") == [(0, 0.0), (1, 70.0), (2, 140.0)]


def test_time_split(spark):
    g = spark.createDataFrame([("a", 10, 10)], "grp string, size long, nsamp long")
    assert out(grouping.time_split(g, "grp", F.col("size"), F.col("nsamp"), 4), "i0", "i1") == [(0, 3), (3, 6), (6, 10)]


def test_expansion_and_hours(spark):
    obs = spark.createDataFrame([("o", "mf", "ws0,ws1,"), ("p", "x", "ws0")], "obs_id string, flavor string, slots string")
    got = [r[0] for r in selection.expand_sub_observations(obs).select("subobs_id").collect()]
    assert len(got) == 14 and "o:ws1:f150" in got and "o:ws0:DARK:DARK" in got and "p:ws0:f???" in got
    hours = spark.createDataFrame([(h * 3600,) for h in (11.0, 23.0, 23.5, 3.0)], "t double")
    assert [r[0] for r in hours.select(selection.day(F.col("t"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize("bounds", [(1, None, 1), (None, None, 2), (-3, None, 1), (2, -1, 3), (None, 4, 1), (-4, -1, 2)])
def test_slices_as_lists(spark, bounds):
    df = spark.range(23).select((F.col("id") * 7 % 23).alias("k"))
    assert sorted(r["k"] for r in catalog.positional_slice(df, ["k"], *bounds).collect()) == list(range(23))[slice(*bounds)]


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b more\n# no\na\n\nb\n c x\n")
    got = catalog.read_id_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"]


def test_keep_last_and_buckets(spark):
    rows = spark.createDataFrame([(v, k) for k, v in enumerate("aba")], "v string, pos int")
    assert out(joins.keep_last(rows, "v", "pos"), "pos", "v") == [(1, "b"), (2, "a")]
    w = spark.createDataFrame([(k, x) for k, x in enumerate((1, 1, 1, 5))], "k int, w long")
    assert out(balance.weight_buckets(w, 2, "w", "k"), "k", "owner") == [(0, 0), (1, 0), (2, 0), (3, 0)]
    w = spark.createDataFrame([(k, x) for k, x in enumerate((1, 1, 1, 5, 4))], "k int, w long")
    assert [o for _, o in out(balance.weight_buckets(w, 2, "w", "k"), "k", "owner")] == [0, 0, 0, 0, 1]


def test_split_is_balanced():
    rnd = np.random.default_rng(0)
    chunks = [{(int(p),): float(h) for p, h in zip(rnd.integers(0, 20, 8), rnd.integers(1, 9, 8))} for _ in range(40)]
    owner = balance.smart_split(chunks, 2)
    hits = [sum(sum(c.values()) for c, o in zip(chunks, owner) if o == s) for s in (0, 1)]
    assert abs(hits[0] - hits[1]) < 0.1 * sum(hits) and balance.smart_split(chunks, 2) == owner


def test_difference_noise_factor(spark):
    assert [math.comb(2 * n, n) for n in range(6)] == [1, 2, 6, 20, 70, 252]
    rng = np.random.default_rng(1)
    samples = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(rng.normal(0, 3, 6400))], "det long, samp long, value double")
    assert abs(blocks.difference_rms(samples, 64).first()["rms"] - 3) < 0.2


def test_pair_rotation_twice(spark):
    rows = [(d, s, float(d * 10 + s)) for d in range(4) for s in range(3)]
    once = blocks.pair_rotated(spark.createDataFrame(rows, "det long, samp long, value double"))
    again = once.select(F.explode(F.array(F.struct((F.col("pair") * 2).alias("det"), "samp", F.col("plus").alias("value")), F.struct((F.col("pair") * 2 + 1).alias("det"), "samp", F.col("minus").alias("value")))).alias("x")).select("x.*")
    twice = blocks.pair_rotated(again)
    got = {(r["pair"] * 2, r["samp"]): r["plus"] for r in twice.collect()}
    assert all(abs(got[d, s] - v) < 1e-9 for d, s, v in rows if d % 2 == 0)


def test_matrix_inverse(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3, 9))
    m = a @ a.T
    names = dict(zip(linalg.SYM3, (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2])))
    df = spark.createDataFrame([tuple(float(v) for v in names.values())], list(linalg.SYM3))
    for inverse in (linalg.inv3({k: F.col(k) for k in linalg.SYM3}), linalg.safe_inv3({k: F.col(k) for k in linalg.SYM3})):
        got = df.select(*(v.alias(k) for k, v in inverse.items())).first()
        assert np.allclose([got[k] for k in linalg.SYM3], np.linalg.inv(m)[np.triu_indices(3)])
    flat = spark.createDataFrame([(2.0, 0.0, 0.0, 0.0, 0.0, 0.0)], list(linalg.SYM3))
    got = flat.select(*(v.alias(k) for k, v in linalg.safe_inv3({k: F.col(k) for k in linalg.SYM3}).items())).first()
    assert tuple(got) == (0.5, 0, 0, 0, 0, 0)


def test_angles(spark):
    row = spark.range(1).select(
        angles.rewind(F.lit(350.0), 360.0).alias("a"),
        angles.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1e-9)).alias("d"),
        angles.fix_overpole(F.lit(10.0), F.lit(100.0))[1].alias("el"),
        angles.horizon_to_equatorial(F.lit(0.0), F.lit(math.pi / 2), F.lit(1e9), 0.3, 0.0)[1].alias("dec"),
    ).first()
    assert row["a"] == -10 and abs(row["d"] - 1e-9) < 1e-20 and row["el"] == 80 and abs(row["dec"] - 0.3) < 1e-9


def test_low_rank_inverse_is_the_dense_one():
    rng = np.random.default_rng(3)
    mode = 1 + 0.2 * rng.normal(size=(24, 1))
    ft = rng.normal(size=(24, 60)) + 1j * rng.normal(size=(24, 60)) + 30 * mode * (rng.normal(size=(1, 60)) + 1j * rng.normal(size=(1, 60)))
    model = noise.low_rank_model(ft, np.array([(0, 60)]))
    m = model[0]
    assert m["v"].shape[1] == 1
    dense = np.diag(1 / m["inverse_d"]) + m["v"] @ np.diag(m["e"]) @ m["v"].T
    assert np.allclose(noise.apply_inverse(ft, model), np.linalg.solve(dense, ft))


def test_filters_and_bins():
    t = np.arange(256)
    slow, fast = np.sin(2 * np.pi * 4 * t / 256), np.sin(2 * np.pi * 100 * t / 256)
    assert np.allclose(noise.lowpass((slow + fast)[None], 0.1)[0], slow, atol=1e-2)
    assert np.allclose(noise.lowpass((slow + fast)[None], 0.1, -8)[0], fast, atol=1e-2)
    assert np.allclose(noise.resample(noise.resample(slow[None], 64), 256), slow, atol=1e-9)
    assert noise.freq_bins([0.1, 0.25], 1.0, 100, 4).tolist() == [[0, 20], [20, 50], [50, 100]]


def test_projection_is_adjoint(spark):
    """<P x, y> = <x, P' y> for the bilinear projection."""
    rng = np.random.default_rng(4)
    rows = [(k, float(rng.uniform(0, 5)), float(rng.uniform(0, 7.99)), float(rng.normal())) for k in range(200)]
    samples = spark.createDataFrame(rows, "k long, y double, x double, value double")
    corners = mapping.bilinear(samples, F.col("y"), F.col("x"), 8)
    sky = spark.createDataFrame([(a, b, float(rng.normal())) for a in range(7) for b in range(8)], "py int, px int, s double")
    at = corners.join(sky, ["py", "px"])
    left = at.groupBy("k").agg(F.sum(F.col("w") * F.col("s")).alias("model"), F.first("value").alias("v")).agg(F.sum(F.col("model") * F.col("v"))).first()[0]
    right = corners.groupBy("py", "px").agg(F.sum(F.col("w") * F.col("value")).alias("r")).join(sky, ["py", "px"]).agg(F.sum(F.col("r") * F.col("s"))).first()[0]
    assert abs(left - right) < 1e-9 and abs(corners.agg(F.sum("w")).first()[0] - 200) < 1e-9


def test_solver_is_the_dense_solution(spark):
    rng = np.random.default_rng(5)
    n_pix, n_off, n = 6, 4, 80
    pix, off = rng.integers(0, n_pix, n), rng.integers(0, n_off, n)
    ivar, value = rng.uniform(0.5, 2, n), rng.normal(size=n)
    p = np.zeros((n, n_pix + n_off))
    p[np.arange(n), pix] = 1
    p[np.arange(n), n_pix + off] = 1
    a = p.T @ (p * ivar[:, None])
    q = np.diag(np.concatenate((np.zeros(n_pix), 0.5 * np.diag(a)[n_pix:])))
    want = np.linalg.solve(a + q, p.T @ (ivar * value))
    rows = [(int(x), int(o), float(w), float(v)) for x, o, w, v in zip(pix, off, ivar, value)]
    df = spark.createDataFrame(rows, "pix long, off long, ivar double, value double")
    got = solver.solve(df, shared.new_path(spark, "test"), prior=0.5, steps=30, error=1e-14)
    vec = {(r["signal"], r["idx"]): r["value"] for r in got.vector.collect()}
    assert all(abs(vec[0, k] - want[k]) < 1e-5 for k in range(n_pix))
    assert all(abs(vec[1, k] - want[n_pix + k]) < 1e-5 for k in range(n_off))
    assert got.errors[-1] < 1e-10


def test_merged_sources_move_file_ids(spark):
    def source(keys, names):
        return (
            spark.createDataFrame([(k, k % len(names)) for k in keys], "key long, file_id long"),
            spark.createDataFrame(list(enumerate(names)), "file_id long, name string"),
        )

    index, files = catalog.merge_sources([source(range(3), "ab"), source(range(10, 12), "c"), source(range(20, 22), "de")])
    got = out(index.join(files, "file_id"), "key", "name")
    assert got == [(0, "a"), (1, "b"), (2, "a"), (10, "c"), (11, "c"), (20, "d"), (21, "e")]
