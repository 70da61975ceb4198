"""Signals as unknowns: adjoints, dense solutions, priors and passes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import signals as sg

N_DET, N_SAMP, NX = 4, 40, 6
SCHEMA = "det long, samp long, pix long, psi double, y double, x double, el double, cut boolean, ivar double, value double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(N_DET):
        for k in range(N_SAMP):
            cut = (d == 1 and 5 <= k < 16) or (d == 2 and k == 30)
            rows.append((d, k, int(rng.integers(0, 5)), float(rng.uniform(0, math.pi)), float(rng.uniform(0, 3)), float(rng.uniform(0, NX)), 50 + math.sin(k / 7), cut, float((0.5, 1.0, 2.0, 1.5)[d]), float(rng.normal())))
    df = spark.createDataFrame(rows, SCHEMA)
    cuts = spark.createDataFrame([(1, 5, 16), (2, 30, 31)], "det long, lo int, hi int")
    df = sg.with_elevation_basis(sg.with_cut_blocks(df, cuts, 6), ["det"], F.col("el"), 2)
    return df.cache()


det, samp = (lambda: F.col("det")), (lambda: F.col("samp"))  # columns need a session


def every(prior=None):
    blocks = det() * 100 + F.floor(samp() / 10)
    return [
        sg.polarised_sky(F.col("pix"), F.col("psi")).only(~F.col("cut")),
        sg.constant("offset", blocks, prior or sg.relative_prior(0.5)),
        sg.cut_polynomial(det() * 1000 + F.col("lo"), 3, sg.relative_prior(0.2)),
        sg.elevation(det(), 2, sg.relative_prior(1.0)),
    ]


def dense(df, signals):
    """P as a matrix, its columns' names, and the samples, from the prepared rows."""
    rows = sg.prepared(df, signals).orderBy("det", "samp").collect()
    taps = sg._taps(signals)
    names = sorted({(n, r[f"__k{i}"], j) for r in rows for i, (n, s, _) in enumerate(taps) if r[f"__k{i}"] is not None for j in range(s.width)})
    at = {k: c for c, k in enumerate(names)}
    p = np.zeros((len(rows), len(names)))
    for a, r in enumerate(rows):
        for i, (n, s, _) in enumerate(taps):
            if r[f"__k{i}"] is not None:
                for j in range(s.width):
                    p[a, at[n, r[f"__k{i}"], j]] += r[f"__b{i}"][j]
    return p, names, np.array([r["w"] for r in rows]), np.array([r["v"] for r in rows]), rows


def vector(x):
    return {(r["signal"], r["key"], j): v for r in x.collect() for j, v in enumerate(r["value"])}


def named(spark, names, values):
    by = {}
    for (n, k, _), v in zip(names, values):
        by.setdefault((n, k), []).append(float(v))
    return spark.createDataFrame([(n, k, v) for (n, k), v in by.items()], "signal int, key long, value array<double>")


SETS = {
    "sky": lambda: [sg.polarised_sky(F.col("pix"), F.col("psi"))],
    "bilinear": lambda: [sg.bilinear_sky(F.col("y"), F.col("x"), NX)],
    "offset": lambda: [sg.constant("offset", det() * 100 + F.floor(samp() / 10))],
    "cut": lambda: [sg.cut_polynomial(det() * 1000 + F.col("lo"), 3)],
    "elevation": lambda: [sg.elevation(det(), 2)],
    "samples": lambda: [sg.constant("own", det() * 1000 + samp()).only(F.col("cut"))],
    "all": every,
}


@pytest.mark.parametrize("name", SETS)
def test_projections_are_adjoint(spark, table, name):
    signals = SETS[name]()
    p, names, _, v, _ = dense(table, signals)
    x = np.random.default_rng(3).normal(size=len(names))
    data = sg.prepared(table, signals)
    model = sg.projected(data, signals, named(spark, names, x)).orderBy("det", "samp").collect()
    assert len(model) == N_DET * N_SAMP and np.allclose([r["model"] for r in model], p @ x)
    back = vector(sg.gathered(data, signals, "v"))
    assert back.keys() == set(names) and np.allclose([back[k] for k in names], p.T @ v)
    assert abs(sum(back[k] * c for k, c in zip(names, x)) - v @ (p @ x)) < 1e-9


def solved(p, w, v, q, n_inv=None):
    n_inv = np.diag(w) if n_inv is None else n_inv
    return np.linalg.lstsq(p.T @ n_inv @ p + np.diag(q), p.T @ (n_inv @ v), rcond=None)[0]


def penalties(p, names, w):
    d = (p * p * w[:, None]).sum(0)
    return d * np.array([{1: 0.5, 2: 0.2, 3: 1.0}.get(n, 0.0) for n, _, _ in names])


def test_white_noise_gives_the_dense_solution(table):
    signals = every()
    p, names, w, v, _ = dense(table, signals)
    want = solved(p, w, v, penalties(p, names, w))
    got = sg.solve(table, signals, error=1e-14)
    have = vector(got.vector)
    assert got.errors[-1] <= 1e-14 and np.allclose([have[k] for k in names], want, atol=1e-4)
    assert np.allclose(have[2, 2030, 1], 0) and (2, 2030, 0) in have  # a block of one sample has a constant only
    again = sg.solve(table, signals, error=1e-12, start=got.vector)  # takes no step
    assert len(again.errors) == 1 and again.errors[0] <= 1e-12


def test_common_mode_noise_gives_the_dense_solution(table):
    signals = [sg.constant("sky", F.col("pix")), sg.constant("offset", det(), sg.relative_prior(0.5))]
    p, names, w, v, rows = dense(table, signals)
    mode = np.array([1 + 0.1 * r["det"] for r in rows])
    same = np.array([[a["samp"] == b["samp"] for b in rows] for a in rows])
    n_inv = np.linalg.inv(np.diag(1 / w) + 3.0 * np.outer(mode, mode) * same)
    d = (p * p * w[:, None]).sum(0)
    want = solved(p, w, v, d * np.array([0.5 * (n == 1) for n, _, _ in names]), n_inv)
    noise = sg.common_mode_noise(["samp"], 1 + 0.1 * det(), F.lit(3.0))
    got = sg.solve(table, signals, noise, steps=12, error=1e-16)
    have = vector(got.vector)
    assert got.errors[-1] < 1e-10 and np.allclose([have[k] for k in names], want, atol=1e-4)


def test_priors(table):
    far = (F.col("pix") >= 3).cast("double")
    sky = vector(sg.solve(table, [sg.constant("sky", F.col("pix"), sg.disk_prior(1e5), far)], error=1e-20).vector)
    plain = vector(sg.solve(table, [sg.constant("sky", F.col("pix"))], error=1e-20).vector)
    for (n, k, j), v in plain.items():
        assert np.isclose(sky[n, k, j], v / (1 + 1e5 * (k >= 3)))
    near = F.lit(0.5)
    soft = vector(sg.solve(table, [sg.constant("own", F.col("pix"), sg.edge_prior(0.1, 100.0), near)], error=1e-20).vector)
    assert all(np.isclose(soft[k], v / (1 + 0.1 * 10)) for k, v in plain.items())
    loud = [sg.constant("own", F.col("pix"), sg.variance_prior(10.0), F.lit(2.0))]
    p, names, w, v, _ = dense(table, loud)
    own = vector(sg.solve(table, loud, error=1e-20).vector)
    assert np.allclose([own[k] for k in names], solved(p, w, v, np.full(len(names), 5.0)))


def test_odd_rows(spark, table):
    signals = [sg.constant("sky", F.col("pix"))]
    assert sg.solve(table.where("false"), signals).vector.count() == 0
    odd = [(0, 0, 1, None, None, 2.0), (0, 1, 1, None, 1.0, None), (0, 2, 1, None, float("nan"), 3.0), (0, 3, 1, None, 1.0, 5.0), (0, 4, 2, None, -1.0, 7.0), (0, 5, None, None, 1.0, 9.0), (0, 3, 1, None, 1.0, 5.0)]
    df = spark.createDataFrame(odd, "det long, samp long, pix long, psi double, ivar double, value double")
    got = vector(sg.solve(df, signals, error=1e-20).vector)
    assert got == {(0, 1, 0): 5.0, (0, 2, 0): 0.0}  # pixels without weight are 0
    assert sg.evaluated(df, signals, sg.solve(df, signals).vector).where("samp = 5").first()["model"] == 0


def test_second_pass_takes_loud_samples_out(spark):
    """Three wild samples disturb the first pass; in the second they are unknowns of their own, and the sky is right."""
    rng = np.random.default_rng(8)
    wild = {(0, 3), (1, 17), (2, 29)}
    rows = [(d, k, k % 4, float(10 * (k % 4) + rng.normal(0, 0.1) + 500 * ((d, k) in wild))) for d in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "det long, samp long, pix long, value double")
    signals = [sg.constant("sky", F.col("pix")), sg.constant("own", det() * 1000 + samp()).only(F.col("loud"))]

    def weigh(s):
        loud = F.col("loud") | (F.abs("rest") > 200) if "loud" in s.columns else F.lit(False)
        return s.withColumns({"loud": loud, "ivar": F.lit(1.0)})

    done, got = sg.passes(df, signals, 2, weigh, error=1e-20)
    have = vector(got.vector)
    assert all(abs(have[0, k, 0] - 10 * k) < 0.1 for k in range(4))
    assert {k for n, k, _ in have if n == 1} == {3, 1017, 2029}
    assert done.count() == 160 and done.where("abs(value - model) > 1").count() == 0
    with pytest.raises(ValueError):
        sg.passes(df, signals, 0, weigh)


def test_query_is_the_dense_solution(spark, small):
    """The registered map of the whole smallest table."""
    from scanloom.plans import signal_queries

    samples, signals = signal_queries.pointed(spark, small), signal_queries.unknowns()
    p, names, w, v, _ = dense(samples, signals)
    d = (p * p * w[:, None]).sum(0)
    want = dict(zip(names, solved(p, w, v, d * np.array([1.0 * (n > 0) for n, _, _ in names]))))
    got = {(0, r["key"], r["part"]): r["value"] for r in signal_queries.signal_map(spark, small).collect()}
    assert got.keys() == {k for k in names if k[0] == 0} and all(abs(got[k] - want[k]) < 2e-3 for k in got)


def test_steps_shuffle_no_blocks(spark, table, monkeypatch):
    """Where the vector is too large to be broadcast, a step reads the matrix from its buckets and deals none of it anew."""
    monkeypatch.setattr(sg, "FEW", 6)
    seen, plain = [], sg._times

    def times(near, far, x, few, width):
        out = plain(near, far, x, few, width)
        seen.append((few, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(sg, "_times", times)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        signals = every()
        p, names, w, v, _ = dense(table, signals)
        have = vector(sg.solve(table, signals, error=1e-14).vector)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert np.allclose([have[k] for k in names], solved(p, w, v, penalties(p, names, w)), atol=1e-4)
    few, plan = seen[0]
    assert 0 in few and 1 not in few
    assert plan.count("Exchange hashpartitioning") == 1 and "signals_far" in plan and "signals_near" in plan  # of the sums of one half
